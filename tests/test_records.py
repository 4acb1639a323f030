"""Label records: what a label may and may not say, one change to a sound label at a time."""

import hashlib

import numpy as np
import pytest

from selenite.operators import records
from selenite.sources import odl

SOUND = """PDS_VERSION_ID = PDS3
RECORD_TYPE = FIXED_LENGTH
RECORD_BYTES = 512
LABEL_RECORDS = 2
FILE_RECORDS = 18
^IMAGE = 3
PRODUCT_ID = "X1"
TARGET_NAME = MOON
OBJECT = IMAGE
 LINES = 64
 LINE_SAMPLES = 64
 SAMPLE_TYPE = LSB_INTEGER
 SAMPLE_BITS = 16
 NULL = -32768
END_OBJECT = IMAGE
END
"""


def read3(spark, labels, name="a.img", size=18 * 512):
    """Records of labels (text, or (text, file name)) by their place in the list."""
    texts = [x if isinstance(x, tuple) else (x, name) for x in labels]
    t = spark.createDataFrame([(i, x.encode(), n, size) for i, (x, n) in enumerate(texts)], "id int, content binary, file_name string, file_size bigint")
    return {r.id: r for r in records.pds3_records(odl.parsed(t.select("id", "content")), t.select("id", "file_name", "file_size")).collect()}


PDS3 = [
    ("RECORD_TYPE = FIXED_LENGTH", "RECORD_TYPE = STREAM", "record type"), ("RECORD_BYTES = 512\n", "", "record type"), ("RECORD_BYTES = 512", "RECORD_BYTES = 512 <m>", "record bytes"), ("FILE_RECORDS = 18", "FILE_RECORDS = 17", "file records"),
    ("^IMAGE = 3", "^IMAGE = 2", "pointer within label"), ("LABEL_RECORDS = 2\n", "", None), ("^IMAGE = 3", "^IMAGE = 1025 <BYTES>", None), ("^IMAGE = 3", "^IMAGE = 1024 <BYTES>", "pointer within label"), ("^IMAGE = 3", '^IMAGE = "b.img"', "pointer"),
    ("^IMAGE = 3", '^IMAGE = ("b.img", 3)', "pointer"), ("^IMAGE = 3", "^IMAGE = 3 <m>", "pointer"), ("OBJECT = IMAGE", "GROUP = IMAGE", "not one image"), ("LINES = 64\n", "LINES = 64\n LINES = 64\n", "ambiguous"), ("LINES = 64\n", "LINES = 9223372036854775807\n", "size"),
    ("LINES = 64\n", "LINES = 2\n BANDS = 2\n", "band order"), ("LINES = 64\n", "LINES = 64\n ENCODING_TYPE = HUFFMAN\n", "encoding"), ("SAMPLE_BITS = 16", "SAMPLE_BITS = 12", "sample type"), ("NULL = -32768", "NULL = -40000", "special value"), ("NULL = -32768", 'NULL = "x"', "number"),
    ("NULL = -32768", "NULL = NULL", None), ("SAMPLE_TYPE = LSB_INTEGER\n SAMPLE_BITS = 16\n NULL = -32768", "SAMPLE_TYPE = IEEE_REAL\n SAMPLE_BITS = 32\n LINES = 32\n NULL = 16#FF7FFFFB#", "bit pattern"), ("TARGET_NAME = MOON", "TARGET_NAME = MARS", "target"),
    ("LINES = 64", "LINES = 65", "short file"), ("VERSION_ID = PDS3", "VERSION_ID = PDS4", "version"), ("\nEND\n", "\n", "unreadable"), ("LABEL_RECORDS = 2", "LABEL_RECORDS = 0", "label records"), ("NULL = -32768", "NULL = 16#-8000#", None), ("NULL = -32768", "VALID_MINIMUM = 5 <m>", "number"),
]


def test_attached_labels(spark):
    assert all(SOUND.count(a) == 1 or a == "OBJECT = IMAGE" for a, *_ in PDS3)
    change = lambda a, b: SOUND.replace("END_OBJECT", "END_GROUP").replace(a, b, 1) if b == "GROUP = IMAGE" else SOUND.replace(a, b, 1)
    twice = SOUND[: -len("END\n")] + SOUND[SOUND.index("OBJECT = IMAGE") :]
    deep = SOUND.replace("OBJECT = IMAGE\n", "OBJECT = FILE\nOBJECT = IMAGE\n", 1).replace("END_OBJECT = IMAGE\n", "END_OBJECT = IMAGE\nEND_OBJECT = FILE\n")
    within = SOUND.replace("LABEL_RECORDS = 2\n", "").replace("^IMAGE = 3", "^IMAGE = 100 <BYTES>")
    got = read3(spark, [SOUND, twice, deep, within, (SOUND, "../a.img"), (SOUND, ".."), *[change(a, b) for a, b, _ in PDS3]])
    r = got[0]
    assert (r.width, r.height, r.bands, r.dtype, r.offset, r.stride, r.end_byte, r.specials, r.product_id, r.violations) == (64, 64, 1, "<i2", 1024, 128, 9216, [-32768.0], "X1", [])
    assert "not one image" in got[1].violations and "not one image" in got[2].violations and got[3].violations == ["pointer within label"]
    assert got[4].violations == ["file name"] == got[5].violations
    for i, (a, b, what) in enumerate(PDS3):
        v = got[6 + i].violations
        assert (v == []) if what is None else (what in v), (a, b, what, v)


LROC = SOUND.replace('PRODUCT_ID = "X1"', "PRODUCT_ID = M174353756RC\nDATA_SET_ID = \"LRO-L-LROC-3-CDR-V1.1\"\nPRODUCT_TYPE = CDR\nFRAME_ID = RIGHT\nSTART_TIME = 2011-01-01T00:00:00\nSTOP_TIME = 2011-01-01T00:01:00").replace(" NULL", ' MD5_CHECKSUM = "0123456789ABCDEF0123456789abcdef"\n NULL')


def test_labels_of_one_instrument(spark):
    name = "M174353756RC.IMG"
    cases = [
        (LROC, name, None), (LROC, "m174353756rc.img", None), (LROC, "other.IMG", "identity"), (LROC.replace("FRAME_ID = RIGHT", "FRAME_ID = LEFT"), name, "identity"), (LROC.replace("-CDR-", "-EDR-"), name, "identity"), (LROC.replace("PRODUCT_TYPE = CDR\n", ""), name, "identity"),
        (LROC.replace("00:01:00", "00:01:00Z"), name, "time"), (LROC.replace("00:01:00", "00:01:00Z").replace("T00:00:00", "T00:00:00Z"), name, None), (LROC.replace("2011-01-01T00:01", "2010-01-01T00:01"), name, "time"), (LROC.replace("STOP_TIME = 2011-01-01T00:01:00\n", ""), name, "time"),
        (LROC.replace("cdef\"", "cdeg\""), name, "checksum"), (LROC.replace(" NULL", " PRODUCT_ID = M1RC\n NULL"), name, "product of the image"), (LROC.replace(" NULL", " PRODUCT_ID = M174353756RC\n NULL"), name, None), (LROC.replace("TARGET_NAME = MOON\n", ""), name, "identity"),
        (LROC.replace("LRO-L-LROC-3-CDR-V1.1", "LRO-L-LROC-5-CDR-V1.1"), name, "identity"),
    ]
    got = read3(spark, [(t, n) for t, n, _ in cases])
    for i, (_, n, what) in enumerate(cases):
        assert (got[i].violations == []) if what is None else (what in got[i].violations), (i, n, what, got[i].violations)
    assert (got[0].md5, got[0].md5_scope) == ("0123456789abcdef" * 2, "image_object")
    other = read3(spark, [SOUND.replace(" NULL", ' MD5_CHECKSUM = "zz"\n NULL'), SOUND])
    assert (other[0].md5, other[0].md5_scope, other[0].violations, other[1].md5_scope) == (None, "unknown", [], None)


XML = """<Product_Observational xmlns="http://pds.nasa.gov/pds4/pds/v1">
<Identification_Area><logical_identifier>urn:x:y</logical_identifier></Identification_Area>
<Observation_Area><Target_Identification><name>Moon</name></Target_Identification></Observation_Area>
<File_Area_Observational><File><file_name>a.img</file_name><file_size unit="byte">32</file_size></File>
<Array_2D_Image><offset unit="byte">0</offset><axes>2</axes><axis_index_order>Last Index Fastest</axis_index_order>
<Element_Array><data_type>UnsignedLSB2</data_type><scaling_factor>.5</scaling_factor><value_offset>1</value_offset></Element_Array>
<Axis_Array><axis_name>Line</axis_name><elements>4</elements><sequence_number>1</sequence_number></Axis_Array>
<Axis_Array><axis_name>Sample</axis_name><elements>4</elements><sequence_number>2</sequence_number></Axis_Array>
<Special_Constants><missing_constant>65535</missing_constant></Special_Constants></Array_2D_Image></File_Area_Observational></Product_Observational>"""
ENCODED = XML[: XML.index("<Array_2D")] + "<Encoded_Image><encoding_standard_id>PNG</encoding_standard_id><offset unit='byte'>0</offset><object_length unit='byte'>32</object_length></Encoded_Image></File_Area_Observational></Product_Observational>"

PDS4 = [
    ("a.img", "other.img", "file name"), ('"byte">32', '"byte">33', "file size"), ('"byte">32', '"MB">32', "file size"), ("<axes>2", "<axes>3", "axes"), ("Last Index", "First Index", "index order"), ("UnsignedLSB2", "ComplexLSB8", "sample type"), (">65535<", ">65536<", "special value"), (">65535<", ">x<", "number"),
    ("missing_constant>65535</missing_constant", "strange_thing>1</strange_thing", "unknown constant"), ("missing_constant>65535</missing_constant", "error_constant>7</error_constant", None), ("missing_constant>65535</missing_constant", "valid_minimum>y</valid_minimum", "number"), ("<name>Moon", "<name>Mars", "target"),
    ("<name>Moon</name>", "<name>Moon</name><target_name>Mars</target_name>", "ambiguous target"), ("<name>Moon</name>", "<name>Moon</name><target_name>MOON</target_name>", None), ("pds4/pds/v1", "pds4/pds/v2", "namespace"), ("<Product_Obs", "<!DOCTYPE x><Product_Obs", "unreadable"), ("unit=\"byte\">0", "unit=\"m\">0", "offset"),
    (">.5<", ">5d<", "number"), (">.5<", ">inf<", "number"), ("<elements>4</elements><sequence_number>1", "<elements>4</elements><sequence_number>3", "axes"), ("<Identification_Area>", "<Identification_Area><product_id>P</product_id><product_id>Q</product_id>", "ambiguous product"), ("</File>", "<md5_checksum>12</md5_checksum></File>", "checksum"),
    ("<Product_Obs", "<!-- <strange_thing>1</strange_thing> --><Product_Obs", None),
]


def read4(spark, labels):
    """Records of (label, container columns)."""
    t = spark.createDataFrame([(i, x, "a.img", 32, *more) for i, (x, *more) in enumerate(labels)], "id int, content string, file_name string, file_size bigint, container string, container_width bigint, container_height bigint, container_bands bigint, container_dtype string")
    return {r.id: r for r in records.pds4_records(t).collect()}


def test_xml_labels(spark):
    none, png = (None,) * 5, ("PNG", 5, 6, 3, "|u1")
    assert all(XML.count(a) >= 1 for a, *_ in PDS4)
    got = read4(spark, [(XML, *none), (None, *none), ("<x", *none), ("<x/>", *none), *[(XML.replace(a, b, 1), *none) for a, b, _ in PDS4]])
    r = got[0]
    assert (r.width, r.height, r.bands, r.dtype, r.offset, r.end_byte, r.scale, r.value_offset, r.specials, r.target, r.product_id, r.encoded, r.violations) == (4, 4, 1, "<u2", 0, 32, 0.5, 1.0, [65535.0], "moon", "urn:x:y", False, [])
    assert "unreadable" in got[1].violations and got[2].violations and "file area" in got[3].violations
    for i, (a, b, what) in enumerate(PDS4):
        v = got[4 + i].violations
        assert (v == []) if what is None else (what in v), (a, b, what, v)
    assert got[4 + 9].specials == [7.0]
    cases = [(ENCODED, png, None), (ENCODED, none, "encoded image"), (ENCODED, ("JPEG", *png[1:]), "encoded image"), (ENCODED, ("PNG", None, 6, 3, "|u1"), "size"), (ENCODED, ("PNG", 5, 6, 3, None), "sample type"), (ENCODED.replace("'byte'>32", "'byte'>7"), png, "object length"), (ENCODED.replace("'byte'>0", "'byte'>1"), png, "encoded image"), (XML, png, "container")]
    more = read4(spark, [(x, *c) for x, c, _ in cases])
    for i, (_, c, what) in enumerate(cases):
        assert (more[i].violations == []) if what is None else (what in more[i].violations), (i, c, what, more[i].violations)
    assert (more[0].width, more[0].height, more[0].bands, more[0].dtype, more[0].offset, more[0].scale, more[0].encoded, more[0].end_byte) == (5, 6, 3, "|u1", 0, 1.0, True, None)


@pytest.mark.parametrize("scope", ["image_object", "file"])
def test_checksums_by_scope(spark, tmp_path, scope):
    """The digest of what the label says it covers; a changed byte within is a mismatch, one outside isn't."""
    from selenite.sources import checksums

    data = np.random.default_rng(4).integers(0, 256, 5_000_000, np.uint8).tobytes()
    first, last = (1000, 4_000_000) if scope == "image_object" else (0, len(data))
    good = hashlib.md5(data[first:last]).hexdigest()
    files = []
    for i, (at, want) in enumerate(((None, good), (2_000_000, good), (4_999_999, good), (None, good.upper()), (None, None), (None, "0" * 32))):
        b = bytearray(data)
        if at is not None:
            b[at] ^= 1
        (tmp_path / f"{i}.img").write_bytes(b)
        files.append((i, f"file://{tmp_path}/{i}.img", len(b), first, last, want, scope if want else None))
    files.append((9, f"file://{tmp_path}/0.img", len(data), 0, len(data) + 1, good, scope))
    files.append((10, f"file://{tmp_path}/none.img", len(data), first, last, good, scope))
    files.append((11, f"file://{tmp_path}/0.img", len(data), first, last, good, "unknown"))
    t = spark.createDataFrame(files, "id int, path string, file_size bigint, offset bigint, end_byte bigint, md5 string, md5_scope string")
    got = {r.id: r.status for r in checksums.verified(t).collect()}
    outside = "verified" if scope == "image_object" else "mismatch"
    assert got == {0: "verified", 1: "mismatch", 2: outside, 3: "verified", 4: "none", 5: "mismatch", 9: "short file" if scope == "image_object" else "verified", 10: "unreadable", 11: "scope unknown"}


def test_labels_laid_out_in_their_batch(spark):
    """Files with their labels beside them give the records of parsed values joined to files, repeats and broken ones too, without a shuffle."""
    from selenite.operators import records
    from selenite.sources import odl

    head = "PDS_VERSION_ID = PDS3\nRECORD_TYPE = UNDEFINED\n^IMAGE = 101 <BYTES>\n"
    image = "OBJECT = IMAGE\n LINES = 3\n LINE_SAMPLES = 4\n SAMPLE_TYPE = MSB_INTEGER\n SAMPLE_BITS = 16\n%sEND_OBJECT = IMAGE\n"
    texts = [head + image % "" + "END\n", head + image % " NULL = 16#FF#\n" + "END\n", head + "TARGET_NAME = (MOON, MARS)\n" + image % " LINES = 30\n OFFSET = NULL\n" + "END\n", head + image % "" + image % "" + "END\n", head + image % "", "END\n", "", "( = \n",
             head + "GROUP = IMAGE\n LINES = 7\nEND_GROUP\n" + image % "" + "END\n", head + "OBJECT = IMAGE\nEND_OBJECT\nEND\n", None]
    t = spark.createDataFrame([(i, f"F{i}.IMG", 124, None if x is None else x.encode()) for i, x in enumerate(texts)], "id bigint, file_name string, file_size bigint, content binary")
    df = records.pds3_attached(t)
    want = records.pds3_records(odl.parsed(t.select("id", "content")), t.drop("content"))
    assert df.columns == want.columns
    rows = lambda x: sorted((tuple(r) for r in x.collect()), key=lambda r: r[0])
    assert rows(df) == rows(want) and len(rows(df)) == len(texts)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_labels_are_dealt_by_rows(spark):
    """A table whose file is one split is many tasks where a row costs much."""
    from selenite.shared import dealt

    t = dealt(spark.range(500).coalesce(1), "id", 20)
    assert t.rdd.getNumPartitions() == 25 and t.count() == 500
