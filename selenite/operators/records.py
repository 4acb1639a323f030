"""Records of labels as tables: layouts from label values, what is wrong with them, and which label of a scene counts.

Every check is a column expression that adds to a list of violations, so a broken label is a row with
reasons and never an exception in a task.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S

#: Fixed limits: bytes of a label's records, samples of a width that one instrument has.
HEADER, NARROW_WIDTH = 1 << 20, 5064
#: Sample types of the two label standards, by byte order and kind.
PDS3_KINDS = {"LSB_INTEGER": "<i", "MSB_INTEGER": ">i", "INTEGER": ">i", "LSB_UNSIGNED_INTEGER": "<u", "MSB_UNSIGNED_INTEGER": ">u", "UNSIGNED_INTEGER": ">u", "IEEE_REAL": ">f", "PC_REAL": "<f"}
PDS4_KINDS = {
    "UnsignedByte": "|u1", "SignedByte": "|i1", "UnsignedLSB2": "<u2", "UnsignedLSB4": "<u4", "UnsignedMSB2": ">u2", "UnsignedMSB4": ">u4", "SignedLSB2": "<i2", "SignedLSB4": "<i4", "SignedMSB2": ">i2", "SignedMSB4": ">i4",
    "IEEE754LSBSingle": "<f4", "IEEE754LSBDouble": "<f8", "IEEE754MSBSingle": ">f4", "IEEE754MSBDouble": ">f8",
}
#: Keys of samples that are none.
SPECIALS = ("NULL", "MISSING_CONSTANT", "INVALID_CONSTANT", "CORE_NULL", "LOW_REPR_SATURATION", "LOW_INSTR_SATURATION", "HIGH_REPR_SATURATION", "HIGH_INSTR_SATURATION")
#: What a record has beside its layout; layouts are compared by their own columns.
LAYOUT = ("width", "height", "bands", "dtype", "offset", "prefix", "suffix", "scale", "value_offset", "valid_min", "valid_max")


def any_of(checks: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, checks)


def looked_up(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def item_bytes(dtype: Column) -> Column:
    return F.substring(dtype, 3, 1).cast("int")


def value_range(dtype: Column) -> tuple[Column, Column]:
    """The least and largest sample of a type such as '>i2'."""
    kind, bits = F.substring(dtype, 2, 1), item_bytes(dtype) * 8
    top = F.when(kind == "u", F.pow(F.lit(2.0), bits) - 1).when(kind == "i", F.pow(F.lit(2.0), bits - 1) - 1).when(bits == 32, F.lit(3.4028234663852886e38)).otherwise(F.lit(1.7976931348623157e308))
    return F.when(kind == "u", F.lit(0.0)).when(kind == "i", -top - 1).otherwise(-top), top


def representable(v: Column, dtype: Column) -> Column:
    """Whether a sample of the type can hold the value exactly; floats of 32 bits by a round trip."""
    low, high = value_range(dtype)
    kind = F.substring(dtype, 2, 1)
    exact = F.when(kind == "f", (item_bytes(dtype) == 8) | (v.cast("float").cast("double") == v)).otherwise(v == F.floor(v))
    return v.between(low, high) & exact


def layout_checks(t: DataFrame, file_size: Column) -> list[tuple[Column, str]]:
    """What is wrong with a layout: type, ranges, special values, sizes that overflow, and a file that is too short."""
    c = F.col
    low, high = value_range(c("dtype"))
    whole = F.substring(c("dtype"), 2, 1) != "f"
    out_of = lambda v: (v < low) | (v > high) | (whole & (v != F.floor(v)))
    return [
        (c("dtype").isNull(), "sample type"),
        # samples of eight bytes must still be counted in 63 bits
        (~F.coalesce((c("width") >= 1) & (c("height") >= 1) & (c("bands") >= 1) & F.try_multiply(F.try_multiply("width", F.lit(8).cast("long")), F.try_multiply("height", F.col("bands").cast("long"))).isNotNull(), F.lit(False)), "size"),
        (~F.coalesce((c("prefix") >= 0) & (c("suffix") >= 0), F.lit(False)), "row padding"),
        (c("valid_min") > c("valid_max"), "range"),
        (F.exists("specials", out_of) | (F.size("specials") > 32) | out_of(c("valid_min")) | out_of(c("valid_max")), "special value"),
        (F.coalesce(c("end_byte") > file_size, F.lit(False)), "short file"),
    ]


def with_end(t: DataFrame) -> DataFrame:
    """Adds stride and end_byte; null where they exceed 63 bits."""
    row = F.try_add(F.try_multiply("width", item_bytes(F.col("dtype")).cast("long")), F.try_add("prefix", "suffix"))
    t = t.withColumn("stride", row)
    return t.withColumn("end_byte", F.try_add("offset", F.try_multiply("stride", F.try_multiply("height", "bands"))))


#: The data sets and products of one instrument, whose labels must agree in more.
LROC_SET, LROC_PRODUCT = r"^LRO-L-LROC-[23]-(EDR|CDR)-V\d+(\.\d+)*$", r"^M\d+[LR][EC]$"
ROOT = ("PDS_VERSION_ID", "RECORD_TYPE", "RECORD_BYTES", "LABEL_RECORDS", "FILE_RECORDS", "^IMAGE", "PRODUCT_ID", "DATA_SET_ID", "TARGET_NAME", "FRAME_ID", "PRODUCT_TYPE", "START_TIME", "STOP_TIME", "INSTRUMENT_ID", "INSTRUMENT_NAME", "MD5_CHECKSUM")
NUMBERS = ("SCALING_FACTOR", "OFFSET", "VALID_MINIMUM", "VALID_MAXIMUM")
IMAGE = ("LINES", "LINE_SAMPLES", "BANDS", "SAMPLE_TYPE", "SAMPLE_BITS", "ENCODING_TYPE", "BAND_STORAGE_TYPE", "LINE_PREFIX_BYTES", "LINE_SUFFIX_BYTES", "PRODUCT_ID", "MD5_CHECKSUM", *NUMBERS, *SPECIALS)
#: Names of files are compared and never opened; what could lead elsewhere is none.
PLAIN_NAME = r"^(?!\.{1,2}$)[^/\\\\:\x00-\x1f]{1,255}$"


def _no(x: Column) -> Column:
    return ~F.coalesce(x, F.lit(False))


def pds3_records(values: DataFrame, files: DataFrame, id_: str = "id") -> DataFrame:
    """One record for each file with an attached label: layout, identity, checksum and its scope, and violations.

    values: rows of odl.parsed with the label's id; files: id, file_name, file_size. Only what a label says once
    counts, outside of all blocks or in its only outermost OBJECT = IMAGE; repeats are violations. What the label
    occupies is LABEL_RECORDS records, or all up to its END where it doesn't say.
    """
    c = F.col
    names = _places()
    outside, inside = c("block") == 0, (c("path") == "IMAGE") & (c("kinds") == "OBJECT")
    v = values.withColumn("_at", F.when(outside, F.concat(F.lit(":"), "key")).when(inside, F.concat(F.lit("IMAGE:"), "key")))
    own = lambda at: c("_at") == at
    one = F.struct("type", "value", "unit", "item", "form")
    t = v.groupBy(id_).agg(
        F.max("violation").alias("_broken"), F.max("last").alias("_last"), F.count_distinct(F.when(inside, c("block"))).alias("_images"),
        *[F.max(F.when(own(at), one)).alias(n) for at, n in names.items()],
        *[F.count_if(own(at)).alias(f"n_{n}") for at, n in names.items()],
    )
    return _pds3(files.join(t, id_, "left"), files.columns)


def _places() -> dict[str, str]:
    """Columns of what a label says, by place."""
    return {f":{k}": f"r{i}" for i, k in enumerate(ROOT)} | {f"IMAGE:{k}": f"i{i}" for i, k in enumerate(IMAGE)}


def pds3_attached(files: DataFrame, id_: str = "id", content: str = "content") -> DataFrame:
    """The records of pds3_records from files with the bytes of their label beside them (id, file_name, file_size, content).

    A label is read and laid out as one row within its batch, so nothing is shuffled and no label's values meet again.
    """
    from ..sources import odl

    names, keep = _places(), [c for c in files.columns if c != content]
    one = "struct<type: string, value: string, unit: string, item: int, form: string>"
    own = "".join(f"`{c}` {files.schema[c].dataType.simpleString()}, " for c in keep)
    rest = ", ".join([f"{n} {one}" for n in names.values()] + [f"n_{n} bigint" for n in names.values()])
    fields = ("type", "value", "unit", "item", "form")
    # as by an aggregate's max: null before all values
    order = lambda x: [(v is not None, v if v is not None else 0) for v in x]

    def laid(data: bytes | None) -> tuple:
        said: dict[str, list[tuple]] = {}
        try:
            values, last = odl.statements(data or b"")
        except odl.OdlError as e:
            return str(e), None, 0, said
        if not values:
            return "no values", None, 0, said
        images = set()
        for path, key, _, item, kind, value, unit, kinds, block, form in values:
            if block == 0:
                said.setdefault(f":{key}", []).append((kind, value, unit, item, form))
            elif path == "IMAGE" and kinds == "OBJECT":
                said.setdefault(f"IMAGE:{key}", []).append((kind, value, unit, item, form))
            if path == "IMAGE" and kinds == "OBJECT":
                images.add(block)
        return None, last, len(images), said

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 512):  # labels of up to 1 MiB: a few at a time
                part = b.slice(i, 512)
                made = [laid(x) for x in part.column(content).to_pylist()]
                columns = [part.column(c) for c in keep] + [pa.array([m[k] for m in made], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64()))]
                kind = pa.struct([(f, pa.int32() if f == "item" else pa.string()) for f in fields])
                best = lambda x: dict(zip(fields, max(x, key=order))) if x else None
                columns += [pa.array([best(m[3].get(at)) for m in made], kind) for at in names]
                columns += [pa.array([len(m[3].get(at, ())) for m in made], pa.int64()) for at in names]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "_broken", "_last", "_images", *names.values(), *[f"n_{n}" for n in names.values()]])

    t = files.select(*keep, content).mapInArrow(run, f"{own}_broken string, _last bigint, _images bigint, {rest}")
    return _pds3(t, keep)


def _pds3(t: DataFrame, kept: list[str]) -> DataFrame:
    """Records from files beside what their labels say by place."""
    c, names = F.col, _places()
    raw = lambda k, where="": c(names[f"{where}:{k}"])
    text = lambda k, where="": F.when(raw(k, where)["type"].isin("string", "name"), raw(k, where)["value"])

    def integer(k: str, where: str = "", default: int | None = None, units: bool = False) -> Column:
        x = raw(k, where)
        plain = (x["type"] == "integer") if units else (x["type"] == "integer") & x["unit"].isNull()
        got = F.when(plain, F.try_to_number(x["value"], F.lit("S9999999999999999999")).cast("long"))
        return got if default is None else F.when(x.isNull(), F.lit(default).cast("long")).otherwise(got)

    def number(k: str, default: float | None = None) -> Column:
        x = raw(k, "IMAGE")
        got = F.when(x["type"].isin("integer", "real") & x["unit"].isNull(), x["value"].cast("double"))
        return got if default is None else F.when(x.isNull() | (x["type"] == "null"), F.lit(default)).otherwise(got)

    bits = integer("SAMPLE_BITS", "IMAGE")
    kind = looked_up(PDS3_KINDS, F.upper(raw("SAMPLE_TYPE", "IMAGE")["value"]))
    dtype = F.when(kind.endswith("f") & bits.isin(32, 64), F.concat(kind, (bits / 8).cast("int").cast("string")))
    dtype = dtype.when(~kind.endswith("f") & (bits == 8), F.concat(F.lit("|"), F.substring(kind, 2, 1), F.lit("1"))).when(~kind.endswith("f") & bits.isin(16, 32), F.concat(kind, (bits / 8).cast("int").cast("string")))
    pointer, record = raw("^IMAGE"), integer("RECORD_BYTES")
    at = integer("^IMAGE", units=True)
    offset = F.when(pointer["unit"].isin("BYTE", "BYTES"), at - 1).when(pointer["unit"].isNull(), F.try_multiply(at - 1, record))
    specials = F.filter(F.array(*[number(k) for k in SPECIALS]), lambda x: x.isNotNull())
    t = t.withColumns({
        "width": integer("LINE_SAMPLES", "IMAGE"), "height": integer("LINES", "IMAGE"), "bands": integer("BANDS", "IMAGE", 1), "dtype": dtype, "offset": offset,
        "prefix": integer("LINE_PREFIX_BYTES", "IMAGE", 0), "suffix": integer("LINE_SUFFIX_BYTES", "IMAGE", 0), "scale": number("SCALING_FACTOR", 1.0), "value_offset": number("OFFSET", 0.0),
        "specials": specials, "valid_min": number("VALID_MINIMUM"), "valid_max": number("VALID_MAXIMUM"), "label_end": F.when(raw("LABEL_RECORDS").isNull(), c("_last")).otherwise(F.try_multiply(integer("LABEL_RECORDS"), record)),
        "product_id": text("PRODUCT_ID"), "data_set_id": text("DATA_SET_ID"), "target": text("TARGET_NAME"), "frame_id": text("FRAME_ID"), "level": text("PRODUCT_TYPE"), "instrument": F.coalesce(text("INSTRUMENT_ID"), text("INSTRUMENT_NAME")),
        "_start": text("START_TIME"), "_stop": text("STOP_TIME"), "_md5": text("MD5_CHECKSUM", "IMAGE"),
    })
    t = with_end(t)
    size, record_type = c("file_size"), F.upper(raw("RECORD_TYPE")["value"])
    # a repeated key, or a list where one value belongs
    again = any_of([F.coalesce(c(f"n_{n}") > 1, F.lit(False)) for n in names.values()])
    storage = F.upper(F.coalesce(raw("BAND_STORAGE_TYPE", "IMAGE")["value"], F.when(c("bands") == 1, "BAND_SEQUENTIAL")))
    lroc = F.coalesce(F.upper("data_set_id").contains("LROC"), F.lit(False))
    expected = F.when(F.upper("data_set_id").contains("-CDR-"), "CDR").otherwise("EDR")
    moment = lambda k: F.try_to_timestamp(F.replace(c(k), F.lit("Z"), F.lit("+00:00")))
    zoned = lambda k: c(k).rlike(r"(Z|[+-]\d\d:?\d\d)$")
    product, frame = F.upper("product_id"), F.upper("frame_id")
    identity = (
        F.upper("data_set_id").rlike(LROC_SET) & (F.upper("level") == expected) & product.rlike(LROC_PRODUCT) & (F.lower(F.regexp_replace("file_name", r"\.[^.]*$", "")) == F.lower("product_id"))
        & frame.isin("LEFT", "RIGHT") & (F.substring(product, -2, 1) == F.substring(frame, 1, 1)) & (F.substring(product, -1, 1) == F.substring(expected, 1, 1)) & (c("target") == "MOON") & (c("width") <= NARROW_WIDTH) & (c("bands") == 1)
    )
    within = raw("PRODUCT_ID", "IMAGE").isNull() | (text("PRODUCT_ID", "IMAGE") == c("product_id"))
    floats = F.coalesce(kind.endswith("f"), F.lit(False))
    whole = lambda k: raw(k).isNotNull() & _no(integer(k) >= 1)
    checks = S.violations(
        (_no(c("file_name").rlike(PLAIN_NAME)), "file name"), (c("_broken").isNotNull() | c("n_r0").isNull(), "unreadable"), (again, "ambiguous"), (_no(F.upper(raw("PDS_VERSION_ID")["value"]) == "PDS3"), "version"),
        (_no(record_type.isin("FIXED_LENGTH", "UNDEFINED")) | ((record_type == "FIXED_LENGTH") & raw("RECORD_BYTES").isNull()), "record type"), (whole("RECORD_BYTES"), "record bytes"),
        (raw("LABEL_RECORDS").isNotNull() & _no((integer("LABEL_RECORDS") >= 1) & (c("label_end") <= HEADER) & (c("label_end") <= size) & (c("_last") <= c("label_end"))), "label records"),
        (raw("FILE_RECORDS").isNotNull() & _no((integer("FILE_RECORDS") >= 1) & (F.try_multiply(integer("FILE_RECORDS"), record) == size)), "file records"),
        (_no(c("offset") >= 0), "pointer"), (F.coalesce(c("offset") < c("label_end"), F.lit(False)), "pointer within label"),
        (F.coalesce(c("_images"), F.lit(0)) != 1, "not one image"), (~F.upper(F.coalesce(raw("ENCODING_TYPE", "IMAGE")["value"], F.lit("N/A"))).isin("N/A", "NONE", "UNCOMPRESSED"), "encoding"), (_no(storage == "BAND_SEQUENTIAL"), "band order"),
        (any_of([raw(k, "IMAGE").isNotNull() & (raw(k, "IMAGE")["type"] != "null") & number(k).isNull() for k in (*SPECIALS, *NUMBERS)]), "number"),
        (floats & any_of([F.coalesce(raw(k, "IMAGE")["form"] == "radix", F.lit(False)) for k in SPECIALS]), "bit pattern"),
        *layout_checks(t, size), (F.coalesce(F.upper("target") != "MOON", F.lit(False)), "target"), (lroc & _no(identity), "identity"), (lroc & _no(within), "product of the image"),
        (lroc & _no((moment("_stop") >= moment("_start")) & (zoned("_start") == zoned("_stop"))), "time"), (lroc & raw("MD5_CHECKSUM", "IMAGE").isNotNull() & _no(c("_md5").rlike("^[0-9a-fA-F]{32}$")), "checksum"),
    )
    # only one instrument's documents say what the checksum covers
    scope = F.when(lroc & c("_md5").isNotNull(), "image_object").when(raw("MD5_CHECKSUM").isNotNull() | raw("MD5_CHECKSUM", "IMAGE").isNotNull(), "unknown")
    return t.select(*kept, *LAYOUT[:7], "stride", "end_byte", *LAYOUT[7:], "specials", "product_id", "data_set_id", "target", "frame_id", "level", "instrument", F.when(lroc, F.lower("_md5")).alias("md5"), scope.alias("md5_scope"), checks.alias("violations"))


#: The part of an XML label that a raster descriptor is made of; everything may be repeated, so that repeats can be refused.
_MEASURE = "array<struct<_VALUE: string, _unit: string>>"
_ARRAY = f"""array<struct<offset: {_MEASURE}, axes: array<string>, axis_index_order: array<string>,
 Element_Array: array<struct<data_type: array<string>, scaling_factor: array<string>, value_offset: array<string>>>,
 Axis_Array: array<struct<axis_name: array<string>, elements: array<string>, sequence_number: array<string>>>,
 Special_Constants: array<struct<missing_constant: array<string>, invalid_constant: array<string>, saturated_constant: array<string>, high_instrument_saturation: array<string>,
  low_instrument_saturation: array<string>, high_representation_saturation: array<string>, low_representation_saturation: array<string>, valid_minimum: array<string>, valid_maximum: array<string>>>>>"""
XMLNS = r"""xmlns(:\w+)?\s*=\s*["']http://pds\.nasa\.gov/pds4/pds/v1["']"""
_AREA = f"""array<struct<File: array<struct<file_name: array<string>, file_size: {_MEASURE}, md5_checksum: array<string>>>, Array_2D_Image: {_ARRAY}, Array_3D_Image: {_ARRAY},
 Encoded_Image: array<struct<encoding_standard_id: array<string>, offset: {_MEASURE}, object_length: {_MEASURE}>>>>"""
AREAS = ("File_Area_Observational", "File_Area_Observational_Supplemental", "File_Area_Encoded_Image")
PDS4 = f"struct<{', '.join(f'{a}: {_AREA}' for a in AREAS)}, Observation_Area: array<struct<Target_Identification: array<struct<name: array<string>>>>>>".replace("\n", "")


def only(values: Column) -> Column:
    """The single item of a list; null for none or several."""
    return F.when(F.size(values) == 1, F.get(values, F.lit(0)))


def uint(text: Column) -> Column:
    """A whole number of at most 19 digits; null otherwise."""
    t = F.trim(text)
    return F.when(t.rlike(r"^[0-9]{1,19}$"), F.try_to_number(t, F.lit("9999999999999999999")).try_cast("long"))


def _in_bytes(measure: Column) -> Column:
    return F.when(F.lower(F.coalesce(measure["_unit"], F.lit("byte"))).isin("byte", "bytes"), uint(measure["_VALUE"]))


#: What a container's header says, in columns beside `container`, its format.
CONTAINER = ("container_width", "container_height", "container_bands", "container_dtype", "container_scale", "container_offset")


def _elements(text: Column, name: str) -> Column:
    """The texts of all elements of a local name."""
    return F.transform(F.regexp_extract_all(text, F.lit(rf"<(?:[\w.-]+:)?{name}(?:\s[^>]*)?>([^<]*)<"), F.lit(1)), lambda x: F.trim(x))


def pds4_records(labels: DataFrame, id_: str = "id", content: str = "content") -> DataFrame:
    """One record for each XML label (text) and the file that it is associated with (file_name, file_size): layout and violations.

    An encoded image's layout is its container's: columns container (its format) and CONTAINER, as far as the rows have
    them; an encoded image without is a violation. Special constants are all that a label names as a constant or a
    saturation; any other name is refused.
    """
    c = F.col
    options = {"ignoreNamespace": "true", "mode": "PERMISSIVE", "rowTag": "Product_Observational"}
    t = labels.withColumns({n: F.lit(None).cast({"container_dtype": "string"}.get(n, "double" if n in CONTAINER[4:] else "bigint")) for n in CONTAINER if n not in labels.columns})
    text = F.regexp_replace(F.coalesce(c(content), F.lit("")), "(?s)<!--.*?-->", "")
    # declarations are not read, and neither is what exceeds the limit
    readable = (F.octet_length(c(content)) <= HEADER) & ~text.rlike("(?i)<!(DOCTYPE|ENTITY)")
    t = t.withColumn("_text", F.when(F.coalesce(readable, F.lit(False)), text)).withColumn("_x", F.from_xml(c("_text"), PDS4, options))
    t = t.withColumn("_areas", F.flatten(F.array(*[F.coalesce(F.col(f"_x.{a}"), F.array()) for a in AREAS])))
    t = t.withColumn("_area", only(F.col("_areas")))
    t = t.withColumn("_file", only(F.col("_area.File"))).withColumn("_arrays", F.concat(F.coalesce("_area.Array_2D_Image", F.array()), F.coalesce("_area.Array_3D_Image", F.array())))
    t = t.withColumn("_array", only(F.col("_arrays"))).withColumn("_encoded", only(F.col("_area.Encoded_Image")))
    axes = F.array_sort(F.transform("_array.Axis_Array", lambda a: F.struct(uint(only(a["sequence_number"])).alias("n"), F.trim(only(a["axis_name"])).alias("name"), uint(only(a["elements"])).alias("size"))))
    t = t.withColumn("_axes", axes).withColumn("_names", F.concat_ws(",", F.transform("_axes", lambda a: a["name"])))
    size = lambda k: F.try_element_at("_axes", F.lit(k))["size"]
    finite = lambda v: F.when(F.abs(v) < float("inf"), v)
    number = lambda values, default: F.when(F.coalesce(F.size(values), F.lit(-1)) < 1, F.lit(default).cast("double")).otherwise(finite(S.lenient_double(only(values))))
    section = F.regexp_extract("_text", r"(?s)<(?:[\w.-]+:)?Special_Constants(?:\s[^>]*)?>(.*?)</(?:[\w.-]+:)?Special_Constants\s*>", 1)
    item = lambda k: F.regexp_extract_all(section, F.lit(r"<(?:[\w.-]+:)?([\w-]+)(?:\s[^>]*)?(?:/>|>([^<]*)<)"), F.lit(k))
    t = t.withColumns({"_element": only(c("_array.Element_Array")), "_special": only(c("_array.Special_Constants")), "_said": F.filter(F.arrays_zip(item(1).alias("name"), item(2).alias("value")), lambda x: c("_array").isNotNull())})
    constant = lambda x: x["name"].endswith("_constant") | x["name"].contains("saturation")
    limit = lambda x: x["name"].isin("valid_minimum", "valid_maximum")
    encoded = c("_encoded").isNotNull()
    either = lambda own, name, zero=None: F.when(encoded, c(name) if zero is None else F.coalesce(c(name), F.lit(zero))).otherwise(own)
    t = t.withColumns({
        "width": either(size(-1), "container_width"), "height": either(size(-2), "container_height"), "bands": either(F.when(F.size("_axes") == 3, size(1)).otherwise(F.lit(1).cast("long")), "container_bands"),
        "dtype": either(looked_up(PDS4_KINDS, F.trim(only(c("_element.data_type")))), "container_dtype"), "offset": F.when(encoded, F.lit(0).cast("long")).otherwise(_in_bytes(only(c("_array.offset")))),
        "prefix": F.lit(0).cast("long"), "suffix": F.lit(0).cast("long"), "scale": either(number(c("_element.scaling_factor"), 1.0), "container_scale", 1.0), "value_offset": either(number(c("_element.value_offset"), 0.0), "container_offset", 0.0),
        "specials": F.when(encoded, F.array().cast("array<double>")).otherwise(F.transform(F.filter("_said", constant), lambda x: finite(S.lenient_double(x["value"])))),
        "valid_min": F.when(~encoded, number(c("_special.valid_minimum"), None)), "valid_max": F.when(~encoded, number(c("_special.valid_maximum"), None)),
    })
    t = with_end(t)
    # a container's bytes are packed: where its samples end says nothing of the file
    t = t.withColumns({k: F.when(~encoded, c(k)) for k in ("stride", "end_byte")})
    targets = F.array_distinct(F.filter(F.transform(F.concat(F.coalesce(F.flatten(F.transform(F.flatten(F.transform(c("_x.Observation_Area"), lambda o: o["Target_Identification"])), lambda x: x["name"])), F.array().cast("array<string>")), _elements(c("_text"), "target_name")), lambda n: F.lower(F.trim(n))), lambda n: n != ""))
    products = F.array_distinct(_elements(c("_text"), "product_id"))
    t = t.withColumns({"_targets": F.coalesce(targets, F.array().cast("array<string>")), "_products": F.coalesce(products, F.array().cast("array<string>")), "_logical": _elements(c("_text"), "logical_identifier")})
    declared = c("_file.file_size")
    md5 = only(c("_file.md5_checksum"))
    raw, has = ~encoded & c("_area").isNotNull(), c("_array").isNotNull()
    length = c("_encoded.object_length")
    said = lambda values: F.coalesce(F.size(values) > 0, F.lit(False))
    checks = S.violations(
        (c("_text").isNull(), "unreadable"), (c("_text").isNotNull() & _no(c("_text").rlike(XMLNS)), "namespace"), (_no(c("file_name").rlike(PLAIN_NAME)), "plain name"), (c("_area").isNull(), "file area"),
        (c("_area").isNotNull() & _no(F.lower(F.trim(only(c("_file.file_name")))) == F.lower("file_name")), "file name"), (said(declared) & _no(_in_bytes(only(declared)) == c("file_size")), "file size"),
        (encoded & (_no(_in_bytes(only(c("_encoded.offset"))) == 0) | (F.size("_arrays") > 0) | _no(F.trim(only(c("_encoded.encoding_standard_id"))) == c("container"))), "encoded image"),
        (encoded & said(length) & _no(_in_bytes(only(length)) == c("file_size")), "object length"),
        (raw & c("container").isNotNull(), "container"), (raw & (F.size("_arrays") != 1), "array"), (raw & has & c("offset").isNull(), "offset"), (raw & has & _no(F.trim(only(c("_array.axis_index_order"))) == "Last Index Fastest"), "index order"),
        (raw & has & _no((uint(only(c("_array.axes"))) == F.size("_axes")) & (F.transform("_axes", lambda a: a["n"]) == F.sequence(F.lit(1), F.greatest(F.size("_axes"), F.lit(1))).cast("array<bigint>")) & c("_names").isin("Line,Sample", "Band,Line,Sample")), "axes"),
        (raw & F.exists("_said", lambda x: ~constant(x) & ~limit(x)), "unknown constant"), (raw & (F.size("_array.Special_Constants") > 1), "constants"),
        (raw & any_of([c("scale").isNull(), c("value_offset").isNull(), F.exists("specials", lambda x: x.isNull()), said(c("_special.valid_minimum")) & c("valid_min").isNull(), said(c("_special.valid_maximum")) & c("valid_max").isNull()]), "number"),
        *[((raw | encoded) & bad, what) for bad, what in layout_checks(t, c("file_size"))],
        (said(c("_file.md5_checksum")) & _no(F.trim(md5).rlike("^[0-9a-fA-F]{32}$")), "checksum"), (F.size("_products") > 1, "ambiguous product"),
        (F.size("_targets") > 1, "ambiguous target"), ((F.size("_targets") == 1) & _no(F.get("_targets", F.lit(0)) == "moon"), "target"),
    )
    keep = [x for x in labels.columns if x not in (content, "container", *CONTAINER)]
    product = F.coalesce(F.get("_products", F.lit(0)), F.get("_logical", F.lit(0)))
    return t.select(*keep, *LAYOUT[:7], "stride", "end_byte", *LAYOUT[7:], "specials", F.get("_targets", F.lit(0)).alias("target"), F.nullif(product, F.lit("")).alias("product_id"), F.lower(F.trim(md5)).alias("md5"), encoded.alias("encoded"), checks.alias("violations"))


#: What two labels of a scene must agree in.
AGREE = ("width", "height", "bands", "dtype", "offset", "row_bytes")


def resolved(scenes: DataFrame, separate: DataFrame, attached: DataFrame, container: DataFrame, fields: tuple[str, ...] = AGREE) -> DataFrame:
    """Which of a scene's labels counts, its fields, and the fields in which the labels differ.

    scenes: id and mode (auto, separate, attached, none); the others: id, the fields, and where they have them
    product_id and violations, at most one row an id. A separate label comes before an attached one and that before
    the container's own header, unless the mode forces one. A separate label that is broken, or differs from an
    attached one (or stands beside a broken one), refuses the scene in every mode but `attached`, where it is ignored
    with a warning; so is a sound one in mode `none`.
    """
    def named(t: DataFrame, prefix: str) -> DataFrame:
        has = {c.lower() for c in t.columns}
        product = F.col("product_id") if "product_id" in has else F.lit(None).cast("string").alias("product_id")
        broken = (F.size("violations") > 0 if "violations" in has else F.lit(False)).alias("broken")
        return t.select("id", F.struct(*fields, product, broken).alias(prefix))

    t = scenes.join(named(separate, "_s"), "id", "left").join(named(attached, "_a"), "id", "left").join(named(container, "_c"), "id", "left")
    mode, s, a, c = (F.col(x) for x in ("mode", "_s", "_a", "_c"))
    both = s.isNotNull() & a.isNotNull() & ~s["broken"] & ~a["broken"]
    own = F.lower(F.element_at(F.split(s["product_id"], ":"), -1))
    names = (F.coalesce(a["product_id"], F.lit("")) != "") & ~F.coalesce(own == F.lower(a["product_id"]), F.lit(False))
    differ = F.filter(F.array(*[F.when(both & ~s[f].eqNullSafe(a[f]), F.lit(f)) for f in fields], F.when(both & names, F.lit("product_id"))), lambda x: x.isNotNull())
    t = t.withColumn("conflicts", differ)
    bad = s.isNotNull() & (s["broken"] | F.coalesce(a["broken"], F.lit(False)) | (F.size("conflicts") > 0))
    forced = mode == "attached"
    route = (
        F.when(forced | ((mode == "auto") & s.isNull() & a.isNotNull()), F.when(a.isNotNull() & ~a["broken"], "attached"))
        .when(mode.isin("auto", "separate") & s.isNotNull(), F.when(~bad, "separate")).when(mode.isin("auto", "none") & ~bad & c.isNotNull(), "container")
    )
    t = t.withColumns({"route": route, "_bad": bad})
    picked = F.when(F.col("route") == "separate", s).when(F.col("route") == "attached", a).when(F.col("route") == "container", c)
    no = lambda x: ~F.coalesce(x, F.lit(False))
    found = S.violations(
        (no(mode.isin("auto", "separate", "attached", "none")), "mode"), (~forced & F.coalesce(s["broken"], F.lit(False)), "separate label"),
        (~forced & s.isNotNull() & no(s["broken"]) & F.coalesce(a["broken"], F.lit(False)), "conflict with a broken label"), (~forced & (F.size("conflicts") > 0), "conflict"),
        ((forced | ((mode == "auto") & s.isNull())) & F.coalesce(a["broken"], F.lit(False)), "attached label"),
    )
    found = F.concat(found, F.when(F.col("route").isNull() & (F.size(found) == 0), F.array(F.lit("no label"))).otherwise(F.array().cast("array<string>")))
    warned = S.violations((forced & s.isNotNull(), "separate label overridden"), ((mode == "none") & s.isNotNull() & ~F.col("_bad"), "separate label ignored"))
    return t.withColumn("_p", picked).select(*scenes.columns, "route", *[F.col("_p")[f].alias(f) for f in fields], "conflicts", warned.alias("warnings"), found.alias("violations"))


MANIFEST = "schema string, original_name string, original_format string, original_size bigint, original_sha256 string, original_label_base64 string, tile_sha256 string, tile struct<x: bigint, y: bigint, width: bigint, height: bigint, band: bigint>, extractor string"
MANIFEST_BYTES, LABEL_BYTES = 2 << 20, 1 << 20


def manifests(t: DataFrame, schema: str = "tile-1") -> DataFrame:
    """Provenance manifests read and checked against their tiles.

    t: id, content (JSON text), tile_digest, width, height and dtype of the tile's own file, layout_width,
    layout_height and layout_dtype of the original label. Adds the manifest m, the decoded label, and violations.
    """
    known = [f.split(" ")[0] for f in ("schema string", "original_name string", "original_format string", "original_size bigint", "original_sha256 string", "original_label_base64 string", "tile_sha256 string", "tile x", "extractor string")]
    t = t.withColumns({"m": F.from_json("content", MANIFEST), "_keys": F.json_object_keys(F.when(F.length("content") <= MANIFEST_BYTES, F.col("content"))), "_tile_keys": F.json_object_keys(F.get_json_object("content", "$.tile"))})
    t = t.withColumn("label", F.try_to_binary(F.col("m.original_label_base64"), F.lit("base64")))
    tile = lambda k: F.col(f"m.tile.{k}")
    no = lambda x: ~F.coalesce(x, F.lit(False))
    digest = "^[0-9a-f]{64}$"
    inside = (tile("x") >= 0) & (tile("y") >= 0) & (tile("width") >= 1) & (tile("height") >= 1) & (tile("x") + tile("width") <= F.col("layout_width")) & (tile("y") + tile("height") <= F.col("layout_height"))
    bad = S.violations(
        (F.octet_length("content") > MANIFEST_BYTES, "too long"),
        (no(F.array_sort("_keys") == F.array(*map(F.lit, sorted(known)))) | no(F.array_sort("_tile_keys") == F.array(*map(F.lit, sorted(("x", "y", "width", "height", "band"))))), "keys"),
        (no(F.col("m.schema") == schema), "schema"), (no(F.col("m.original_format").isin("PDS3", "PDS4")), "format"),
        (no(F.col("m.original_sha256").rlike(digest)) | no(F.col("m.tile_sha256").rlike(digest)), "digest"), (no(F.col("m.tile_sha256") == F.col("tile_digest")), "tile digest"),
        (F.col("label").isNull(), "label"), (F.octet_length("label") > LABEL_BYTES, "label too long"), (no(inside), "tile"),
        (no((tile("width") == F.col("width")) & (tile("height") == F.col("height")) & (F.substring("dtype", 2, 2) == F.substring("layout_dtype", 2, 2))), "tile differs"),
    )
    return t.withColumn("violations", bad).drop("_keys", "_tile_keys")
