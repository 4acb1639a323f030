"""WARC archives: written as monolithic gzip files, normalised to one member per record with an offset index, read back.

An archive that is one gzip stream can't be read at an offset. The normaliser inflates each such
file once, front to back, rewrites every record as a member of its own and writes a sidecar index of
offsets; a reader then inflates single records. Files lie in the folder given, on any file system
that pyarrow opens; their names carry the task attempt, and only files of the manifest are read, so
lost and repeated tasks leave nothing in the result.

Defined results: a null html is an empty payload; among equal payloads of at least min_bytes the
smallest page_id is the response and the others revisits of it; rows that share the smallest page_id
are all responses; a null page_id revisits, and is a response where its group has no other; a null
url becomes `urn:none`; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import bounded_batches, pieces
from .common import BROADCAST_ROWS, cut, shared_dir, table

#: Uncompressed bytes after which a new archive is begun, and bytes read at once.
ROTATE, BLOCK = 64 << 20, 1 << 20
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "path string, records bigint, bytes bigint"


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or a revisit that has the response's HTTP head only."""
    name = lambda i: f"<urn:page:{'none' if i is None else i}>"
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:none")
    kind = "response" if refers_to is None else "revisit"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if kind == "revisit" else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", "Content-Type: application/http; msgtype=response"]
    if kind == "revisit":
        lines += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def fields(head: bytes) -> dict[str, str]:
    rows = (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:] if x)
    return {k.strip().lower(): v.strip() for k, _, v in rows}


def inflated(stream) -> Iterator[bytes]:
    """What a gzip file of one or several members holds, in blocks."""
    z = zlib.decompressobj(31)
    while data := stream.read(BLOCK):
        while data:
            yield z.decompress(data)
            data = z.unused_data
            if z.eof and data:
                z = zlib.decompressobj(31)
    if not z.eof:
        raise ValueError("the gzip stream is cut short")


def records(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records, one at a time; no more than a record and a block is held."""
    buf = bytearray()
    for data in blocks:
        buf += data
        at = 0
        while (end := buf.find(b"\r\n\r\n", at)) >= 0:
            if not buf.startswith(b"WARC/", at):
                raise ValueError("a record doesn't begin with its version")
            stop = end + 8 + int(fields(bytes(buf[at:end]))["content-length"])
            if len(buf) < stop:
                break
            yield bytes(buf[at:stop])
            at = stop
        del buf[:at]
    if buf:
        raise ValueError("the last record is cut short")


def write_monolithic(pages: DataFrame, folder: str) -> DataFrame:
    """Archives of (page_id, url, html, refers_to), each one gzip stream; returns the manifest, already written."""

    def run(batches):
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        part, n, out = f"{task.partitionId():06d}-{task.taskAttemptId()}", 0, None
        done = lambda: pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [count], "bytes": [size]})
        for b in pieces(batches):
            for page_id, url, html, refers_to in zip(*(b.column(i).to_pylist() for i in range(4))):
                if out is None:
                    name, count, size, z = f"{part}-{n:04d}.warc.gz", 0, 0, zlib.compressobj(6, zlib.DEFLATED, 31)
                    out, n = fs.open_output_stream(f"{root}/{name}", compression=None), n + 1
                r = record(page_id, url, (html or "").encode(), refers_to)
                out.write(z.compress(r))
                count, size = count + 1, size + len(r)
                if size >= ROTATE:
                    out.write(z.flush())
                    out.close()
                    out = None
                    yield done()
        if out is not None:
            out.write(z.flush())
            out.close()
            yield done()

    bounded_batches(pages.sparkSession)
    return cut(pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, MANIFEST))


def _each_file(manifest: DataFrame) -> DataFrame:
    """One file a task."""
    return manifest.repartition(max(1, manifest.count()))


def normalise(manifest: DataFrame, folder: str) -> DataFrame:
    """Rewrites each archive with a member for each record, beside it `.index` with a JSON line for each; returns their manifest."""

    def run(batches):
        source, _ = _open(folder)
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        tag = TaskContext.get().taskAttemptId()
        for b in batches:
            for path in b.column(0).to_pylist():
                name = path.rpartition("/")[2].removesuffix(".warc.gz") + f"-n{tag}.warc.gz"
                at = count = 0
                _, old = _open(path)
                with source.open_input_stream(old, compression=None) as f, fs.open_output_stream(f"{root}/{name}", compression=None) as out, fs.open_output_stream(f"{root}/{name}.index", compression=None) as index:
                    for r in records(inflated(f)):
                        z = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = z.compress(r) + z.flush()
                        h = fields(r[: r.find(b"\r\n\r\n")])
                        out.write(member)
                        index.write(json.dumps({"id": h["warc-record-id"], "type": h["warc-type"], "offset": at, "length": len(member)}).encode() + b"\n")
                        at, count = at + len(member), count + 1
                yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [count], "bytes": [at]})

    return cut(_each_file(manifest).mapInArrow(run, MANIFEST))


PAGES = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, archive string, member_offset bigint, member_length bigint"


def read_members(manifest: DataFrame) -> DataFrame:
    """A row for each record, read by the offsets of the index; a response's digest is that of the payload read."""

    def page(name: str | None) -> int | None:
        m = re.fullmatch(r"<urn:page:(-?[0-9]+)>", name or "")
        return int(m[1]) if m else None

    def read(path: str, lines: list[dict], f) -> list[list]:
        out = []
        for x in lines:
            f.seek(x["offset"])
            r = zlib.decompress(f.read(x["length"]), 31)
            cut_at = r.find(b"\r\n\r\n")
            h, block = fields(r[:cut_at]), r[cut_at + 4 : -4]
            head_end = block.find(b"\r\n\r\n")
            digest = h["warc-payload-digest"].removeprefix("sha1:")
            size = int(fields(block[:head_end])["content-length"])
            if h["warc-type"] == "response":
                payload = block[head_end + 4 :]
                if len(payload) != size or base32_sha1(payload) != digest:
                    raise ValueError(f"{path} at {x['offset']}: the payload differs from its digest")
            out.append([page(h["warc-record-id"]), size, digest, h["warc-type"], page(h.get("warc-refers-to")), path.rpartition("/")[2], x["offset"], x["length"]])
        return out

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, at = _open(path)
                with fs.open_input_stream(f"{at}.index", compression=None) as i, fs.open_input_file(at) as f:
                    lines = list(map(json.loads, i.read().splitlines()))
                    for k in range(0, len(lines), 1000):
                        rows = read(path, lines[k : k + 1000], f)
                        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in PAGES.split(", ")])

    return _each_file(manifest).mapInArrow(run, PAGES)


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html, and refers_to: the smallest page_id of those with an equal payload, for all but itself.

    Digests are counted first and only repeated ones joined back. Those of more than a thousandth of all
    repeats are fewer than a thousand, so these are broadcast whatever the table's size, and no page of a
    common payload is shuffled for its digest.
    """
    digest = F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256)
    p = pages.select("page_id", "url", "html", digest.alias("_d"), F.octet_length(F.coalesce("html", F.lit(""))).alias("_n"))
    again = cut(p.where(F.col("_n") >= min_bytes).groupBy("_d").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_c")).where("_c > 1"))
    n, rows = again.agg(F.count(F.lit(1)), F.sum("_c")).first()
    if n <= BROADCAST_ROWS:
        p = p.join(F.broadcast(again.drop("_c")), "_d", "left")
    else:
        often = F.col("_c") > rows / 1000
        p = p.join(F.broadcast(again.where(often).select("_d", F.col("_first").alias("_often"))), "_d", "left")
        # found already: a key of its own, so that those pages are dealt evenly
        p = p.withColumn("_k", F.when(F.col("_often").isNull(), F.col("_d")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id").cast("string"))))
        p = p.join(again.where(~often).select(F.col("_d").alias("_k"), "_first"), "_k", "left").withColumn("_first", F.coalesce("_often", "_first"))
    refers = F.when((F.col("_n") >= min_bytes) & F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))
    return p.select("page_id", "url", "html", refers.alias("refers_to"))


def op3_warc_normalise(spark, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    raw = write_monolithic(with_revisits(table(spark, sf_dir, "pages")), f"{folder}/monolithic")
    rows = cut(read_members(normalise(raw, f"{folder}/members")))
    fs, root = _open(folder)
    if fs.get_file_info(root).type.name == "Directory":
        fs.delete_dir(root)  # the result is written; the archives were only made to be read back
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
with p as (select page_id, coalesce(html, '') html from pages),
h as (select page_id, octet_length(encode(html))::bigint n, sha1(html) d, sha256(html) s from p),
f as (select *, min(page_id) over (partition by s) first from h)
select page_id, n payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(d, (i // 4) * 5 + 1, 5))::int >> (15 - 5 * (i % 4))::int) & 31) + 1, 1)), '') payload_digest,
       case when page_id = first then 'response' else 'revisit' end record_type,
       case when page_id = first then null else first end refers_to
from f
"""
