"""Collocations: phrases of two or three words that stand together far more often than their parts.

Texts are split into pieces, and identical pieces become one with a multiplicity. A task counts the weighted n-grams of
its pieces in duckdb, which spills what its memory can't hold, and sends them to hash buckets as compressed columns; each
bucket adds up its parts in duckdb again and keeps n-grams that are frequent enough to be, or to be part of, a candidate.
A candidate's parts stand in other buckets: it asks for their counts by rows that are shuffled to where those are.

Words and pairs are counted first. A triple can't be more frequent than the two pairs in it, so triples are counted only
where both may be frequent: frequent pairs are marked in a bitmap of CELLS bits, whatever their number, and a pair that
shares a mark by chance only costs work. No count is estimated.

An n-gram comes to its bucket once from each group of pieces, whatever its frequency, so no bucket is hot; parts that
many candidates ask for are joined by broadcast (see spread_join). Products are decimals, so nothing overflows or rounds.

Defined results: a null text has no words; a null lang is the lang `und`, together with rows that say so; words of a piece
may stand any number of blanks apart; repeated rows and rows that share a doc_id count each; ties in score go to the
smaller cut, ties in rank to the more frequent phrase, then to the first in UTF-8 order; pieces of any length are counted
whole; an empty table gives an empty one; columns beside text and lang are ignored, whatever their names.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import bounded_batches
from .common import Scratch, spread_join, table
from .op10_minhash import M1, mix64

LEAST, TOP, INSIDE = 10, 2000, 50
#: n-grams of a group that is counted at a time, about, and MB that duckdb may use before it spills.
GROUP, MEMORY = 2_000_000, 200
#: Bits of the bitmap of frequent pairs, and of one of the segments that it is made of.
CELLS, SEGMENT = 1 << 27, 1 << 16
#: Bytes of pieces whose triples are looked for at a time.
PIECES = 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Words and pairs of the pieces p (lang, piece, m).
PAIRS = """select lang, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) gram, m
from (select lang, m, string_split(piece, ' ') ws from p)"""
#: The n-grams of a group, added up, with the bucket that each belongs to.
DEALT = "select hash(gram) % {buckets} as bucket, lang, gram, sum(m)::bigint as f from ({grams}) group by lang, gram order by bucket, lang, gram"
#: The parts q of a bucket, added up: what is frequent, and beside it the words of each lang under an empty n-gram.
SUMS = """
with s as (select lang, gram, sum(f)::bigint f from q group by lang, gram)
select lang, gram, f from s where f >= {least}
union all
select lang, '', sum(f)::bigint from s where position(' ' in gram) = 0 group by lang
"""


def _database(folder: str):
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": f"{MEMORY}MB", "temp_directory": folder, "preserve_insertion_order": False})
    return con


PART = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("f", pa.int64())])


def _pack(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, PART, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as w:
        w.write_table(t.cast(PART))
    return sink.getvalue().to_pybytes()


def _dealt(groups: Iterator[pa.Table], sql: str, buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, part) of each group; sql has a group's n-grams (lang, gram, m) from its table p."""
    for own in groups:
        with tempfile.TemporaryDirectory() as folder, _database(folder) as con:
            con.register("p", own)
            out = con.sql(DEALT.format(buckets=buckets, grams=sql)).to_arrow_table().combine_chunks()
        b = out.column("bucket").to_numpy()
        at = [0, *(1 + (b[1:] != b[:-1]).nonzero()[0]).tolist(), len(b)] if len(b) else []
        for i, j in zip(at, at[1:]):
            part = _pack(out.slice(i, j - i).select(["lang", "gram", "f"]))
            yield pa.RecordBatch.from_arrays([pa.array([int(b[i])], pa.int64()), pa.array([part], pa.binary())], ["bucket", "part"])
        del own, out, b
        pa.default_memory_pool().release_unused()  # workers stay, and would keep it


def _sums(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """A bucket at a time, for its parts come one after another; they are unpacked while duckdb reads them."""
    rows = ((b, p) for batch in batches for b, p in zip(batch.column(0).to_pylist(), batch.column(1)))
    ahead = next(rows, None)
    while ahead is not None:
        bucket = ahead[0]

        def parts():
            nonlocal ahead
            while ahead is not None and ahead[0] == bucket:  # noqa: B023
                yield from pa.ipc.open_stream(ahead[1].as_buffer())
                ahead = next(rows, None)

        with tempfile.TemporaryDirectory() as folder, _database(folder) as con:
            con.register("q", pa.RecordBatchReader.from_batches(PART, parts()))
            yield from con.sql(SUMS.format(least=least)).to_arrow_table().to_batches(50_000)


def _hashed(names: pa.Array) -> np.ndarray:
    """A 64-bit hash of each name; each different one is hashed once."""
    import xxhash

    names = names.dictionary_encode()
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, names.dictionary.to_pylist()), np.uint64, len(names.dictionary))
    return own[names.indices.to_numpy()]


def _cells(lang: np.ndarray, first: np.ndarray, second: np.ndarray, size: int) -> np.ndarray:
    """The bit of each pair, of `size`, from the hashes of its lang and words."""
    return (mix64(mix64(lang * M1 + first) * M1 + second) & np.uint64(size - 1)).astype(np.int64)


def bitmap(pairs: DataFrame) -> np.ndarray:
    """The bitmap of pairs (lang, gram), CELLS / 8 bytes at most; it is put together from segments of one size."""

    size = CELLS

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = pc.split_pattern(b.column(1), " ").flatten()
            c = _cells(_hashed(b.column(0)), _hashed(words.take(pa.array(np.arange(0, len(words), 2)))), _hashed(words.take(pa.array(np.arange(1, len(words), 2)))), size)
            yield pa.RecordBatch.from_arrays([pa.array(c // SEGMENT), pa.array(c % SEGMENT)], ["segment", "bit"])

    def segment(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(SEGMENT, np.uint8)
        bits[b["bit"].to_numpy()] = 1
        return pd.DataFrame({"segment": [key[0]], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    seen = pairs.select("lang", "gram").mapInArrow(cells, "segment bigint, bit bigint").distinct()
    out = np.zeros((size // SEGMENT, SEGMENT // 8), np.uint8)
    for r in seen.groupBy("segment").applyInPandas(segment, "segment bigint, bits binary").toLocalIterator():
        out[r["segment"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def _together(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The batches, so many put together that a table has about `size` bytes."""
    held = []
    for b in batches:
        held.append(b)
        if sum(x.nbytes for x in held) >= size:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _triples(batches: Iterator[pa.RecordBatch], marks: np.ndarray) -> Iterator[pa.Table]:
    """Groups of triples (lang, gram, m) of pieces whose pairs are both marked."""
    held, size = [], 0
    for own in _together(batches, PIECES):
        langs, texts, weights = (own.column(i).combine_chunks() for i in range(3))
        cut = pc.split_pattern(texts, " ")
        words, n = cut.flatten(), pc.list_value_length(cut).to_numpy()
        if len(words) < 3:
            continue
        of, h = np.repeat(np.arange(len(n)), n), _hashed(words)
        c = _cells(_hashed(langs)[of[:-1]], h[:-1], h[1:], 8 * len(marks))
        pair = (marks[c >> 3] >> (c & 7).astype(np.uint8) & 1).astype(bool) & (of[:-1] == of[1:])
        at = np.flatnonzero(pair[:-1] & pair[1:])
        grams = pc.binary_join_element_wise(*(words.take(pa.array(at + k)) for k in range(3)), " ")
        held.append(pa.table({"lang": langs.take(pa.array(of[at])), "gram": grams, "m": weights.take(pa.array(of[at]))}))
        size += len(at)
        if size >= GROUP:
            yield pa.concat_tables(held)
            held, size = [], 0
    if held:
        yield pa.concat_tables(held)


def pieces(docs: DataFrame) -> DataFrame:
    """lang, piece (its words with one blank between them), m (how often it stands in docs)."""
    p = F.explode(F.split(F.translate("text", UPPER, LOWER), r"[.,;:!?\x0A-\x0D]"))
    p = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), p.alias("piece"))
    words = F.trim(F.regexp_replace("piece", r"[\x20\x09]+", " "))
    return p.select("lang", words.alias("piece")).where("piece <> ''").groupBy("lang", "piece").agg(F.count(F.lit(1)).alias("m"))


def frequent(pieces: DataFrame, least: int, marks: np.ndarray | None = None) -> DataFrame:
    """lang, gram, f of n-grams with f >= least, once each: triples whose pairs are marked, or else words and pairs.

    Words bring rows with an empty gram, whose f adds up to a lang's words.
    """
    spark = pieces.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * tasks
    shared = None if marks is None else spark.sparkContext.broadcast(marks)

    size = 3 * GROUP  # three bytes to a word or pair, about

    def deal(batches):
        if shared is None:
            return _dealt(_together(batches, size), PAIRS, buckets)
        return _dealt(_triples(batches, shared.value), "select lang, gram, m from p", buckets)

    bounded_batches(spark)
    parts = pieces.select("lang", "piece", "m").mapInArrow(deal, "bucket bigint, part binary")
    parts = parts.repartition(tasks, "bucket").sortWithinPartitions("bucket")
    return parts.mapInArrow(lambda batches: _sums(batches, least), "lang string, gram string, f bigint")


def _cuts(candidates: DataFrame) -> DataFrame:
    """A row for each cut of each candidate: lang, gram, a, k, side, part."""
    w = F.split("gram", " ")
    part = lambda i, n: F.array_join(F.slice(w, i, n), " ")
    size = F.size(w)
    cuts = F.explode(F.transform(F.sequence(F.lit(1), size - 1), lambda k: F.struct(k.alias("k"), part(F.lit(1), k).alias("first"), part(k + 1, size - k).alias("rest"))))
    c = candidates.select("lang", "gram", F.col("f").alias("a"), cuts.alias("c"))
    return c.select("lang", "gram", "a", "c.k", F.explode(F.create_map(F.lit("l"), "c.first", F.lit("r"), "c.rest")).alias("side", "part"))


def scored(told: DataFrame) -> DataFrame:
    """lang, gram, a, l, r, score of the lowest-scoring cut of each candidate, from rows (lang, gram, a, k, side, p)."""
    one = lambda s: F.max(F.when(F.col("side") == s, F.col("p"))).alias(s)
    cuts = told.groupBy("lang", "gram", "a", "k").agg(one("l"), one("r"))
    exact = "cast({} as decimal(19,0)) * cast({} as decimal(19,0))"
    # a is neither above l nor above r, so a score is a million at most
    score = F.expr(f"(1000000BD * {exact.format('a', 'a')}) div ({exact.format('l', 'r')})").alias("score")
    best = cuts.select("lang", "gram", "a", "k", "l", "r", score).groupBy("lang", "gram", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.select("lang", "gram", "a", "b.l", "b.r", "b.score")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, inside: int = INSIDE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each lang, once those that a longer one explains are dropped."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    own = scratch.save(pieces(docs))
    counts = scratch.save(frequent(own, least))
    pairs = counts.where("gram <> ''").where(F.size(F.split("gram", " ")) == 2)
    triples = scratch.save(frequent(own, least, bitmap(pairs)).where("gram <> ''"))
    scratch.drop(own)
    n = counts.where("gram = ''").groupBy("lang").agg(F.sum("f").alias("n"))
    grams = counts.where("gram <> ''").unionByName(triples).select("lang", "gram", "f")
    longer = pairs.unionByName(triples)
    asked = scratch.save(_cuts(longer))
    held = asked.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("held"))
    found = scratch.save(held.join(grams.select("lang", F.col("gram").alias("part"), F.col("f").alias("p")), ["lang", "part"]))
    total = found.agg(F.coalesce(F.sum("held"), F.lit(0))).first()[0]
    told = spread_join(asked, found, ["lang", "part"], total)
    best = scored(told)
    # words of a phrase that stand inside a longer one
    w = F.split("gram", " ")
    parts = F.array_join(F.slice(w, F.col("i"), 2), " ")
    inner = longer.where(F.size(w) == 3).withColumn("i", F.explode(F.array(F.lit(1), F.lit(2)))).select("lang", parts.alias("gram"), F.col("f").alias("f3"))
    inner = inner.groupBy("lang", "gram").agg(F.max("f3").alias("f3"))
    best = best.join(inner, ["lang", "gram"], "left").where(f"f3 is null or 100 * cast(f3 as decimal(19,0)) < {inside} * cast(a as decimal(19,0))").drop("f3")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("gram")]
    # a lang's candidates are ranked in shares first, so that they don't meet in a task
    best = best.withColumn("_share", F.pmod(F.xxhash64("gram"), F.lit(64)))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_share").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(n, "lang").select("lang", "rank", F.col("gram").alias("phrase"), "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = rf"""
with d as (select coalesce(lang, 'und') lang, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') t from documents),
p as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) piece from d),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') ws from p),
g as (select lang, len(ws) k, unnest(ws) phrase, 1 size from w
      union all select lang, 0, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])), 2 from w
      union all select lang, 0, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])), 3 from w),
f as (select lang, phrase, size, count(*)::hugeint f from g group by all),
n as (select lang, sum(f)::bigint n from f where size = 1 group by lang),
c as (select lang, phrase, size, f a, string_split(phrase, ' ') ws from f where size > 1 and f >= {LEAST}),
cut as (select lang, phrase, size, a, k, array_to_string(ws[:k], ' ') x, array_to_string(ws[k + 1:], ' ') y from c, (values (1), (2)) v(k) where k < size),
s as (select cut.lang, cut.phrase, cut.size, a, k, l.f l, r.f r, 1000000 * a * a // (l.f * r.f) score
      from cut join f l on l.lang = cut.lang and l.phrase = x join f r on r.lang = cut.lang and r.phrase = y),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1),
i as (select lang, array_to_string(ws[j:j + 1], ' ') phrase, max(a) f3 from c, (values (1), (2)) v(j) where size = 3 group by all),
o as (select b.* from b left join i on i.lang = b.lang and i.phrase = b.phrase and b.size = 2 where f3 is null or 100 * f3 < {INSIDE} * a),
r as (select lang, row_number() over (partition by lang order by score desc, a desc, phrase) rank, phrase, a, l, r, score from o)
select lang, rank, phrase, a::bigint a, l::bigint l, r::bigint r, n, score::bigint score from r join n using (lang) where rank <= {TOP}
"""
