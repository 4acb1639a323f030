"""Token counts through a digest cache.

A count is stored under two digests: that of the content as the tokenizer's own normaliser leaves it, and that of
the tokenizer (its file, its library and the library's version). Documents are joined to the stored counts; of the
digests that are missing, one text each is encoded by the library, and the counts are appended to the cache. Where a
tokenizer provably encodes the stretches of a text apart, a worker gives the library each stretch that is new to it.

Only texts that are missing are moved, compressed, and one of each digest from a task. A digest that holds a large
part of all rows is joined by broadcast (see spread_join). An append that is cut short leaves rows that are right by
themselves, and rows that two runs append twice are read once, so a cache can be shared by runs and survives lost ones.

Defined results: a null text is an empty one, with no bytes and no tokens; repeated rows give repeated results; rows
that share a text share a count, whatever their doc_id, which may be null; texts of any length are encoded whole; an
empty table gives an empty one and appends nothing; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_arrow, map_rows
from .common import Scratch, shared_dir, small, spread_join, table
from .op11_align import cut, marked, stretches

LIMIT = 512
#: Stretches of text whose counts a worker keeps, and the longest that it keeps.
KEPT, KEPT_CHARS = 500_000, 64
CACHED = "content binary, n_tokens bigint, tokenizer string"


class Tokenizer:
    """Counts and normal forms of a .json file (tokenizers) or a .model file (sentencepiece), given as bytes."""

    def __init__(self, kind: str, spec: bytes):
        if kind == ".json":
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has a core of its own
            import tokenizers

            t = tokenizers.Tokenizer.from_str(spec.decode())
            t.no_truncation()
            t.no_padding()
            added = [x.content for x in t.get_added_tokens_decoder().values()]
            own = t.normalizer.normalize_str if t.normalizer else None
            # added tokens are cut out of the text before it is normalised
            self.normal = lambda s: "n" + own(s) if own and not any(x in s for x in added) else "t" + s
            self.library = lambda texts: [len(e) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
            self.apart = self.in_stretches(json.loads(spec))
            version = f"tokenizers {tokenizers.__version__}"
        elif kind == ".model":
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_proto=spec)
            self.normal = lambda s: "n" + sp.normalize(s) if s else "t"
            self.library, self.apart = lambda texts: [len(e) for e in sp.encode(texts, num_threads=1)], False
            version = f"sentencepiece {sentencepiece.__version__}"
        else:
            raise ValueError(f"neither .json nor .model: {kind}")
        self.known: dict[str, int] = {}
        self.digest = hashlib.sha256(version.encode() + b"\n" + spec).hexdigest()[:32]

    @staticmethod
    def in_stretches(spec: dict) -> bool:
        """Whether a text's tokens are those of its stretches: a byte-level vocabulary that cuts words by the usual pattern."""
        cut = spec.get("pre_tokenizer") or {}
        plain = not spec.get("normalizer") and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")
        words = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        alone = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and len(stretches(t["content"])) == 1 for t in spec.get("added_tokens", []))
        return bool(plain and words and alone)

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; of stretches that are new to the worker the library is asked once."""
        if not self.apart:
            texts = texts.to_pylist()
            parts = (self.library(texts[i : i + 32]) for i in range(0, len(texts), 32))  # encodings take many times the text's memory
            return np.array([n for p in parts for n in p], np.int64)
        words, at, n = cut(*marked(texts, ""), "")
        words = words.to_pylist()
        if len(self.known) > KEPT:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        counts = dict(zip(new, self.library(new)))
        self.known |= {w: k for w, k in counts.items() if len(w) <= KEPT_CHARS}
        each = np.fromiter((k if (k := self.known.get(w)) is not None else counts[w] for w in words), np.int64, len(words))
        upto = np.concatenate([[0], np.cumsum(each[at])])
        edge = np.concatenate([[0], np.cumsum(n)])
        return upto[edge[1:]] - upto[edge[:-1]]

    def content(self, text: str | None) -> bytes:
        return hashlib.blake2b(self.normal(text or "").encode(), digest_size=16).digest()


def stored(spark, cache: str, tokenizer: str) -> DataFrame:
    """content, n_tokens of the cache's rows for a tokenizer, each content once; empty where there is no cache yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], CACHED).drop("tokenizer")
    rows = spark.read.schema(CACHED).parquet(cache).where(F.col("tokenizer") == tokenizer)
    return rows.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, cache: str, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than limit tokens) of each row; new counts are appended to the folder cache."""
    spark = docs.sparkSession
    kind = os.path.splitext(path)[1]
    with open(path, "rb") as f:
        spec = f.read()
    version, scratch, file = Tokenizer(kind, spec).digest, Scratch(spark), spark.sparkContext.broadcast(spec)

    def keys():
        t = Tokenizer(kind, file.value)
        return lambda cols: [cols["doc_id"], [len((x or "").encode()) for x in cols["text"]], [t.content(x) for x in cols["text"]]]

    def packed():
        import zstandard

        t, z, seen = Tokenizer(kind, file.value), zstandard.ZstdCompressor(1), set()

        def f(cols):
            new = {k: x or "" for x in cols["text"] if (k := t.content(x)) not in seen}
            seen.update(new)
            return [list(new), [z.compress(x.encode()) for x in new.values()]]

        return f

    def counted():
        import zstandard

        t, z = Tokenizer(kind, file.value), zstandard.ZstdDecompressor()

        def f(batch):
            texts = pa.array([z.decompress(x) for x in batch.column(1).to_pylist()], pa.binary()).cast(pa.string())
            return [batch.column(0), pa.array(t.count(texts))]

        return f

    rows = scratch.save(map_rows(docs.select("doc_id", "text"), keys, "doc_id bigint, n_bytes bigint, content binary"))
    held = scratch.save(rows.groupBy("content").agg(F.count(F.lit(1)).alias("held")))
    missing = scratch.save(held.select("content").join(stored(spark, cache, version), "content", "left_anti"))
    if n := missing.count():
        texts = map_rows(docs.select("text"), packed, "content binary, z binary").join(small(missing, n), "content", "left_semi")
        texts = texts.groupBy("content").agg(F.first("z").alias("z"))
        new = map_arrow(texts, counted, "content binary, n_tokens bigint")
        new.withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache)
    facts = scratch.save(held.join(stored(spark, cache, version), "content"))
    total = facts.agg(F.coalesce(F.sum("held"), F.lit(0))).first()[0]
    scratch.drop(missing, held)
    out = spread_join(rows, facts, ["content"], total)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op13_token_counts(spark, sf_dir: str) -> DataFrame:
    """Over a cache of its own, so that a run encodes every text that it is given."""
    import public_tokenizers

    cache = f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}"
    return count_tokens(table(spark, sf_dir, "documents"), cache, public_tokenizers.path("byte_bpe_50k.json"))
