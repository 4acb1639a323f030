"""Near duplicates by circulant MinHash.

Two permutations of the 32-bit shingle universe make the whole signature: the first spreads the
shingles, the second is used again and again, circularly shifted by one place for each coordinate.
Bands of coordinates name candidates, and every link is confirmed by the exact Jaccard index of the
full sets. Equal sets are collapsed first. Within a bucket of a band, members are compared with one
representative, then those outside the bucket's largest component with a random member of that. What
is then still in different components is compared pair by pair, block by block, unless the sizes or
parity sketches of the sets exclude the similarity; so no candidate is left out, while a group of
copies costs a few comparisons each. Only texts of pairs that the sketches let pass are moved.

Defined results: a document with fewer words than a shingle is one shingle of all its words; one
without words (or null, or empty) has an empty set and no links; rows without a doc_id have no links,
no component and are kept; rows that share a doc_id but not the text are judged apart; repeated rows
get equal results; equal sets are at similarity 1 and thus linked; an empty table gives an empty one;
texts of any length are taken whole, their signature in pieces of bounded size; other columns are
ignored, whatever their names, and deduplicated() keeps them.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_rows
from .common import BROADCAST_ROWS, Scratch, small, table
from .graph import components, merged

#: 32 bands of 5 coordinates: a pair with a Jaccard index of 0.8 shares no band with a chance of 3 in a million.
BANDS, WIDTH = 32, 5
CACHE = 400_000
#: Members of a bucket that a task compares at a time with those outside of the bucket's largest component.
BLOCK = 256
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Sorted distinct 64-bit hashes of a text's word shingles."""

    def __init__(self, words: int):
        import xxhash

        self.k, self.of, self.known = words, xxhash.xxh3_64_intdigest, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode().translate(LOWER).split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > CACHE:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = self.of(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k = min(self.k, len(h))
        acc = np.full(len(h) - k + 1, k, np.uint64)
        for j in range(k):
            acc = mix64(acc * M1 + h[j : len(h) - k + 1 + j])
        return np.unique(acc)


class Circulant:
    """Signatures of size BANDS * WIDTH, hashed to one key for each band."""

    def __init__(self, bands: int = BANDS, width: int = WIDTH):
        self.bands, self.width = bands, width
        self.shift = np.arange(bands * width, dtype=np.uint32)[:, None]
        self.odd = mix64(np.arange(1, width + 1, dtype=np.uint64) * M1) | np.uint64(1)
        self.salt = mix64(np.arange(1000, 1000 + bands, dtype=np.uint64) * M1)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        # first permutation: an affine map of the universe of 2**32
        x = (hashes >> np.uint64(32)).astype(np.uint32) * np.uint32(0x2C1B3C6D) + np.uint32(0x297A2D39)
        low = np.full(len(self.shift), 0xFFFFFFFF, np.uint32)
        for i in range(0, len(x), 512):
            m = x[None, i : i + 512] - self.shift  # the second one, at shifted places
            t = m >> np.uint32(16)
            m ^= t
            m *= np.uint32(0x85EBCA6B)
            np.right_shift(m, np.uint32(13), out=t)
            m ^= t
            m *= np.uint32(0xC2B2AE35)
            np.minimum(low, m.min(1), out=low)
        return low

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        s = self.signature(hashes).astype(np.uint64).reshape(self.bands, self.width)
        return mix64((s * self.odd).sum(1, dtype=np.uint64) + self.salt).view(np.int64)


#: Longs of a parity sketch.
SKETCH = 16


def parity(hashes: np.ndarray) -> np.ndarray:
    """For each of 1024 cells, whether an odd number of elements falls into it.

    The exclusive or of two such sketches is the sketch of the symmetric difference, so the number of its
    ones is never above the number of elements in which two sets differ.
    """
    odd = np.bincount((hashes >> np.uint64(5)) & np.uint64(64 * SKETCH - 1), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _near(big: str, small: str, percent: int):
    """Whether the sizes of two sets allow the similarity."""
    return F.least(big, small) * 100 >= F.greatest(big, small) * percent


def _may_link(x: str, y: str, xn: str, yn: str, percent: int):
    """False only if the sizes or the sketches of two sets exclude the similarity."""
    apart = sum((F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(1, SKETCH)), F.bit_count(F.col(x)[0].bitwiseXOR(F.col(y)[0])))
    return _near(xn, yn, percent) & ((100 + percent) * apart <= (100 - percent) * (F.col(xn) + F.col(yn)))


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, mark (of the text), n_shingles, key (128 bits of the set; null if empty), bands, sketch."""

    def make():
        shingles, circulant = Shingles(words), Circulant()

        def f(cols):
            n, key, bands, sketch = [], [], [], []
            for t in cols["text"]:
                h = shingles(t)
                n.append(len(h))
                key.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None)
                bands.append(circulant.keys(h) if len(h) else None)
                sketch.append(parity(h) if len(h) else None)
            return [cols["doc_id"], cols["mark"], n, key, bands, sketch]

        return f

    kinds = "doc_id bigint, mark bigint, n_shingles bigint, key binary, bands array<bigint>, sketch array<bigint>"
    return map_rows(docs.select("doc_id", F.xxhash64("text").alias("mark"), "text"), make, kinds)


def _representatives(sets: DataFrame, scratch: Scratch) -> tuple[DataFrame, bool]:
    """One row for each set: key, node, doc_id and mark (of the row that stands for it), n, bands, sketch; whether nodes are not all doc_ids.

    The node is the smallest doc_id of the set's rows; of sets that share it, all but one get a hash instead.
    """
    first = F.min(F.struct("doc_id", "mark", "n_shingles", "bands", "sketch")).alias("r")
    full = sets.where("key is not null and doc_id is not null").groupBy("key").agg(first)
    reps = scratch.save(full.select("key", "r.doc_id", "r.mark", F.col("r.n_shingles").alias("n"), "r.bands", "r.sketch"))
    twins = scratch.save(reps.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_c"), F.min("key").alias("_k")).where("_c > 1"))
    if not (n := twins.count()):
        return reps.withColumn("node", F.col("doc_id")), False
    own = F.when(F.col("_k").isNull() | (F.col("_k") == F.col("key")), F.col("doc_id")).otherwise(F.xxhash64("key", "doc_id"))
    return scratch.save(reps.join(small(twins, n), "doc_id", "left").withColumn("node", own).drop("_c", "_k")), True


class _Run:
    """What the rounds of one run share: documents, representatives and their tables."""

    def __init__(self, docs: DataFrame, words: int, percent: int):
        self.scratch, self.words, self.percent = Scratch(docs.sparkSession), words, percent
        self.sets = self.scratch.save(_sets(docs, words))
        self.reps, self.twins = _representatives(self.sets, self.scratch)
        self.texts = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").where("doc_id is not null and text is not null")

    def passing(self, pairs: DataFrame) -> DataFrame:
        """Of the pairs (a, b) those whose sizes and sketches don't exclude a link, each once."""
        x = self.reps.select(F.col("node").alias("a"), F.col("n").alias("an"), F.col("sketch").alias("sa"))
        y = self.reps.select(F.col("node").alias("b"), F.col("n").alias("bn"), F.col("sketch").alias("sb"))
        return pairs.distinct().join(x, "a").join(y, "b").where(_may_link("sa", "sb", "an", "bn", self.percent)).select("a", "b")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Of the pairs (a, b), all different, those whose full sets have 100 * intersection >= percent * union."""
        save, drop = self.scratch.save, self.scratch.drop
        pairs = save(pairs)
        n = pairs.count()
        if n == 0:
            return pairs
        ends = save(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        ends_n = ends.count()
        rows = save(self.reps.select("node", "doc_id", "mark").join(small(ends, ends_n), "node"))
        texts = save(self.texts.join(small(rows, ends_n), ["doc_id", "mark"]).select("node", "text"))
        if not texts.groupBy("node").count().where("count > 1").isEmpty():  # rows that are repeated
            texts = save(texts.groupBy("node").agg(F.min("text").alias("text")))
        both = texts.select(F.col("node").alias("a"), F.col("text").alias("ta")).join(small(pairs, n), "a")
        both = both.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
        words, percent = self.words, self.percent

        def make():
            shingles, last = Shingles(words), {}

            def f(cols):
                keep = []
                for a, b, ta, tb in zip(cols["a"], cols["b"], cols["ta"], cols["tb"]):
                    if b not in last:
                        last.clear()
                        last[b] = shingles(tb)
                    x, y = shingles(ta), last[b]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        keep.append((a, b))
                return [[a for a, _ in keep], [b for _, b in keep]]

            return f

        out = save(map_rows(both, make, "a bigint, b bigint"))
        drop(pairs, ends, rows, texts)
        return out

    def open_buckets(self, members: DataFrame, comp: DataFrame) -> DataFrame | None:
        """Members of buckets that hold several components, each with its own, the bucket's largest, and a random node of that.

        Buckets are judged by partial counts, so the members of a large one don't meet in a task.
        """
        named = comp.select(F.col("id").alias("node"), "component")
        labelled = self.scratch.save(members.select("band", "node").join(named, "node", "left").withColumn("component", F.coalesce("component", "node")))
        one = F.min(F.struct(F.xxhash64("band", "node").alias("h"), "node")).alias("_one")
        parts = labelled.groupBy("band", "component").agg(F.count(F.lit(1)).alias("_c"), one)
        most = F.max_by(F.struct(F.col("component").alias("main"), F.col("_one.node").alias("pick")), F.struct("_c", "component")).alias("_m")
        buckets = self.scratch.save(parts.groupBy("band").agg(F.count(F.lit(1)).alias("_n"), F.sum("_c").alias("total"), most).where("_n > 1"))
        n = buckets.count()
        rest = None
        if n:
            of = buckets.select("band", "total", "_m.main", "_m.pick")
            rest = self.scratch.save(labelled.join(small(of, n), "band"))
        self.scratch.drop(labelled, buckets)
        return rest

    def last_pairs(self, rest: DataFrame) -> DataFrame:
        """Pairs in different components that share a bucket and whose sketches don't exclude the similarity.

        One side only takes what lies outside of a bucket's largest component. A bucket is dealt into blocks of
        about BLOCK members, and that side meets each block in a task of its own.
        """
        blocks = F.ceil(F.col("total") / BLOCK).cast("int")
        wide = rest.join(self.reps.select("node", "n", "sketch"), "node").withColumn("_blocks", blocks)
        x = wide.where("component <> main").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        x = x.select("band", "block", "main", F.col("node").alias("a"), F.col("n").alias("an"), F.col("sketch").alias("sa"), F.col("component").alias("ac"))
        y = wide.withColumn("block", F.pmod(F.xxhash64("node", "band"), F.col("_blocks")).cast("int"))
        y = y.select("band", "block", F.col("node").alias("b"), F.col("n").alias("bn"), F.col("sketch").alias("sb"), F.col("component").alias("bc"))
        pairs = x.join(y, ["band", "block"]).where("ac <> bc and (bc = main or ac < bc)").where(_may_link("sa", "sb", "an", "bn", self.percent))
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def components(self) -> DataFrame:
        save, drop = self.scratch.save, self.scratch.drop
        rows = self.reps.select("node", "n", F.explode("bands").alias("band"))
        shared = rows.groupBy("band").agg(F.count(F.lit(1)).alias("_c"), F.min(F.struct("node", "n")).alias("_r")).where("_c > 1")
        members = save(rows.join(shared.select("band", F.col("_r.node").alias("first"), F.col("_r.n").alias("first_n")), "band"))
        stars = members.where("node <> first").where(_near("n", "first_n", self.percent)).select(F.col("node").alias("a"), F.col("first").alias("b"))
        comp = components(self.confirmed(self.passing(stars)), self.scratch)
        if (rest := self.open_buckets(members, comp)) is not None:
            again = rest.where("component <> main").select(F.col("node").alias("a"), F.col("pick").alias("b"))
            comp = merged(comp, self.confirmed(self.passing(again)), self.scratch)
            drop(rest)
            if (rest := self.open_buckets(members, comp)) is not None:
                comp = merged(comp, self.confirmed(self.last_pairs(rest)), self.scratch)
                drop(rest)
        drop(members)
        return comp


def _judged(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, mark, n_shingles, component_id, kept of each row."""
    run = _Run(docs, words, percent)
    found = run.reps.select("key", "doc_id", "node").join(run.components().withColumnRenamed("id", "node"), "node", "left")
    found = found.select(F.col("key").alias("_key"), F.coalesce("component", "node").alias("component_id"), F.col("doc_id").alias("_doc_id"))
    if run.twins:  # a component's smallest node need not be its smallest doc_id
        found = run.scratch.save(found.withColumnRenamed("component_id", "_component"))
        least = found.groupBy("_component").agg(F.min("_doc_id").alias("component_id"))
        found = found.join(least, "_component")
    found = run.scratch.save(found.select("_key", "component_id"))
    out = run.sets.select("doc_id", "mark", "n_shingles", "key")
    # empty sets have no key: one byte more than a key has never equals one, and deals them evenly
    none = F.concat(F.lit("0" * 17), F.xxhash64("doc_id", "mark").cast("string")).cast("binary")
    out = out.withColumn("key", F.coalesce("key", none))
    out = out.join(found, out["key"] == found["_key"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "mark", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept; one row for each row of docs."""
    return _judged(docs, words, percent).drop("mark")


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group: the one with the smallest doc_id. Documents without links stay.

    Rows are dropped by doc_id and text; a kept document whose row is repeated stays repeated.
    """
    gone = _judged(docs, words, percent).where("not kept").select(F.col("doc_id").alias("_gone"), F.col("mark").alias("_mark")).distinct()
    return docs.join(gone, (docs["doc_id"] == gone["_gone"]) & (F.xxhash64(docs["text"]) == gone["_mark"]), "left_anti")


def op10_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)
