"""Alignment of two tokenizers: the byte offsets where tokens of both end cut a text into groups.

Both tokenizers treat a text as a row of stretches that they encode independently of one another, such as a word with
the blank before it. So each different stretch is encoded and aligned once, whatever texts it stands in, with relations
throughout: tokens by posexplode, their ends by windowed cumulative lengths, the links where both sides are equal in
stretch and end, groups by running counts of the cuts, and tokens brought together by stretch and group. A stretch's links count as often
as it stands in the corpus. A document's figures are then the sums over its stretches and its groups their groups in a row.

The stretches that stand most often in a corpus are broadcast, at most STRETCHES of them and STRETCHES * 64 bytes; all
others are asked for by rows that are shuffled to where they are and sent back to the documents.

Defined results: texts that are null, empty, or that a tokenizer doesn't give back byte for byte have no tokens; strings
of special tokens are plain text; repeated rows and rows that share a doc_id count each and get equal results, doc_id may
be null; all ids that tie for an id's highest count are best; stretches and texts of any length are taken whole; an empty
table gives an empty one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import collections
import hashlib
import itertools
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import map_arrow, map_rows
from .common import Scratch, spread_join, table
from .op6_bpe import byte_letters

STRETCHES = 200_000
#: Stretches that are encoded as one text.
RUN = 64
NUMBERS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
#: Letters after which, and signs before which, a text may be cut; and all places where it is.
LETTER, SIGN = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-ɏ", ".,;:!?"
stretches = re.compile(rf"(?<=\S)(?=[ \n])|(?<=[{LETTER}])(?=[{SIGN}])").split
BLANK = "▁"
#: What \S excludes, spelled out for a library that knows fewer blanks, and a mark that hardly any text holds.
BLANKS, MARK = "\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000", "\x01"


def marked(texts: pa.Array, first: str = " ") -> tuple[pa.Array, pa.Array]:
    """The texts, with a blank (or another first) before each and a mark at every cut; and as they are those that hold the mark themselves."""
    texts = pa.array(texts, pa.string())
    held = pc.match_substring(texts, MARK)
    full = pc.binary_join_element_wise(first, pc.if_else(held, None, texts), "")
    for before, after in ((f"[^{BLANKS}]", "[ \n]"), (f"[{LETTER}]", f"[{SIGN}]")):
        full = pc.replace_substring_regex(full, f"({before})({after})", rf"\1{MARK}\2")
    return full, pc.if_else(held, texts, None)


def cut(full: pa.Array, raw: pa.Array, first: str = " ") -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The stretches of marked() texts (a null has none): the different ones, which of them stands at each place, and how many places a text has."""
    lists = pc.split_pattern(full, MARK)
    if raw.null_count < len(raw):
        own = zip(lists.to_pylist(), raw.to_pylist())
        lists = pa.array([a if t is None else stretches(first + t) for a, t in own], pa.list_(pa.string()))
    words = lists.flatten().dictionary_encode()
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
    return words.dictionary, words.indices.to_numpy().astype(np.int64), n


class Pair:
    """A byte-level vocabulary (A, a .json file's text) and a piece model with byte fallback (B, a .model file's bytes).

    ValueError if either could join what lies on the two sides of a cut.
    """

    def __init__(self, a: str, b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has a core of its own
        import sentencepiece
        import tokenizers

        self.a, self.b = tokenizers.Tokenizer.from_str(a), sentencepiece.SentencePieceProcessor(model_proto=b)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        back = {c: i for i, c in byte_letters().items()}
        size = self.a.get_vocab_size(with_added_tokens=True)
        letters = [self.a.id_to_token(i) or "" for i in range(size)]
        self.a_len = np.array([len(t) if all(c in back for c in t) else len(t.encode()) for t in letters], np.int32)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        isbyte = [self.b.is_byte(i) for i in range(len(pieces))]
        self.b_len = np.array([1 if x else len(p.replace(BLANK, " ").encode()) for p, x in zip(pieces, isbyte)], np.int32)
        own = [p for i, p in enumerate(pieces) if not (isbyte[i] or self.b.is_control(i) or self.b.is_unknown(i))]
        joins = re.compile(rf"[^{BLANK}]{BLANK}|\n|[{LETTER}][{SIGN}]")
        if sum(isbyte) < 256 or any(map(joins.search, own)):
            raise ValueError("the piece model joins words, or lacks bytes")
        if self.a.normalizer or not str(self.a.pre_tokenizer).startswith("ByteLevel"):
            raise ValueError("the first tokenizer is not byte-level")
        probe = self.b.encode("\nx")
        if self.b.id_to_piece(probe[0]) != BLANK or self.b.id_to_piece(probe[1]) != "<0x0A>":
            raise ValueError("the piece model adds no blank")

    def whole(self, text: str | None) -> bool:
        """Whether tokens of both give a blank and the text back."""
        return bool(text) and self.b.normalize(text).replace(BLANK, " ") == " " + text

    def encode(self, parts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = [e.ids for e in self.a.encode_batch_fast(parts, add_special_tokens=False)]
        # a line end before a stretch keeps the blank that the model adds, and is a token of its own
        b = [e[2:] for e in self.b.encode(["\n" + p for p in parts], num_threads=1)]
        return a, b

    def columns(self, parts: pa.Array) -> list[pa.Array]:
        """ids and lengths of both, as lists. Stretches that may stand one after the other are encoded together and cut by their bytes."""
        names = parts.to_pylist()
        alone = np.array([w[0] != " " or w[-1].isspace() for w in names], bool)
        order = np.concatenate([np.flatnonzero(alone), np.flatnonzero(~alone)])
        k, rest = int(alone.sum()), [names[i] for i in order[int(alone.sum()) :]]
        runs = ["".join(rest[i : i + RUN]) for i in range(0, len(rest), RUN)]
        size = np.array([len(w.encode()) for w in rest], np.int64)
        out = []
        for ids, lengths in zip(self.encode([names[i] for i in order[:k]] + runs), (self.a_len, self.b_len)):
            own = np.fromiter(itertools.chain.from_iterable(ids), np.int32, sum(map(len, ids)))
            each = np.array(list(map(len, ids[:k])), np.int64)
            joined = own[each.sum() :]
            ends = np.cumsum(lengths[joined])
            upto = np.searchsorted(ends, np.cumsum(size), "right")  # tokens up to each stretch's end
            if len(size) and ((ends[upto - 1] != np.cumsum(size)).any() or upto[-1] != len(joined)):
                raise ValueError("a token lies across a cut")
            each = np.concatenate([each, np.diff(upto, prepend=0)])
            offsets = np.concatenate([[0], np.cumsum(each)])
            back = np.argsort(order)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(own)).take(pa.array(back))
            flat = lists.flatten().to_numpy()
            out += [lists, pa.ListArray.from_arrays(lists.offsets, pa.array(lengths[flat]))]
        return out


def _packed(texts: pa.Array) -> list[bytes | None]:
    import zstandard

    z = zstandard.ZstdCompressor(3)
    return [None if t is None else z.compress(t.encode()) for t in texts.to_pylist()]


def _texts(packed: pa.Array) -> pa.Array:
    import zstandard

    z = zstandard.ZstdDecompressor()
    return pa.array([None if b is None else z.decompress(b) for b in packed.to_pylist()], pa.binary()).cast(pa.string())


def _tokens(units: DataFrame, pair) -> DataFrame:
    """cid, stretch, n (how often it stands in the texts), and of both tokenizers the ids and lengths."""

    def counted():
        def f(batch):
            words, at, _ = cut(_texts(batch.column(0)), batch.column(1))
            return [words, pa.array(np.bincount(at, minlength=len(words)))]

        return f

    def encoded():
        p = pair()
        return lambda batch: [batch.column(0), batch.column(1), *p.columns(batch.column(0))]

    n = map_arrow(units.select("z", "raw"), counted, "stretch string, n bigint").groupBy("stretch").agg(F.sum("n").alias("n"))
    kinds = "stretch string, n bigint, a array<int>, a_len array<int>, b array<int>, b_len array<int>"
    return map_arrow(n, encoded, kinds).withColumn("cid", F.monotonically_increasing_id())


def _aligned(tokens: DataFrame) -> DataFrame:
    """cid, n, n_a, n_b, n_groups, groups (as text), links (a, b) of each stretch.

    Tokens of both sides are dealt by stretch once, and all that follows finds a stretch's rows together: the join of
    both sides by stretch and end is therefore a grouping by them, and so is that of a group's tokens.
    """
    def side(ids: str, first: bool) -> DataFrame:
        t = F.posexplode(F.arrays_zip(F.col(ids).alias("id"), F.col(f"{ids}_len").alias("len"))).alias("pos", "t")
        return tokens.select("cid", "n", F.lit(first).alias("first"), t).select("cid", "n", "first", "pos", "t.id", "t.len")

    upto = Window.partitionBy("cid", "first").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    t = side("a", True).unionByName(side("b", False)).repartition("cid").withColumn("end", F.sum("len").over(upto))
    own = lambda first: F.max(F.when(F.col("first") == first, F.col("id")))
    ends = t.groupBy("cid", "end").agg(F.max("n").alias("n"), own(True).alias("a"), own(False).alias("b"))
    cut = F.col("a").isNotNull() & F.col("b").isNotNull()
    before = Window.partitionBy("cid").orderBy("end").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("g", F.count(F.when(cut, True)).over(before))
    listed = lambda c: F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("end", c))))
    g = ends.groupBy("cid", "g").agg(F.max("n").alias("n"), listed("a").alias("a"), listed("b").alias("b"))
    ids = lambda c: F.array_join(F.transform(c, lambda x: x[c].cast("string")), ",")
    last = lambda c: F.element_at(c, -1)[c].alias(c)
    g = g.select("cid", "n", "g", F.size("a").alias("x"), F.size("b").alias("y"), F.concat(ids("a"), F.lit("|"), ids("b")).alias("t"), F.struct(last("a"), last("b")).alias("link"))
    rows = F.sort_array(F.collect_list(F.struct("g", "t", "link"))).alias("r")
    out = g.groupBy("cid").agg(F.max("n").alias("n"), F.sum("x").alias("n_a"), F.sum("y").alias("n_b"), F.count(F.lit(1)).alias("n_groups"), rows)
    return out.select("cid", "n", "n_a", "n_b", "n_groups", F.array_join(F.transform("r", lambda x: x["t"]), ";").alias("groups"), F.transform("r", lambda x: x["link"]).alias("links"))


class Alignment:
    """The tables of an alignment: units (row, doc_id, z: the packed text with its cuts, raw: texts that hold the mark), pairs (a, b, count, best), stats (a row for each stretch)."""

    def __init__(self, docs: DataFrame, a_path: str, b_path: str):
        spark = docs.sparkSession
        with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:
            spec = spark.sparkContext.broadcast((f.read(), g.read()))
        Pair(*spec.value)
        self.pair = lambda: Pair(*spec.value)
        self.spark, self.scratch = spark, Scratch(spark)
        save, drop = self.scratch.save, self.scratch.drop
        self.units = save(self._units(docs))
        tokens = save(_tokens(self.units, self.pair))
        aligned = save(_aligned(tokens))
        links = aligned.select("cid", "n", F.explode("links").alias("l")).select("cid", "n", "l.a", "l.b")
        pairs = save(links.groupBy("a", "b").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("held")))
        top = pairs.groupBy("b").agg(F.max("count").alias("_top"))  # as many rows as B has ids at most
        self.pairs = pairs.join(F.broadcast(top), "b").select("a", "b", "count", (F.col("count") == F.col("_top")).alias("best"), "held")
        total = pairs.agg(F.coalesce(F.sum("held"), F.lit(0))).first()[0]
        told = spread_join(links.drop("n"), self.pairs, ["a", "b"], total)
        sums = told.groupBy("cid").agg(F.count(F.lit(1)).alias("n_links"), F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("count").alias("count_sum"))
        names = tokens.select("cid", "stretch")
        self.stats = save(aligned.drop("links").join(sums, "cid").join(names, "cid").select("stretch", "n", *[F.col(c).cast("long") for c in NUMBERS], "groups"))
        drop(aligned, tokens)

    def _units(self, docs: DataFrame) -> DataFrame:
        pair = self.pair

        def make():
            p = pair()

            def f(batch):
                whole = pa.array([t if p.whole(t) else None for t in batch.column(2).to_pylist()], pa.string())
                full, raw = marked(whole)
                return [batch.column(0), batch.column(1), pa.array(_packed(full), pa.binary()), raw]

            return f

        rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
        return map_arrow(rows, make, "row bigint, doc_id bigint, z binary, raw string")

    def documents(self, last: str, made) -> DataFrame:
        """doc_id, NUMBERS and a last column, made(the text's groups), for each row."""
        # a stretch takes one place for every 64 bytes; those with most uses a place are broadcast, as far as there are places
        places = F.ceil(F.octet_length("stretch") / 64)
        level = F.floor(F.log2(F.col("n") / places) * 8)
        left, least = STRETCHES, None
        for r in self.stats.groupBy(level.alias("level")).agg(F.sum(places).alias("places")).orderBy(F.desc("level")).collect():
            left -= r["places"]
            if left < 0:
                break
            least = r["level"]
        large = F.lit(False) if least is None else level >= least
        hot = self.stats.where(large).drop("n").toPandas()
        known = {w: i for i, w in enumerate(hot["stretch"])}
        hot = self.spark.sparkContext.broadcast((known, hot[NUMBERS].to_numpy(np.int64), hot["groups"].tolist()))

        def places(z, raw, known):
            """Of each place its text, the broadcast stretch there or -1, and else the question that it belongs to; and the questions.

            A text asks for each of its other stretches once, in the order of their first places.
            """
            words, at, n = cut(_texts(z), raw)
            of = np.repeat(np.arange(len(n)), n)
            hot = np.fromiter((known.get(w, -1) for w in words.to_pylist()), np.int64, len(words))[at]
            rare = np.flatnonzero(hot < 0)
            _, first, which = np.unique(of[rare] * len(words) + at[rare], return_index=True, return_inverse=True)
            order = np.argsort(first)  # by place, so by text too
            question = np.empty(len(order), np.int64)
            question[order] = np.arange(len(order))
            asked = rare[first[order]]
            return n, of, hot, rare, question[which], of[asked], words.take(pa.array(at[asked]))

        def asked():
            known = hot.value[0]

            def f(batch):
                *_, of, stretch = places(batch.column(1), batch.column(2), known)
                k = np.arange(len(of)) - np.searchsorted(of, of)
                return [batch.column(0).take(pa.array(of)), pa.array(k, pa.int32()), stretch]

            return f

        def summed():
            known, numbers, texts = hot.value
            texts = pa.array(texts, pa.string())

            def f(batch):
                n, of, at, rare, question, _, stretch = places(batch.column(1), batch.column(2), known)
                # answers are numbers and groups in one text, in the order of the questions
                told = pc.split_pattern(batch.column(3).flatten(), " ", max_splits=len(NUMBERS)).flatten()
                columns = [told.take(pa.array(np.arange(i, len(told), len(NUMBERS) + 1))) for i in range(len(NUMBERS) + 1)]
                if len(columns[0]) != len(stretch):
                    raise ValueError("questions and answers differ")
                more = np.stack([c.cast(pa.int64()).to_numpy() for c in columns[:-1]], 1)
                every, names = np.concatenate([numbers, more]), pa.concat_arrays([texts, columns[-1].cast(pa.string())])
                place = at.copy()
                place[rare] = len(texts) + question
                upto = np.concatenate([np.zeros((1, len(NUMBERS)), np.int64), np.cumsum(every[place], 0)])
                edge = np.concatenate([[0], np.cumsum(n)])
                total = upto[edge[1:]] - upto[edge[:-1]]
                groups = pc.binary_join(pa.ListArray.from_arrays(pa.array(edge, pa.int32()), names.take(pa.array(place))), ";")
                return [batch.column(0), *map(pa.array, total.T), pa.array(list(map(made, groups.to_pylist())), pa.string())]

            return f

        want = map_arrow(self.units.select("row", "z", "raw"), asked, "row bigint, k int, stretch string")
        rest = self.stats.where(~large).select("stretch", F.concat_ws(" ", *NUMBERS, "groups").alias("told"))
        told = want.join(rest, "stretch").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("k", "told"))).alias("r"))
        both = self.units.join(told, "row", "left").select("doc_id", "z", "raw", F.col("r.told").alias("told"))
        return map_arrow(both, summed, f"doc_id bigint, {', '.join(f'{c} bigint' for c in NUMBERS)}, {last} string")


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, NUMBERS, groups (as `a1,a2|b1;a3|b2`) of each row."""
    a, b = default_paths()
    return Alignment(docs, a_path or a, b_path or b).documents("groups", lambda groups: groups)


def op11_token_alignment(spark, sf_dir: str) -> DataFrame:
    digest = lambda groups: hashlib.sha256(groups.encode()).hexdigest() if groups else ""
    return Alignment(table(spark, sf_dir, "documents"), *default_paths()).documents("groups_sha256", digest)
