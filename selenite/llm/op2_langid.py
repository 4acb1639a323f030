"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary. The probability of a
word is the sum over all its segmentations into pieces, found by the forward algorithm; pieces don't
cross words, so a text's log probability is the sum over its words. Training is expectation
maximisation: forward-backward over the word counts of labelled texts gives expected piece counts.

All languages that have a label are learned; the model has one number for each language and piece
(0.3 MB a language), whatever the size of the corpus.

Defined results: `und` with score 0 for null texts, texts without a letter, and where nothing was
learned (an empty table, no labels); ties go to the first language by code point; repeated rows get
equal results and count once in training; null languages are not learned from; texts and words of any
length are scored whole; other columns are ignored, whatever their names and types.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import beside, map_rows, plain
from .common import cut, table

#: The sample that the classifier is fitted on: about so many different texts of each language, by their hash.
TRAIN_DOCS, STEPS = 1500, 3
#: Words of up to so many letters are laid out together in one array; longer ones each by themselves.
SHORT = 48
#: Probability of a letter that the vocabulary lacks, in any language.
UNSEEN = 1e-7
#: Keeps the products of a word's probabilities within the range of doubles; cancels out.
SCALE = 30.0
#: Words that a worker keeps at most; fewer where a row of many languages would take much memory.
CACHE, CELLS = 400_000, 1 << 22
#: Letters of the texts whose new words are looked for at a time, and words that are laid out together (fewer for many languages).
PORTION, TOGETHER = 1 << 20, 2048

RUNS = re.compile(r"[^\W\d_]+").findall


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str | None = None) -> list[str]:
    """Lower-case pieces of letters; the mark of a word's start is a space."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or default_vocabulary())
    pieces = {sp.id_to_piece(i).replace("▁", " ").lower() for i in range(sp.get_piece_size())}
    ok = (p for p in pieces if p == " " or (p.lstrip(" ").isalpha() and p.rfind(" ") <= 0))
    return sorted(ok)


def marked(word: str) -> str:
    """A run of letters as scored: with its start marked; other numerals in it don't count."""
    w = word if word.isalpha() else "".join(filter(str.isalpha, word))
    return " " + w if w else ""


class Trie:
    """The vocabulary as sorted arrays: (state, letter) -> state, and the piece that ends in a state (-1 if none)."""

    def __init__(self, pieces: list[str]):
        states, edges, ends = {"": 0}, {}, {}
        for i, x in enumerate(pieces):
            for n in range(1, len(x) + 1):
                if x[:n] not in states:
                    states[x[:n]] = len(states)
                    edges[states[x[: n - 1]] << 21 | ord(x[n - 1])] = states[x[:n]]
            ends[states[x]] = i
        self.keys = np.array(sorted(edges), np.int64)
        self.next = np.array([edges[k] for k in sorted(edges)], np.int64)
        self.piece = np.full(len(states), -1, np.int64)
        for s, i in ends.items():
            self.piece[s] = i
        self.unseen, self.depth = len(pieces), max(map(len, pieces), default=0)

    def walk(self, letters: np.ndarray, stop: np.ndarray) -> list[tuple[np.ndarray, int, np.ndarray]]:
        """(starts, length, pieces) for each length: all places walk down together, a letter at a time, up to their stops."""
        at, state, found = np.arange(len(letters)), np.zeros(len(letters), np.int64), []
        for n in range(self.depth):
            ok = at + n < stop[at]
            at, state = at[ok], state[ok]
            if not len(at):
                break
            key = state << 21 | letters[at + n]
            j = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[j] == key
            at, state = at[ok], self.next[j[ok]]
            hit = self.piece[state] >= 0
            found.append((at[hit], n + 1, self.piece[state[hit]]))
        return found


def _letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


class Lattice:
    """All pieces of all places of some words, sorted by (end, start) for a pass over them in numpy.

    For words of up to SHORT letters. A found piece is packed into one integer: end, start (6 bits each),
    word (19), piece (17).
    """

    def __init__(self, words: list[str], trie: Trie):
        size = np.fromiter(map(len, words), np.int64, len(words))
        letters = _letters("".join(words))
        word = np.repeat(np.arange(len(words)), size)
        first = np.repeat(np.cumsum(size) - size, size)
        single, codes = np.zeros(len(letters), bool), []
        for x, n, piece in trie.walk(letters, first + np.repeat(size, size)):
            if n == 1:
                single[x] = True
            codes.append((x - first[x] + n) << 42 | (x - first[x]) << 36 | word[x] << 17 | piece)
        x = np.flatnonzero(~single)
        codes.append((x - first[x] + 1) << 42 | (x - first[x]) << 36 | word[x] << 17 | trie.unseen)
        c = np.sort(np.concatenate(codes))
        self.words, self.size = len(words), size
        self.end, self.start, self.at, self.piece = c >> 42, c >> 36 & 63, c >> 17 & (1 << 19) - 1, c & (1 << 17) - 1
        cuts = np.flatnonzero(np.diff(c >> 36)) + 1
        self.parts = list(zip([0, *cuts], [*cuts, len(c)])) if len(c) else []

    def forward(self, p: np.ndarray) -> np.ndarray:
        """alpha[word, place, column] for the probabilities p[piece, column]."""
        a = np.zeros((self.words, int(self.size.max(initial=0)) + 1, p.shape[1]))
        a[:, 0] = 1
        for x, y in self.parts:  # within a part each word occurs once
            k = self.at[x:y]
            a[k, self.end[x]] += a[k, self.start[x]] * p[self.piece[x:y]]
        return a

    def expected(self, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected counts of the pieces, for one column of probabilities."""
        a = self.forward(p)
        b = np.zeros_like(a)
        rows = np.arange(self.words)
        b[rows, self.size] = 1
        for x, y in reversed(self.parts):
            k = self.at[x:y]
            b[k, self.start[x]] += b[k, self.end[x]] * p[self.piece[x:y]]
        total = a[rows, self.size, 0]
        share = a[self.at, self.start, 0] * p[self.piece, 0] * b[self.at, self.end, 0] / total[self.at]
        return np.bincount(self.piece, share * weight[self.at], len(p))


class LongWord:
    """The same for one word of any length: alpha is kept at 1 in sum from place to place, its logarithm apart."""

    def __init__(self, word: str, trie: Trie):
        letters = _letters(word)
        self.n, self.depth = len(letters), max(trie.depth, 1)
        found = trie.walk(letters, np.full(self.n, self.n))
        single = np.zeros(self.n, bool)
        for x, n, _ in found:
            if n == 1:
                single[x] = True
        lone = np.flatnonzero(~single)
        starts = np.concatenate([lone, *(x for x, _, _ in found)])
        ends = np.concatenate([lone + 1, *(x + n for x, n, _ in found)])
        pieces = np.concatenate([np.full(len(lone), trie.unseen), *(k for _, _, k in found)])
        order = np.lexsort((starts, ends))
        self.start, self.end, self.piece = starts[order], ends[order], pieces[order]
        self.cuts = np.searchsorted(self.end, np.arange(self.n + 2))

    def forward(self, p: np.ndarray) -> np.ndarray:
        """The logarithm of the probability for each column."""
        a, log = np.zeros((self.depth + 1, p.shape[1])), np.zeros(p.shape[1])
        a[0] = 1
        for e in range(1, self.n + 1):
            x, y = self.cuts[e], self.cuts[e + 1]
            now = (a[self.start[x:y] % (self.depth + 1)] * p[self.piece[x:y]]).sum(0)
            a /= now
            log += np.log(now)
            a[e % (self.depth + 1)] = 1
        return log

    def expected(self, p: np.ndarray, weight: float) -> np.ndarray:
        """Expected counts of the pieces, for one column of probabilities."""
        q, grown, share = p[self.piece, 0], np.ones(self.n + 1), np.zeros(len(self.piece))
        for e in range(1, self.n + 1):  # grown[e]: alpha at e by alpha at e - 1
            x, y = self.cuts[e], self.cuts[e + 1]
            share[x:y] = q[x:y] / [np.prod(grown[s + 1 : e]) for s in self.start[x:y]]
            grown[e] = share[x:y].sum()
            share[x:y] /= grown[e]
        cut_at = np.zeros(self.n + 1)  # the share of segmentations that cut at a place
        cut_at[self.n] = 1
        for e in range(self.n, 0, -1):
            x, y = self.cuts[e], self.cuts[e + 1]
            share[x:y] *= cut_at[e]
            np.add.at(cut_at, self.start[x:y], share[x:y])
        return np.bincount(self.piece, share * weight, len(p))


def expected(words: list[str], trie: Trie, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected counts of the pieces over words of any length."""
    short = np.array([len(w) <= SHORT for w in words], bool)
    e = Lattice([w for w, ok in zip(words, short) if ok], trie).expected(p, weight[short])
    for i in np.flatnonzero(~short):
        e += LongWord(words[i], trie).expected(p, weight[i])
    return e


def _scaled(p: np.ndarray, pieces: list[str]) -> np.ndarray:
    """Probabilities with the unseen letter's row, each times SCALE to the power of its length."""
    lens = np.array([*map(len, pieces), 1], float)[:, None]
    return np.vstack([p, np.full((1, p.shape[1]), UNSEEN)]) * SCALE**lens


def train(labelled: DataFrame, path: str | None = None, docs_per_lang: int = TRAIN_DOCS, steps: int = STEPS) -> dict:
    """The model {langs, pieces, p} from rows with text and lang.

    The sample takes texts by their hash, at a rate that gives about docs_per_lang different ones of each
    language. Words are counted and expectations summed on Spark; the driver gets one row for each
    language and piece, bounded by the vocabulary.
    """
    spark = labelled.sparkSession
    rows = labelled.select("text", "lang", F.xxhash64("text").alias("_h")).where("text is not null and lang is not null")
    counts = {r["lang"]: max(r["n"], 1) for r in rows.groupBy("lang").agg(F.approx_count_distinct("_h").alias("n")).collect()}
    langs, pieces = sorted(counts), vocabulary(path)
    if not langs:
        return {"langs": [], "pieces": pieces, "p": np.zeros((len(pieces), 0))}
    rate = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, docs_per_lang / n))])
    unit = F.pmod(F.col("_h"), F.lit(1 << 30)).cast("double") / float(1 << 30)
    # a text that is repeated, however often, counts once; its copies meet in partial aggregates
    sample = rows.where(unit < F.try_element_at(rate, F.col("lang"))).groupBy("lang", "_h").agg(F.first("text").alias("text"))

    def count_words():
        def f(cols):
            c = Counter()
            for text, lang in zip(cols["text"], cols["lang"]):
                c.update((lang, s) for w in RUNS(text.lower()) if (s := marked(w)))
            return [[k[0] for k in c], [k[1] for k in c], list(c.values())]

        return f

    words = cut(map_rows(sample.select("text", "lang"), count_words, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    column, trie = {x: i for i, x in enumerate(langs)}, Trie(pieces)
    p = np.full((len(pieces), len(langs)), 1 / len(pieces))
    for _ in range(steps):
        now = spark.sparkContext.broadcast((_scaled(p, pieces), trie))

        def expect(now=now):
            q, own = now.value

            def f(cols):
                out = []
                lang, word, n = np.array([column[x] for x in cols["lang"]]), cols["word"], np.array(cols["n"], float)
                for c in np.unique(lang):
                    own_rows = np.flatnonzero(lang == c)
                    e = expected([word[i] for i in own_rows], own, q[:, [c]], n[own_rows])[:-1]
                    hit = np.flatnonzero(e)
                    out.append((np.full(len(hit), c), hit, e[hit]))
                return [np.concatenate(x) for x in zip(*out)]

            return f

        got = map_rows(words, expect, "c int, piece int, e double").groupBy("c", "piece").agg(F.sum("e").alias("e")).toPandas()
        e = np.zeros_like(p)
        e[got["piece"], got["c"]] = got["e"]
        p = (e + 0.01) / (e.sum(0) + 0.01 * len(pieces))
    # rounded, so that the order in which partial sums meet leaves no trace
    return {"langs": langs, "pieces": pieces, "p": np.round(p, 12) + 1e-12}


class Numbered(dict):
    """Numbers words as they are asked for; those asked for the first time stand in `new`."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = n = len(self)
        return n


class Scorer:
    """Log probabilities of words in all languages, kept for words met before."""

    def __init__(self, model: dict):
        self.langs, self.n = model["langs"], len(model["langs"])
        self.trie = Trie(model["pieces"])
        self.p = _scaled(model["p"], model["pieces"])
        self.clear()

    def clear(self) -> None:
        self.rows = Numbered()
        self.table = np.zeros((1 << 16, self.n + 1))

    def learn(self, words: list[str]) -> None:
        """Rows of the table for the words that were numbered last."""
        got = np.zeros((len(words), self.n + 1))
        # words of about a length share a lattice
        scored = sorted(((k, s) for k, w in enumerate(words) if (s := marked(w))), key=lambda x: len(x[1]))
        short = [x for x in scored if len(x[1]) <= SHORT]
        step = max(32, min(TOGETHER, 4 * TOGETHER // max(self.n, 1)))
        for i in range(0, len(short), step):
            lat = Lattice([s for _, s in short[i : i + step]], self.trie)
            a = lat.forward(self.p)[np.arange(lat.words), lat.size]
            got[[k for k, _ in short[i : i + step]]] = np.column_stack([np.log(a) - np.log(SCALE) * lat.size[:, None], np.ones(lat.words)])
        for k, s in scored[len(short) :]:
            got[k] = [*(LongWord(s, self.trie).forward(self.p) - np.log(SCALE) * len(s)), 1]
        n = len(self.rows) - len(words)
        while n + len(words) > len(self.table):
            self.table = np.vstack([self.table, np.zeros_like(self.table)])
        self.table[n : n + len(words)] = got

    def texts(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language and its posterior probability for each text."""
        sums = np.zeros((len(texts), self.n + 1))
        k = 0
        while k < len(texts):
            if len(self.rows) > min(CACHE, CELLS // (self.n + 1)):
                self.clear()
            # the new words of some texts are scored together
            first, size, at = k, 0, []
            while k < len(texts) and size < PORTION:
                words = RUNS(texts[k].lower()) if texts[k] else []
                at.append(np.fromiter(map(self.rows.__getitem__, words), np.int32, len(words)))
                size += len(texts[k] or "")
                k += 1
            if self.rows.new:
                self.learn(self.rows.new)
                self.rows.new = []
            for i, x in enumerate(at, first):
                sums[i] = self.table[x].sum(0)
        if not self.n:
            return ["und"] * len(texts), [0.0] * len(texts)
        log, best = sums[:, :-1], sums[:, :-1].argmax(1)
        post = 1 / np.exp(log - log.max(1, keepdims=True)).sum(1)
        some = sums[:, -1] > 0
        return [self.langs[b] if ok else "und" for b, ok in zip(best, some)], np.where(some, post, 0.0).tolist()


SCORED = "lang_pred string, score double"


def _scored(spark: SparkSession, model: dict):
    shared = spark.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(shared.value)
        return lambda cols: scorer.texts(cols["text"])

    return make


def predict(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """The columns keep, with lang_pred and score from the text alone."""
    docs = docs.select(*[F.col(f"`{c.replace('`', '``')}`") for c in dict.fromkeys(["text", *keep])])
    out = beside(docs, ["text"], _scored(docs.sparkSession, model), SCORED, () if "text" in keep else ("text",))
    at = [plain(docs.columns)[docs.columns.index(c)] for c in keep]
    return out.select(*at, "lang_pred", "score").toDF(*keep, "lang_pred", "score")


def held_out():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    out = predict(docs, model, ["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def kept_languages(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents whose language is found with a probability of `least` or more; a null lang is filled in.

    Where no row has a lang nothing is learned, so nothing but texts without a letter is rejected.
    """
    model = train(docs)
    if not model["langs"]:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    own = plain(docs.columns)
    at = own[docs.columns.index("lang")]
    out = beside(docs, ["text"], _scored(docs.sparkSession, model), SCORED).where((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return out.withColumn(at, F.coalesce(at, "lang_pred")).select(*own).toDF(*docs.columns)
