"""Secret scans whose false positives a random forest removes.

Candidates are long tokens with digits, or values assigned to a telling name. The forest judges each
by its length, the transitions between its characters, how much of it words of a dictionary cover,
the path, and the neighbouring words. It is trained from a labelled table of findings, and so are the
weights of the words of paths and neighbourhoods; the words of the dictionary are the longer pieces of
a public vocabulary.

Defined results: null and empty texts have no candidates and no rows; a candidate that occurs twice
is two rows; names may have any length and form; of a long token and an assigned value or its name that
overlap the value counts; candidates and texts
of any length are looked at whole; a score of exactly a half is a secret; an empty table gives an empty
one; repeated rows get repeated results; a null path counts as an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import map_rows
from .common import table

#: Rows of a labelled table that training takes at most, by a hash.
TRAIN_ROWS = 20_000
LONG = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}={0,2}")
#: A name of any length, a sign, and the value that follows; each name is looked at once, so this takes linear time.
ASSIGNED = re.compile(r"(?<![\w.-])([\w.-]++)[\"'\]]{0,2}+\s*+[:=]{1,2}+\s*+[\"']?+(?=([A-Za-z0-9+/_.=!@#$%^&*-]{6,}))")
TELLING = re.compile(r"(?i)token|secret|passwd|password|api[_-]?key|access[_-]?key|private[_-]?key|auth")
#: One of these is in each name that is telling.
NAMES = ("token", "secret", "passw", "auth", "key")
WORDS = re.compile("[a-z]+").findall
#: Words before and after a candidate that count as its neighbours, and rows that a word is in at least to have a weight.
BEFORE, AFTER, SEEN = 4, 2, 4
FEATURES = ("length", "entropy", "kinds", "switches", "repeats", "runs", "hex", "digits", "upper", "covered", "prefix", "dotted", "assigned", "quoted", "near", "near_most", "near_least", "path", "path_words")
#: Fixed prefixes of well-known kinds of keys.
PREFIX = re.compile(r"AKIA|ASIA|ghp_|gho_|xox[abp]-|sk_live_|sk-|AIza|eyJ|glpat-|npm_")


def dictionary(path: str | None = None) -> set[str]:
    """Lower-case words of four letters and more among the pieces of a public vocabulary."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    words = (sp.id_to_piece(i).lstrip("▁").lower() for i in range(sp.get_piece_size()))
    return {w for w in words if len(w) >= 4 and w.isascii() and w.isalpha()}


def covered(value: str, words: set[str], longest: int) -> float:
    """Share of the characters within words of the dictionary (of `longest` letters at most), taken longest first from the left."""
    low, i, n = value.lower(), 0, 0
    while i < len(low):
        for k in range(min(longest, len(low) - i), 3, -1):
            if low[i : i + k] in words:
                n, i = n + k, i + k
                break
        else:
            i += 1
    return n / max(1, len(low))


def neighbours(before: str, after: str) -> list[str]:
    """The words beside a candidate; one that touches it, such as the name of a value, is among them."""
    return ["<" + w for w in WORDS(before.lower())[-BEFORE:]] + [">" + w for w in WORDS(after.lower())[:AFTER]]


def path_words(path: str) -> list[str]:
    return ["/" + w for w in WORDS(path.lower())]


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def features(value: str, before: str, after: str, path: str, assigned: bool, known: tuple) -> list[float]:
    """What the forest sees; known has the dictionary, its longest word's length, and the learned weights of words."""
    v, n, counts = value, len(value), Counter(value)
    words, longest, weights = known
    kinds = list(map(_kind, v))
    near, place = ([weights.get(w, 0.0) for w in own] for own in (neighbours(before, after), path_words(path)))
    return [
        math.log2(len(value)),
        -sum(c / n * math.log2(c / n) for c in counts.values()),
        len(set(kinds)),
        sum(a != b for a, b in zip(kinds, kinds[1:])) / n,
        sum(a == b for a, b in zip(v, v[1:])) / n,
        sum(abs(ord(a) - ord(b)) == 1 for a, b in zip(v, v[1:])) / n,
        float(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", v) is not None),
        sum(k == 0 for k in kinds) / n,
        sum(k == 2 for k in kinds) / n,
        covered(v, words, longest),
        float(PREFIX.match(v) is not None),
        (v.count("-") + v.count("_") + v.count("/")) / n,
        float(assigned),
        float(before[-1:] in "\"'" and before[-1:] != ""),
        sum(near),
        max(near, default=0.0),
        min(near, default=0.0),
        sum(place),
        float(len(place)),
    ]


def candidates(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, whether assigned to a telling name), by start."""
    out, taken, low, at = {}, [], text.casefold(), 0
    some = any(x in low for x in NAMES)
    while some and (m := ASSIGNED.search(text, at)):
        if TELLING.search(m[1]):
            taken += [m.span(1), m.span(2)]
            out[m.span(2)] = True
            at = m.end(2)
        else:
            at = m.end()
    # both are in order and free of overlaps of their own, so one pass finds those between them
    i = 0
    for m in LONG.finditer(text):
        a, b = m.span()
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if i == len(taken) or taken[i][0] >= b:
            out[a, b] = False
    return sorted((a, b, k) for (a, b), k in out.items())


def labelled_findings(n: int = 3000, seed: int = 11) -> list[tuple[str, str, int, int, int]]:
    """A labelled table of findings: text, path, start, end, and whether it is a secret (1) or not (0)."""
    r = random.Random(seed)
    words = sorted(dictionary())
    pick = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    true = (
        lambda: pick("0123456789abcdef", r.choice((32, 40, 64))), lambda: pick(base64, r.choice((24, 32, 40, 44))), lambda: "AKIA" + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16),
        lambda: "ghp_" + pick(base64[:62], 36), lambda: "sk_live_" + pick(base64[:62], 24), lambda: pick(base64[:62] + "!@#$%&*", r.randint(10, 18)),
    )
    false = (
        lambda: "-".join(r.choice(words) for _ in range(3)) + f"-{r.randint(1, 99)}", lambda: "".join(r.choice(words).capitalize() for _ in range(3)) + str(r.randint(1, 9)), lambda: r.choice(("changeme123456789", "your-token-here-123", "xxxxxxxxxxxxxxxx1", "0000000000000000", "example-secret-1")),
        lambda: f"{pick('0123456789abcdef', 8)}-{pick('0123456789abcdef', 4)}-4{pick('0123456789abcdef', 3)}-a{pick('0123456789abcdef', 3)}-{pick('0123456789abcdef', 12)}", lambda: pick("0123456789", r.randint(16, 20)), lambda: "/".join(r.choice(words) for _ in range(4)) + "2", lambda: pick("0123456789abcdef", r.choice((32, 40, 64))), lambda: "1234567890abcdefgh",
    )
    lead = {1: ("token = \"", "api_key: ", "SECRET_KEY=", "password = '", "Authorization: Bearer ", "access_key=\"", "{w} {w} token = \"", "my secret is "), 0: ("commit ", "sha256: ", "see {w} ", "id=", "uuid: ", "{w} {w} {w} ", "path {w}/", "card ", "checksum ", "order no ")}
    leaves = {1: ("settings.env", "prod.yml", "deploy.cfg", "credentials.json", "app.properties"), 0: ("fixtures/data.json", "readme.md", "package.lock", "example.ini", "test_data.py")}
    either = ("main.py", "index.html", "", "src0", "notes.txt")
    rows = []
    for i in range(n):
        label = i % 2
        value = r.choice(true if label else false)()
        # now and then a harmless value in a telling place: only its form gives it away
        head = r.choice(lead[1 if label or (not re.fullmatch("[0-9a-f]{32,}", value) and r.random() < 0.3) else 0])
        head = re.sub(r"\{w\}", lambda _: r.choice(words), head)
        tail = r.choice(("\" and more", "\n", " ", "' # set", ""))
        before = " ".join(r.choice(words) for _ in range(r.randrange(4)))
        head = f"{before} {head}" if before and r.random() < 0.5 else head
        # half of the paths say nothing, and the others have folders of any name
        leaf = r.choice(either) if r.random() < 0.5 else r.choice(leaves[label])
        path = "/".join([*(r.choice(words) for _ in range(r.randrange(3))), leaf]) if leaf else ""
        rows.append((head + value + tail, path, len(head), len(head) + len(value), label))
    return rows


def labelled_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled_findings(), "text string, path string, start int, end int, label int")


def word_weights(labelled: DataFrame) -> dict[str, float]:
    """For each word that is near findings or in their paths, how much it speaks for a secret: a logarithm of odds."""

    def make():
        def f(cols):
            own = [sorted({*neighbours(t[:a], t[b:]), *path_words(p or "")}) for t, p, a, b in zip(cols["text"], cols["path"], cols["start"], cols["end"])]
            return [cols["label"], own]

        return f

    rows = map_rows(labelled, make, "label int, words array<string>").select("label", F.explode("words").alias("word"))
    n = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    of = lambda k: (F.count_if(F.col("label") == k) + 1) / F.lit(n.get(k, 0) + 2.0)
    seen = rows.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.log(of(1) / of(0)).alias("w")).where(F.col("n") >= SEEN)
    return {r["word"]: r["w"] for r in seen.collect()}


class Forest:
    """What scan() needs: the words and weights of the features, and the forest over them."""

    def __init__(self, weights: dict[str, float], model):
        words = dictionary()
        self.known, self.model = (words, max(map(len, words)), weights), model


def fit(labelled: DataFrame, trees: int = 30, depth: int = 7) -> Forest:
    """From a labelled table of findings (text, path, start, end, label), TRAIN_ROWS of its rows by a hash at most.

    The weights of words are learned from one half of them and the forest from the other, so it can't trust them too much.
    """
    rows = labelled.orderBy(F.xxhash64("text", "start", "label"), "text", "start", "label").limit(TRAIN_ROWS)
    half = F.pmod(F.xxhash64("start", "text", "label"), F.lit(2))
    weights = word_weights(rows.where(half == 0))
    known = Forest(weights, None).known

    def make():
        def f(cols):
            out = []
            for t, p, a, b in zip(cols["text"], cols["path"], cols["start"], cols["end"]):
                assigned = any(x <= a < y and k for x, y, k in candidates(t))
                out.append(features(t[a:b], t[max(0, a - 80) : a], t[b : b + 40], p or "", assigned, known))
            return [cols["label"], out]

        return f

    rows = map_rows(rows.where(half == 1), make, "label int, f array<double>")
    rows = rows.select(F.col("label").cast("double").alias("label"), array_to_vector("f").alias("features")).repartition(1).sortWithinPartitions("label", F.col("features").cast("string"))
    return Forest(weights, RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=5, featureSubsetStrategy="sqrt").fit(rows))


FOUND = "doc_id bigint, start bigint, end bigint, value_sha256 string, f array<double>"


def scan(docs: DataFrame, forest: Forest, path: str = "source") -> DataFrame:
    """A row for each candidate: doc_id, start, end (code points), value_sha256, score, is_secret. No value leaves the scan."""
    shared = docs.sparkSession.sparkContext.broadcast(forest.known)

    def make():
        known = shared.value

        def f(cols):
            rows = []
            for d, t, p in zip(cols["doc_id"], cols["text"], cols["path"]):
                for a, b, assigned in candidates(t or ""):
                    rows.append((d, a, b, hashlib.sha256(t[a:b].encode()).hexdigest(), features(t[a:b], t[max(0, a - 80) : a], t[b : b + 40], p or "", assigned, known)))
            return list(zip(*rows)) if rows else [[]] * 5

        return f

    found = map_rows(docs.select("doc_id", "text", docs[f"`{path}`"].cast("string").alias("path")), make, FOUND)
    judged = forest.model.transform(found.withColumn("features", array_to_vector("f")))
    score = F.round(vector_to_array("probability").getItem(1), 6)
    return judged.select("doc_id", "start", "end", "value_sha256", score.alias("score"), (score >= 0.5).alias("is_secret"))


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), fit(labelled_table(spark)))
