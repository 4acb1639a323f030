"""Byte-pair encoding and decoding with a public vocabulary.

A word is merged over a contiguous array: its parts, and beside each part the rank of its pair with
the next one. The smallest rank is sought by a scan, its boundary deleted, and the ranks on both
sides refreshed. A scan costs the word's length, so words beyond SHORT bytes go through a heap
over linked parts instead, with the same result.

Defined results: a null text is an empty one and has no tokens; special tokens written in a text
become their ids; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import beside, free, map_rows, plain
from .common import table

SHORT = 160
#: Words kept with their ids in a worker; longer words than KEEP_CHARS are not kept.
CACHE, KEEP_CHARS = 250_000, 64
NONE = 1 << 40


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[int, str]:
    """The visible letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the rest from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def load(spec: str) -> dict:
    """Tables of a byte-level vocabulary, from its JSON text."""
    d = json.loads(spec)
    vocab, letters = d["model"]["vocab"], byte_letters()
    back = {c: b for b, c in letters.items()}
    special = {t["content"]: t["id"] for t in d.get("added_tokens", [])}
    pair, new = {}, []
    for m in d["model"]["merges"]:
        a, b = m if isinstance(m, list) else m.split(" ")
        pair.setdefault(vocab[a] << 20 | vocab[b], len(new))
        new.append(vocab[a + b])
    piece = {i: t.encode() for t, i in special.items()}
    piece |= {i: bytes(back[c] for c in t) for t, i in vocab.items() if t not in special}
    return {"pair": pair, "new": new, "first": [vocab[letters[b]] for b in range(256)], "piece": piece, "special": special}


def merge_short(ids: list[int], pair: dict[int, int], new: list[int]) -> list[int]:
    get = pair.get
    ranks = [get(a << 20 | b, NONE) for a, b in zip(ids, ids[1:])]
    while ranks:
        low = min(ranks)
        if low == NONE:
            break
        i = ranks.index(low)
        ids[i] = new[low]
        del ids[i + 1], ranks[i]
        if i:
            ranks[i - 1] = get(ids[i - 1] << 20 | ids[i], NONE)
        if i < len(ranks):
            ranks[i] = get(ids[i] << 20 | ids[i + 1], NONE)
    return ids


def merge_long(ids: list[int], pair: dict[int, int], new: list[int]) -> list[int]:
    n = len(ids)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pair.get(ids[i] << 20 | ids[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
            continue
        ids[i], alive[j], after[i] = new[r], False, after[j]
        if after[i] < n:
            before[after[i]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y < n and (r := pair.get(ids[x] << 20 | ids[y])) is not None:
                heapq.heappush(heap, (r, x, ids[x], ids[y]))
    return [t for t, live in zip(ids, alive) if live]


class Bpe:
    """Encodes and decodes; ids are held as little-endian unsigned 32-bit integers."""

    def __init__(self, spec: str):
        import public_tokenizers
        import regex

        self.t = load(spec)
        self.words = regex.compile(public_tokenizers.PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.t["special"], key=len, reverse=True))) + ")").split if self.t["special"] else None
        self.known: dict[str, bytes] = {}
        self.pieces = [self.t["piece"].get(i, b"") for i in range(max(self.t["piece"]) + 1)]

    def word(self, w: str) -> bytes:
        first, pair, new = self.t["first"], self.t["pair"], self.t["new"]
        ids = [first[b] for b in w.encode()]
        ids = merge_short(ids, pair, new) if len(ids) <= SHORT else merge_long(ids, pair, new)
        return np.array(ids, "<u4").tobytes()

    def plain(self, text: str) -> bytes:
        known, words = self.known, self.words(text)
        missing = [w for w in set(words) if w not in known]
        if not missing:
            return b"".join(map(known.__getitem__, words))
        own = {w: self.word(w) for w in missing}
        if len(known) + len(own) > CACHE:
            known.clear()
        known |= {w: ids for w, ids in own.items() if len(w) <= KEEP_CHARS}
        get = known.get
        return b"".join([get(w) or own.get(w) or self.word(w) for w in words])

    def encode(self, text: str) -> bytes:
        special = self.t["special"]
        if self.cut is None or not any(s in text for s in special):
            return self.plain(text)
        return b"".join(np.array([special[p]], "<u4").tobytes() if p in special else self.plain(p) for p in self.cut(text) if p)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def _spec(path: str | None) -> str:
    with open(path or default_vocabulary(), encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The documents' own columns, with n_tokens and token_ids instead of the text.

    Own columns of those two names get an underscore before them.
    """
    spec = docs.sparkSession.sparkContext.broadcast(_spec(vocabulary))

    def make():
        bpe = Bpe(spec.value)

        def f(cols):
            ids = [np.frombuffer(bpe.encode(t or ""), "<u4").astype("i4") for t in cols["text"]]
            return [[len(x) for x in ids], ids]

        return f

    out = beside(docs, ["text"], make, "n_tokens bigint, token_ids array<int>", ("text",))
    kept = [(a, b) for a, b in zip(plain(docs.columns), docs.columns) if b != "text"]
    names, new = [], ["n_tokens", "token_ids"]
    for _, b in kept:
        names.append(free(b, names + new))
    return out.select(*[a for a, _ in kept], *new).toDF(*names, *new)


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    spec = spark.sparkContext.broadcast(_spec(None))
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def make():
        bpe = Bpe(spec.value)

        def f(cols):
            ids = [bpe.encode(t or "") for t in cols["text"]]
            return [cols["doc_id"], [len(x) // 4 for x in ids], [sha(x) for x in ids], [sha(bpe.decode(x).encode()) for x in ids]]

        return f

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id"), F.col("text"))
    return map_rows(docs, make, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
