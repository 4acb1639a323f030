"""Alignment, collocations and token counts against plain versions."""

import collections
import hashlib
import itertools
import re

import pytest

from selenite.llm import op11_align, op12_phrases, op13_counts
from selenite.llm.op6_bpe import byte_letters

from .test_operators import SCHEMA, docs, none, rows  # noqa: F401

SF = "/root/testdata/sf0.001"
#: Texts at which two tokenizers may part: runs of blanks, signs, other scripts, special strings, bytes that no piece has.
HARD = [
    "a  b\n\nc\t d ", "   x", "x   ", "\n", " ", "\t \n ", "it's 'tis don't.x, y;z 12.5 ².³ ₂.a", "<s>x</s> <|endoftext|> <unk>", "a▁b", "日本語。テキスト、です", "x  y　 z  .",
    "ﬁ ① \x00 \x1c \x85 q", "🙂🙂 é ñ.ñ ß! Ω.ω я.ж", "a" * 3000, "×.× ÷, a× b÷.", "\r\n a\r b   c", "\\n .. ... ,, .a .\n. !?", "ab.cd,ef;gh:ij!kl?mn", "é.è ǎ,ǎ ɏ;ɐ:",
]


def spans(tokens):
    end, out = 0, {}
    for k, b in enumerate(tokens):
        end += len(b)
        out[end] = k
    return out


def plain_alignment(texts):
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(P.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    back = {c: i for i, c in byte_letters().items()}
    of_a = lambda i: bytes(back[c] for c in a.id_to_token(i))
    of_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    got, count = [], collections.Counter()
    for t in texts:
        x, y = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        tx, ty = [of_a(i) for i in x], [of_b(i) for i in y]
        if not t or b"".join(tx) != (" " + t).encode() or b"".join(ty) != (" " + t).encode():
            got.append(None)
            continue
        ex, ey, i, j, groups, links = spans(tx), spans(ty), 0, 0, [], []
        for cut in sorted(set(ex) & set(ey)):
            p, q = ex[cut] + 1, ey[cut] + 1
            groups.append(",".join(map(str, x[i:p])) + "|" + ",".join(map(str, y[j:q])))
            links.append((x[p - 1], y[q - 1]))
            i, j = p, q
        count.update(links)
        got.append((len(x), len(y), links, ";".join(groups)))
    top = collections.Counter()
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    return [(0,) * 6 + ("",) if r is None else (r[0], r[1], len(r[2]), len(r[2]), sum(count[x] == top[x[1]] for x in r[2]), sum(count[x] for x in r[2]), r[3]) for r in got]


@pytest.mark.parametrize("hot", [op11_align.STRETCHES, 3])
def test_alignment_of_hard_texts(spark, docs, hot, monkeypatch):  # noqa: F811
    """All texts together, as counts are corpus-wide; once with nearly all stretches asked for by shuffled rows."""
    monkeypatch.setattr(op11_align, "STRETCHES", hot)
    texts = [r[1] for r in rows()] + HARD + HARD[:2]
    own = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, `n_a.b` string").repartition(3)
    got = {r[0]: tuple(r[1:]) for r in op11_align.align(own).collect()}
    assert [got[i] for i in range(len(texts))] == plain_alignment(texts)


def test_alignment_of_a_whole_table(spark):
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r[0]: tuple(r[1:]) for r in op11_align.op11_token_alignment(spark, SF).collect()}
    want = [(*w[:-1], hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "") for w in plain_alignment([t for _, t in table])]
    assert len(got) == len(table) and [got[i] for i, _ in table] == want


def test_alignment_edges(spark, none):  # noqa: F811
    assert op11_align.align(none).count() == 0
    a, b = op11_align.default_paths()
    with open(a) as f, open(b, "rb") as g:
        spec, model = f.read(), g.read()
    with pytest.raises(ValueError):
        op11_align.Pair(open(a.replace("byte_bpe_50k", "word_bpe_49k")).read(), model)


def test_cuts_by_columns():
    """The cuts by Arrow are those by the pattern; a text that holds the mark itself is cut too."""
    import pyarrow as pa

    texts = HARD + [None, "", "a b", *("x" + chr(c) + " y" + chr(c) + "\n.z" for c in [*range(2, 300), 0x1680, *range(0x2000, 0x2030), 0x205F, 0x3000, 0xFEFF])]
    for own in (texts, [*texts, f"a{op11_align.MARK} b.", None]):
        words, at, n = op11_align.cut(*op11_align.marked(pa.array(own)))
        flat = [words[i].as_py() for i in at.tolist()]
        edge = [0, *itertools.accumulate(n.tolist())]
        assert [flat[a:b] for a, b in zip(edge, edge[1:])] == [[] if t is None else op11_align.stretches(" " + t) for t in own]


def test_cuts_are_safe():
    """Stretches encode to what whole texts encode to, for all that may stand around a cut."""
    import public_tokenizers as P
    from tokenizers import Tokenizer

    a, b = op11_align.default_paths()
    with open(a) as f, open(b, "rb") as g:
        pair = op11_align.Pair(f.read(), g.read())
    signs = ["a", "Z", "é", "²", "9", "ⅷ", "'s", "'", ".", ",", "!", "×", " ", "  ", "\n", "\t", "\r", "\x1c", "\x85", "\xa0", "\u3000", "語", "ь", "-", "<", "🙂", "\u0301"]
    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    texts = [x + y + z for x in signs for y in signs for z in signs] + [x + y + z + w for x in signs[:14] for y in signs[12:] for z in signs for w in "a. \n"]
    for t in texts:
        x, y = pair.encode(op11_align.stretches(" " + t))
        assert sum(map(list, x), []) == whole.encode(" " + t, add_special_tokens=False).ids, t
        assert sum(map(list, y), []) == pair.b.encode(t), t


def plain_collocations(data, least, top, inside):
    """data: (text, lang). Everything by counting one by one, in Python's own integers."""
    f = collections.defaultdict(collections.Counter)
    n = collections.Counter()
    for text, lang in data:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = [w for w in re.split("[ \t]", piece) if w]
            n[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, own in f.items():
        found = []
        for g, a in own.items():
            if len(g) < 2 or a < least:
                continue
            cuts = [(1_000_000 * a * a // (own[g[:k]] * own[g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            longer = [x for h, x in own.items() if len(h) > len(g) and x >= least and any(h[i : i + len(g)] == g for i in range(len(h)))]
            if not any(100 * x >= inside * a for x in longer):
                found.append((-score, -a, " ".join(g).encode(), own[g[:k]], own[g[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top])]
    return sorted(out)


NAMED = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("least, top, inside, group", [(2, 9, 50, 50), (3, 2000, 90, 10**6), (1, 3, 1, 10**6)])
def test_collocations_of_small_tables(spark, monkeypatch, least, top, inside, group):
    monkeypatch.setattr(op12_phrases, "GROUP", group)
    monkeypatch.setattr(op12_phrases, "CELLS", 1 << 17)
    base = ["new york city. new york; old york", "New\tYork   City\r\nnew york", "a b c a b c a b c", "é ü é ü\x0bé ü", "", None, " .,;", "x" * 9000 + " y", "ab cd. ab cd! ab cd? ab  cd : e ab cd e"]
    data = [(t, lang) for i, t in enumerate(base * 3) for lang in [[None, "en", "und", "de"][i % 4]]]
    docs = spark.createDataFrame([(1, t, lang, "z") for t, lang in data], "doc_id bigint, text string, lang string, gram string").repartition(5)  # noqa: F811
    got = op12_phrases.collocations(docs, least, top, inside)
    assert got.columns == NAMED
    assert sorted(map(tuple, got.collect())) == plain_collocations(data, least, top, inside)


def test_collocations_do_not_overflow(spark):
    """Counts whose products pass 64 bits: their score as Python's integers have it."""
    big = 4_000_000_123
    told = spark.createDataFrame([("en", "a b", big, 1, s, "x", n) for s, n in (("l", big + 7), ("r", big + 11))], "lang string, gram string, a long, k int, side string, part string, p long")
    (row,) = op12_phrases.scored(told).collect()
    assert row.score == 1_000_000 * big * big // ((big + 7) * (big + 11))


def test_collocations_edges(spark, none, docs):  # noqa: F811
    assert op12_phrases.collocations(none).count() == 0
    data = [(r.text, r.lang) for r in docs.collect()]
    assert sorted(map(tuple, op12_phrases.collocations(docs).collect())) == plain_collocations(data, 10, 2000, 50)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_are_the_library_s(spark, tmp_path, name):
    import public_tokenizers as P

    texts = [r[1] for r in rows()] + HARD + ["X y", "x Y", " x  y ", "<|startoftext|>A b", "<|startoftext|>a B"]
    docs = spark.createDataFrame([(i, t, b"x") for i, t in enumerate(texts)], "doc_id bigint, text string, content binary").repartition(3)  # noqa: F811
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(P.path(name))
        n = [len(t.encode(x or "", add_special_tokens=False)) for x in texts]
    else:
        import sentencepiece

        t = sentencepiece.SentencePieceProcessor(model_file=P.path(name))
        n = [len(t.encode(x or "")) for x in texts]
    got = {r[0]: tuple(r)[1:] for r in op13_counts.count_tokens(docs, f"file://{tmp_path}/c", P.path(name), limit=40).collect()}
    assert [got[i] for i in range(len(texts))] == [(len((x or "").encode()), k, k > 40) for x, k in zip(texts, n)]


def test_cache_of_counts(spark, tmp_path, docs, none):  # noqa: F811
    """Only texts that no run has met are encoded; other tokenizers have counts of their own; rows appended twice are read once."""
    import public_tokenizers as P

    a, b, cache = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json"), f"file://{tmp_path}/cache"
    stored = lambda: spark.read.schema(op13_counts.CACHED).parquet(cache).count()
    assert op13_counts.count_tokens(none, cache, a).count() == 0
    first = sorted(map(str, op13_counts.count_tokens(docs, cache, a).collect()))
    n = stored()
    assert n == len({r.text or "" for r in docs.collect()})
    assert sorted(map(str, op13_counts.count_tokens(docs, cache, a).collect())) == first and stored() == n
    more = docs.unionByName(spark.createDataFrame([(1, "quite new"), (2, "quite new"), (3, "QUITE new")], "doc_id bigint, text string"), True)
    assert op13_counts.count_tokens(more, cache, a).count() == docs.count() + 3 and stored() == n + 2
    spark.read.schema(op13_counts.CACHED).parquet(cache).write.mode("append").partitionBy("tokenizer").parquet(cache)
    assert sorted(map(str, op13_counts.count_tokens(docs, cache, a).collect())) == first
    before, own = stored(), op13_counts.Tokenizer(".json", open(b, "rb").read())
    assert own.content("QUITE new") == own.content("quite new") != own.content("<|endoftext|>QUITE") != own.content("<|endoftext|>quite")
    op13_counts.count_tokens(more, cache, b).collect()
    assert stored() == before + len({own.content(r.text) for r in more.collect()})
