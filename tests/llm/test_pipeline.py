import collections
import hashlib
import math
import re

import numpy as np
import pytest

import corpus_pipeline
from selenite.llm import op2_langid, op9_pii

from .test_operators import brute_components, brute_spans, plain_forward

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"


def languages(rows, model):
    """The rows that a plain forward sum gives a language with a probability of a half or more; a null lang is filled in."""
    of, unseen = dict(zip(model["pieces"], model["p"])), np.full(len(model["langs"]), op2_langid.UNSEEN)
    known = {}
    for r in rows:
        words = [w for w in ("".join(filter(str.isalpha, x)) for x in re.findall(r"[^\W\d_]+", (r["text"] or "").lower())) if w]
        for w in words:
            if w not in known:
                known[w] = plain_forward(" " + w, of, unseen)
        if words:
            total = sum(known[w] for w in words)
            if 1 / np.exp(total - total.max()).sum() >= 0.5:
                yield r | {"lang": r["lang"] or model["langs"][int(total.argmax())]}


def redacted(rows, field):
    for r in rows:
        t = r["text"] or ""
        base = brute_spans(t)
        spans = sorted(base + field.spans([t], [base])[0], key=lambda s: (s[0], op9_pii.ORDER[s[1]], s[2]))
        out, at = "", 0
        for a, kind, b in spans:
            if a >= at:
                out += t[at:a] + f"<{kind.upper()}>"
            at = max(at, b)
        out += t[at:]
        yield r | {"text": out, "n_chars": len(out)}


def mixed(rows):
    """Each row as often as its source's stream, in the order of md5 and run over thrice at most, begins it before the target."""
    size = {id(r): len(re.findall(WORD, r["text"])) for r in rows}
    total = collections.Counter()
    for r in rows:
        total[r["source"]] += size[id(r)]
    sources = sorted(total, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(sources)}
    full, target = set(), {}
    while True:  # a source at its ceiling leaves the rest to the others
        left = sum(total.values()) - sum(3 * total[s] for s in full)
        share = sum(weight[s] for s in sources if s not in full)
        target = {s: 3 * total[s] if s in full else left * weight[s] / share for s in sources}
        more = {s for s in sources if s not in full and target[s] >= 3 * total[s]}
        if not more:
            break
        full |= more
    at = collections.Counter()
    for r in sorted(rows, key=lambda r: hashlib.md5(str(r["doc_id"]).encode()).hexdigest()):
        s, n = r["source"], size[id(r)]
        if n:
            yield from [r] * sum(at[s] + k * total[s] < math.floor(target[s]) for k in range(3))
            at[s] += n


@pytest.fixture(scope="module")
def field():
    return op9_pii.Field(op9_pii.train(op9_pii.labelled_rows()))


def test_run_equals_plain_stages(spark, field):
    import public_tokenizers
    import tokenizers

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    rows = list(languages(rows, op2_langid.train(docs)))
    component, _ = brute_components({r["doc_id"]: r["text"] for r in rows}, 5)
    kept = [r for r in rows if component[r["doc_id"]] == r["doc_id"]]
    assert len(kept) < len(rows)
    clean = list(redacted(kept, field))
    assert sum(a["text"] != b["text"] for a, b in zip(kept, clean)) > 3
    out = list(mixed(clean))
    tok = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for r in out:
        ids = tok.encode(r["text"], add_special_tokens=False).ids
        want[r["doc_id"], r["lang"], r["source"], r["n_chars"], len(ids), tuple(ids)] += 1
    got = corpus_pipeline.run(spark, SF).select("doc_id", "lang", "source", "n_chars", "n_tokens", "token_ids").collect()
    assert collections.Counter((*r[:5], tuple(r[5])) for r in got) == want


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, counts, first = docs.columns, [], docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF).persist()
        counts.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == names
    assert counts[0] == first.count()  # every one has a language
    assert counts[1] < counts[0] and counts[2] == counts[1]
    assert {"doc_id", "n_tokens", "token_ids"} <= set(docs.columns)
