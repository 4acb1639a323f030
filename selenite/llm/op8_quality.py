"""Quality rules: lines that too many documents of a host share are removed, and depleted documents rejected.

Lines are normalised (words joined by one space, A-Z lower-cased, digits as 0) and hashed; for each
host the documents that hold a line are counted, each once however often it repeats the line. Exact
copies are documents too. A document is rejected if the lines above the limit leave less than a share
of its words, or by the base rules (too short, or made of repeated 3-word windows).

Defined results: a null text has no words and fails the base rule on length, as an empty one does; a
null source is a host of its own; each row is a document, so repeated rows count as several and get
equal results; a line on exactly the limit of documents stays; lines without words are none; texts of
any length are taken whole; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_rows
from .common import cut, spread_join, table

MAX_DOCS, LEAST_LEFT = 20, 0.3
NORMAL = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", b"abcdefghijklmnopqrstuvwxyz000000000")


def repeated_words(words: list) -> int:
    """Words within 3-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if len(ids) == n:
        return 0
    pair = a[:-1] * len(ids) + a[1:]
    if len(ids) > 2_000_000:
        pair = np.unique(pair, return_inverse=True)[1]
    _, where, count = np.unique(pair[:-1] * len(ids) + a[2:], return_inverse=True, return_counts=True)
    again = count[where] > 1
    mark = np.zeros(n, bool)
    for k in range(3):
        mark[k : n - 2 + k] |= again
    return int(mark.sum())


def base_figures(text: str | None) -> tuple[int, int, int, int, int, dict[bytes, int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the words of each normalised line."""
    raw = (text or "").encode()
    words = raw.split()
    blanks = len(raw) - sum(map(len, words))
    seen, dup, lines = set(), 0, {}
    for line in raw.split(b"\n"):
        if own := line.split():
            dup += line in seen
            seen.add(line)
            key = b" ".join(own).translate(NORMAL)
            lines[key] = lines.get(key, 0) + len(own)
    return len(words), len(text or "") - blanks, len(raw) - len(raw.translate(None, b"#*$%&|<>")), dup, repeated_words(words), lines


def line_frequency_rules(docs: DataFrame, max_docs: int = MAX_DOCS, least_left: float = LEAST_LEFT) -> DataFrame:
    """doc_id, the base figures, base_failed, removed_words and kept; one row for each row of docs."""

    def make():
        import xxhash

        of = lambda b: xxhash.xxh3_64_intdigest(b) - (1 << 63)

        def f(cols):
            got = [base_figures(t) for t in cols["text"]]
            lines = [[{"h": of(k), "w": n} for k, n in g[5].items()] for g in got]
            return [cols["row"], cols["doc_id"], cols["host"], *([g[i] for g in got] for i in range(5)), lines]

        return f

    host = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    kinds = "row bigint, doc_id bigint, host string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, lines array<struct<h: bigint, w: bigint>>"
    base = cut(map_rows(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", host.alias("host"), "text"), make, kinds))
    # a document has a line once, so a plain count is one of documents, and each map task adds up what it can
    lines = base.select("row", "host", F.explode("lines").alias("l")).select("row", "host", "l.h", "l.w")
    often = cut(lines.groupBy("host", "h").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > max_docs))
    total = base.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0))).first()[0]
    # a line that a good part of all documents of a host share stays where it is
    gone = spread_join(lines, often, ["host", "h"], total).groupBy("row").agg(F.sum("w").alias("removed_words"))
    out = base.drop("lines", "host").join(gone, "row", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words") >= F.lit(least_left) * F.col("n_words")
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & left).drop("row")


def op8_line_frequency(spark, sf_dir: str) -> DataFrame:
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words"]
    return line_frequency_rules(table(spark, sf_dir, "documents")).select(*names)


SQL = rf"""
with d as (select doc_id, coalesce('s' || source, 'n') host, coalesce(text, '') text from documents),
w as (select doc_id, host, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') ws from d),
l0 as (select doc_id, host, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) i from d),
l1 as (select *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') lw from l0),
l as (select *, translate(list_aggregate(lw, 'string_agg', ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000') norm,
             row_number() over (partition by doc_id, line order by i) again from l1 where len(lw) > 0),
often as (select host, norm from l group by 1, 2 having count(distinct doc_id) > {MAX_DOCS}),
lines as (select l.doc_id, sum(case when again > 1 then 1 else 0 end) dups, sum(case when o.norm is not null then len(lw) else 0 end) gone
          from l left join often o on o.host = l.host and o.norm = l.norm group by 1),
p as (select doc_id, unnest(ws) x, generate_subscripts(ws, 1) i from w),
t as (select doc_id, i, x || chr(10) || lead(x, 1) over s || chr(10) || lead(x, 2) over s k from p window s as (partition by doc_id order by i)),
r as (select doc_id, i, count(*) over (partition by doc_id, k) c from t where k is not null),
m as (select doc_id, count(distinct i + j) n from r, (select unnest([0, 1, 2]) j) where c > 1 group by 1),
f as (select w.doc_id, len(ws)::bigint n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint n_symbols, coalesce(dups, 0)::bigint n_dup_lines,
             coalesce(n, 0)::bigint n_repeat_words, coalesce(gone, 0)::bigint gone
      from w left join lines using (doc_id) left join m using (doc_id)),
v as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed from f)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and n_words - gone >= {LEAST_LEFT} * n_words kept, gone removed_words from v
"""
