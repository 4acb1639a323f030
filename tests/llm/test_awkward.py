"""Every registered query on tables with nulls, empty and long texts, ties, repeated rows and clashing columns, and on empty ones."""

import collections

import pytest

import __spark_entry__
import corpus_pipeline

from .test_operators import SCHEMA, rows

PAGES = [(1, "u", "a"), (2, None, None), (3, "u", "a"), (4, "u", ""), (5, "u", "é" * 9999), (None, "u", "a"), (3, "u", "a")]
NAMES = sorted(n for n in __spark_entry__.queries() if n.startswith("op"))


@pytest.fixture(scope="module", params=["awkward", "empty"])
def folder(request, spark, tmp_path_factory):
    where, full = tmp_path_factory.mktemp(request.param), request.param == "awkward"
    spark.createDataFrame(rows() if full else [], SCHEMA).repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(PAGES if full else [], "page_id bigint, url string, html string").write.parquet(f"{where}/pages.parquet")
    return str(where)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, folder, name):
    query = __spark_entry__.queries()[name]
    got = collections.Counter(map(str, query(spark, folder).collect()))
    assert got == collections.Counter(map(str, query(spark, folder).collect()))
    if not name.startswith(("op4", "op12")):  # a row for each row
        of = "pages" if name.startswith("op3") else "documents"
        assert sum(got.values()) == spark.read.parquet(f"{folder}/{of}.parquet").count()


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == names
    assert corpus_pipeline.run(spark, folder).count() == docs.count()


NAMED = "`meta.url` string, `a``b` int, `x y` struct<`a b`: int, `c.d`: array<struct<`e f`: string>>>, m map<string, int>, N_TOKENS int, c0 string, redacted string, `lang_pred` string, at timestamp, price decimal(9,2)"


def test_names_of_other_columns(spark, folder):
    """Columns of any name and type pass every stage as they are, repeated rows and nulls among them."""
    import datetime
    import decimal

    more = ("u", 1, (2, [("x",)]), {"k": 3}, 7, "c", "r", "l", datetime.datetime(2020, 1, 2, 3, 4, 5), decimal.Decimal("1.50"))
    base = [(i, t, lang, source, n) for i, t, lang, source, n, *_ in rows()]
    kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    docs = spark.createDataFrame([(*r, *(more if i % 3 else (None,) * len(more))) for i, r in enumerate(base)], kinds + NAMED).repartition(3)
    names, extra = docs.columns, docs.columns[5:]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "encode":
            assert out.columns == names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        else:
            assert out.columns == ["doc_id", "lang", "source", "n_chars", *[f"_{c}" if c == "N_TOKENS" else c for c in extra], "n_tokens", "token_ids"]
        got = out.toDF(*[f"k{i}" for i in range(len(out.columns))]).collect()
        first = 5 if name != "encode" else 4
        assert got and all(tuple(r)[first : first + len(extra)] in ((None,) * len(extra), tuple(got_row(more))) for r in got)
    alone = corpus_pipeline.STAGES[-1][1](spark, docs.select("text"), folder)
    assert alone.columns == ["n_tokens", "token_ids"] and alone.count() == len(base)


def got_row(more):
    from pyspark.sql import Row

    return [Row(**{"a b": 2, "c.d": [Row(**{"e f": "x"})]}) if isinstance(v, tuple) else v for v in more]
