"""A training-data pipeline: language identification, near duplicates, personal data, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.

Defined results of every stage: an empty table gives an empty one; columns beside those of documents are
kept, whatever their names; texts of any length are taken whole; repeated rows are judged alike. A null or
empty text has no language and goes in the first stage, so no later stage of run() meets one; stages that
are called by themselves keep such documents, but for the mix, which never takes a document without words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from selenite.llm import common, op1_mix, op2_langid, op6_bpe, op9_pii, op10_minhash

#: The stages hold models and hashed states, so SQL can't express run(); see tests/llm.
ORACLE_SQL = None


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; texts without letters, or that no language explains with a probability of a half, go.

    A null lang is filled in; ties between languages go to the first by code point.
    """
    return op2_langid.kept_languages(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more.

    The smallest doc_id stays; rows without a doc_id or without words are in no group and stay.
    """
    return op10_minhash.deduplicated(docs, words=5, percent=80)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in them replaced by its kind; of overlapping finds the first one's kind."""
    return op9_pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all beyond a target, up to three times below it.

    A null source is a source of its own.
    """
    return op1_mix.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, n_tokens and token_ids of each document."""
    return op6_bpe.encode(docs)


STAGES = [
    ("language_id", identify_languages),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mix", mix_sources),
    ("encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over the documents of sf_dir; what lies between them is written to the shared folder.

    A stage's table is dropped once the next one's is written; the last of them is what the result is read from.
    """
    docs, scratch = common.table(spark, sf_dir, "documents"), common.Scratch(spark)
    for _, stage in STAGES[:-1]:
        before, docs = docs, scratch.save(stage(spark, docs, sf_dir))
        scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
