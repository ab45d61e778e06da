"""A corpus pipeline of five operators: every stage works on what its predecessor kept.

toxicity -> near-duplicates -> decontamination -> secrets -> mixing. The first four stages return
the columns of ``documents``; the last returns the drawn rows with their places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modsieve.llm import decontaminate, mixing, near_duplicates, secrets, toxicity
from modsieve.llm.storage import table, written


def clean_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group of near-duplicates."""
    return near_duplicates.keep_one(docs)


def unseen_tests(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by [SECRET] and n_chars set anew."""
    return secrets.redacted(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows to train on, with their place in the mixture."""
    return mixing.mixed(docs)


STAGES = [
    ("toxicity", clean_language),
    ("near_duplicates", distinct_texts),
    ("decontamination", unseen_tests),
    ("secrets", without_secrets),
    ("mixing", mixture),
]

#: Trained models and sampled signatures have no SQL form; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
