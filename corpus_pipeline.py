"""A corpus run: reject toxic texts, keep one of each group of near copies, redact secrets, mix sources, encode.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again as the next
stage's docs; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.bpe import round_trip
from veilspark.llm.common import freeze, read_table
from veilspark.llm.jaccard import jaccard_components
from veilspark.llm.mixing import mixed
from veilspark.llm.secrets import redact
from veilspark.llm.toxicity import not_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go."""
    return not_toxic(docs, read_table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays; a null doc_id stays."""
    gone = jaccard_components(docs.select("doc_id", "text")).where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; every document stays."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixed(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document."""
    return round_trip(docs)


STAGES = [("toxicity", toxicity), ("near_copies", near_copies), ("secrets", secrets), ("mixing", mixing), ("encoding", encoding)]

#: The trained classifier, the drawn mix and the tokenizer can't be expressed in SQL; a test holds each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = freeze(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
