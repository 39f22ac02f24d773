"""The training-corpus pipeline: each stage is one operator over all that the stage before kept.

language ID -> exact dedup -> near dedup -> benchmark decontamination -> token ids
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelore.llm import bpe, common, decontam, exactdedup, lid, neardup, queries

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the model of some language accepts."""
    docs = docs.select(*COLUMNS)
    return lid.identify(docs, lid.train(docs)).where("not rejected").select(*COLUMNS)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of equal texts the row with the largest doc_id."""
    return exactdedup.drop_exact(docs.select(*COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies the document with the smallest doc_id."""
    return neardup.drop_near(docs.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that hold no test item of ``benchmark``."""
    return decontam.drop_leaks(docs.select(*COLUMNS), common.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document: doc_id, n_tokens, ids."""
    encoded = bpe.encode_table(docs, queries.vocabulary()).select("doc_id", "n_tokens", "ids")
    return encoded.withColumn("ids", F.when(F.col("ids") == "", F.array().cast("array<int>")).otherwise(F.split("ids", " ").cast("array<int>")))


STAGES = [("language ID", language_id), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("decontamination", decontaminate), ("token ids", encode)]

#: Trained models, alignment and tokenizing have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; what a stage keeps is written as Parquet under the shared checkpoint folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
