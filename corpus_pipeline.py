"""A corpus pipeline of the operators in ``strataweave.llm``: each stage works on all that the one before has kept.

A stage takes ``(spark, docs, sf_dir)`` and returns a table. All but the last return the columns of ``docs``, whatever they
are. ``docs`` needs ``doc_id`` and ``text``; the operators state what nulls, repeated rows and empty tables give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.llm import co_training, decontaminate, jaccard_join, piece_codec
from strataweave.llm.queries import reach_package
from strataweave.session import stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the co-trained classifier rejects."""
    return co_training.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies."""
    return jaccard_join.keep_one(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents contaminated with benchmark items."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, token_ids, n_tokens, round_trip``: piece ids, and whether they decode to the text."""
    coded = piece_codec.encode(docs.select("doc_id", "text"), check="round_trip")
    return coded.select("doc_id", "token_ids", F.coalesce(F.size("token_ids"), F.lit(0)).cast("long").alias("n_tokens"), "round_trip")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("contamination", contamination), ("pieces", pieces)]

#: SQL cannot train the classifier; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    reach_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES:
        docs = stage(step(spark, docs, sf_dir))
    return docs
