"""Named result tables: written once, loaded only if complete."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def _present(spark: SparkSession, path: str) -> bool:
    """Whether a readable table is there; only the file listing is touched."""
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def save_tables(tables: Mapping[str, DataFrame], folder: str) -> None:
    """Write each table to its own Parquet folder. Nothing is written if any target exists."""
    spark = next(iter(tables.values())).sparkSession
    taken = [name for name in tables if _present(spark, f"{folder}/{name}")]
    if taken:
        raise FileExistsError(f"already written: {', '.join(sorted(taken))}")
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{folder}/{name}")


def load_tables(spark: SparkSession, names: Sequence[str], folder: str) -> dict[str, DataFrame]:
    """Open tables written by :func:`save_tables`; a missing one is an error naming it."""
    absent = [name for name in names if not _present(spark, f"{folder}/{name}")]
    if absent:
        raise FileNotFoundError(f"run the preparation first, missing: {', '.join(absent)}")
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}
