"""Unions, pivots, sample-size tables and row numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataweave.functions.nulls import paste
from strataweave.operators.joins import lookup_join
from strataweave.session import stage


#: Rows that one partition of a numbered table is meant to hold.
PARTITION_ROWS = 250_000


def union_fill(first: DataFrame, *more: DataFrame) -> DataFrame:
    """Stack tables by column name; columns absent from a table are NULL there."""
    out = first.select("*")
    for df in more:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def union_strict(first: DataFrame, *more: DataFrame) -> DataFrame:
    """Stack tables that have the same columns; anything else is an error."""
    out = first
    for df in more:
        if set(df.columns) != set(out.columns):
            raise ValueError(f"columns differ: {sorted(set(df.columns) ^ set(out.columns))}")
        out = out.unionByName(df)
    return out


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str], names_to: str, values_to: str) -> DataFrame:
    """Wide to long; missing values are kept."""
    return df.unpivot(list(ids), list(values), names_to, values_to)


def pivot_counts(df: DataFrame, by: str, spread: str, values: Sequence[str]) -> DataFrame:
    """Rows per ``by`` and ``spread`` as one column per value; an absent pair is NULL."""
    counts = df.groupBy(by).pivot(spread, list(values)).agg(F.count(F.lit(1)))
    return counts.select(by, *[F.nullif(F.col(v), F.lit(0)).alias(v) for v in values])


def sample_sizes(df: DataFrame, by: str, source: str, own: str, other: str, shown: str | None = None) -> DataFrame:
    """Counts per group and source, for groups with over one own row, with an axis label.

    ``shown`` names the count printed for the other source (the own count in matched resampling).
    """
    wide = pivot_counts(df, by, source, [own, other]).filter(F.col(own) > 1)
    label = paste(
        by, F.lit(f"\n{own} = "), F.col(own), F.lit(f", {other} = "), F.col(shown or other)
    )
    return wide.withColumn("axis_label", label)


def with_row_id(df: DataFrame, key: Sequence[str], name: str = "id", partitions: int | None = None) -> DataFrame:
    """Number rows 1..n in the order of a unique key, without a single-task sort.

    Rows are range-partitioned into a staged table; each partition numbers its rows and adds the
    total of the partitions before it.
    """
    df = stage(df)
    parts = partitions or max(1, -(-df.count() // PARTITION_ROWS))
    ranged = df.repartitionByRange(parts, *key).withColumn("_part", F.spark_partition_id())
    ranged = stage(ranged)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    )
    local = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*key)))
    numbered = lookup_join(local, offsets, "_part")
    return numbered.withColumn(name, F.col("_before") + F.col("_n")).drop("_part", "_n", "_before")
