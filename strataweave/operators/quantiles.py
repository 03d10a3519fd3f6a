"""Exact quantiles per group, interpolated linearly between order statistics.

Rows are first reduced to distinct values with counts, so repeated values cost nothing later. The
counts are range-partitioned by group and value, in as many partitions as their number asks for:
totals per partition tell where each wanted order statistic lies, and only those partitions are ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataweave.operators.joins import lookup_join
from strataweave.session import stage

#: Distinct values that one partition is meant to hold.
PARTITION_VALUES = 1_000_000


def value_counts(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Staged table of the distinct present values ``_v`` per group with their counts ``_w``."""
    rows = df.select(*by, F.nullif(F.col(value).cast("double"), F.lit(float("nan"))).alias("_v"))
    return stage(rows.filter("_v is not null").groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_w")))


def group_quantiles(
    df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], partition_values: int = PARTITION_VALUES
) -> DataFrame:
    """Columns ``by``, ``n`` (present values) and ``quantiles`` (array, one per probability)."""
    return quantiles_of_counts(value_counts(df, by, value), by, probs, partition_values)


def quantiles_of_counts(
    counts: DataFrame, by: Sequence[str], probs: Sequence[float], partition_values: int = PARTITION_VALUES
) -> DataFrame:
    """As :func:`group_quantiles`, from a table of value counts."""
    by = list(by)
    parts = max(1, -(-counts.count() // partition_values))
    ranged = stage(counts.repartitionByRange(parts, *by, "_v").withColumn("_part", F.spark_partition_id()))
    group = Window.partitionBy(*by)
    totals = ranged.groupBy(*by, "_part").agg(F.sum("_w").alias("_here"))
    totals = totals.withColumns(
        {"_upto": F.sum("_here").over(group.orderBy("_part")), "n": F.sum("_here").over(group)}
    ).withColumn("_before", F.col("_upto") - F.col("_here"))
    # Ranks below and above each quantile, kept where the partition holds them.
    ranks = ", ".join(
        f"named_struct('i', {i}, 'side', {side}, 'k', {fn}((n - 1) * {float(p)!r}D))"
        for i, p in enumerate(probs)
        for side, fn in enumerate(("floor", "ceil"))
    )
    asked = totals.selectExpr(
        *by, "_part", "n", "_before", f"filter(array({ranks}), r -> r.k >= _before and r.k < _upto) as _asked"
    ).filter("size(_asked) > 0")
    near = lookup_join(ranged, asked, [*by, "_part"], "inner")
    running = Window.partitionBy(*by, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("_end", F.col("_before") + F.sum("_w").over(running))
    found = near.selectExpr(*by, "n", "_v", "inline(filter(_asked, r -> r.k < _end and r.k >= _end - _w)) as (i, side, k)")
    pairs = found.groupBy(*by, "n", "i").agg(
        F.max(F.expr("case when side = 0 then _v end")).alias("_lo"),
        F.max(F.expr("case when side = 1 then _v end")).alias("_hi"),
        F.max(F.expr("case when side = 0 then k end")).alias("_k"),
    )
    at = "element_at(array({}), i + 1)".format(", ".join(f"{float(p)!r}D" for p in probs))
    pairs = pairs.selectExpr(*by, "n", "i", f"_lo + ((n - 1) * {at} - _k) * (_hi - _lo) as _q")
    ordered = F.array_sort(F.collect_list(F.struct("i", "_q")))
    return pairs.groupBy(*by, "n").agg(ordered.alias("_s")).selectExpr(*by, "n", "_s._q as quantiles")


def overall_quantiles(df: DataFrame, value: str, probs: Sequence[float], **options) -> DataFrame:
    """Quantiles of a whole column."""
    return group_quantiles(df.withColumn("_all", F.lit(1)), ["_all"], value, probs, **options).drop("_all")
