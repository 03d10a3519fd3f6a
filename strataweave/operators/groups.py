"""Group statistics: summaries, and group values attached to every row.

Attached values are aggregated first (partial sums on the map side) and joined back, so a group
holding most of the rows is never gathered in one task as a window would.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.functions.nulls import summary
from strataweave.operators.clean import choose, complete_cases
from strataweave.operators.joins import lookup_join
from strataweave.operators.quantiles import group_quantiles

# Weight of each core section, and of the one-day and four-day rates.
SECTION_WEIGHTS = {"TOP": 0.65, "BTM": 0.35}
DAY_WEIGHTS = (1 / 3, 2 / 3)


def attach(df: DataFrame, by: Sequence[str], **aggregates: Column) -> DataFrame:
    """Add aggregates of a row's group to the row."""
    table = df.groupBy(*by).agg(*[c.alias(n) for n, c in aggregates.items()])
    return lookup_join(df, table, list(by))


def partition_count(df: DataFrame, by: str, out: str = "samples", lead: str = "n = ") -> DataFrame:
    """Label every row with the size of its group."""
    counted = attach(df, [by], _n=F.count(F.lit(1)))
    return counted.withColumn(out, F.concat(F.lit(lead), F.col("_n").cast("string"))).drop("_n")


def zscore(df: DataFrame, by: Sequence[str], value: str, out: str = "z", na_rm: bool = False) -> DataFrame:
    """Standardise within groups. Strict by default: one missing value makes its group missing."""
    joined = attach(df, by, _mean=summary("mean", value, na_rm), _sd=summary("sd", value, na_rm))
    z = F.try_divide(F.col(value) - F.col("_mean"), F.col("_sd"))
    return joined.withColumn(out, z).drop("_mean", "_sd")


def zscores(df: DataFrame, by: Sequence[str], outputs: Mapping[str, tuple[str, bool]]) -> DataFrame:
    """Several z-scores with one pass for the group values: output name -> (column, na_rm)."""
    aggregates = {}
    for i, (value, na_rm) in enumerate(outputs.values()):
        aggregates |= {f"_mean{i}": summary("mean", value, na_rm), f"_sd{i}": summary("sd", value, na_rm)}
    joined = attach(df, by, **aggregates)
    z = {n: F.try_divide(F.col(v) - F.col(f"_mean{i}"), F.col(f"_sd{i}")) for i, (n, (v, _)) in enumerate(outputs.items())}
    return joined.withColumns(z).drop(*aggregates)


def describe(
    df: DataFrame, by: Sequence[str], value: str, names: Mapping[str, str], count: str | None = None, na_rm: bool = True
) -> DataFrame:
    """Chosen summaries of one column per group; ``names`` maps mean, sd, min, max to output names."""
    aggs = [summary(stat, value, na_rm).alias(name) for stat, name in names.items()]
    if count:
        aggs.append(F.count(F.lit(1)).alias(count))
    return df.groupBy(*by).agg(*aggs)


def source_summary(df: DataFrame, source: str, value: str, units: str, digits: int = 4) -> DataFrame:
    """Rounded minimum, maximum and mean per source, with a units label."""
    rounded = [F.bround(summary(s, value), digits).alias(f"{s}_{value}") for s in ("min", "max", "mean")]
    return df.groupBy(source).agg(*rounded).withColumn("units", F.lit(units))


def present_table(df: DataFrame, headings: Mapping[str, str]) -> DataFrame:
    """Columns under their printed headings."""
    return df.select(*[F.col(c).alias(h) for c, h in headings.items()])


def weighted_index(
    df: DataFrame, site: str, section: str, rates: tuple[str, str], out: str = "rs_index", normalise: bool = False
) -> DataFrame:
    """Depth- and time-weighted rate index per site, from complete rows.

    Sections without a weight add nothing, replicate cores add up. ``normalise`` divides by the
    weights present.
    """
    timed = F.lit(DAY_WEIGHTS[0]) * F.col(rates[0]) + F.lit(DAY_WEIGHTS[1]) * F.col(rates[1])
    weight = choose(section, {k: F.lit(w) for k, w in SECTION_WEIGHTS.items()})
    total = F.coalesce(F.sum(weight * timed), F.lit(0.0))
    if normalise:
        total = F.try_divide(total, F.sum(weight))
    return complete_cases(df, site, section, *rates).groupBy(site).agg(total.alias(out))


def region_rollup(df: DataFrame, by: Sequence[str], prefix: str = "region_") -> DataFrame:
    """Mean of means, median of medians, extremes of extremes and mean of quartiles per region."""
    aggs = [
        summary("mean", "weighted_average", False).alias(prefix + "average"),
        summary("min", "min_value", False).alias(prefix + "min_value"),
        summary("max", "max_value", False).alias(prefix + "max_value"),
        summary("mean", "q1_value", False).alias(prefix + "q1_value"),
        summary("mean", "q3_value", False).alias(prefix + "q3_value"),
        (F.count("median_value") == F.count(F.lit(1))).alias("_whole"),
    ]
    medians = group_quantiles(df, by, "median_value", [0.5])
    joined = lookup_join(df.groupBy(*by).agg(*aggs), medians, list(by))
    median = F.when(F.col("_whole"), F.get("quantiles", F.lit(0)))
    return joined.withColumn(prefix + "median_value", median).drop("_whole", "quantiles", "n")
