"""Tables behind distribution figures: histograms, box statistics, kernel densities."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.operators.joins import lookup_join
from strataweave.operators.quantiles import quantiles_of_counts, value_counts

# Whisker length, and the rule-of-thumb bandwidth 0.9 * min(sd, IQR / 1.34) * n^-0.2.
WHISKER = 1.5
BANDWIDTH_FACTOR, BANDWIDTH_IQR, BANDWIDTH_POWER = 0.9, 1.34, -0.2


def density_histogram(df: DataFrame, by: Sequence[str], value: str, bins: int = 30) -> DataFrame:
    """Density per group over bins shared by all groups.

    The bin width is the pooled range over ``bins - 1``; the first bin is centred on the minimum,
    and bins are closed on the right. Every group has a row for each bin, also for the empty ones; if all
    values are equal there is one bin of no width.
    """
    values = value_counts(df, by, value)
    low, high = values.agg(F.min("_v"), F.max("_v")).first()
    if low is None:
        low = high = 0.0
    width = (high - low) / (bins - 1)
    # With a single value everything is in one bin of no width.
    place = f"greatest(ceil((_v - {low - width / 2!r}D) / {width!r}D) - 1, 0)" if width > 0 else "0"
    counts = values.groupBy(*by, F.expr(f"cast({place} as int)").alias("bin")).agg(F.sum("_w").alias("count"))
    totals = values.groupBy(*by).agg(F.sum("_w").alias("_n"))
    shown = totals.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1 if width > 0 else 0))))
    filled = lookup_join(shown, counts, [*by, "bin"]).withColumn("count", F.coalesce("count", F.lit(0).cast("long")))
    return filled.select(
        *by,
        "bin",
        (F.lit(low) + F.lit(width) * F.col("bin")).alias("x"),
        "count",
        F.try_divide(F.col("count"), F.col("_n") * F.lit(width)).alias("density"),
    )


def boxplot_stats(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Quartiles, and whiskers at the furthest value within 1.5 IQR of the box."""
    counts = value_counts(df, by, value)
    quartiles = quantiles_of_counts(counts, by, [0.25, 0.5, 0.75]).select(
        *by, "n", *[F.get("quantiles", F.lit(i)).alias(c) for i, c in enumerate(("q1", "median", "q3"))]
    )
    reach = F.lit(WHISKER) * (F.col("q3") - F.col("q1"))
    values = lookup_join(counts, quartiles, list(by))
    return values.groupBy(*by, "n", "q1", "median", "q3").agg(
        F.min(F.when(F.col("_v") >= F.col("q1") - reach, F.col("_v"))).alias("lower"),
        F.max(F.when(F.col("_v") <= F.col("q3") + reach, F.col("_v"))).alias("upper"),
    )


def violin_density(df: DataFrame, by: Sequence[str], value: str, points: int = 512) -> DataFrame:
    """Gaussian kernel density per group on ``points`` positions over the group's range.

    Values are binned linearly onto the positions, so the cost of the kernel sums depends on the
    number of positions only. ``scaled`` is relative to the group's peak. A group of equal values has
    all positions at that value and takes the value, or 1, for its spread; a single value has no density.
    """
    last = points - 1
    counts = value_counts(df, by, value)
    quartiles = quantiles_of_counts(counts, by, [0.25, 0.75])
    spread = counts.groupBy(*by).agg(
        F.min("_v").alias("_lo"),
        F.max("_v").alias("_hi"),
        F.sum("_w").alias("_n"),
        (F.sum(F.col("_w") * F.col("_v")) / F.sum("_w")).alias("_mean"),
    )
    spread = lookup_join(spread, quartiles.drop("n"), list(by))
    # Second pass for the variance around the mean; one pass of squares loses digits.
    centred = lookup_join(counts, spread, list(by))
    group = [*by, "_lo", "_hi", "_n", "quantiles"]
    sd = F.sqrt(F.sum(F.col("_w") * F.pow(F.col("_v") - F.col("_mean"), F.lit(2))) / (F.col("_n") - 1))
    iqr = (F.get("quantiles", F.lit(1)) - F.get("quantiles", F.lit(0))) / F.lit(BANDWIDTH_IQR)
    positive = lambda c: F.when(c > 0, c)
    least = F.coalesce(positive(F.least("_sd", iqr)), positive(F.col("_sd")), positive(F.abs("_lo")), F.lit(1.0))
    spread = (
        centred.filter(F.col("_n") > 1)
        .groupBy(*group)
        .agg(sd.alias("_sd"))
        .withColumn("_h", F.lit(BANDWIDTH_FACTOR) * least * F.pow(F.col("_n"), F.lit(BANDWIDTH_POWER)))
        .select(*by, "_lo", "_hi", "_n", "_h")
    )
    placed = lookup_join(counts, spread, list(by), "inner")
    at = F.coalesce(F.try_divide(F.col("_v") - F.col("_lo"), (F.col("_hi") - F.col("_lo")) / last), F.lit(0.0))
    placed = placed.withColumn("_at", at).withColumn("_i", F.least(F.floor("_at"), F.lit(last - 1)).cast("int"))
    f = F.col("_at") - F.col("_i")
    halves = F.array(
        F.struct(F.col("_i").alias("i"), (F.col("_w") * (1 - f)).alias("w")),
        F.struct((F.col("_i") + 1).alias("i"), (F.col("_w") * f).alias("w")),
    )
    params = ["_lo", "_hi", "_n", "_h"]
    binned = (
        placed.select(*by, *params, F.explode(halves).alias("_p"))
        .groupBy(*by, *params, F.col("_p.i").alias("_i"))
        .agg(F.sum("_p.w").alias("_w"))
        .filter(F.col("_w") > 0)
    )
    # At most `points` weights per group, so the array is of fixed size.
    grid = binned.groupBy(*by, *params).agg(F.array_sort(F.collect_list(F.struct("_i", "_w"))).alias("_weights"))
    grid = grid.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(last))))
    step = (F.col("_hi") - F.col("_lo")) / last

    def kernel(acc, p):
        u = (F.col("i") - p["_i"]) * step / F.col("_h")
        return acc + p["_w"] * F.exp(F.lit(-0.5) * u * u)

    total = F.aggregate("_weights", F.lit(0.0), kernel)
    out = grid.select(
        *by,
        "i",
        (F.col("_lo") + F.col("i") * step).alias("x"),
        (total / (F.col("_n") * F.col("_h") * F.lit(math.sqrt(2 * math.pi)))).alias("density"),
    )
    peaks = out.groupBy(*by).agg(F.max("density").alias("_peak"))
    return lookup_join(out, peaks, list(by)).withColumn("scaled", F.col("density") / F.col("_peak")).drop("_peak")
