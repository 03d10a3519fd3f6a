"""Sampling by hash: seeded, uniform over row keys, independent of partitioning.

A row's rank is the text order of ``md5(seed|key...)``. The ``n`` lowest ranks of a stratum are
found without gathering the stratum: counts per hash prefix give the prefix in which the n-th row
falls, lower prefixes are taken whole, and only that one prefix is sorted. Rows of equal rank are
told apart by a hash of the whole row, and rows equal in every column may stand for each other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.operators.joins import equi_join, lookup_join
from strataweave.session import stage

#: Hexadecimal digits of the hash used to cut a stratum: 3 gives 4096 slices.
PREFIX_DIGITS = 3


def draw_order(seed, key: Sequence[str]) -> Column:
    """Sort key of a draw. Rows with equal keys have equal ranks, and chance in the whole row decides between them."""
    first = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws("|", first, *[F.col(k).cast("string") for k in key]))


def take_lowest(
    df: DataFrame,
    by: Sequence[str],
    rank: str,
    quota: int | DataFrame,
    quota_on: Sequence[str] | None = None,
    digits: int = PREFIX_DIGITS,
) -> DataFrame:
    """The rows with the lowest ``rank`` text in each stratum.

    ``quota`` is a number, or a table with the columns ``quota_on`` and ``quota``; strata absent
    from that table yield nothing. Strata shorter than their quota are kept whole. ``df`` is read
    three times, so it should be a stored or staged table.
    """
    df = df.withColumn("_slice", F.left(F.col(rank), F.lit(digits)))
    slices = df.groupBy(*by, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    if isinstance(quota, int):
        slices = slices.withColumn("_quota", F.lit(quota).cast("long"))
    else:
        sizes = quota.select(*quota_on, F.col("quota").cast("long").alias("_quota"))
        slices = equi_join(slices, sizes, list(quota_on), "inner")
    running = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)
    slices = slices.withColumn("_upto", F.sum("_n").over(running))
    full = F.col("_upto") >= F.col("_quota")
    cuts = slices.groupBy(*by).agg(
        F.min(F.when(full, F.col("_slice"))).alias("_cut"),
        (F.first("_quota") - F.coalesce(F.max(F.when(~full, F.col("_upto"))), F.lit(0))).alias("_need"),
    )
    cuts = stage(cuts)
    joined = lookup_join(df, cuts, list(by), "inner", staged=False)
    whole = joined.filter(F.col("_cut").isNull() | (F.col("_slice") < F.col("_cut")))
    order = Window.partitionBy(*by).orderBy(rank, F.xxhash64(*[c for c in df.columns if c != rank]))
    last = joined.filter(F.col("_slice") == F.col("_cut")).withColumn("_rn", F.row_number().over(order))
    if isinstance(quota, int):
        last = last.filter(F.col("_rn") <= quota)
    last = last.filter(F.col("_rn") <= F.col("_need")).drop("_rn")
    return whole.unionByName(last).drop("_slice", "_cut", "_need")


def stratified_sample(
    df: DataFrame, by: Sequence[str], key: Sequence[str], n: int = 1000, seed=1, digits: int = PREFIX_DIGITS
) -> DataFrame:
    """Up to ``n`` rows per stratum without replacement; shorter strata are kept whole."""
    ranked = df.withColumn("_rank", draw_order(seed, key))
    return take_lowest(ranked, by, "_rank", n, digits=digits).drop("_rank")


def matched_resample(
    df: DataFrame,
    key: Sequence[str],
    own: str,
    seeds: Sequence[int] = (1, 5, 10),
    zone: str = "climate",
    source: str = "source",
    tag: str = "grid_sample_",
    digits: int = PREFIX_DIGITS,
) -> DataFrame:
    """All own rows, and per seed and zone as many comparison rows as the zone has own rows.

    Zones with one own row or none get no comparison rows. Draws are tagged by seed position.
    """
    own_rows = df.filter(F.col(source) == own)
    sizes = own_rows.groupBy(zone).agg(F.count(F.lit(1)).alias("quota")).filter(F.col("quota") > 1)
    draws = F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(str(s)).alias("s")) for i, s in enumerate(seeds)])
    others = df.filter(F.col(source) != own).withColumn("_draw", F.explode(draws))
    others = others.withColumn("_rank", draw_order(F.col("_draw.s"), key)).withColumn("_draw", F.col("_draw.i"))
    drawn = take_lowest(others, [zone, "_draw"], "_rank", sizes, [zone], digits)
    drawn = drawn.withColumn(source, F.concat(F.lit(tag), F.col("_draw").cast("string"))).drop("_draw", "_rank")
    return own_rows.unionByName(drawn)


def entity_sample(df: DataFrame, entity: str, n: int, seed=42, require: bool = True) -> DataFrame:
    """``n`` distinct entities. Fewer than ``n`` is an error unless ``require`` is off."""
    picked = df.select(entity).distinct().orderBy(draw_order(seed, [entity]), entity).limit(n)
    if require and picked.count() < n:
        raise ValueError(f"fewer than {n} distinct values of {entity}")
    return picked
