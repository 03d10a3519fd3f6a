"""Equi-joins in which a missing key matches a missing key.

``on`` is a column name, a list of names, or a mapping from left to right names. The left key
names are kept. Non-key columns found on both sides get suffixes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.session import fits_broadcast, stage

On = str | Sequence[str] | Mapping[str, str]

#: A key with more left rows than this is spread over SALTS tasks.
HOT_ROWS = 2_000_000
SALTS = 64


def key_pairs(on: On) -> list[tuple[str, str]]:
    if isinstance(on, str):
        return [(on, on)]
    if isinstance(on, Mapping):
        return list(on.items())
    return [(k, k) for k in on]


def _match(pairs: Sequence[tuple[str, str]], null_safe: bool = True) -> Column:
    tests = [F.col(a).eqNullSafe(F.col(b)) if null_safe else F.col(a) == F.col(b) for a, b in pairs]
    return reduce(lambda p, q: p & q, tests)


def _disjoint(left: DataFrame, right: DataFrame, pairs, suffixes, how: str):
    """Rename so that no column name occurs on both sides; right keys become ``_k0, _k1, ...``."""
    right_keys = {b: f"_k{i}" for i, (_, b) in enumerate(pairs)}
    clash = set() if how in ("left_semi", "left_anti") else set(left.columns) & (set(right.columns) - set(right_keys))
    clash -= {a for a, _ in pairs}
    both_keys = {a for a, _ in pairs} & (set(right.columns) - set(right_keys))
    left = left.withColumnsRenamed({c: c + suffixes[0] for c in clash})
    renames = {c: c + suffixes[1] for c in clash | both_keys}
    right = right.withColumnsRenamed({**right_keys, **renames})
    return left, right, [(a, f"_k{i}") for i, (a, _) in enumerate(pairs)]


def _salted(left: DataFrame, right: DataFrame, pairs, hot: DataFrame):
    """Spread the rows of hot left keys over salts; only their right rows are repeated."""
    marks = hot.toDF(*[f"_h{i}" for i in range(len(pairs))]).withColumn("_hot", F.lit(True))
    if fits_broadcast(marks):
        marks = F.broadcast(marks)
    names = marks.columns[:-1]
    # The partition number spreads exact copies of a row; it is the same if a task is repeated.
    row = F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int")
    salt = F.pmod(row + F.spark_partition_id(), F.lit(SALTS))
    left = (
        left.join(marks, _match([(a, h) for (a, _), h in zip(pairs, names)]), "left")
        .withColumn("_salt", F.when(F.col("_hot"), salt).otherwise(F.lit(0)))
        .drop(*names, "_hot")
    )
    all_salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    right = (
        right.join(marks, _match([(b, h) for (_, b), h in zip(pairs, names)]), "left")
        .withColumn("_rsalt", F.explode(F.when(F.col("_hot"), all_salts).otherwise(F.array(F.lit(0)))))
        .drop(*names, "_hot")
    )
    return left, right


def equi_join(
    left: DataFrame,
    right: DataFrame,
    on: On,
    how: str = "left",
    where: Column | None = None,
    suffixes: tuple[str, str] = ("_x", "_y"),
    null_safe: bool = True,
    spread: bool = False,
    hot_rows: int | None = None,
    small: bool | None = None,
) -> DataFrame:
    """Join on equal keys, with an optional further condition.

    The right side is broadcast if it is ``small``, else both are shuffled (adaptive execution splits
    skewed partitions); without ``small`` it is measured, unless ``spread`` says that it is large.
    Spark's own choice goes by the bytes of compressed files, which may hold rows of a hundred times as many.
    ``spread=True`` counts the left keys first and salts those with over ``hot_rows`` rows, so one
    key, or one group of exact copies, may hold any share of the left side.
    """
    pairs = key_pairs(on)
    left, right, pairs = _disjoint(left, right, pairs, suffixes, how)
    condition = _match(pairs, null_safe)
    if where is not None:
        condition = condition & where
    drop = [b for _, b in pairs]
    if small is None and not left.isStreaming:
        small = not spread and fits_broadcast(right)
    if spread and not left.isStreaming:
        limit = HOT_ROWS if hot_rows is None else hot_rows
        keys = [a for a, _ in pairs]
        hot = stage(left.groupBy(*keys).count().filter(F.col("count") > limit).select(*keys))
        if not hot.isEmpty():
            left, right = _salted(left, right, pairs, hot)
            condition = condition & (F.col("_salt") == F.col("_rsalt"))
            drop += ["_salt", "_rsalt"]
    if small is not None:
        right = F.broadcast(right) if small else right.hint("merge")
    return left.join(right, condition, how).drop(*drop)


def lookup_join(
    left: DataFrame,
    table: DataFrame,
    on: On,
    how: str = "left",
    null_safe: bool = True,
    staged: bool = True,
    hot_rows: int | None = None,
) -> DataFrame:
    """Join a derived table with unique keys, such as group statistics.

    The table is computed once into the shared folder and measured there: within the limit it is
    broadcast and the left side does not move; beyond it the join is shuffled with hot keys spread.
    """
    table = stage(table) if staged else table
    if fits_broadcast(table):
        return equi_join(left, table, on, how, null_safe=null_safe, small=True)
    return equi_join(left, table, on, how, null_safe=null_safe, spread=True, hot_rows=hot_rows)


def left_join(left: DataFrame, right: DataFrame, on: On, **options) -> DataFrame:
    return equi_join(left, right, on, "left", **options)


def inner_join(left: DataFrame, right: DataFrame, on: On, **options) -> DataFrame:
    return equi_join(left, right, on, "inner", **options)


def semi_join(left: DataFrame, right: DataFrame, on: On, **options) -> DataFrame:
    """Rows of ``left`` whose key occurs in ``right``."""
    pairs = key_pairs(on)
    return equi_join(left, right.select(*[b for _, b in pairs]), on, "left_semi", **options)


def anti_join(left: DataFrame, right: DataFrame, on: On, **options) -> DataFrame:
    """Rows of ``left`` whose key does not occur in ``right``."""
    pairs = key_pairs(on)
    return equi_join(left, right.select(*[b for _, b in pairs]), on, "left_anti", **options)


def left_join_distinct(left: DataFrame, right: DataFrame, on: On, columns: Sequence[str], **options) -> DataFrame:
    """Left join to the distinct rows of some columns of ``right``.

    A key with several distinct attribute rows multiplies its left rows.
    """
    keys = [b for _, b in key_pairs(on)]
    return left_join(left, right.select(*keys, *columns).distinct(), on, **options)


def located_only(left: DataFrame, places: DataFrame, on: On, x: str = "x", **options) -> DataFrame:
    """Left join to a point table, keeping the rows that got a location."""
    return left_join(left, places, on, **options).filter(F.col(x).isNotNull())
