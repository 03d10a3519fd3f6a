"""Row-wise cleaning: projections, tags, repairs and filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.functions.nulls import lenient_double
from strataweave.sources.lookups import CONTERMINOUS_STATES

GEOMETRY = ("x", "y", "edges", "xmin", "ymin", "xmax", "ymax")


def project(df: DataFrame, *columns: str, **renamed: str) -> DataFrame:
    """Select columns; keyword arguments are ``new="old"``."""
    return df.select(*columns, *[F.col(old).alias(new) for new, old in renamed.items()])


def rename_dynamic(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.withColumnRenamed(old, new)


def rename_tail(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rename the last columns by position and read them as numbers."""
    head, tail = df.columns[: -len(names)], df.columns[-len(names) :]
    return df.select(*head, *[lenient_double(F.col(t)).alias(n) for t, n in zip(tail, names)])


def drop_geometry(df: DataFrame) -> DataFrame:
    return df.drop(*GEOMETRY)


def tag(df: DataFrame, **constants) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in constants.items()})


def western_longitude(c: str) -> Column:
    """Positive longitudes are mislabelled west ones: flip their sign."""
    return F.when(F.col(c) > 0, -F.col(c)).otherwise(F.col(c))


def label_by_presence(c: str, present: str, absent: str) -> Column:
    return F.when(F.col(c).isNotNull(), F.lit(present)).otherwise(F.lit(absent))


def relabel(c: str, match: str, then: str, otherwise: str | Column) -> Column:
    """Two-way relabelling; a missing value stays missing."""
    other = F.lit(otherwise) if isinstance(otherwise, str) else otherwise
    return F.when(F.col(c).isNull(), F.lit(None)).when(F.col(c) == match, F.lit(then)).otherwise(other)


def choose(c: str, branches: Mapping[str, Column]) -> Column:
    """One expression per value of ``c``; NULL for any other value."""
    out = F.lit(None)
    for value, expression in reversed(list(branches.items())):
        out = F.when(F.col(c) == value, expression).otherwise(out)
    return out


def keep_present(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which at least one of the columns is present."""
    test = F.lit(False)
    for c in columns:
        test = test | F.col(c).isNotNull()
    return df.filter(test)


def keep_listed(df: DataFrame, column: str, values: Sequence[str] = CONTERMINOUS_STATES) -> DataFrame:
    """Rows whose value is in a list, by default that of the conterminous states."""
    return df.filter(F.col(column).isin(*values))


def complete_cases(df: DataFrame, *columns: str) -> DataFrame:
    """Rows without NULL or NaN in the columns (all columns if none is named)."""
    return df.dropna(subset=list(columns) or None)


def error_bounds(df: DataFrame, centre: str, spread: str) -> DataFrame:
    """``ymin`` and ``ymax``: centre minus and plus the spread."""
    return df.withColumns({"ymin": F.col(centre) - F.col(spread), "ymax": F.col(centre) + F.col(spread)})


def within_limits(df: DataFrame, x: str, y: str, low: float, high: float) -> DataFrame:
    """Axis limits: rows outside the square are removed before a fit."""
    return df.filter(F.col(x).between(low, high) & F.col(y).between(low, high))
