"""Rounding of computed doubles, so that last-bit differences between engines do not count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rounded(df: DataFrame, digits: int = 6, **columns: int) -> DataFrame:
    """Round every double column; keyword arguments give other digits for single columns."""
    doubles = {f.name for f in df.schema.fields if f.dataType.typeName() == "double"}

    def fix(c: str) -> Column:
        return (F.round(F.col(c), columns.get(c, digits)) + F.lit(0.0)).alias(c) if c in doubles else F.col(c)

    return df.select(*[fix(c) for c in df.columns])
