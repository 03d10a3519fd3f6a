"""Missing-value rules.

NaN and NULL both count as missing. Aggregates come in a strict form (one missing input
makes the group's result missing) and in the form that skips missing inputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_AGGREGATES = {"mean": F.avg, "sd": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_double(c) -> Column:
    """NaN becomes NULL, and -0.0 becomes 0.0."""
    c = _col(c)
    return F.nullif(c, F.lit(float("nan"))) + F.lit(0.0)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Apply :func:`clean_double` to every floating column; used at every ingest."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[clean_double(F.col(c)).alias(c) if c in floating else F.col(c) for c in df.columns])


def lenient_double(c) -> Column:
    """Text to double; anything that is not a number becomes NULL."""
    return F.nullif(_col(c).try_cast("double"), F.lit(float("nan")))


def number_text(c) -> Column:
    """A number as text, whole doubles without a trailing ``.0``."""
    c = _col(c)
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    return F.when(whole, c.cast("long").cast("string")).otherwise(c.cast("string"))


def paste(*parts, sep: str = "") -> Column:
    """Concatenate as text; a missing part reads ``NA``. Plain strings name columns, use F.lit for text."""
    texts = [F.coalesce(_col(p).cast("string"), F.lit("NA")) for p in parts]
    joined = [texts[0]]
    for text in texts[1:]:
        joined += [F.lit(sep), text] if sep else [text]
    return F.concat(*joined)


def summary(name: str, c, na_rm: bool = True) -> Column:
    """``mean``, ``sd``, ``min``, ``max`` or ``sum`` of a column.

    ``na_rm=False`` is the strict form. With ``na_rm=True`` a sum over nothing is 0.
    """
    c = _col(c)
    value = _AGGREGATES[name](c)
    if na_rm:
        return F.coalesce(value, F.lit(0.0)) if name == "sum" else value
    return F.when(F.count(c) == F.count(F.lit(1)), value)


def row_mean(*cols) -> Column:
    """Mean across columns of one row, missing ones skipped."""
    values = F.filter(F.array(*[_col(c).cast("double") for c in cols]), lambda v: v.isNotNull() & ~F.isnan(v))
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
    return F.try_divide(total, F.size(values))
