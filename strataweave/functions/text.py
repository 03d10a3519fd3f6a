"""Text splitting and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The separator between parts of a compound key, and the one between name tokens.
NON_ALPHANUMERIC = r"[^\p{Alnum}]+"
TOKEN_SEPARATOR = "_"


def separate(df: DataFrame, column: str, into: Sequence[str], pattern: str = NON_ALPHANUMERIC) -> DataFrame:
    """Split ``column`` into named columns in its place.

    Surplus pieces are dropped, absent ones are NULL.
    """
    pieces = F.split(F.col(column), pattern, -1)
    out = []
    for name in df.columns:
        if name == column:
            out += [F.get(pieces, i).alias(part) for i, part in enumerate(into)]
        elif name not in into:
            out.append(F.col(name))
    return df.select(*out)


def token(c, k: int, sep: str = TOKEN_SEPARATOR) -> Column:
    """The ``k``-th (1-based) piece of ``c``; NULL past the end.

    One trailing empty piece does not count, and empty text has no pieces.
    """
    c = F.col(c) if isinstance(c, str) else c
    trimmed = F.when(F.endswith(c, F.lit(sep)), F.left(c, F.length(c) - len(sep))).otherwise(c)
    return F.when(c != "", F.get(F.split(trimmed, rf"\Q{sep}\E", -1), k - 1))


def prefix(c, n: int) -> Column:
    return F.substring(c, 1, n)


def number_after(c, lead: str) -> Column:
    """Remove the regular expression ``lead`` from a name and read the rest as a number."""
    return F.regexp_replace(c, lead, "").try_cast("double")
