"""Unit conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the flux conversion.
BULK_DENSITY_G_CM3 = 1.33
SOIL_DEPTH_CM = 10
CM2_PER_M2 = 10000
DAYS_PER_YEAR = 365
MG_PER_G = 1000

#: g C per m2 and year to mg C per g soil and day.
FLUX_FACTOR = MG_PER_G / (BULK_DENSITY_G_CM3 * SOIL_DEPTH_CM * CM2_PER_M2 * DAYS_PER_YEAR)


def rescale(c, divisor: float = 10.0) -> Column:
    return (F.col(c) if isinstance(c, str) else c) / F.lit(float(divisor))


def flux_to_soil_mass(c) -> Column:
    """Areal flux (g C per m2 and year) as mg C per g soil and day."""
    return (F.col(c) if isinstance(c, str) else c) * F.lit(FLUX_FACTOR)
