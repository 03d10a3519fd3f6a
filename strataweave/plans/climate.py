"""Climate at sites, the rate index, and its regression on climate."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.functions.crs import reproject
from strataweave.functions.units import flux_to_soil_mass
from strataweave.operators.groups import weighted_index, zscore
from strataweave.operators.joins import inner_join, left_join_distinct, lookup_join
from strataweave.operators.raster import Grid, extract_points
from strataweave.operators.regression import facet_long, ols
from strataweave.operators.reshape import union_fill, with_row_id
from strataweave.session import stage


@dataclass(frozen=True)
class SiteClimate:
    """Monthly precipitation, monthly temperature and annual values by place."""

    monthly_prec: DataFrame
    monthly_temp: DataFrame
    annual: DataFrame


def climate_by_site(
    points: DataFrame, place: str, crs: str, prec: DataFrame, tavg: DataFrame, grid: Grid, row_id: bool = True
) -> SiteClimate:
    """Climate of the cell that holds each point, from twelve monthly layers per variable.

    Every point is a row of its own with an ``ID``, so a place may have several. Points are first
    carried to the reference system of the climate grid. Annual precipitation is twelve times the mean
    month, so a missing month counts as an average one. Each table of ``prec`` and ``tavg`` is one variable.
    """
    numbered = with_row_id(points.select(F.col(place).alias("place"), "x", "y"), ["place", "x", "y"], "ID")
    at = stage(reproject(numbered, crs, grid.crs).withColumnsRenamed({"x": "lon", "y": "lat"}))
    named = [c for c in ("raster_id", "month") if c in prec.columns and c in tavg.columns]
    months_p = stage(extract_points(at, prec, grid, "lon", "lat", "precipitation", keep=named))
    months_t = stage(extract_points(at, tavg, grid, "lon", "lat", "temperature", keep=named))
    annual = lookup_join(
        months_p.groupBy("ID", "place", "lon", "lat").agg((F.avg("precipitation") * 12).alias("MAP")),
        months_t.groupBy("ID").agg(F.avg("temperature").alias("MAT")),
        "ID",
    )
    if not row_id:
        annual = annual.drop("ID")
    return SiteClimate(months_p.drop("lon", "lat"), months_t.drop("lon", "lat"), stage(annual))


def index_with_climate(samples: DataFrame, annual: DataFrame, site: str, section: str, rates, source: str) -> DataFrame:
    """Rate index per site with its climate; only samples of places with climate count.

    The result is staged, as later steps read it several times.
    """
    joined = inner_join(samples, annual.select("place", "MAT", "MAP"), {site: "place"})
    present = joined.dropna(subset=["MAT", "MAP"])
    index = weighted_index(present, site, section, rates)
    index = left_join_distinct(index, annual, {site: "place"}, ["MAT", "MAP"])
    return stage(index.withColumns({"source": F.lit(source), "respiration_rate": F.col("rs_index")}))


def combine_rates(index: DataFrame, buffers: DataFrame, site: str, source: str) -> DataFrame:
    """The index stacked on the gridded rate of the same sites, in the same unit."""
    # sites have many samples: one row each before the join, which reads the staged rows twice
    each = stage(buffers.select(site, "gridded_mean", "gridded_count", "gridded_sd").distinct())
    joined = lookup_join(each, index, site, staged=False)
    present = joined.filter(F.col("rs_index").isNotNull())
    once = present.select(site, "respiration_rate", "gridded_count", "gridded_sd", "gridded_mean", "MAP", "MAT").distinct()
    grid = once.select(
        site, flux_to_soil_mass("gridded_mean").alias("respiration_rate"), "gridded_count", "gridded_sd", "MAT", "MAP"
    )
    return stage(union_fill(index, grid.withColumn("source", F.lit(source))))


def standardised(combined: DataFrame) -> DataFrame:
    """Rates as z-scores within their source."""
    return zscore(combined, ["source"], "respiration_rate", "respiration_z")


def rate_model(combined: DataFrame, y: str, levels: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rate on source, temperature and precipitation: coefficients and fit."""
    return ols(combined, y, ["MAT", "MAP"], "source", levels)


def climate_facets(combined: DataFrame, y: str) -> DataFrame:
    """One row per climate parameter, for regressions by facet and source."""
    return facet_long(combined, ["source", y], ["MAT", "MAP"])
