"""From raw sample tables to located, zone-tagged samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.functions.crs import GEOGRAPHIC, reproject
from strataweave.functions.nulls import lenient_double, number_text, paste
from strataweave.functions.text import prefix, separate, token
from strataweave.operators.clean import complete_cases, keep_present, label_by_presence, western_longitude
from strataweave.operators.groups import partition_count
from strataweave.operators.joins import left_join, located_only
from strataweave.operators.reshape import union_fill, union_strict
from strataweave.operators.spatial import clip_points, make_points, within_any, zone_join


def country_sites(records: DataFrame, key: str, lon: str, lat: str, country: DataFrame, crs: str) -> DataFrame:
    """Complete coordinate records strictly inside a country, in its reference system."""
    rows = complete_cases(records.select(key, lon, lat))
    return within_any(reproject(make_points(rows, lon, lat), GEOGRAPHIC, crs), country)


def sample_tokens(df: DataFrame, name: str, site: str, section: str) -> DataFrame:
    """Site (third) and core section (fourth) from the sample name."""
    return df.withColumns({site: token(name, 3), section: token(name, 4)})


def normalise_sites(
    samples: DataFrame,
    sites: DataFrame,
    crs: str,
    names: Mapping[str, str],
    set_column: str,
    site: str,
    lon: str,
    lat: str,
    ppm: str,
    source: str,
    labels: tuple[str, str],
    excluded: Sequence[str] = (),
) -> DataFrame:
    """Join samples to located sites by the second half of their set name, and tag them.

    ``names`` maps output names to sample columns; rows of unlocated sites are dropped.
    """
    places = sites.filter(~F.col(site).isin(list(excluded))) if excluded else sites
    places = reproject(make_points(places.select(site, lon, lat), lon, lat), GEOGRAPHIC, crs)
    located = located_only(separate(samples, set_column, ["_prj", site]), places, site)
    return located.select(
        *[F.col(old).alias(new) for new, old in names.items()],
        paste("_prj", F.lit("_"), site).alias("sample"),
        label_by_presence(ppm, *labels).alias("label"),
        F.lit(source).alias("source"),
        "x",
        "y",
    )


def normalise_samples(
    properties: DataFrame, coordinates: DataFrame, name: str, value: str, source: str, extra: Sequence[str] = ()
) -> DataFrame:
    """Split sample names, look up coordinates by proposal and sample, repair longitudes."""
    rows = separate(properties, name, ["proposal_id", "sample", "core_section"]).withColumns(
        {"proposal_id": lenient_double("proposal_id"), "sample": lenient_double("sample")}
    )
    places = coordinates.select(
        F.col("proposal_id").cast("double"), F.col("sampling_set").cast("double"), "latitude", "longitude"
    )
    joined = left_join(rows, places, {"proposal_id": "proposal_id", "sample": "sampling_set"})
    return joined.select(
        *extra,
        "proposal_id",
        number_text("sample").alias("sample"),
        "core_section",
        value,
        "latitude",
        western_longitude("longitude").alias("longitude"),
        F.lit(source).alias("source"),
    )


def located_samples(
    samples: DataFrame, sites: DataFrame, value: str, country: DataFrame, crs: str, on_missing: str = "error"
) -> DataFrame:
    """Samples clipped to a country, with the site samples appended; rows without a value dropped."""
    points = reproject(make_points(samples, "longitude", "latitude", on_missing), GEOGRAPHIC, crs)
    both = union_fill(clip_points(points, country), sites.select(*[c for c in sites.columns if c in points.columns]))
    return keep_present(both, value)


def tag_zones(samples: DataFrame, zones: DataFrame, columns: Sequence[str], climate: str = "climate", **options):
    """Samples with the attributes of every zone they meet; samples without a climate are dropped."""
    return keep_present(zone_join(samples, zones, **options).select(*columns), climate)


def missing_counterpart(
    tables: Mapping[str, DataFrame], located: DataFrame, sites: DataFrame, value: str, key: Sequence[str] = ()
) -> DataFrame:
    """Located samples whose cell value is missing, listed by site prefix with group sizes.

    ``tables`` holds the point extractions by section, each with the cell value ``extracted``.
    Repeated keys multiply, as in any left join; ``key`` adds identifying columns to prevent it.
    """
    on = ["core_section", value, "source", "sample", *key]
    gaps = union_strict(*[t.filter(F.col("extracted").isNull()).select(*on) for t in tables.values()])
    listed = left_join(located, gaps.withColumn("missing", F.lit(True)), on).filter(F.col("missing"))
    listed = separate(listed, "sample", ["prj", "site_code"])
    listed = left_join(listed, sites, "site_code", suffixes=("_x", "_y"))
    return partition_count(listed.withColumn("location", prefix("site_code", 2)), "location")
