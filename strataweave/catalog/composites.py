"""Queries for the sample preparation analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataweave.catalog import query
from strataweave.catalog.layers import cells, coordinates, cores, country, grid, samples, sites, sql_hits, sql_with
from strataweave.catalog.projections import CONE, sql_to_albers
from strataweave.catalog.rounding import rounded
from strataweave.catalog.spatial import AT_CELL, albers_country, sample_points
from strataweave.functions.crs import ALBERS, GEOGRAPHIC
from strataweave.operators.raster import extract_points
from strataweave.plans.samples import (
    country_sites,
    located_samples,
    missing_counterpart,
    normalise_samples,
    normalise_sites,
)

_MOVED = {
    "cone": CONE,
    "apts": f"SELECT site_code, x, y FROM ({sql_to_albers('sites', 'lon', 'lat')})",
    "moved": "SELECT state, ax1 AS x1, ay1 AS y1, ax2 AS x2, ay2 AS y2 FROM ("
    + sql_to_albers("(" + sql_to_albers("country_edges", "x1", "y1", "ax1", "ay1") + ")", "x2", "y2", "ax2", "ay2")
    + ")",
}


@query(
    "country_sites",
    sql_with("sites", "country_edges", **_MOVED, hits=sql_hits("apts", "site_code", "moved", "state", False))
    + """SELECT site_code, round(x, 2) + 0.0 AS x, round(y, 2) + 0.0 AS y FROM apts
    WHERE site_code IN (SELECT site_code FROM hits)""",
)
def country_sites_query(spark, sf):
    return rounded(country_sites(sites(spark, sf), "site_code", "lon", "lat", albers_country(spark, sf), ALBERS), 2)


EXCLUDED = "S1"
NORMALISED = f"""SELECT sample_id, proposal_id, 'P' || proposal_id || '_' || site_code AS sample, core_section, ph, clay, ppm, r24,
    CASE WHEN ppm IS NOT NULL THEN 'own ppm' ELSE 'own rate' END AS label, 'own' AS source, lon AS x, lat AS y
    FROM samples JOIN sites USING (site_code) WHERE site_code <> '{EXCLUDED}'"""


def normalised(spark, sf):
    """Samples of all sites but one, tagged and located in degrees."""
    columns = ("sample_id", "proposal_id", "core_section", "ph", "clay", "ppm", "r24")
    return normalise_sites(
        samples(spark, sf).drop("site_code"),
        sites(spark, sf),
        GEOGRAPHIC,
        {c: c for c in columns},
        "sampling_set",
        "site_code",
        "lon",
        "lat",
        "ppm",
        "own",
        ("own ppm", "own rate"),
        excluded=[EXCLUDED],
    )


@query(
    "normalise_sites",
    sql_with("samples", "sites", s=NORMALISED)
    + "SELECT * REPLACE (round(ph, 6) AS ph, round(ppm, 6) AS ppm, round(r24, 6) AS r24, round(x, 6) AS x, round(y, 6) AS y) FROM s",
)
def normalise_sites_query(spark, sf):
    return rounded(normalised(spark, sf))


PREPARED = """SELECT sample_id, CAST(c.proposal_id AS DOUBLE) AS proposal_id, CAST(set_no AS VARCHAR) AS sample, core_section,
    clay, latitude, CASE WHEN longitude > 0 THEN -longitude ELSE longitude END AS longitude, 'own' AS source
    FROM cores c LEFT JOIN coordinates k ON c.proposal_id = k.proposal_id AND set_no = sampling_set"""


def prepared(spark, sf):
    """Samples known by a compound name only, with the coordinates of their proposal and set."""
    name = F.concat_ws("-", F.col("proposal_id").cast("string"), F.col("set_no").cast("string"), "core_section")
    properties = cores(spark, sf).select("sample_id", name.alias("sample_name"), "clay")
    return normalise_samples(properties, coordinates(spark, sf), "sample_name", "clay", "own", extra=["sample_id"])


@query(
    "normalise_samples",
    sql_with("cores", "coordinates", s=PREPARED)
    + "SELECT * REPLACE (round(latitude, 6) AS latitude, round(longitude, 6) AS longitude) FROM s",
)
def normalise_samples_query(spark, sf):
    return rounded(prepared(spark, sf))


@query(
    "located_samples",
    sql_with(
        "cores",
        "coordinates",
        "samples",
        "sites",
        "country_edges",
        prepared=PREPARED,
        normalised=NORMALISED,
        places="SELECT proposal_id || '-' || sampling_set AS place, CASE WHEN longitude > 0 THEN -longitude ELSE longitude END AS x, "
        "latitude AS y FROM coordinates",
        hits=sql_hits("places", "place", "country_edges", "state"),
    )
    + """SELECT sample_id, proposal_id, sample, core_section, clay, source, round(longitude, 6) AS x, round(latitude, 6) AS y
    FROM prepared WHERE clay IS NOT NULL AND proposal_id::BIGINT || '-' || sample IN (SELECT place FROM hits)
    UNION ALL SELECT sample_id, proposal_id, sample, core_section, clay, source, round(x, 6), round(y, 6)
    FROM normalised WHERE clay IS NOT NULL""",
)
def located_samples_query(spark, sf):
    appended = normalised(spark, sf).withColumn("proposal_id", F.col("proposal_id").cast("double"))
    return rounded(located_samples(prepared(spark, sf), appended, "clay", country(spark, sf), GEOGRAPHIC))


@query(
    "missing_counterpart",
    sql_with("samples", "sites", "cells_top", spots=f"SELECT site_code, {AT_CELL} FROM sites, grid")
    + """, gaps AS (SELECT sample_id, clay, core_section, 'own' AS source, sampling_set, site_code, substr(site_code, 1, 2) AS location
    FROM samples JOIN spots USING (site_code) LEFT JOIN cells_top USING (row, col)
    WHERE core_section = 'TOP' AND clay IS NOT NULL AND value IS NULL)
    SELECT sample_id, split_part(sampling_set, '-', 1) AS prj, site_code, clay, core_section, source, location,
    'n = ' || count(*) OVER (PARTITION BY location) AS samples, segment FROM gaps JOIN sites USING (site_code)""",
)
def missing_counterpart_query(spark, sf):
    s = sample_points(spark, sf).filter(F.col("clay").isNotNull())
    s = s.select(
        "sample_id", "core_section", "clay", F.lit("own").alias("source"), F.col("sampling_set").alias("sample"), "x", "y"
    )
    top = s.filter(F.col("core_section") == "TOP")
    g = grid(spark, sf)
    tables = {
        section: extract_points(s.filter(F.col("core_section") == section), cells(spark, sf, raster), g, out="extracted")
        for section, raster in (("TOP", "top"), ("BTM", "btm"))
    }
    listed = missing_counterpart(tables, top, sites(spark, sf).select("site_code", "segment"), "clay", ["sample_id"])
    columns = ("sample_id", "prj", "site_code", "clay", "core_section", "source", "location", "samples", "segment")
    return listed.select(*columns)


