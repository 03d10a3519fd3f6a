"""Queries for sampling, group sizes and the combination of sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataweave.catalog import query
from strataweave.catalog.layers import cells, samples, sql_hits, sql_with, zones
from strataweave.catalog.spatial import PTS, ZONE_CTES, sample_points
from strataweave.catalog.rounding import rounded
from strataweave.functions.text import prefix
from strataweave.operators.groups import partition_count
from strataweave.operators.raster import zone_values
from strataweave.operators.reshape import union_strict
from strataweave.operators.sampling import entity_sample, matched_resample, stratified_sample
from strataweave.operators.spatial import zone_join
from strataweave.plans.comparison import combine_sources, resample_labelled, sample_with_labels
from strataweave.session import stage
from strataweave.sources.lookups import ENTITY_ROWS, ENTITY_SEED, RESAMPLE_SEEDS, STRATUM_ROWS

#: Own rows are known by sample, grid rows by zone and value.
KEY = ["sample_id", "zone", "clay"]

COMBINED = dict(
    pts=PTS,
    hits=sql_hits("pts", "site_code", "zone_edges", "code"),
    **ZONE_CTES,
    own="""SELECT climate, clay, sample_id, 'own' AS source, NULL::VARCHAR AS zone FROM samples JOIN hits USING (site_code)
    JOIN zones USING (code) WHERE core_section = 'TOP' AND clay IS NOT NULL""",
    combined="""SELECT * FROM own UNION ALL SELECT climate, value / 10, NULL, 'grid', zone FROM zone_vals
    JOIN zones ON zone = code WHERE climate IN (SELECT climate FROM own)""",
)
LAYERS = ("samples", "sites", "cells_top", "zones", "zone_edges")

RANKED = "md5(concat_ws('|', {seed}, sample_id, zone, CAST(clay AS VARCHAR)))"


def combined_sources(spark, sf):
    """Clay of top samples by climate, stacked on the grid values of the same climates."""
    own = sample_points(spark, sf).filter(F.col("clay").isNotNull())
    own = zone_join(own.select("sample_id", "core_section", "clay", "x", "y"), zones(spark, sf))
    values = zone_values(cells(spark, sf), zones(spark, sf))
    mapping = zones(spark, sf).select("code", "climate").distinct()
    return combine_sources(own, "TOP", "clay", values, mapping, key=["sample_id"])


@query("combine_sources", sql_with(*LAYERS, **COMBINED) + "SELECT climate, clay, sample_id, source, zone FROM combined")
def combine_sources_query(spark, sf):
    return combined_sources(spark, sf)


# All four runs: clay and pH of both sections, each section with its own raster.
PROPERTIES, SECTIONS = ("clay", "ph"), {"TOP": "top", "BTM": "btm"}
RUNS = dict(
    pts=PTS,
    hits=sql_hits("pts", "site_code", "zone_edges", "code"),
    cell_pts=ZONE_CTES["cell_pts"],
    cell_hits=ZONE_CTES["cell_hits"],
    layers="SELECT 'TOP' AS section, row, col, value FROM cells_top UNION ALL SELECT 'BTM', row, col, value FROM cells_btm",
    long="""SELECT sample_id, site_code, core_section AS section, 'clay' AS property, clay AS value FROM samples
    UNION ALL SELECT sample_id, site_code, core_section, 'ph', ph FROM samples""",
    own="""SELECT property, section, climate, value, sample_id, 'own' AS source, NULL::VARCHAR AS zone FROM long JOIN hits USING (site_code)
    JOIN zones USING (code) WHERE section IN ('TOP', 'BTM') AND value IS NOT NULL""",
    gridded="""SELECT DISTINCT property, section, climate, code AS zone, value FROM cell_hits JOIN layers ON cell = row * 50 + col
    JOIN zones USING (code), (VALUES ('clay'), ('ph')) p(property) WHERE value IS NOT NULL""",
)


@query(
    "combine_sources_runs",
    sql_with("samples", "sites", "cells_top", "cells_btm", "zones", "zone_edges", **RUNS)
    + """SELECT property, section, climate, round(value, 6) AS value, sample_id, source, zone FROM own
    UNION ALL SELECT property, section, climate, round(value / 10, 6), NULL, 'grid', zone FROM gridded
    WHERE (property, section, climate) IN (SELECT property, section, climate FROM own)""",
)
def combine_sources_runs(spark, sf):
    """Clay and pH, top and bottom: own values stacked on the grid values of the same climates."""
    mapping = zones(spark, sf).select("code", "climate").distinct()
    own = zone_join(sample_points(spark, sf).select("sample_id", "core_section", *PROPERTIES, "x", "y"), zones(spark, sf))
    own = stage(own)
    runs = []
    for section, raster in SECTIONS.items():
        values = stage(zone_values(cells(spark, sf, raster), zones(spark, sf)))
        for name in PROPERTIES:
            run = combine_sources(own.filter(F.col(name).isNotNull()), section, name, values, mapping, key=["sample_id"])
            runs.append(run.withColumnRenamed(name, "value").withColumns({"property": F.lit(name), "section": F.lit(section)}))
    return rounded(union_strict(*runs))


DRAWN = f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY climate, source
    ORDER BY {RANKED.format(seed="'1'")}) AS rn FROM combined) WHERE rn <= {STRATUM_ROWS}"""


@query("stratified_sample", sql_with(*LAYERS, **COMBINED) + DRAWN)
def stratified_sample_query(spark, sf):
    return stratified_sample(stage(combined_sources(spark, sf)), ["climate", "source"], KEY, STRATUM_ROWS, 1)


SIZES = """SELECT climate, nullif(count(*) FILTER (WHERE source = 'own'), 0) AS own,
    nullif(count(*) FILTER (WHERE source = 'grid'), 0) AS grid FROM {rows} GROUP BY climate HAVING own > 1"""
LABEL = "climate || chr(10) || 'own = ' || own || ', grid = ' || coalesce(CAST({shown} AS VARCHAR), 'NA') AS axis_label"


@query(
    "sample_with_labels",
    sql_with(*LAYERS, **COMBINED, drawn=DRAWN, sizes=SIZES.format(rows="drawn"))
    + f"SELECT drawn.*, own, grid, {LABEL.format(shown='grid')} FROM drawn LEFT JOIN sizes USING (climate)",
)
def sample_with_labels_query(spark, sf):
    return sample_with_labels(combined_sources(spark, sf), KEY, STRATUM_ROWS, 1)


RESAMPLED = f"""SELECT climate, clay, sample_id, source, zone FROM combined WHERE source = 'own'
    UNION ALL SELECT climate, clay, sample_id, 'grid_sample_' || i, zone FROM (
    SELECT c.*, i, quota, row_number() OVER (PARTITION BY climate, i ORDER BY {RANKED.format(seed="CAST(seed AS VARCHAR)")}) AS rn
    FROM combined c JOIN (SELECT climate, count(*) AS quota FROM own GROUP BY climate HAVING count(*) > 1) USING (climate),
    (VALUES (1, {RESAMPLE_SEEDS[0]}), (2, {RESAMPLE_SEEDS[1]}), (3, {RESAMPLE_SEEDS[2]})) v(i, seed) WHERE source <> 'own')
    WHERE rn <= quota"""


@query("matched_resample", sql_with(*LAYERS, **COMBINED) + RESAMPLED)
def matched_resample_query(spark, sf):
    return matched_resample(stage(combined_sources(spark, sf)), KEY, "own", RESAMPLE_SEEDS)


@query(
    "resample_labelled",
    sql_with(*LAYERS, **COMBINED, drawn=RESAMPLED, sizes=SIZES.format(rows="combined"))
    + f"SELECT drawn.*, own, grid, {LABEL.format(shown='own')} FROM drawn JOIN sizes USING (climate)",
)
def resample_labelled_query(spark, sf):
    return resample_labelled(combined_sources(spark, sf), KEY, RESAMPLE_SEEDS)


@query(
    "entity_sample",
    sql_with("samples")
    + f"""SELECT site_code FROM (SELECT DISTINCT site_code FROM samples)
    ORDER BY md5('{ENTITY_SEED}|' || site_code) LIMIT {ENTITY_ROWS}""",
)
def entity_sample_query(spark, sf):
    return entity_sample(samples(spark, sf), "site_code", ENTITY_ROWS, ENTITY_SEED)


@query(
    "partition_count",
    sql_with("samples")
    + """SELECT sample_id, substr(site_code, 1, 2) AS location,
    'n = ' || count(*) OVER (PARTITION BY substr(site_code, 1, 2)) AS samples FROM samples""",
)
def partition_count_query(spark, sf):
    s = samples(spark, sf).select("sample_id", prefix("site_code", 2).alias("location"))
    return partition_count(s, "location")


