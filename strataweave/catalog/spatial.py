"""Queries for points, projections, polygons and rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataweave.catalog import query
from strataweave.catalog.layers import (
    RADIUS_DEG,
    basins,
    cells,
    country,
    grid,
    region_stats,
    samples,
    sites,
    sql_hits,
    sql_with,
    table,
    zones,
)
from strataweave.catalog.projections import CONE, sql_from_albers, sql_from_goode, sql_to_albers, sql_to_goode, warp_steps
from strataweave.catalog.rounding import rounded
from strataweave.functions.crs import ALBERS, GEOGRAPHIC, from_albers, from_goode, to_albers, to_goode
from strataweave.operators.clean import western_longitude
from strataweave.operators.groups import region_rollup
from strataweave.operators.joins import left_join
from strataweave.operators.raster import (
    Grid,
    buffer_stats,
    crop_raster,
    extract_points,
    mask_raster,
    raster_window,
    read_project_mask,
    warp_bilinear,
    warp_grid,
    zone_values,
)
from strataweave.operators.spatial import (
    Box,
    clip_points,
    crop_polygons,
    join_polygons,
    layer_bbox,
    make_points,
    points_bbox,
    reproject_polygons,
    within_any,
    zone_join,
)
from strataweave.plans.comparison import basin_choropleth, buffer_comparison, respiration_buffer
from strataweave.plans.samples import sample_tokens
from strataweave.session import stage

CROP = Box(-110.0, 30.0, -80.0, 42.0)


def site_points(spark, sf):
    """Sites as points in degrees, longitudes repaired."""
    s = sites(spark, sf).select("site_code", western_longitude("raw_lon").alias("lon"), "lat")
    return make_points(s, "lon", "lat")


def sample_points(spark, sf):
    """Samples at the points of their sites."""
    return left_join(samples(spark, sf), site_points(spark, sf), "site_code")


def albers_grid(spark, sf, raster_id: str = "warped") -> Grid:
    """Grid in the working system that covers the study grid and has its shape."""
    return warp_grid(spark, grid(spark, sf), ALBERS, raster_id)


def albers_country(spark, sf):
    return reproject_polygons(country(spark, sf), GEOGRAPHIC, ALBERS)


PTS = "SELECT site_code, lon AS x, lat AS y FROM sites"

# ---------------------------------------------------------------- points and projections


@query(
    "make_points",
    sql_with("sites") + "SELECT site_code, segment, round(raw_lon, 6) AS x, round(lat, 6) AS y FROM sites",
)
def make_points_query(spark, sf):
    return rounded(make_points(sites(spark, sf).select("site_code", "segment", "raw_lon", "lat"), "raw_lon", "lat"))


@query(
    "to_albers",
    sql_with("sites", cone=CONE) + f"""SELECT site_code, round(x, 2) + 0.0 AS x, round(y, 2) + 0.0 AS y
    FROM ({sql_to_albers("sites", "lon", "lat")})""",
)
def to_albers_query(spark, sf):
    return rounded(to_albers(site_points(spark, sf)), 2)


_METRES = {"albers": (-2500000.0, 200000.0, 2400000.0, 3200000.0), "goode": (-13600000.0, 2700000.0, -7700000.0, 5400000.0)}


def _metres(spark, sf, name):
    """Points spread evenly over a box in metres, one per customer."""
    xmin, ymin, xmax, ymax = _METRES[name]
    return table(spark, sf, "customer").selectExpr(
        "c_custkey",
        f"{xmin}D + {xmax - xmin}D * ((c_custkey * 7919) % 10007) / 10007D as x",
        f"{ymin}D + {ymax - ymin}D * ((c_custkey * 104729) % 10009) / 10009D as y",
    )


def _sql_metres(name):
    xmin, ymin, xmax, ymax = _METRES[name]
    return f"""SELECT c_custkey, {xmin}::DOUBLE + {xmax - xmin}::DOUBLE * ((c_custkey * 7919) % 10007) / 10007::DOUBLE AS x,
    {ymin}::DOUBLE + {ymax - ymin}::DOUBLE * ((c_custkey * 104729) % 10009) / 10009::DOUBLE AS y FROM customer"""


@query(
    "from_albers",
    "WITH cone AS (" + CONE + "), pts AS (" + _sql_metres("albers") + ")"
    + f""" SELECT c_custkey, round(lon, 6) + 0.0 AS x, round(lat, 6) + 0.0 AS y FROM ({sql_from_albers("pts", "x", "y")})""",
)
def from_albers_query(spark, sf):
    return rounded(from_albers(_metres(spark, sf, "albers")))


@query(
    "to_goode",
    sql_with("sites") + f"""SELECT site_code, round(x, 2) + 0.0 AS x, round(y, 2) + 0.0 AS y
    FROM ({sql_to_goode("sites", "lon", "lat")})""",
)
def to_goode_query(spark, sf):
    return rounded(to_goode(site_points(spark, sf)), 2)


@query(
    "from_goode",
    "WITH pts AS (" + _sql_metres("goode") + ")"
    + f""" SELECT c_custkey, round(lon, 6) + 0.0 AS x, round(lat, 6) + 0.0 AS y FROM ({sql_from_goode("pts", "x", "y")})""",
)
def from_goode_query(spark, sf):
    return rounded(from_goode(_metres(spark, sf, "goode")))


@query(
    "layer_bbox",
    sql_with("zone_edges", "zones", "sites")
    + """SELECT climate AS layer, round(min(x1), 6) + 0.0 AS xmin, round(min(y1), 6) + 0.0 AS ymin, round(max(x1), 6) + 0.0 AS xmax,
    round(max(y1), 6) + 0.0 AS ymax FROM zone_edges JOIN zones USING (code) GROUP BY climate
    UNION ALL SELECT segment, round(min(lon), 6), round(min(lat), 6), round(max(lon), 6), round(max(lat), 6)
    FROM sites GROUP BY segment""",
)
def layer_bbox_query(spark, sf):
    zoned = layer_bbox(zones(spark, sf), ["climate"]).withColumnRenamed("climate", "layer")
    placed = points_bbox(sites(spark, sf), "lon", "lat", ["segment"]).withColumnRenamed("segment", "layer")
    return rounded(zoned.unionByName(placed))


# ---------------------------------------------------------------- points and polygons


@query(
    "within_filter",
    sql_with("sites", "country_edges", pts=PTS, hits=sql_hits("pts", "site_code", "country_edges", "state", False))
    + "SELECT DISTINCT site_code FROM hits",
)
def within_filter(spark, sf):
    return within_any(site_points(spark, sf), country(spark, sf)).select("site_code")


@query(
    "clip_points",
    sql_with("samples", "sites", "country_edges", pts=PTS, hits=sql_hits("pts", "site_code", "country_edges", "state"))
    + "SELECT sample_id, site_code FROM samples WHERE site_code IN (SELECT site_code FROM hits)",
)
def clip_points_query(spark, sf):
    return clip_points(sample_points(spark, sf).select("sample_id", "site_code", "x", "y"), country(spark, sf)).select(
        "sample_id", "site_code"
    )


@query(
    "zone_join",
    sql_with("samples", "sites", "zones", "zone_edges", pts=PTS, hits=sql_hits("pts", "site_code", "zone_edges", "code"))
    + """SELECT sample_id, core_section, clay, code, climate, key_en FROM samples
    JOIN hits USING (site_code) JOIN zones USING (code)""",
)
def zone_join_query(spark, sf):
    s = sample_points(spark, sf).select("sample_id", "core_section", "clay", "x", "y")
    return zone_join(s, zones(spark, sf)).drop("x", "y")


@query(
    "clip_zones",
    sql_with(
        "sites",
        "zones",
        "zone_edges",
        "country_edges",
        pts=PTS,
        hits=sql_hits("pts", "site_code", "zone_edges", "code"),
        kept=sql_hits("pts", "site_code", "country_edges", "state"),
    )
    + "SELECT site_code, code, climate FROM hits JOIN zones USING (code) WHERE site_code IN (SELECT site_code FROM kept)",
)
def clip_zones(spark, sf):
    return zone_join(site_points(spark, sf), zones(spark, sf), country(spark, sf)).select("site_code", "code", "climate")


@query(
    "crop_polygons",
    sql_with(
        "sites",
        "zone_edges",
        pts=PTS,
        boxes2="SELECT code, greatest(min(x1), -110) AS xmin, greatest(min(y1), 30) AS ymin, least(max(x1), -80) AS xmax, "
        "least(max(y1), 42) AS ymax FROM zone_edges GROUP BY code",
        hits=sql_hits("pts", "site_code", "zone_edges", "code"),
    )
    + """SELECT site_code, code FROM hits JOIN boxes2 b USING (code) JOIN pts p USING (site_code)
    WHERE p.x BETWEEN b.xmin AND b.xmax AND p.y BETWEEN b.ymin AND b.ymax""",
)
def crop_polygons_query(spark, sf):
    """Zones cropped to a rectangle, and the sites in what is left of each."""
    cropped = crop_polygons(zones(spark, sf), CROP)
    return join_polygons(site_points(spark, sf), cropped).select("site_code", "code")


@query(
    "basin_join",
    sql_with("samples", "sites", "basin_edges", pts=PTS, hits=sql_hits("pts", "site_code", "basin_edges", "glu_id, glu_nm"))
    + "SELECT sample_id, core_section, clay, glu_id, glu_nm FROM samples JOIN hits USING (site_code)",
)
def basin_join(spark, sf):
    s = sample_points(spark, sf).select("sample_id", "core_section", "clay", "x", "y")
    return zone_join(s, basins(spark, sf)).drop("x", "y")


ROLLUP = """SELECT iso, glu_code, glu_name, c_type, round(avg(weighted_average), 6) AS region_average,
    round(min(min_value), 6) AS region_min_value, round(max(max_value), 6) AS region_max_value,
    round(avg(q1_value), 6) AS region_q1_value, round(avg(q3_value), 6) AS region_q3_value,
    round(quantile_cont(median_value, 0.5), 6) AS region_median_value FROM region_stats
    GROUP BY iso, glu_code, glu_name, c_type"""


@query(
    "basin_choropleth",
    sql_with("basins", "region_stats", rolled=ROLLUP)
    + "SELECT glu_id, glu_nm, rolled.* EXCLUDE (glu_code) FROM basins LEFT JOIN rolled ON glu_id = glu_code",
)
def basin_choropleth_query(spark, sf):
    rolled = region_rollup(region_stats(spark, sf), ["iso", "glu_code", "glu_name", "c_type"])
    return rounded(basin_choropleth(basins(spark, sf), rolled).drop("edges", "xmin", "ymin", "xmax", "ymax"))


# ---------------------------------------------------------------- rasters


@query(
    "raster_window",
    sql_with("cells_top")
    + "SELECT row, col, value FROM cells_top WHERE x BETWEEN -110 AND -80 AND y BETWEEN 30 AND 42",
)
def raster_window_query(spark, sf):
    return raster_window(cells(spark, sf), CROP).select("row", "col", "value")


@query(
    "crop_raster",
    sql_with(
        "cells_top",
        "country_edges",
        box="SELECT min(x1) AS xmin, max(x1) AS xmax, min(y1) AS ymin, max(y1) AS ymax FROM country_edges WHERE state < 'NATION_2'",
    )
    + "SELECT row, col, value FROM cells_top, box WHERE x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax",
)
def crop_raster_query(spark, sf):
    part = country(spark, sf).filter(F.col("state") < "NATION_2")
    return crop_raster(cells(spark, sf), part).select("row", "col", "value")


CELL_PTS = "SELECT row * 50 + col AS cell, x, y FROM cells_top"


@query(
    "mask_raster",
    sql_with("cells_top", "country_edges", pts=CELL_PTS, hits=sql_hits("pts", "cell", "country_edges", "state"))
    + """SELECT row, col, CASE WHEN row * 50 + col IN (SELECT cell FROM hits) THEN value END AS value FROM cells_top""",
)
def mask_raster_query(spark, sf):
    return mask_raster(cells(spark, sf), country(spark, sf), lattice=grid(spark, sf)).select("row", "col", "value")


AT_CELL = """least(floor((49 - lat) / yres)::INT, nrow - 1)::INT AS row, least(floor((lon + 125) / xres)::INT, 49)::INT AS col"""


@query(
    "extract_points",
    sql_with("samples", "sites", "cells_top", spots=f"SELECT site_code, {AT_CELL} FROM sites, grid")
    + """SELECT sample_id, core_section, clay, value AS extracted FROM samples LEFT JOIN spots USING (site_code)
    LEFT JOIN cells_top USING (row, col)""",
)
def extract_points_query(spark, sf):
    s = sample_points(spark, sf).select("sample_id", "core_section", "clay", "x", "y")
    return extract_points(s, cells(spark, sf), grid(spark, sf), out="extracted").drop("x", "y")


def sql_buffer(name: str, cells_name: str, scale: str = "10::DOUBLE") -> dict[str, str]:
    """Per site: mean, count and sd of the cells within the radius."""
    return {
        name: f"""SELECT site_code, avg(value / {scale}) AS m, count(value) AS n, stddev_samp(value / {scale}) AS s
    FROM pts p LEFT JOIN {cells_name} c ON (c.x - p.x) * (c.x - p.x) + (c.y - p.y) * (c.y - p.y) <= {RADIUS_DEG * RADIUS_DEG}
    GROUP BY site_code"""
    }


def buffer_rows(spark, sf, value="clay"):
    """Samples with a value and the buffer statistics of their section's raster."""
    s = sample_points(spark, sf).filter(F.col(value).isNotNull())
    s = stage(s.select("sample_id", "site_code", "core_section", value, "x", "y"))
    sections = {
        section: (s.filter(F.col("core_section") == section), cells(spark, sf, raster))
        for section, raster in (("TOP", "top"), ("BTM", "btm"))
    }
    return buffer_comparison(sections, RADIUS_DEG, lattice=grid(spark, sf))


BUFFER_CTES = dict(
    pts=PTS,
    **sql_buffer("b_top", "cells_top"),
    **sql_buffer("b_btm", "cells_btm"),
    buffers="""SELECT sample_id, core_section, clay, coalesce(t.m, b.m) AS sg_mean, coalesce(t.n, b.n) AS sg_count,
    coalesce(t.s, b.s) AS sg_sd FROM samples s
    LEFT JOIN b_top t ON s.site_code = t.site_code AND core_section = 'TOP'
    LEFT JOIN b_btm b ON s.site_code = b.site_code AND core_section = 'BTM'
    WHERE clay IS NOT NULL AND core_section IN ('TOP', 'BTM')""",
)


@query(
    "buffer_stats",
    sql_with("samples", "sites", "cells_top", "cells_btm", **BUFFER_CTES)
    + """SELECT sample_id, core_section, clay, round(sg_mean, 6) AS sg_mean, sg_count, round(sg_sd, 6) AS sg_sd FROM buffers""",
)
def buffer_stats_query(spark, sf):
    return rounded(buffer_rows(spark, sf).drop("site_code", "x", "y"))


PH_CTES = BUFFER_CTES | {"buffers": BUFFER_CTES["buffers"].replace("clay", "ph")}


@query(
    "buffer_stats_ph",
    sql_with("samples", "sites", "cells_top", "cells_btm", **PH_CTES)
    + """SELECT sample_id, core_section, round(ph, 6) AS ph, round(sg_mean, 6) AS sg_mean, sg_count, round(sg_sd, 6) AS sg_sd FROM buffers""",
)
def buffer_stats_ph(spark, sf):
    return rounded(buffer_rows(spark, sf, "ph").drop("site_code", "x", "y"))


ZONE_CTES = dict(
    cell_pts=CELL_PTS,
    cell_hits=sql_hits("cell_pts", "cell", "zone_edges", "code"),
    zone_vals="""SELECT DISTINCT code AS zone, value FROM cell_hits JOIN cells_top ON cell = row * 50 + col
    WHERE value IS NOT NULL""",
)


@query("zone_values", sql_with("cells_top", "zones", "zone_edges", **ZONE_CTES) + "SELECT zone, value FROM zone_vals")
def zone_values_query(spark, sf):
    return zone_values(cells(spark, sf), zones(spark, sf), lattice=grid(spark, sf))


_HALF = "(e.x1 + e.x2) / 2 - p.x AS mx, (e.y1 + e.y2) / 2 - p.y AS my, (e.x2 - e.x1) / 2 AS dx, (e.y2 - e.y1) / 2 AS dy, xres / 2 AS hx, yres / 2 AS hy"


def sql_touching(points: str, point_key: str, edges: str, polygon_key: str) -> str:
    """Pairs of cells and polygons whose edges enter the cell's square, by separating axes."""
    return f"""SELECT DISTINCT {point_key}, {polygon_key} FROM (SELECT p.{point_key}, e.{polygon_key}, {_HALF} FROM {points} p, {edges} e, grid)
    WHERE abs(mx) <= hx + abs(dx) AND abs(my) <= hy + abs(dy) AND abs(dx * my - dy * mx) <= hx * abs(dy) + hy * abs(dx)"""


TOUCHED_ZONES = dict(
    cell_pts=CELL_PTS,
    even=sql_hits("cell_pts", "cell", "zone_edges", "code", False),
    entered=sql_touching("cell_pts", "cell", "zone_edges", "code"),
    layers="SELECT * FROM cells_top UNION ALL SELECT * FROM cells_btm",
)


@query(
    "zone_values_touched",
    sql_with("cells_top", "cells_btm", "zones", "zone_edges", **TOUCHED_ZONES)
    + """SELECT DISTINCT code AS zone, raster_id, value FROM (SELECT * FROM even UNION SELECT * FROM entered)
    JOIN layers ON cell = row * 50 + col WHERE value IS NOT NULL""",
)
def zone_values_touched(spark, sf):
    """Two layers in one table, and every cell that a zone touches."""
    both = cells(spark, sf).unionByName(cells(spark, sf, "btm"))
    return zone_values(both, zones(spark, sf), grid=grid(spark, sf), keep=["raster_id"])


@query(
    "buffer_by_layer",
    sql_with("sites", "cells_btm", pts=PTS, **sql_buffer("b_btm", "cells_btm"))
    + "SELECT site_code, round(m, 6) AS sg_mean, n AS sg_count, round(s, 6) AS sg_sd FROM b_btm",
)
def buffer_by_layer(spark, sf):
    """Buffers over one layer of a table of two."""
    both = cells(spark, sf).unionByName(cells(spark, sf, "btm"))
    return rounded(buffer_stats(site_points(spark, sf).select("site_code", "x", "y"), both, RADIUS_DEG, layer="btm", lattice=grid(spark, sf, "btm")).drop("x", "y"))


@query(
    "warp_bilinear",
    sql_with("cells_top", **warp_steps("cells_top")) + "SELECT row, col, round(value, 4) AS value FROM warped",
)
def warp_bilinear_query(spark, sf):
    warped = warp_bilinear(cells(spark, sf), grid(spark, sf), albers_grid(spark, sf))
    return rounded(warped.select("row", "col", "value"), 4)


def _masked_steps(cells_name: str) -> dict[str, str]:
    """Crop to the country, warp, and mask by the transformed country polygons."""
    first = sql_to_albers("country_edges", "x1", "y1", "ax1", "ay1")
    second = sql_to_albers(f"({first})", "x2", "y2", "ax2", "ay2")
    return {
        "box": "SELECT min(x1) AS bx0, max(x1) AS bx1, min(y1) AS by0, max(y1) AS by1 FROM country_edges",
        "cropped": f"SELECT row, col, value FROM {cells_name}, box WHERE x BETWEEN bx0 AND bx1 AND y BETWEEN by0 AND by1",
        **warp_steps("cropped"),
        "moved": f"SELECT state, ax1 AS x1, ay1 AS y1, ax2 AS x2, ay2 AS y2 FROM ({second})",
        "warped_pts": "SELECT row * 50 + col AS cell, x, y FROM warped",
        "warped_in": sql_hits("warped_pts", "cell", "moved", "state"),
        "masked": """SELECT row, col, x, y, value FROM warped WHERE row * 50 + col IN (SELECT cell FROM warped_in)""",
    }


def masked_raster(spark, sf, raster_id="top", keep_outside=False):
    return read_project_mask(
        cells(spark, sf, raster_id),
        grid(spark, sf, raster_id),
        albers_grid(spark, sf),
        country(spark, sf),
        albers_country(spark, sf),
        keep_outside,
    )


@query(
    "read_project_mask",
    sql_with("cells_top", "country_edges", **_masked_steps("cells_top"))
    + """SELECT w.row, w.col, round(m.value, 4) AS value FROM warped w LEFT JOIN masked m ON w.row = m.row AND w.col = m.col""",
)
def read_project_mask_query(spark, sf):
    return rounded(masked_raster(spark, sf, keep_outside=True).select("row", "col", "value"), 4)


BUFFER_M = 150000.0
RS_CTES = dict(
    **_masked_steps("cells_rs"),
    apts=f"""SELECT site_code, x, y FROM ({sql_to_albers("sites", "lon", "lat")})""",
    rs_site=f"""SELECT site_code, avg(value) AS m, count(value) AS n, stddev_samp(value) AS s FROM apts p
    LEFT JOIN masked c ON (c.x - p.x) * (c.x - p.x) + (c.y - p.y) * (c.y - p.y) <= {BUFFER_M * BUFFER_M} GROUP BY site_code""",
)


def rs_rows(spark, sf):
    """Sample rows with the buffer statistics of the masked respiration raster, in the working system."""
    named = sample_tokens(samples(spark, sf).drop("site_code", "core_section"), "sample_name", "site_code", "core_section")
    return respiration_buffer(
        named.select("sample_id", "sample_name", "site_code", "core_section", "ppm", "r24", "r96"),
        to_albers(site_points(spark, sf)),
        masked_raster(spark, sf, "rs"),
        BUFFER_M,
        "site_code",
        scale=1.0,
        lattice=albers_grid(spark, sf),
    )


@query(
    "rs_buffer",
    sql_with("samples", "sites", "cells_rs", "country_edges", **RS_CTES)
    + """SELECT sample_id, site_code, core_section, round(m, 4) AS gridded_mean, n AS gridded_count, round(s, 4) AS gridded_sd
    FROM samples JOIN rs_site USING (site_code)""",
)
def rs_buffer(spark, sf):
    return rounded(
        rs_rows(spark, sf).select("sample_id", "site_code", "core_section", "gridded_mean", "gridded_count", "gridded_sd"), 4
    )
