"""Sites, samples, polygons and rasters derived from the test tables.

The tables carry no coordinates, so whole-number arithmetic on keys places every row inside the
study window; Spark and the SQL below evaluate it alike. Missing values, mislabelled longitudes
and gaps come from attribute values, so every rule meets data at every scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.functions.geometry import ring_edges, with_box
from strataweave.operators.raster import Grid
from strataweave.sources.lookups import STUDY_WINDOW

NCOL = 50
# Part of a step by which sites are moved off the corner of the window and off cell borders.
OFFSET = 0.29
LON0, LAT0 = STUDY_WINDOW[:2]
LON_SPAN, LAT_SPAN = STUDY_WINDOW[2] - LON0, STUDY_WINDOW[3] - LAT0

# Buffer radius of the registered raster queries, in degrees.
RADIUS_DEG = 1.5


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def sites(spark: SparkSession, sf: str) -> DataFrame:
    """One site per customer; ``raw_lon`` has the wrong sign in one market segment."""
    lon = f"{LON0}D + {LON_SPAN}D * ((c_custkey * 7919) % 10007 + {OFFSET}D) / 10007D"
    lat = f"{LAT0}D + {LAT_SPAN}D * ((c_custkey * 104729) % 10009 + {OFFSET}D) / 10009D"
    return table(spark, sf, "customer").selectExpr(
        "'S' || c_custkey as site_code",
        "c_nationkey as nation",
        "c_mktsegment as segment",
        f"{lon} as lon",
        f"{lat} as lat",
        f"case when c_mktsegment = 'MACHINERY' then -({lon}) else {lon} end as raw_lon",
    )


def cores(spark: SparkSession, sf: str) -> DataFrame:
    """One core sample per line item. The first line of an order has no clay and pH value."""
    return table(spark, sf, "lineitem").selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as sample_id",
        "l_orderkey as order_key",
        "l_suppkey as proposal_id",
        "l_linenumber as set_no",
        "case l_returnflag when 'A' then 'TOP' when 'R' then 'BTM' else 'MID' end as core_section",
        "case when l_linenumber <> 1 then l_quantity end as clay",
        "case when l_linenumber <> 1 then 3D + 50D * (l_discount + 0D) end as ph",
        "l_extendedprice / 1000D as r24",
        "(l_tax + 0D) * 100D as r96",
        "case when l_linestatus = 'F' then l_extendedprice / 1000D * 10D end as ppm",
    )


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Core samples with the site of their order and compound names."""
    o = table(spark, sf, "orders").selectExpr("o_orderkey as order_key", "'S' || o_custkey as site_code")
    # orders grow with their lines: no broadcast, however well their files are compressed
    return cores(spark, sf).join(o.hint("merge"), "order_key").selectExpr(
        "*",
        "'P' || proposal_id || '-' || site_code as sampling_set",
        "concat_ws('_', 'P' || proposal_id, set_no, site_code, core_section) as sample_name",
    )


def coordinates(spark: SparkSession, sf: str) -> DataFrame:
    """One coordinate pair per proposal and sampling set; set 3 has the wrong longitude sign."""
    li = table(spark, sf, "lineitem").selectExpr("l_suppkey as supp", "l_linenumber as line").distinct()
    lon = f"({LON0}D + {LON_SPAN}D * ((supp * 701 + line * 97) % 1009 + {OFFSET}D) / 1009D)"
    return li.selectExpr(
        "supp as proposal_id",
        "line as sampling_set",
        f"{LAT0}D + {LAT_SPAN}D * ((supp * 467 + line * 211) % 1013 + {OFFSET}D) / 1013D as latitude",
        f"case when line = 3 then -{lon} else {lon} end as longitude",
    )


def grid(spark: SparkSession, sf: str, raster_id: str = "top") -> Grid:
    """Header of the study grid: 50 columns, as many rows as the parts need."""
    rows = -(-table(spark, sf, "part").count() // NCOL)
    return Grid(raster_id, LON0, LAT0 + LAT_SPAN, LON_SPAN / NCOL, LAT_SPAN / rows, rows, NCOL)


_ROW_COL = (f"cast(p_partkey div {NCOL} as int) as row", f"cast(p_partkey % {NCOL} as int) as col")


def cells(spark: SparkSession, sf: str, raster_id: str = "top") -> DataFrame:
    """One cell per part: the layers ``top``, ``btm`` (values times ten) and ``rs``; size 17 is missing."""
    g = grid(spark, sf, raster_id)
    value = {"top": "p_size * 10D", "btm": "(51 - p_size) * 10D", "rs": "p_retailprice - 900D"}[raster_id]
    at = table(spark, sf, "part").selectExpr(
        f"'{raster_id}' as raster_id", *_ROW_COL, f"case when p_size <> 17 then {value} end as value"
    )
    return at.select("raster_id", "row", "col", g.x_of().alias("x"), g.y_of().alias("y"), "value")


def stack(spark: SparkSession, sf: str, variable: str) -> DataFrame:
    """Twelve months of ``prec`` or ``tavg`` per cell; size 17 is missing in the first half year."""
    value = {"prec": "p_size + cast(month as double)", "tavg": "p_retailprice / 50D - month"}[variable]
    p = table(spark, sf, "part").selectExpr("*", "explode(sequence(1, 12)) as month")
    return p.selectExpr(
        f"'{variable}' as raster_id", *_ROW_COL, "month", f"case when p_size <> 17 or month > 6 then {value} end as value"
    )


def zones(spark: SparkSession, sf: str) -> DataFrame:
    """One sheared box per nation, five by five; the climate is the nation's region.

    Boxes are 11.8 by 5 degrees; their sides lean east by a tenth of a degree per degree.
    """
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.expr("n_regionkey = r_regionkey"), "left")
    n = n.selectExpr(
        "n_name as code",
        "r_name as climate",
        "r_name || ' ' || n_name as key_en",
        f"{LON0}D + 11.8D * (n_nationkey % 5) as x0",
        f"{LAT0}D + 5D * (n_nationkey div 5) as y0",
    )
    n = n.selectExpr("*", "y0 + 5D as y1").selectExpr("*", "0.1D * (y0 - 36.5D) as lean0", "0.1D * (y1 - 36.5D) as lean1")
    corners = [("x0 + lean0", "y0"), ("x0 + 11.8D + lean0", "y0"), ("x0 + 11.8D + lean1", "y1"), ("x0 + lean1", "y1")]
    return with_box(n.select("code", "climate", "key_en", ring_edges(corners).alias("edges")))


COUNTRY_GAPS = ("NATION_0", "NATION_12")


def country(spark: SparkSession, sf: str) -> DataFrame:
    """The boxes of all nations but two: a corner one and the central one."""
    z = zones(spark, sf).withColumnRenamed("code", "state")
    return z.filter(~F.col("state").isin(*COUNTRY_GAPS)).select("state", "edges", "xmin", "ymin", "xmax", "ymax")


def basins(spark: SparkSession, sf: str) -> DataFrame:
    """One stripe per region, rising by two degrees from west to east."""
    r = table(spark, sf, "region").selectExpr(
        "cast(r_regionkey as bigint) as glu_id", "r_name as glu_nm", f"{LAT0}D + 5D * r_regionkey as y0"
    )
    west, east = f"{LON0}D", f"{LON0 + LON_SPAN}D"
    ring = ring_edges([(west, "y0"), (east, "y0 + 2D"), (east, "y0 + 7D"), (west, "y0 + 5D")])
    return with_box(r.select("glu_id", "glu_nm", ring.alias("edges")))


def region_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Regional statistics per part: country from the type, content type from the brand."""
    return table(spark, sf, "part").selectExpr(
        "p_type as iso",
        "cast(p_size % 5 as bigint) as glu_code",
        "'basin ' || p_size % 5 as glu_name",
        "p_brand as c_type",
        "cast(p_size as double) as weighted_average",
        "p_retailprice / 20D as median_value",
        "p_size / 2D as min_value",
        "p_size * 2D as max_value",
        "p_size * 0.75D as q1_value",
        "p_size * 1.25D as q3_value",
    )


# The same layers in SQL. Polygons are edge rows: part of the key, edge number, x1, y1, x2, y2.
_GRID = "SELECT 59::DOUBLE / 50 AS xres, 25::DOUBLE / ((count(*) + 49) // 50) AS yres, (count(*) + 49) // 50 AS nrow FROM part"
_PLACE = (
    "SELECT p_partkey, p_size, p_retailprice, CAST(p_partkey // 50 AS INT) AS row, CAST(p_partkey % 50 AS INT) AS col, "
    "-125::DOUBLE + (CAST(p_partkey % 50 AS INT) + 0.5::DOUBLE) * xres AS x, "
    "49::DOUBLE - (CAST(p_partkey // 50 AS INT) + 0.5::DOUBLE) * yres AS y FROM part, grid"
)
_BOXES = """SELECT n_name, r_name, x0 + lean0 AS ax, y0 AS ay, x0 + 11.8::DOUBLE + lean0 AS bx, y0 AS by_,
  x0 + 11.8::DOUBLE + lean1 AS cx, y1 AS cy, x0 + lean1 AS dx, y1 AS dy
  FROM (SELECT *, 0.1::DOUBLE * (y0 - 36.5::DOUBLE) AS lean0, 0.1::DOUBLE * (y1 - 36.5::DOUBLE) AS lean1
    FROM (SELECT *, y0 + 5::DOUBLE AS y1 FROM (SELECT n_name, r_name,
      -125::DOUBLE + 11.8::DOUBLE * (n_nationkey % 5) AS x0, 24::DOUBLE + 5::DOUBLE * (n_nationkey // 5) AS y0
      FROM nation LEFT JOIN region ON n_regionkey = r_regionkey)))"""


def _edges(key: str, source: str) -> str:
    """Edge rows of the four-cornered shapes in ``source``."""
    corners = (("ax", "ay"), ("bx", "by_"), ("cx", "cy"), ("dx", "dy"))
    sides = zip(corners, corners[1:] + corners[:1])
    return " UNION ALL ".join(
        f"SELECT {key}, {i} AS edge, {a} AS x1, {b} AS y1, {c} AS x2, {e} AS y2 FROM {source}"
        for i, ((a, b), (c, e)) in enumerate(sides)
    )


_CTES = {
    "sites": """SELECT 'S' || c_custkey AS site_code, c_nationkey AS nation, c_mktsegment AS segment, lon, lat,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN -lon ELSE lon END AS raw_lon FROM (SELECT *,
  -125::DOUBLE + 59::DOUBLE * ((c_custkey * 7919) % 10007 + 0.29::DOUBLE) / 10007::DOUBLE AS lon,
  24::DOUBLE + 25::DOUBLE * ((c_custkey * 104729) % 10009 + 0.29::DOUBLE) / 10009::DOUBLE AS lat FROM customer)""",
    "coordinates": """SELECT supp AS proposal_id, line AS sampling_set, lat AS latitude,
  CASE WHEN line = 3 THEN -lon ELSE lon END AS longitude FROM (SELECT *,
  -125::DOUBLE + 59::DOUBLE * ((supp * 701 + line * 97) % 1009 + 0.29::DOUBLE) / 1009::DOUBLE AS lon,
  24::DOUBLE + 25::DOUBLE * ((supp * 467 + line * 211) % 1013 + 0.29::DOUBLE) / 1013::DOUBLE AS lat
  FROM (SELECT DISTINCT l_suppkey AS supp, l_linenumber AS line FROM lineitem))""",
    "cores": """SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS sample_id,
  l_orderkey AS order_key, l_suppkey AS proposal_id, l_linenumber AS set_no,
  CASE l_returnflag WHEN 'A' THEN 'TOP' WHEN 'R' THEN 'BTM' ELSE 'MID' END AS core_section,
  CASE WHEN l_linenumber <> 1 THEN l_quantity END AS clay,
  CASE WHEN l_linenumber <> 1 THEN 3::DOUBLE + 50::DOUBLE * (l_discount + 0.0::DOUBLE) END AS ph,
  l_extendedprice / 1000::DOUBLE AS r24, (l_tax + 0.0::DOUBLE) * 100::DOUBLE AS r96,
  CASE WHEN l_linestatus = 'F' THEN l_extendedprice / 1000::DOUBLE * 10::DOUBLE END AS ppm FROM lineitem""",
    "samples": """SELECT c.*, 'S' || o_custkey AS site_code, 'P' || proposal_id || '-S' || o_custkey AS sampling_set,
  'P' || proposal_id || '_' || set_no || '_S' || o_custkey || '_' || core_section AS sample_name
  FROM cores c JOIN orders ON o_orderkey = order_key""",
    "grid": _GRID,
    "place": _PLACE,
    "cells_top": "SELECT 'top' AS raster_id, row, col, x, y, CASE WHEN p_size <> 17 THEN p_size::DOUBLE * 10 END AS value FROM place",
    "cells_btm": "SELECT 'btm' AS raster_id, row, col, x, y, CASE WHEN p_size <> 17 THEN (51 - p_size)::DOUBLE * 10 END AS value FROM place",
    "cells_rs": "SELECT 'rs' AS raster_id, row, col, x, y, CASE WHEN p_size <> 17 THEN p_retailprice - 900::DOUBLE END AS value FROM place",
    "stack": """SELECT variable AS raster_id, row, col, month, CASE WHEN p_size <> 17 OR month > 6 THEN
  CASE variable WHEN 'prec' THEN p_size::DOUBLE + month ELSE p_retailprice / 50::DOUBLE - month END END AS value
  FROM place, (SELECT unnest(range(1, 13))::INT AS month), (VALUES ('prec'), ('tavg')) v(variable)""",
    "boxes": _BOXES,
    "zones": "SELECT n_name AS code, r_name AS climate, r_name || ' ' || n_name AS key_en FROM boxes",
    "zone_edges": _edges("n_name AS code", "boxes"),
    "country_edges": _edges("n_name AS state", "boxes WHERE n_name NOT IN ('NATION_0', 'NATION_12')"),
    "stripes": """SELECT r_regionkey::BIGINT AS glu_id, r_name AS glu_nm, -125::DOUBLE AS ax, y0 AS ay, -66::DOUBLE AS bx,
  y0 + 2::DOUBLE AS by_, -66::DOUBLE AS cx, y0 + 7::DOUBLE AS cy, -125::DOUBLE AS dx, y0 + 5::DOUBLE AS dy
  FROM (SELECT *, 24::DOUBLE + 5::DOUBLE * r_regionkey AS y0 FROM region)""",
    "basins": "SELECT glu_id, glu_nm FROM stripes",
    "basin_edges": _edges("glu_id, glu_nm", "stripes"),
    "region_stats": """SELECT p_type AS iso, (p_size % 5)::BIGINT AS glu_code, 'basin ' || (p_size % 5) AS glu_name,
  p_brand AS c_type, p_size::DOUBLE AS weighted_average, p_retailprice / 20::DOUBLE AS median_value,
  p_size::DOUBLE / 2 AS min_value, p_size::DOUBLE * 2 AS max_value, p_size::DOUBLE * 0.75 AS q1_value,
  p_size::DOUBLE * 1.25 AS q3_value FROM part""",
}

_NEEDS = {
    "samples": ["cores"],
    "place": ["grid"],
    "cells_top": ["place"],
    "cells_btm": ["place"],
    "cells_rs": ["place"],
    "stack": ["place"],
    "zones": ["boxes"],
    "zone_edges": ["boxes"],
    "country_edges": ["boxes"],
    "basins": ["stripes"],
    "basin_edges": ["stripes"],
}


def sql_with(*names: str, **more: str) -> str:
    """WITH clause holding the named layers and what they need, then further named queries."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    parts = [f"{n} AS ({_CTES[n]})" for n in order] + [f"{n} AS ({q})" for n, q in more.items()]
    return "WITH " + ",\n".join(parts) + "\n"


_CROSSED = "(e.y1 > p.y) <> (e.y2 > p.y) AND p.x < (e.x2 - e.x1) * (p.y - e.y1) / (e.y2 - e.y1) + e.x1"
_TOUCHED = (
    "(e.x2 - e.x1) * (p.y - e.y1) - (e.y2 - e.y1) * (p.x - e.x1) = 0 "
    "AND p.x BETWEEN least(e.x1, e.x2) AND greatest(e.x1, e.x2) AND p.y BETWEEN least(e.y1, e.y2) AND greatest(e.y1, e.y2)"
)


def sql_hits(points: str, point_key: str, edges: str, polygon_key: str, boundary: bool = True) -> str:
    """Pairs of point key and polygon keys by the even-odd rule over joined edge rows."""
    odd = f"count(*) FILTER (WHERE CASE WHEN e.y1 = e.y2 THEN false ELSE {_CROSSED} END) % 2 = 1"
    touch = f"count(*) FILTER (WHERE {_TOUCHED})"
    rule = f"{odd} OR {touch} > 0" if boundary else f"{odd} AND {touch} = 0"
    keys = ", ".join(f"e.{k.strip()}" for k in polygon_key.split(","))
    return f"SELECT p.{point_key}, {keys} FROM {points} p, {edges} e GROUP BY p.{point_key}, {keys} HAVING {rule}"
