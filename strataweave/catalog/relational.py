"""Queries for scans, projections, filters, joins, unions and pivots."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strataweave.catalog import query
from strataweave.catalog.layers import basins, cells, cores, region_stats, samples, sites, sql_with, stack, table, zones
from strataweave.catalog.rounding import rounded
from strataweave.functions.nulls import lenient_double, number_text, paste, row_mean
from strataweave.functions.text import number_after, prefix, separate, token
from strataweave.functions.units import flux_to_soil_mass, rescale
from strataweave.operators.clean import (
    complete_cases,
    drop_geometry,
    error_bounds,
    keep_listed,
    keep_present,
    label_by_presence,
    project,
    relabel,
    rename_dynamic,
    rename_tail,
    tag,
    western_longitude,
)
from strataweave.operators.groups import present_table
from strataweave.operators.joins import inner_join, left_join, located_only, semi_join
from strataweave.operators.reshape import pivot_counts, sample_sizes, union_fill, union_strict, unpivot, with_row_id
from strataweave.session import staging_dir
from strataweave.sources.checkpoints import load_tables, save_tables
from strataweave.sources.polygons import edge_rows, parse_geojson
from strataweave.sources.rasters import read_monthly_stack, read_raster, write_raster
from strataweave.sources.tables import MISSING, SCHEMAS, read_csv, read_parquet

# ---------------------------------------------------------------- scans and sinks


@query("scan_table", "SELECT c_custkey, c_name, c_nationkey, c_acctbal + 0.0 AS c_acctbal, c_mktsegment FROM customer")
def scan_table(spark, sf):
    return read_parquet(spark, f"{sf}/customer.parquet")


CSV_SCHEMA = "respiration_summary"


@query(
    "scan_csv",
    sql_with("samples")
    + """SELECT sample_name AS Sample_Name, sampling_set AS Sampling_Set, 'P' || proposal_id AS Proposal_ID, core_section AS Core_Section,
    round(ph, 6) AS pH, round(clay, 6) AS Clay_percent, round(ppm, 6) AS respiration_ppm_co2_c,
    round(r24, 6) AS respiration_mg_co2_c_g_soil_day_24hour, round(r96, 6) AS respiration_mg_co2_c_g_soil_day_96hour FROM samples""",
)
def scan_csv(spark, sf):
    """Samples written as CSV with a header, missing values as text, and read back by name."""
    folder = f"{staging_dir(spark)}/csv-{uuid.uuid4().hex}"
    sources = dict(zip(SCHEMAS[CSV_SCHEMA].fieldNames(), ("sample_name", "sampling_set", "proposal_id", "core_section", "ph", "clay", "ppm", "r24", "r96")))
    s = samples(spark, sf).withColumn("proposal_id", F.concat(F.lit("P"), "proposal_id"))
    written = s.select(F.lit(1).alias("extra"), *[F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias(n) for n, c in sources.items()])
    written.write.csv(folder, header=True)
    return rounded(read_csv(spark, folder, CSV_SCHEMA))


@query(
    "scan_polygons",
    sql_with("zone_edges", "zones")
    + """SELECT code, climate, edge::INT AS edge, round(x1, 6) + 0.0 AS x1, round(y1, 6) + 0.0 AS y1,
    round(x2, 6) + 0.0 AS x2, round(y2, 6) + 0.0 AS y2 FROM zone_edges JOIN zones USING (code)""",
)
def scan_polygons(spark, sf):
    """Zones written as GeoJSON features, one per row, and parsed back."""
    corner = F.expr("transform(edges, e -> array(e.x1, e.y1))")
    feature = F.to_json(
        F.struct(
            F.lit("Feature").alias("type"),
            F.struct("code", "climate").alias("properties"),
            F.struct(F.lit("Polygon").alias("type"), F.array(corner).alias("coordinates")).alias("geometry"),
        )
    )
    layer = parse_geojson(zones(spark, sf).select(feature.alias("value")), {"code": "string", "climate": "string"})
    return rounded(edge_rows(layer, "code", "climate"))


@query(
    "scan_raster",
    sql_with("cells_top", "cells_btm", "cells_rs")
    + " UNION ALL ".join(
        f"SELECT raster_id, row, col, round(x, 6) AS x, round(y, 6) AS y, round(value, 6) + 0.0 AS value FROM cells_{r}" for r in ("top", "btm", "rs")
    ),
)
def scan_raster(spark, sf):
    """All layers written as one raster table and read back."""
    folder = f"{staging_dir(spark)}/raster-{uuid.uuid4().hex}"
    write_raster(union_strict(*[cells(spark, sf, r) for r in ("top", "btm", "rs")]), folder)
    return rounded(read_raster(spark, folder))


@query(
    "scan_monthly_stack",
    sql_with("stack") + "SELECT raster_id, row, col, month, round(value, 6) + 0.0 AS value FROM stack",
)
def scan_monthly_stack(spark, sf):
    """Both variables written as one raster table and read back one by one."""
    folder = f"{staging_dir(spark)}/stack-{uuid.uuid4().hex}"
    write_raster(union_strict(*[stack(spark, sf, v) for v in ("prec", "tavg")]), folder)
    return rounded(union_strict(*[read_monthly_stack(spark, folder, v) for v in ("prec", "tavg")]))


@query(
    "presentation_table",
    sql_with("region_stats")
    + """SELECT glu_name AS "Basin", c_type AS "Content type", round(avg(weighted_average), 6) AS "Mean of averages" FROM region_stats
    GROUP BY glu_name, c_type""",
)
def presentation_table(spark, sf):
    means = region_stats(spark, sf).groupBy("glu_name", "c_type").agg(F.avg("weighted_average").alias("mean"))
    return rounded(present_table(means, {"glu_name": "Basin", "c_type": "Content type", "mean": "Mean of averages"}))


@query(
    "checkpoint_roundtrip",
    sql_with("sites") + "SELECT site_code, segment, round(lon, 6) AS lon, round(lat, 6) AS lat FROM sites",
)
def checkpoint_roundtrip(spark, sf):
    """Write the sites once to a fresh folder and load them back."""
    folder = f"{staging_dir(spark)}/saved-{uuid.uuid4().hex}"
    save_tables({"sites": sites(spark, sf).select("site_code", "segment", "lon", "lat")}, folder)
    return rounded(load_tables(spark, ["sites"], folder)["sites"])


@query("drop_geometry", sql_with("basins") + "SELECT glu_id, glu_nm FROM basins")
def drop_geometry_query(spark, sf):
    return drop_geometry(basins(spark, sf))


# ---------------------------------------------------------------- projections and scalar functions


@query("project_rename", "SELECT o_orderkey, o_custkey AS site, o_orderpriority AS priority FROM orders")
def project_rename(spark, sf):
    return project(table(spark, sf, "orders"), "o_orderkey", site="o_custkey", priority="o_orderpriority")


@query("dynamic_rename", sql_with("cores") + "SELECT sample_id, core_section, clay AS measured FROM cores")
def dynamic_rename(spark, sf):
    return rename_dynamic(cores(spark, sf).select("sample_id", "core_section", "clay"), "clay", "measured")


@query(
    "rename_tail_cast",
    """SELECT l_orderkey, l_linenumber, l_returnflag, TRY_CAST(l_returnflag AS DOUBLE) AS sg_mean,
    l_quantity AS sg_count, CAST(l_partkey AS DOUBLE) AS sg_sd FROM lineitem""",
)
def rename_tail_cast(spark, sf):
    li = table(spark, sf, "lineitem")
    text = [F.col(c).cast("string").alias(f"V{i}") for i, c in enumerate(("l_returnflag", "l_quantity", "l_partkey"))]
    return rename_tail(li.select("l_orderkey", "l_linenumber", "l_returnflag", *text), ["sg_mean", "sg_count", "sg_sd"])


@query("tag_source", sql_with("cores") + "SELECT sample_id, core_section, 'own' AS source, 1 AS batch FROM cores")
def tag_source(spark, sf):
    return tag(cores(spark, sf).select("sample_id", "core_section"), source="own", batch=1)


@query("unit_scale", sql_with("cells_top") + "SELECT row, col, value / 10 AS value FROM cells_top")
def unit_scale(spark, sf):
    return cells(spark, sf).select("row", "col", rescale("value", 10).alias("value"))


@query(
    "flux_convert",
    sql_with("cells_rs")
    + "SELECT row, col, round(value * (1000::DOUBLE / (1.33::DOUBLE * 10 * 10000 * 365)), 9) AS rate FROM cells_rs",
)
def flux_convert(spark, sf):
    return rounded(cells(spark, sf, "rs").select("row", "col", flux_to_soil_mass("value").alias("rate")), 9)


_PARTS = "regexp_split_to_array({}, '[^A-Za-z0-9]+')"


@query(
    "separate_columns",
    sql_with("samples")
    + f"""SELECT sample_id, {_PARTS.format("sampling_set")}[1] AS prj, {_PARTS.format("sampling_set")}[2] AS site,
    {_PARTS.format("sampling_set")}[3] AS rest FROM samples""",
)
def separate_columns(spark, sf):
    return separate(samples(spark, sf).select("sample_id", "sampling_set"), "sampling_set", ["prj", "site", "rest"])


@query(
    "token_extract",
    sql_with("samples")
    + """SELECT sample_id, split_part(sample_name, '_', 3) AS site, split_part(sample_name, '_', 4) AS section,
    NULL::VARCHAR AS absent FROM samples""",
)
def token_extract(spark, sf):
    named = samples(spark, sf)
    tokens = [token("sample_name", k).alias(n) for k, n in ((3, "site"), (4, "section"), (5, "absent"))]
    return named.select("sample_id", *tokens)


@query("site_prefix", sql_with("sites") + "SELECT site_code, substr(site_code, 1, 2) AS location FROM sites")
def site_prefix(spark, sf):
    return sites(spark, sf).select("site_code", prefix("site_code", 2).alias("location"))


@query(
    "label_concat",
    sql_with("cores")
    + """SELECT sample_id, core_section || ' = ' || coalesce(CAST(CAST(clay AS BIGINT) AS VARCHAR), 'NA') AS label
    FROM cores""",
)
def label_concat(spark, sf):
    c = cores(spark, sf)
    return c.select("sample_id", paste("core_section", F.lit(" = "), number_text("clay")).alias("label"))


@query(
    "lenient_cast",
    """SELECT o_orderkey, TRY_CAST(o_orderpriority AS DOUBLE) AS none, TRY_CAST(left(o_orderpriority, 1) AS DOUBLE) AS level,
    CAST(o_custkey AS VARCHAR) AS site FROM orders""",
)
def lenient_cast(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(
        "o_orderkey",
        lenient_double("o_orderpriority").alias("none"),
        lenient_double(F.left("o_orderpriority", F.lit(1))).alias("level"),
        number_text(F.col("o_custkey").cast("double")).alias("site"),
    )


@query(
    "fix_longitude",
    sql_with("sites")
    + "SELECT site_code, round(CASE WHEN raw_lon > 0 THEN -raw_lon ELSE raw_lon END, 6) AS longitude FROM sites",
)
def fix_longitude(spark, sf):
    return rounded(sites(spark, sf).select("site_code", western_longitude("raw_lon").alias("longitude")))


@query(
    "label_by_presence",
    sql_with("cores")
    + "SELECT sample_id, CASE WHEN ppm IS NOT NULL THEN 'own ppm' ELSE 'own rate' END AS label FROM cores",
)
def label_by_presence_query(spark, sf):
    return cores(spark, sf).select("sample_id", label_by_presence("ppm", "own ppm", "own rate").alias("label"))


@query(
    "relabel_source",
    sql_with("cores")
    + "SELECT sample_id, CASE WHEN core_section = 'TOP' THEN 'own_clay' ELSE 'comp_clay' END AS experiment FROM cores",
)
def relabel_source(spark, sf):
    return cores(spark, sf).select("sample_id", relabel("core_section", "TOP", "own_clay", "comp_clay").alias("experiment"))


@query(
    "month_from_name",
    "SELECT event_id, TRY_CAST(replace(name, 'prec_', '') AS DOUBLE) AS month FROM "
    "(SELECT event_id, CASE WHEN event_type = 'view' THEN 'unnamed' ELSE 'prec_' || strftime(ts, '%m') END AS name FROM events)",
)
def month_from_name(spark, sf):
    e = table(spark, sf, "events")
    name = F.when(F.col("event_type") == "view", "unnamed").otherwise(
        F.concat(F.lit("prec_"), F.date_format("ts", "MM"))
    )
    return e.select("event_id", name.alias("name")).select("event_id", number_after("name", "prec_").alias("month"))


@query(
    "annual_climate",
    sql_with("stack")
    + """SELECT row, col, round(avg(value) FILTER (WHERE raster_id = 'tavg'), 6) + 0.0 AS MAT,
    round(avg(value) FILTER (WHERE raster_id = 'prec') * 12, 6) + 0.0 AS MAP FROM stack GROUP BY row, col""",
)
def annual_climate(spark, sf):
    """Wide monthly columns per cell and their row means."""
    months = [f"m{m}" for m in range(1, 13)]

    def wide(variable):
        monthly = [F.max(F.when(F.col("month") == m, F.col("value"))).alias(f"m{m}") for m in range(1, 13)]
        return stack(spark, sf, variable).groupBy("row", "col").agg(*monthly)

    tavg = wide("tavg").select("row", "col", row_mean(*months).alias("MAT"))
    prec = wide("prec").select("row", "col", (row_mean(*months) * 12).alias("MAP"))
    return rounded(tavg.join(prec, ["row", "col"]))


@query(
    "row_id_lookup",
    sql_with("sites")
    + """SELECT id, site_code AS place FROM (SELECT row_number() OVER (ORDER BY site_code) AS id, site_code FROM sites)""",
)
def row_id_lookup(spark, sf):
    """Number the sites, then find each place again by its number."""
    numbered = with_row_id(sites(spark, sf).select("site_code"), ["site_code"], "id")
    return inner_join(numbered.select("id"), numbered.withColumnRenamed("site_code", "place"), "id").select(
        F.col("id").cast("long"), "place"
    )


@query(
    "error_bounds",
    sql_with("cores") + "SELECT sample_id, round(r24 - r96, 6) + 0.0 AS ymin, round(r24 + r96, 6) + 0.0 AS ymax FROM cores",
)
def error_bounds_query(spark, sf):
    return rounded(error_bounds(cores(spark, sf), "r24", "r96").select("sample_id", "ymin", "ymax"))


# ---------------------------------------------------------------- filters


@query(
    "filter_section",
    sql_with("cores") + "SELECT sample_id, core_section, proposal_id FROM cores WHERE core_section = 'TOP' AND proposal_id <> 7",
)
def filter_section(spark, sf):
    c = cores(spark, sf).filter((F.col("core_section") == "TOP") & (F.col("proposal_id") != 7))
    return c.select("sample_id", "core_section", "proposal_id")


LISTED = ("BUILDING", "MACHINERY", "FURNITURE")


@query("filter_in_list", f"SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN {LISTED}")
def filter_in_list(spark, sf):
    c = table(spark, sf, "customer")
    return keep_listed(c, "c_mktsegment", LISTED).select("c_custkey", "c_mktsegment")


@query(
    "filter_missing",
    sql_with("cores") + "SELECT sample_id, clay, ppm + 0.0 AS ppm FROM cores WHERE clay IS NOT NULL OR ppm IS NOT NULL",
)
def filter_missing(spark, sf):
    return keep_present(cores(spark, sf), "clay", "ppm").select("sample_id", "clay", "ppm")


@query(
    "complete_cases",
    sql_with("cores") + "SELECT sample_id, clay, ppm FROM cores WHERE clay IS NOT NULL AND ppm IS NOT NULL",
)
def complete_cases_query(spark, sf):
    return complete_cases(cores(spark, sf).select("sample_id", "clay", "ppm"))


# ---------------------------------------------------------------- joins


@query(
    "left_join_key",
    sql_with("samples", "sites") + "SELECT s.sample_id, s.site_code, t.segment FROM samples s LEFT JOIN sites t USING (site_code)",
)
def left_join_key(spark, sf):
    s = samples(spark, sf).select("sample_id", "site_code")
    return left_join(s, sites(spark, sf).select("site_code", "segment"), "site_code")


@query(
    "left_join_multikey",
    sql_with("cores")
    + """, slots AS (SELECT l_suppkey AS supp, l_linenumber AS line, max(l_partkey) AS plot FROM lineitem
    WHERE l_returnflag = 'A' GROUP BY l_suppkey, l_linenumber)
    SELECT sample_id, proposal_id, set_no, plot FROM cores LEFT JOIN slots ON proposal_id = supp AND set_no = line""",
)
def left_join_multikey(spark, sf):
    li = table(spark, sf, "lineitem").filter(F.col("l_returnflag") == "A")
    slots = project(li, "l_partkey", supp="l_suppkey", line="l_linenumber")
    slots = slots.groupBy("supp", "line").agg(F.max("l_partkey").alias("plot"))
    left = cores(spark, sf).select("sample_id", "proposal_id", "set_no")
    return left_join(left, slots, {"proposal_id": "supp", "set_no": "line"})


@query(
    "inner_join_renamed",
    sql_with("samples", "sites")
    + "SELECT sample_id, s.site_code, segment FROM samples s JOIN sites t ON s.site_code = t.site_code WHERE t.segment <> 'BUILDING'",
)
def inner_join_renamed(spark, sf):
    places = sites(spark, sf).filter(F.col("segment") != "BUILDING").select(F.col("site_code").alias("place"), "segment")
    return inner_join(samples(spark, sf).select("sample_id", "site_code"), places, {"site_code": "place"})


@query(
    "located_only",
    sql_with("samples", "sites")
    + """SELECT sample_id, s.site_code, round(lon, 6) AS x, round(lat, 6) AS y FROM samples s JOIN sites t USING (site_code)
    WHERE t.lat > 30""",
)
def located_only_query(spark, sf):
    places = sites(spark, sf).filter(F.col("lat") > 30).select("site_code", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return rounded(located_only(samples(spark, sf).select("sample_id", "site_code"), places, "site_code"))


@query(
    "semi_join",
    sql_with("samples", "sites")
    + "SELECT sample_id, site_code FROM samples WHERE site_code IN (SELECT site_code FROM sites WHERE segment = 'BUILDING')",
)
def semi_join_query(spark, sf):
    wanted = sites(spark, sf).filter(F.col("segment") == "BUILDING")
    return semi_join(samples(spark, sf).select("sample_id", "site_code"), wanted, "site_code")


@query(
    "join_suffix",
    """SELECT c.c_custkey AS id, c.c_name AS name_x, s.s_name AS name_y, c.c_acctbal + 0.0 AS balance_x,
    s.s_acctbal + 0.0 AS balance_y FROM customer c LEFT JOIN supplier s ON c.c_custkey = s.s_suppkey""",
)
def join_suffix(spark, sf):
    left = project(table(spark, sf, "customer"), id="c_custkey", name="c_name", balance="c_acctbal")
    right = project(table(spark, sf, "supplier"), id="s_suppkey", name="s_name", balance="s_acctbal")
    joined = left_join(left, right, "id")
    return joined.withColumns({c: F.col(c) + F.lit(0.0) for c in ("balance_x", "balance_y")})


# ---------------------------------------------------------------- unions, distinct, reshaping


@query(
    "distinct_rows",
    sql_with("samples") + "SELECT DISTINCT site_code, core_section, clay FROM samples",
)
def distinct_rows(spark, sf):
    return samples(spark, sf).select("site_code", "core_section", "clay").distinct()


@query(
    "union_fill",
    sql_with("cores", "cells_top")
    + """SELECT sample_id AS id, clay, core_section, NULL::INT AS row FROM cores
    UNION ALL SELECT NULL, value / 10, NULL, row FROM cells_top""",
)
def union_fill_query(spark, sf):
    own = cores(spark, sf).select(F.col("sample_id").alias("id"), "clay", "core_section")
    return union_fill(own, cells(spark, sf).select((F.col("value") / 10).alias("clay"), "row"))


@query(
    "union_strict",
    sql_with("cells_top", "cells_btm")
    + "SELECT raster_id, row, col, value FROM cells_top UNION ALL SELECT raster_id, row, col, value FROM cells_btm",
)
def union_strict_query(spark, sf):
    top, btm = (cells(spark, sf, r).select("raster_id", "row", "col", "value") for r in ("top", "btm"))
    return union_strict(top, btm)


@query(
    "unpivot_climate",
    sql_with("cores")
    + """SELECT sample_id, 'clay' AS climate_parameter, clay AS climate_value FROM cores
    UNION ALL SELECT sample_id, 'ppm', ppm FROM cores""",
)
def unpivot_climate(spark, sf):
    c = cores(spark, sf)
    return unpivot(c, ["sample_id"], ["clay", "ppm"], "climate_parameter", "climate_value")


@query(
    "pivot_counts",
    sql_with("samples")
    + """SELECT site_code, nullif(count(*) FILTER (WHERE core_section = 'TOP'), 0) AS TOP,
    nullif(count(*) FILTER (WHERE core_section = 'BTM'), 0) AS BTM FROM samples GROUP BY site_code""",
)
def pivot_counts_query(spark, sf):
    return pivot_counts(samples(spark, sf), "site_code", "core_section", ["TOP", "BTM"])


@query(
    "sample_sizes",
    sql_with("samples")
    + """, n AS (SELECT site_code, nullif(count(*) FILTER (WHERE core_section = 'TOP'), 0) AS "TOP",
    nullif(count(*) FILTER (WHERE core_section = 'BTM'), 0) AS BTM FROM samples GROUP BY site_code)
    SELECT *, site_code || chr(10) || 'TOP = ' || "TOP" || ', BTM = ' || coalesce(CAST(BTM AS VARCHAR), 'NA') AS axis_label
    FROM n WHERE "TOP" > 1""",
)
def sample_sizes_query(spark, sf):
    return sample_sizes(samples(spark, sf), "site_code", "core_section", "TOP", "BTM")

