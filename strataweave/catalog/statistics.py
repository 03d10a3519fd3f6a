"""Queries for summaries, z-scores, regressions and distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataweave.catalog import query
from strataweave.catalog.layers import basins, cores, country, grid, region_stats, sites, sql_hits, sql_with, stack
from strataweave.catalog.rounding import rounded
from strataweave.catalog.sampling import COMBINED, LAYERS, combined_sources
from strataweave.catalog.spatial import (
    AT_CELL,
    BUFFER_CTES,
    PTS,
    ROLLUP,
    RS_CTES,
    buffer_rows,
    rs_rows,
    sample_points,
    site_points,
)
from strataweave.functions.crs import ALBERS, to_albers
from strataweave.operators.clean import keep_present, within_limits
from strataweave.operators.distributions import boxplot_stats, density_histogram, violin_density
from strataweave.operators.groups import region_rollup, source_summary, zscores
from strataweave.operators.joins import semi_join
from strataweave.operators.regression import equation_label, group_regression, one_to_one, regression_band
from strataweave.operators.sampling import entity_sample
from strataweave.plans.climate import (
    climate_by_site,
    climate_facets,
    combine_rates,
    index_with_climate,
    rate_model,
    standardised,
)
from strataweave.plans.comparison import basin_compare, basin_summary
from strataweave.sources.lookups import ENTITY_ROWS, ENTITY_SEED, FIT_LIMITS

# ---------------------------------------------------------------- basins and regions

BASIN_CTES = dict(
    pts=PTS,
    extent="SELECT min(x1) AS ex0, max(x1) AS ex1, min(y1) AS ey0, max(y1) AS ey1 FROM country_edges",
    inside="SELECT pts.* FROM pts, extent WHERE x BETWEEN ex0 AND ex1 AND y BETWEEN ey0 AND ey1",
    hits=sql_hits("inside", "site_code", "basin_edges", "glu_id, glu_nm"),
    by_basin="""SELECT core_section, glu_id, glu_nm, avg(clay) AS clay_mean, stddev_samp(clay) AS clay_sd, min(clay) AS clay_min,
    max(clay) AS clay_max, count(*) AS n FROM samples JOIN hits USING (site_code) WHERE clay IS NOT NULL
    GROUP BY core_section, glu_id, glu_nm""",
)
BASIN_LAYERS = ("samples", "sites", "basin_edges", "country_edges", "region_stats")
BASIN_COLUMNS = "core_section, glu_id, glu_nm, round(clay_mean, 6) AS clay_mean, round(clay_sd, 6) AS clay_sd, clay_min, clay_max, n"


def basin_rows(spark, sf):
    located = sample_points(spark, sf).filter(F.col("clay").isNotNull()).select("core_section", "clay", "x", "y")
    return basin_summary(located, basins(spark, sf), "clay", country(spark, sf))


@query("basin_summary", sql_with(*BASIN_LAYERS, **BASIN_CTES) + f"SELECT {BASIN_COLUMNS} FROM by_basin")
def basin_summary_query(spark, sf):
    return rounded(basin_rows(spark, sf))


@query("region_rollup", sql_with("region_stats") + ROLLUP)
def region_rollup_query(spark, sf):
    return rounded(region_rollup(region_stats(spark, sf), ["iso", "glu_code", "glu_name", "c_type"]))


ISO, CONTENT = "STANDARD", "Brand#12"


@query(
    "basin_compare",
    sql_with(*BASIN_LAYERS, **BASIN_CTES, rolled=ROLLUP)
    + f"""SELECT {BASIN_COLUMNS}, r.* EXCLUDE (glu_code) FROM by_basin
    LEFT JOIN (SELECT * FROM rolled WHERE iso = '{ISO}' AND c_type = '{CONTENT}') r ON glu_id = glu_code""",
)
def basin_compare_query(spark, sf):
    return rounded(basin_compare(basin_rows(spark, sf), region_stats(spark, sf), ISO, CONTENT))


# ---------------------------------------------------------------- climate, index and rates

# Every site has a second point three degrees further east or west.
MOVED = "CASE WHEN lon > -95 THEN lon - 3 ELSE lon + 3 END"
MONTHLY = f"""SELECT ID, place, raster_id, month, round(value, 6) + 0.0 AS value
    FROM (SELECT row_number() OVER (ORDER BY site_code, lon, lat) AS ID, site_code AS place, {AT_CELL} FROM points, grid)
    JOIN stack USING (row, col) WHERE place IN (SELECT site_code FROM (SELECT DISTINCT site_code FROM sites)
    ORDER BY md5('{ENTITY_SEED}|' || site_code) LIMIT {ENTITY_ROWS})"""

CLIMATE = """SELECT site_code AS place, round(lon, 6) AS lon, round(lat, 6) AS lat,
    row_number() OVER (ORDER BY site_code) AS ID,
    round(avg(value) FILTER (WHERE raster_id = 'tavg'), 6) + 0.0 AS MAT,
    round(avg(value) FILTER (WHERE raster_id = 'prec') * 12, 6) + 0.0 AS MAP
    FROM (SELECT *, {at} FROM sites, grid) LEFT JOIN stack USING (row, col) GROUP BY site_code, lon, lat""".format(at=AT_CELL)


def site_climate(spark, sf, row_id=False):
    """Climate at the sites, whose points are in the working system."""
    prec, tavg = (stack(spark, sf, v) for v in ("prec", "tavg"))
    return climate_by_site(to_albers(site_points(spark, sf)), "site_code", ALBERS, prec, tavg, grid(spark, sf), row_id)


@query(
    "climate_monthly",
    sql_with("sites", "stack", points=f"SELECT site_code, lon, lat FROM sites UNION ALL SELECT site_code, {MOVED}, lat FROM sites") + MONTHLY,
)
def climate_monthly(spark, sf):
    """Monthly values at the points of twelve sampled places, each place with two points."""
    once = site_points(spark, sf).select("site_code", "x", "y")
    twice = once.unionByName(once.withColumn("x", F.expr(MOVED.replace("lon", "x"))))
    prec, tavg = (stack(spark, sf, v) for v in ("prec", "tavg"))
    months = climate_by_site(to_albers(twice), "site_code", ALBERS, prec, tavg, grid(spark, sf))
    picked = entity_sample(sites(spark, sf), "site_code", ENTITY_ROWS, ENTITY_SEED)
    both = months.monthly_prec.withColumnRenamed("precipitation", "value").unionByName(
        months.monthly_temp.withColumnRenamed("temperature", "value")
    )
    kept = semi_join(both, picked, {"place": "site_code"}).filter(F.col("raster_id").isNotNull())
    return rounded(kept.select(F.col("ID").cast("long").alias("ID"), "place", "raster_id", "month", "value"))


@query("climate_by_site", sql_with("sites", "stack") + CLIMATE)
def climate_by_site_query(spark, sf):
    annual = site_climate(spark, sf, row_id=True).annual
    return rounded(annual.withColumn("ID", F.col("ID").cast("long")))


RATE_CTES = dict(
    **RS_CTES,
    climate_at=f"""SELECT site_code, avg(value) FILTER (WHERE raster_id = 'tavg') AS MAT,
    avg(value) FILTER (WHERE raster_id = 'prec') * 12 AS MAP
    FROM (SELECT site_code, {AT_CELL} FROM sites, grid) LEFT JOIN stack USING (row, col) GROUP BY site_code""",
    indexed="""SELECT site_code, MAT, MAP, rs_index FROM (SELECT site_code, sum(CASE core_section WHEN 'TOP' THEN 0.65::DOUBLE
    WHEN 'BTM' THEN 0.35::DOUBLE ELSE 0 END * (r24 / 3 + r96 * 2 / 3)) AS rs_index FROM samples GROUP BY site_code)
    JOIN climate_at USING (site_code) WHERE MAT IS NOT NULL AND MAP IS NOT NULL""",
    rates="""SELECT site_code, 'own' AS source, rs_index AS respiration_rate, MAT, MAP FROM indexed
    UNION ALL SELECT site_code, 'gridded', m * (1000::DOUBLE / (1.33::DOUBLE * 10 * 10000 * 365)), MAT, MAP
    FROM indexed JOIN rs_site USING (site_code)""",
    present="SELECT * FROM rates WHERE respiration_rate IS NOT NULL",
)
RATE_LAYERS = ("samples", "sites", "stack", "cells_rs", "country_edges")


def indexed(spark, sf):
    """Rate index by site with its climate."""
    rows = sample_points(spark, sf).select("site_code", "core_section", "r24", "r96")
    return index_with_climate(rows, site_climate(spark, sf).annual, "site_code", "core_section", ("r24", "r96"), "own")


def rates(spark, sf):
    """The index stacked on the gridded rates of the same sites."""
    return combine_rates(indexed(spark, sf), rs_rows(spark, sf), "site_code", "gridded")


def present_rates(spark, sf):
    return keep_present(rates(spark, sf), "respiration_rate")


@query(
    "weighted_index",
    sql_with("samples", "sites", "stack", **{k: RATE_CTES[k] for k in ("climate_at", "indexed")})
    + """SELECT site_code, round(rs_index, 8) AS rs_index, round(MAT, 8) + 0.0 AS MAT, round(MAP, 8) AS MAP, 'own' AS source,
    round(rs_index, 8) AS respiration_rate FROM indexed""",
)
def weighted_index_query(spark, sf):
    # Exact sums end in 5 at the seventh place, so six digits would meet ties.
    return rounded(indexed(spark, sf), 8)


UNITS = "mg CO2-C per g soil per d"


@query(
    "source_summary",
    sql_with(*RATE_LAYERS, **RATE_CTES)
    + f"""SELECT source, round_even(min(respiration_rate), 4) AS min_respiration_rate,
    round_even(max(respiration_rate), 4) AS max_respiration_rate,
    round_even(avg(respiration_rate), 4) AS mean_respiration_rate, '{UNITS}' AS units FROM rates GROUP BY source""",
)
def source_summary_query(spark, sf):
    return source_summary(rates(spark, sf), "source", "respiration_rate", UNITS)


@query(
    "zscore",
    sql_with("cores")
    + """, g AS (SELECT core_section, avg(r24) AS m, stddev_samp(r24) AS s, avg(clay) AS cm, stddev_samp(clay) AS cs
    FROM cores GROUP BY core_section)
    SELECT sample_id, round((r24 - m) / s, 6) + 0.0 AS z_rate, round((clay - cm) / cs, 6) + 0.0 AS z_clay,
    NULL::DOUBLE AS z_strict FROM cores JOIN g USING (core_section)""",
)
def zscore_query(spark, sf):
    """Rates have no gaps; clay has, so its strict z-score is missing everywhere."""
    c = cores(spark, sf).select("sample_id", "core_section", "r24", "clay")
    z = zscores(c, ["core_section"], {"z_rate": ("r24", False), "z_clay": ("clay", True), "z_strict": ("clay", False)})
    return rounded(z.select("sample_id", "z_rate", "z_clay", "z_strict"))


def _sql_model(y: str) -> str:
    """Closed form: within-source sums for the two numeric predictors, then the source means."""
    return f"""
, m AS (SELECT source, count(*) AS n, avg({y}) AS my, avg(MAT) AS ma, avg(MAP) AS mp FROM obs GROUP BY source)
, w AS (SELECT sum((MAT - ma) * (MAT - ma)) AS saa, sum((MAP - mp) * (MAP - mp)) AS spp, sum((MAT - ma) * (MAP - mp)) AS sap,
  sum((MAT - ma) * ({y} - my)) AS say, sum((MAP - mp) * ({y} - my)) AS spy FROM obs JOIN m USING (source))
, b AS (SELECT *, saa * spp - sap * sap AS det, (say * spp - spy * sap) / (saa * spp - sap * sap) AS ba,
  (spy * saa - say * sap) / (saa * spp - sap * sap) AS bp FROM w)
, a AS (SELECT b.*, f.my - ba * f.ma - bp * f.mp AS b0, (o.my - ba * o.ma - bp * o.mp) - (f.my - ba * f.ma - bp * f.mp) AS bs,
  f.n AS nf, o.n AS no, f.ma AS fa, f.mp AS fp, o.ma - f.ma AS da, o.mp - f.mp AS dp
  FROM b, (SELECT * FROM m WHERE source = 'gridded') f, (SELECT * FROM m WHERE source = 'own') o)
, e AS (SELECT {y} AS y, {y} - b0 - ba * MAT - bp * MAP - CASE WHEN source = 'own' THEN bs ELSE 0 END AS r FROM obs, a)
, s AS (SELECT count(*) AS n, count(*) - 4 AS df, sum(r * r) AS rss, sum((y - (SELECT avg(y) FROM e)) * (y - (SELECT avg(y) FROM e))) AS tss,
  min(r) AS r0, quantile_cont(r, 0.25) AS r1, quantile_cont(r, 0.5) AS r2, quantile_cont(r, 0.75) AS r3, max(r) AS r4 FROM e)
, t AS (SELECT '(Intercept)' AS term, b0 AS estimate, sqrt(rss / df * (1 / nf + (fa * fa * spp - 2 * fa * fp * sap + fp * fp * saa) / det)) AS se FROM a, s
  UNION ALL SELECT 'sourceown', bs, sqrt(rss / df * (1 / nf + 1 / no + (da * da * spp - 2 * da * dp * sap + dp * dp * saa) / det)) FROM a, s
  UNION ALL SELECT 'MAT', ba, sqrt(rss / df * spp / det) FROM a, s UNION ALL SELECT 'MAP', bp, sqrt(rss / df * saa / det) FROM a, s)
SELECT term, 'estimate' AS statistic, round(estimate, 5) + 0.0 AS value FROM t
UNION ALL SELECT term, 'std_error', round(se, 5) + 0.0 FROM t UNION ALL SELECT term, 't_value', round(estimate / se, 5) + 0.0 FROM t
UNION ALL SELECT term, 'p_value', round(greatest(0, 1 - 2 * sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
  * exp(lgamma((df + 1) / 2::DOUBLE) - lgamma(df / 2::DOUBLE)) / sqrt(df * pi()) * pow(1 + pow(top * i / 4000, 2) / df, -(df + 1) / 2::DOUBLE))
  * max(top) / 12000), 5) + 0.0 FROM (SELECT term, df, least(abs(estimate / se), 40) AS top FROM t, s), range(0, 4001) r(i) GROUP BY term
UNION ALL SELECT 'fit', k, round(v, 5) + 0.0 FROM (SELECT unnest(['n', 'df', 'sigma', 'r2', 'adj_r2', 'f_value', 'res_min', 'res_q1',
  'res_median', 'res_q3', 'res_max']) AS k, unnest([n::DOUBLE, df, sqrt(rss / df), 1 - rss / tss, 1 - (rss / df) / (tss / (n - 1)),
  ((tss - rss) / 3) / (rss / df), r0, r1, r2, r3, r4]) AS v FROM s)"""


def _model_rows(combined, y: str):
    """Coefficients and fit in one long table (term, statistic, value)."""
    coefficients, fit = rate_model(combined, y)
    long = coefficients.unpivot(["term"], ["estimate", "std_error", "t_value", "p_value"], "statistic", "value")
    fit = fit.select(F.lit("fit").alias("term"), *[F.col(c).cast("double").alias(c) for c in fit.columns])
    fit = fit.unpivot(["term"], [c for c in fit.columns if c != "term"], "statistic", "value")
    return rounded(long.unionByName(fit), 5)


Z_OBS = """SELECT source, MAT, MAP, (respiration_rate - avg(respiration_rate) OVER (PARTITION BY source))
    / stddev_samp(respiration_rate) OVER (PARTITION BY source) AS respiration_z FROM present"""


@query("ols_zscore", sql_with(*RATE_LAYERS, **RATE_CTES, obs=Z_OBS) + _sql_model("respiration_z"))
def ols_zscore(spark, sf):
    return _model_rows(standardised(present_rates(spark, sf)), "respiration_z")


@query("ols_raw", sql_with(*RATE_LAYERS, **RATE_CTES, obs="SELECT * FROM present") + _sql_model("respiration_rate"))
def ols_raw(spark, sf):
    return _model_rows(present_rates(spark, sf), "respiration_rate")


LINE = """round(regr_slope({y}, {x}), {k}) + 0.0 AS slope, round(regr_intercept({y}, {x}), {k}) + 0.0 AS intercept,
    round(regr_r2({y}, {x}), {k}) AS r2, regr_count({y}, {x})::BIGINT AS n"""


@query(
    "group_regression",
    sql_with(*RATE_LAYERS, **RATE_CTES)
    + "SELECT climate_parameter, source, "
    + LINE.format(y="respiration_rate", x="v", k=5)
    + """ FROM (SELECT source, respiration_rate, 'MAT' AS climate_parameter, MAT AS v FROM rates
    UNION ALL SELECT source, respiration_rate, 'MAP', MAP FROM rates) GROUP BY climate_parameter, source""",
)
def group_regression_query(spark, sf):
    long = climate_facets(rates(spark, sf), "respiration_rate")
    return rounded(group_regression(long, ["climate_parameter", "source"], "respiration_rate", "climate_value"), 5)


def _sql_digits(c: str, digits: int) -> str:
    """A number as text with some significant digits."""
    power = f"({digits - 1} - floor(log10(abs({c})))::INT)"
    return f"regexp_replace(CAST(round({c} * pow(10::DOUBLE, {power})) / pow(10::DOUBLE, {power}) AS VARCHAR), '[.]0$', '')"


@query(
    "facet_equations",
    sql_with(*RATE_LAYERS, **RATE_CTES, obs=Z_OBS)
    + ", fits AS (SELECT climate_parameter, source, "
    + LINE.format(y="respiration_z", x="v", k=9)
    + """ FROM (SELECT source, respiration_z, 'MAT' AS climate_parameter, MAT AS v FROM obs
    UNION ALL SELECT source, respiration_z, 'MAP', MAP FROM obs) GROUP BY climate_parameter, source)
    SELECT climate_parameter, source, n, 'y = ' || {a} || CASE WHEN slope < 0 THEN ' - ' ELSE ' + ' END || {b} || ' x, R2 = ' || {r} AS equation
    FROM fits""".format(a=_sql_digits("intercept", 3), b=_sql_digits("abs(slope)", 3), r=_sql_digits("r2", 2)),
)
def facet_equations(spark, sf):
    """Regressions of the z-scores by facet and source, with their printed equations."""
    long = climate_facets(standardised(present_rates(spark, sf)), "respiration_z")
    fits = rounded(group_regression(long, ["climate_parameter", "source"], "respiration_z", "climate_value"), 9)
    return equation_label(fits).select("climate_parameter", "source", "n", "equation")


LOW, HIGH = FIT_LIMITS


@query(
    "censored_fit",
    sql_with("samples", "sites", "cells_rs", "country_edges", **RS_CTES)
    + "SELECT core_section, "
    + LINE.format(y="m", x="r24", k=5)
    + f""" FROM samples JOIN rs_site USING (site_code) WHERE r24 BETWEEN {LOW} AND {HIGH} AND m BETWEEN {LOW} AND {HIGH}
    GROUP BY core_section""",
)
def censored_fit(spark, sf):
    kept = within_limits(rs_rows(spark, sf), "r24", "gridded_mean", LOW, HIGH)
    return rounded(group_regression(kept, ["core_section"], "gridded_mean", "r24"), 5)


Z975 = "1.959963984540054::DOUBLE"
# Critical value of t by expansion in 1/df; sections have thousands of rows.
T975 = f"""({Z975} + (pow({Z975}, 3) + {Z975}) / 4 / df + (5 * pow({Z975}, 5) + 16 * pow({Z975}, 3) + 3 * {Z975}) / 96 / (df * df)
  + (3 * pow({Z975}, 7) + 19 * pow({Z975}, 5) + 17 * pow({Z975}, 3) - 15 * {Z975}) / 384 / pow(df, 3))"""


@query(
    "regression_band",
    sql_with("cores")
    + f""", g AS (SELECT core_section, count(*) AS n, count(*) - 2 AS df, avg(clay) AS mx, regr_slope(r24, clay) AS b,
    regr_intercept(r24, clay) AS a, regr_sxx(r24, clay) AS sxx, regr_syy(r24, clay) AS syy, min(clay) AS lo, max(clay) AS hi
    FROM cores WHERE clay IS NOT NULL AND r24 IS NOT NULL GROUP BY core_section)
    , x AS (SELECT *, lo + (hi - lo) * i / 79::DOUBLE AS x FROM g, (SELECT unnest(range(0, 80))::INT AS i))
    , f AS (SELECT *, a + b * x AS fit, sqrt((syy - b * b * sxx) / df * (1 / n + (x - mx) * (x - mx) / sxx)) AS se FROM x)
    SELECT core_section, i, round(x, 6) AS x, round(fit, 6) AS fit, round(se, 6) AS se, round(fit - {T975} * se, 6) AS ymin,
    round(fit + {T975} * se, 6) AS ymax FROM f""",
)
def regression_band_query(spark, sf):
    return rounded(regression_band(cores(spark, sf), ["core_section"], "r24", "clay"))


# ---------------------------------------------------------------- distributions


@query(
    "density_histogram",
    sql_with(*LAYERS, **COMBINED)
    + """, r AS (SELECT min(clay) AS low, (max(clay) - min(clay)) / 29 AS width FROM combined)
    , c AS (SELECT source, greatest(ceil((clay - (low - width / 2)) / width) - 1, 0)::INT AS bin, count(*) AS count
    FROM combined, r WHERE clay IS NOT NULL GROUP BY 1, 2)
    , f AS (SELECT a.source, a.bin, coalesce(c.count, 0)::BIGINT AS count
    FROM (SELECT source, b::INT AS bin FROM (SELECT DISTINCT source FROM c), range(0, 30) g(b)) a LEFT JOIN c USING (source, bin))
    SELECT source, bin, round(low + width * bin, 6) AS x, count, round(count / (sum(count) OVER (PARTITION BY source) * width), 6) AS density
    FROM f, r""",
)
def density_histogram_query(spark, sf):
    return rounded(density_histogram(combined_sources(spark, sf), ["source"], "clay"))


@query(
    "boxplot_stats",
    sql_with(*LAYERS, **COMBINED)
    + """, q AS (SELECT climate, source, count(clay) AS n, quantile_cont(clay, 0.25) AS q1, quantile_cont(clay, 0.5) AS median,
    quantile_cont(clay, 0.75) AS q3 FROM combined GROUP BY climate, source)
    SELECT climate, source, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
    min(clay) FILTER (WHERE clay >= q1 - 1.5 * (q3 - q1)) AS lower, max(clay) FILTER (WHERE clay <= q3 + 1.5 * (q3 - q1)) AS upper
    FROM combined JOIN q USING (climate, source) GROUP BY climate, source, n, q1, median, q3""",
)
def boxplot_stats_query(spark, sf):
    return rounded(boxplot_stats(combined_sources(spark, sf), ["climate", "source"], "clay"))


@query(
    "violin_density",
    sql_with(*LAYERS, **COMBINED)
    + """, g AS (SELECT climate, source, count(clay) AS n, min(clay) AS lo, (max(clay) - min(clay)) / 511 AS step,
    0.9::DOUBLE * least(stddev_samp(clay), (quantile_cont(clay, 0.75) - quantile_cont(clay, 0.25)) / 1.34::DOUBLE)
    * pow(count(clay), -0.2::DOUBLE) AS h FROM combined GROUP BY climate, source)
    , p AS (SELECT climate, source, n, lo, step, h, (clay - lo) / step AS pos, least(floor((clay - lo) / step), 510)::INT AS i
    FROM combined JOIN g USING (climate, source))
    , w AS (SELECT climate, source, i, sum(w) AS w FROM (SELECT climate, source, i, 1 - (pos - i) AS w FROM p
    UNION ALL SELECT climate, source, i + 1, pos - i FROM p) GROUP BY climate, source, i)
    , d AS (SELECT climate, source, j AS i, lo + j * step AS x,
    sum(w * exp(-0.5 * pow((j - w.i) * step / h, 2))) / (n * h * sqrt(2 * pi())) AS density
    FROM g JOIN w USING (climate, source), (SELECT unnest(range(0, 512))::INT AS j) GROUP BY climate, source, j, lo, step, n, h)
    SELECT climate, source, i, round(x, 6) AS x, round(density, 6) AS density,
    round(density / max(density) OVER (PARTITION BY climate, source), 6) AS scaled FROM d""",
)
def violin_density_query(spark, sf):
    return rounded(violin_density(combined_sources(spark, sf), ["climate", "source"], "clay"))


@query(
    "one_to_one",
    sql_with("samples", "sites", "cells_top", "cells_btm", **BUFFER_CTES)
    + """SELECT sample_id, core_section, clay AS x, round(sg_mean, 6) AS y, round(sg_mean - sg_sd, 6) + 0.0 AS ymin,
    round(sg_mean + sg_sd, 6) AS ymax, round(sg_mean - clay, 6) + 0.0 AS deviation FROM buffers""",
)
def one_to_one_query(spark, sf):
    return rounded(one_to_one(buffer_rows(spark, sf), "clay", "sg_mean", "sg_sd", ["sample_id", "core_section"]))
