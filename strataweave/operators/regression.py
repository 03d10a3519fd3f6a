"""Linear models and their tables."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.operators.clean import complete_cases
from strataweave.operators.quantiles import overall_quantiles
from strataweave.session import stage

#: Degrees of freedom solved exactly; beyond, the normal expansion is accurate to 1e-9.
EXACT_DF = 150


def _t_cdf(t: float, df: int) -> float:
    """Student t distribution for whole degrees of freedom (finite cosine series)."""
    theta = math.atan(t / math.sqrt(df))
    c2, term, total = math.cos(theta) ** 2, 1.0, 0.0
    for j in range(1 + df % 2, df, 2):
        total += term
        term *= c2 * j / (j + 1)
    if df % 2 == 0:
        return 0.5 + 0.5 * math.sin(theta) * total
    return 0.5 + (theta + math.sin(theta) * math.cos(theta) * total) / math.pi


def t_quantile(p: float, df: int) -> float:
    """Inverse of the t distribution for ``p`` above one half."""
    low, high = 0.0, 1.0
    while _t_cdf(high, df) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _t_cdf(mid, df) < p else (low, mid)
    return (low + high) / 2


def t_critical(df: Column, level: float = 0.95) -> Column:
    """Two-sided critical value for a column of degrees of freedom; NULL below one."""
    p = 0.5 + level / 2
    table = F.array(*[F.lit(t_quantile(p, k)) for k in range(1, EXACT_DF + 1)])
    z = NormalDist().inv_cdf(p)
    # Coefficients of the Cornish-Fisher expansion of t in powers of 1/df.
    terms = (
        z,
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    )
    far = F.lit(0.0)
    for coefficient in reversed(terms[1:]):
        far = (far + F.lit(coefficient)) / df
    return F.when(df > EXACT_DF, far + F.lit(z)).when(df >= 1, F.get(table, df.cast("int") - 1))


#: Levels that a factor may have; each is a column of the model.
MAX_LEVELS = 1000


def ols(
    df: DataFrame, y: str, numeric: Sequence[str], factor: str | None = None, levels: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Least squares on complete rows: a coefficient table and a one-row fit table.

    ``factor`` enters as one indicator per level after the first of the sorted levels, which are those
    of the complete rows unless ``levels`` names them; a row of another level is an error. Residual
    quantiles are those of the fitted rows. Without degrees of freedom the errors, tests and ``sigma``
    are NULL; an exact fit has no residual variance, so its t and F values are infinite.
    """
    rows = complete_cases(df, y, *numeric, *([factor] if factor else []))
    rows = rows.select(
        F.col(y).cast("double").alias("_y"),
        *([F.col(factor).cast("string").alias("_factor")] if factor else []),
        *[F.col(c).cast("double").alias(f"_n{i}") for i, c in enumerate(numeric)],
    )
    rows = stage(rows)  # read by the levels, the fit, its summary and the residuals
    others = []
    if factor:
        found = sorted(r[0] for r in rows.select("_factor").distinct().limit(MAX_LEVELS + 1).collect())
        if len(found) > MAX_LEVELS:
            raise ValueError(f"{factor} has more than {MAX_LEVELS} levels")
        unknown = set(found) - set(found if levels is None else levels)
        if unknown:
            raise ValueError(f"{factor} has levels that are not listed: {sorted(unknown)}")
        others = sorted(found if levels is None else levels)[1:]
    indicators = {f"{factor}{level}": level for level in others}
    ready = rows.select(
        "_y",
        *[F.when(F.col("_factor") == level, 1.0).otherwise(0.0).alias(f"_i{i}") for i, level in enumerate(others)],
        *[f"_n{i}" for i in range(len(numeric))],
    )
    inputs = [f"_i{i}" for i in range(len(others))] + [f"_n{i}" for i in range(len(numeric))]
    ready = VectorAssembler(inputCols=inputs, outputCol="_x").transform(ready).select("_y", "_x")
    model = LinearRegression(featuresCol="_x", labelCol="_y", predictionCol="_fit", solver="normal", regParam=0.0).fit(ready)
    s = model.summary
    n, k = int(s.numInstances), len(inputs)
    dof, r2 = n - k - 1, float(s.r2)
    values = [*map(float, model.coefficients), float(model.intercept)]
    if dof > 0:
        errors, t_values, p_values = s.coefficientStandardErrors, s.tValues, s.pValues
        sigma = math.sqrt(s.meanSquaredError * n / dof)
        f_value = (r2 / k) / ((1 - r2) / dof) if r2 < 1 else math.inf
        adjusted = float(s.r2adj)
    else:
        errors = t_values = p_values = [None] * len(values)
        sigma = f_value = adjusted = None
    table = list(zip([*indicators, *numeric, "(Intercept)"], values, errors, t_values, p_values))
    spark = df.sparkSession
    coefficients = spark.createDataFrame(
        [table[-1], *table[:-1]], "term string, estimate double, std_error double, t_value double, p_value double"
    )
    residuals = model.transform(ready).select((F.col("_y") - F.col("_fit")).alias("_r"))
    q = overall_quantiles(residuals, "_r", [0.0, 0.25, 0.5, 0.75, 1.0]).first()
    names = ("res_min", "res_q1", "res_median", "res_q3", "res_max")
    fit = spark.createDataFrame(
        [(n, dof, sigma, r2, adjusted, f_value, *(q["quantiles"] if q else [None] * 5))],
        "n long, df long, sigma double, r2 double, adj_r2 double, f_value double, " + ", ".join(f"{c} double" for c in names),
    )
    return coefficients, fit


def group_regression(df: DataFrame, by: Sequence[str], y: str, x: str) -> DataFrame:
    """Slope, intercept, R2 and n of ``y ~ x`` per group, over pairs with both values."""
    return df.groupBy(*by).agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        F.regr_count(y, x).alias("n"),
    )


def _significant(c: Column, digits: int) -> Column:
    """A number as text with some significant digits."""
    power = F.lit(digits - 1) - F.floor(F.log10(F.abs(c))).cast("int")
    scale = F.pow(F.lit(10.0), power)
    rounded = F.when(c == 0, F.lit(0.0)).otherwise(F.round(c * scale) / scale)
    text = F.regexp_replace(rounded.cast("string"), r"\.0(?=E|$)", "")
    text = F.regexp_replace(F.regexp_replace(text, r"E(-?)(\d)$", "e$10$2"), "E", "e")
    # Fixed notation down to 1e-4, where it is no longer than the other.
    small = F.abs(rounded).between(1e-4, 1e-3)
    return F.when(small, F.regexp_replace(rounded.cast("decimal(20,10)").cast("string"), "0+$", "")).otherwise(text)


def equation_label(df: DataFrame, slope: str = "slope", intercept: str = "intercept", r2: str = "r2") -> DataFrame:
    """Add a printed equation and R2: three significant digits, and two for R2."""
    sign = F.when(F.col(slope) < 0, F.lit(" - ")).otherwise(F.lit(" + "))
    text = F.concat(
        F.lit("y = "), _significant(F.col(intercept), 3), sign, _significant(F.abs(slope), 3), F.lit(" x, R2 = "),
        _significant(F.col(r2), 2),
    )
    return df.withColumn("equation", text)


def regression_band(df: DataFrame, by: Sequence[str], y: str, x: str, points: int = 80, level: float = 0.95) -> DataFrame:
    """Fitted line with its confidence band on an even grid over each group's range of ``x``."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    g = both.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(x).alias("_mx"),
        F.regr_slope(y, x).alias("_b"),
        F.regr_intercept(y, x).alias("_a"),
        F.regr_sxx(y, x).alias("_sxx"),
        F.regr_syy(y, x).alias("_syy"),
        F.min(x).alias("_lo"),
        F.max(x).alias("_hi"),
    )
    g = g.filter((F.col("n") > 2) & (F.col("_sxx") > 0))
    rss = F.greatest(F.col("_syy") - F.col("_b") * F.col("_b") * F.col("_sxx"), F.lit(0.0))
    g = g.withColumns({"_s2": rss / (F.col("n") - 2), "_t": t_critical(F.col("n") - 2, level)})
    g = g.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    g = g.withColumn("x", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("i") / F.lit(float(points - 1)))
    dx = F.col("x") - F.col("_mx")
    g = g.withColumns(
        {
            "fit": F.col("_a") + F.col("_b") * F.col("x"),
            "se": F.sqrt(F.col("_s2") * (1 / F.col("n") + dx * dx / F.col("_sxx"))),
        }
    )
    half = F.col("_t") * F.col("se")
    return g.select(*by, "i", "x", "fit", "se", (F.col("fit") - half).alias("ymin"), (F.col("fit") + half).alias("ymax"))


def one_to_one(df: DataFrame, own: str, other: str, spread: str, keep: Sequence[str] = ()) -> DataFrame:
    """Own value against the other source: its bounds and the deviation from y = x."""
    return df.select(
        *keep,
        F.col(own).alias("x"),
        F.col(other).alias("y"),
        (F.col(other) - F.col(spread)).alias("ymin"),
        (F.col(other) + F.col(spread)).alias("ymax"),
        (F.col(other) - F.col(own)).alias("deviation"),
    )


def facet_long(df: DataFrame, ids: Sequence[str], predictors: Sequence[str]) -> DataFrame:
    """One row per predictor, for regressions by facet."""
    return df.unpivot(list(ids), list(predictors), "climate_parameter", "climate_value")
