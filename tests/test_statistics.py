"""Sampling, quantiles, regressions and distributions."""

from __future__ import annotations

import hashlib
import math
import random
import statistics

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from strataweave.operators.distributions import boxplot_stats, density_histogram, violin_density
from strataweave.operators.groups import region_rollup
from strataweave.operators.quantiles import group_quantiles, overall_quantiles
from strataweave.operators.regression import (
    equation_label,
    group_regression,
    ols,
    regression_band,
    t_critical,
    t_quantile,
)
from strataweave.operators.sampling import entity_sample, matched_resample, stratified_sample
from strataweave.plans.comparison import resample_labelled, sample_with_labels


def lowest(keys, n, seed):
    return set(sorted(keys, key=lambda k: hashlib.md5(f"{seed}|{k}".encode()).hexdigest())[:n])


@pytest.fixture(scope="module")
def strata(spark):
    sizes = {"one": 1, "five": 5, "big": 2000, None: 30}
    data = [(s, i) for s, n in sizes.items() for i in range(n)]
    return spark.createDataFrame([(s, f"{s}-{i}") for s, i in data], "s string, k string")


@pytest.mark.parametrize("digits", [1, 3])
def test_stratified_sample(strata, digits):
    got = stratified_sample(strata, ["s"], ["k"], 20, seed=7, digits=digits)
    members = {}
    for r in got.collect():
        members.setdefault(r["s"], set()).add(r["k"])
    assert {s: len(m) for s, m in members.items()} == {"one": 1, "five": 5, "big": 20, None: 20}
    assert members["big"] == lowest([f"big-{i}" for i in range(2000)], 20, 7)
    again = stratified_sample(strata.repartition(13), ["s"], ["k"], 20, seed=7, digits=digits)
    assert rows(again, "k") == rows(got, "k")
    assert rows(stratified_sample(strata, ["s"], ["k"], 20, seed=8), "k") != rows(got, "k")


@pytest.fixture(scope="module")
def two_sources(spark):
    data = [("a", "own", i) for i in range(40)] + [("a", "grid", i) for i in range(500)]
    data += [("b", "own", 1), ("b", "grid", 1), ("c", "own", 1), ("c", "own", 2), ("c", "own", 3), ("c", "grid", 9), ("d", "grid", 4)]
    frame = [(c, s, f"{c}{s}{i}", float(i)) for c, s, i in data]
    return spark.createDataFrame(frame, "climate string, source string, k string, v double")


def test_matched_resample(two_sources):
    got = matched_resample(two_sources, ["k"], "own", (1, 5))
    counts = {(r["climate"], r["source"]): r["count"] for r in got.groupBy("climate", "source").count().collect()}
    assert counts == {
        ("a", "own"): 40, ("a", "grid_sample_1"): 40, ("a", "grid_sample_2"): 40, ("b", "own"): 1,
        ("c", "own"): 3, ("c", "grid_sample_1"): 1, ("c", "grid_sample_2"): 1,
    }
    drawn = {r["k"] for r in got.filter("source = 'grid_sample_2' and climate = 'a'").collect()}
    assert drawn == lowest([f"agrid{i}" for i in range(500)], 40, 5)


def test_labelled_samples(two_sources):
    sampled = sample_with_labels(two_sources, ["k"], n=50)
    labels = {(r["climate"], r["axis_label"]) for r in sampled.select("climate", "axis_label").distinct().collect()}
    assert labels == {("a", "a\nown = 40, grid = 50"), ("b", None), ("c", "c\nown = 3, grid = 1"), ("d", None)}
    labelled = resample_labelled(two_sources, ["k"])
    assert {r[0] for r in labelled.select("axis_label").distinct().collect()} == {"a\nown = 40, grid = 40", "c\nown = 3, grid = 3"}


@pytest.mark.parametrize("digits", [1, 3])
def test_samples_of_repeated_keys_ignore_partitions(spark, digits):
    df = spark.createDataFrame([("s", f"k{i % 3}", float(i)) for i in range(300)] + [("s", "k0", 1.0)] * 5, "s string, k string, v double")
    drawn = [rows(stratified_sample(df.repartition(n), ["s"], ["k"], 40, seed=3, digits=digits), "k", "v") for n in (1, 3, 7)]
    assert drawn[0] == drawn[1] == drawn[2] and len(drawn[0]) == 40


def test_entity_sample(strata):
    assert entity_sample(strata, "k", 12).count() == 12
    with pytest.raises(ValueError):
        entity_sample(strata, "s", 12)
    assert entity_sample(strata, "s", 12, require=False).count() == 4


PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]


@pytest.mark.parametrize("partition_values", [10**6, 100])
def test_quantiles(spark, partition_values):
    rng = random.Random(5)
    data = {
        "normal": [rng.gauss(0, 1) for _ in range(997)],
        "ties": [float(rng.randrange(4)) for _ in range(400)] + [2.0] * 600,
        "one": [3.0],
        "two": [1.0, 2.0],
    }
    df = spark.createDataFrame([(g, v) for g, vs in data.items() for v in [*vs, None]], "g string, v double")
    got = {r["g"]: r for r in group_quantiles(df, ["g"], "v", PROBS, partition_values).collect()}
    for g, vs in data.items():
        assert got[g]["n"] == len(vs)
        assert got[g]["quantiles"] == pytest.approx(list(np.quantile(vs, PROBS)))
    every = [v for vs in data.values() for v in vs]
    whole = overall_quantiles(df, "v", [0.5], partition_values=partition_values).first()
    assert whole["quantiles"] == pytest.approx([statistics.median(every)])


def test_region_rollup(spark):
    columns = "iso string, glu long, weighted_average double, median_value double, min_value double, max_value double, q1_value double, q3_value double"
    df = spark.createDataFrame([("u", 1, 1.0, 4.0, 0.0, 9.0, 2.0, 6.0), ("u", 1, 3.0, 7.0, -1.0, 8.0, 4.0, 8.0), ("u", 2, 1.0, None, 0.0, 1.0, 1.0, 1.0)], columns)
    got = {r["glu"]: r for r in region_rollup(df, ["iso", "glu"]).collect()}
    one = got[1]
    assert (one["region_average"], one["region_median_value"], one["region_min_value"], one["region_max_value"]) == (2.0, 5.5, -1.0, 9.0)
    assert (one["region_q1_value"], one["region_q3_value"]) == (3.0, 7.0)
    assert got[2]["region_median_value"] is None


def test_t_quantiles(spark):
    # Printed tables, two-sided 95 %.
    for df, t in ((1, 12.7062), (2, 4.3027), (5, 2.5706), (30, 2.0423), (120, 1.9799)):
        assert t_quantile(0.975, df) == pytest.approx(t, abs=5e-5)
    got = spark.createDataFrame([(150,), (151,), (10000,), (0,)], "df int").select(t_critical(F.col("df"))).collect()
    assert got[0][0] == pytest.approx(t_quantile(0.975, 150), abs=1e-9)
    assert got[1][0] == pytest.approx(t_quantile(0.975, 151), abs=1e-8)
    assert got[2][0] == pytest.approx(1.960201, abs=1e-6) and got[3][0] is None


def test_ols_against_normal_equations(spark):
    rng = np.random.default_rng(2)
    n = 200
    a, p, s = rng.normal(10, 3, n), rng.normal(800, 200, n), rng.integers(0, 2, n)
    y = 3 + 0.5 * a - 0.01 * p + 2 * s + rng.normal(0, 1, n)
    data = [(float(v), float(i), float(j), "own" if k else "gridded") for v, i, j, k in zip(y, a, p, s)]
    df = spark.createDataFrame([*data, (None, 1.0, 1.0, "own")], "y double, MAT double, MAP double, source string")
    coefficients, fit = ols(df, "y", ["MAT", "MAP"], "source", ["own", "gridded"])
    x = np.column_stack([np.ones(n), s, a, p])
    beta = np.linalg.solve(x.T @ x, x.T @ y)
    residual = y - x @ beta
    sigma2 = residual @ residual / (n - 4)
    se = np.sqrt(np.diag(sigma2 * np.linalg.inv(x.T @ x)))
    got = {r["term"]: r for r in coefficients.collect()}
    for i, term in enumerate(["(Intercept)", "sourceown", "MAT", "MAP"]):
        assert got[term]["estimate"] == pytest.approx(beta[i], rel=1e-6)
        assert got[term]["std_error"] == pytest.approx(se[i], rel=1e-6)
    f = fit.first()
    assert (f["n"], f["df"]) == (n, n - 4) and f["sigma"] == pytest.approx(math.sqrt(sigma2))
    r2 = 1 - residual @ residual / ((y - y.mean()) @ (y - y.mean()))
    assert f["r2"] == pytest.approx(r2) and f["res_median"] == pytest.approx(np.median(residual), abs=1e-6)


def test_ols_levels(spark):
    data = [(float(i % 5 + 3 * (g == "b") + 7 * (g == "c")) + i * 0.1, float(i), g) for i in range(30) for g in "abc"]
    df = spark.createDataFrame(data, "y double, x double, g string")
    coefficients, _ = ols(df, "y", ["x"], "g")
    got = {r["term"]: r["estimate"] for r in coefficients.collect()}
    assert got["gb"] == pytest.approx(3) and got["gc"] == pytest.approx(7)
    with pytest.raises(ValueError, match="c"):
        ols(df, "y", ["x"], "g", ["a", "b"])


def test_ols_without_residuals(spark):
    exact = spark.createDataFrame([(float(2 * i), float(i)) for i in range(10)], "y double, x double")
    _, fit = ols(exact, "y", ["x"])
    assert fit.first()["n"] == 10 and fit.first()["r2"] == pytest.approx(1) and fit.first()["f_value"] > 1e9
    none = spark.createDataFrame([(1.0, 1.0), (3.0, 2.0)], "y double, x double")
    coefficients, fit = ols(none, "y", ["x"])
    assert fit.first()["df"] == 0 and fit.first()["sigma"] is None
    assert all(r["std_error"] is None for r in coefficients.collect())


def test_group_regression(spark):
    data = [("line", float(x), 2.0 * x + 1) for x in range(5)] + [("line", 9.0, None), ("flat", 1.0, 1.0), ("flat", 1.0, 2.0), ("one", 1.0, 1.0)]
    got = {r["g"]: r for r in group_regression(spark.createDataFrame(data, "g string, x double, y double"), ["g"], "y", "x").collect()}
    assert (got["line"]["slope"], got["line"]["intercept"], got["line"]["r2"], got["line"]["n"]) == pytest.approx((2, 1, 1, 5))
    assert got["flat"]["slope"] is None and got["one"]["slope"] is None
    label = equation_label(spark.createDataFrame([(0.98765, -12.3456, 0.456)], "slope double, intercept double, r2 double"))
    assert label.first()["equation"] == "y = -12.3 + 0.988 x, R2 = 0.46"


def test_regression_band(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 10, 12)
    y = 2 * x + rng.normal(0, 1, 12)
    df = spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(x, y)], "g string, x double, y double")
    band = regression_band(df, ["g"], "y", "x").orderBy("i").collect()
    assert len(band) == 80
    slope, intercept = np.polyfit(x, y, 1)
    rss = ((y - slope * x - intercept) ** 2).sum()
    at = x.min()
    se = math.sqrt(rss / 10 * (1 / 12 + (at - x.mean()) ** 2 / ((x - x.mean()) ** 2).sum()))
    assert band[0]["fit"] == pytest.approx(slope * at + intercept)
    assert band[0]["ymax"] - band[0]["fit"] == pytest.approx(2.228139 * se, rel=1e-5)


@pytest.fixture(scope="module")
def measured(spark):
    rng = random.Random(9)
    data = [("a", rng.gauss(20, 5)) for _ in range(300)] + [("b", float(rng.randrange(10, 40))) for _ in range(200)] + [("b", None), ("c", 4.0)]
    return data, spark.createDataFrame(data, "g string, v double")


def test_histogram(measured):
    data, df = measured
    got = density_histogram(df, ["g"], "v").collect()
    values = [v for _, v in data if v is not None]
    width = (max(values) - min(values)) / 29
    for g in "abc":
        assert sum(r["density"] for r in got if r["g"] == g) * width == pytest.approx(1)
    first = [v for s, v in data if s == "a" and v is not None and v <= min(values) + width / 2]
    assert sum(r["count"] for r in got if r["g"] == "a" and r["bin"] == 0) == len(first)
    assert all({r["bin"] for r in got if r["g"] == g} == set(range(30)) for g in "abc")
    assert sum(r["count"] for r in got) == len(values)


def test_histogram_of_one_value(spark):
    got = density_histogram(spark.createDataFrame([("a", 2.0), ("a", 2.0)], "g string, v double"), ["g"], "v").collect()
    assert [(r["bin"], r["count"], r["density"]) for r in got] == [(0, 2, None)]


def test_boxplot(measured):
    data, df = measured
    got = {r["g"]: r for r in boxplot_stats(df, ["g"], "v").collect()}
    for g in "abc":
        vs = np.array([v for s, v in data if s == g and v is not None])
        q1, q2, q3 = np.quantile(vs, [0.25, 0.5, 0.75])
        assert (got[g]["q1"], got[g]["median"], got[g]["q3"]) == pytest.approx((q1, q2, q3))
        assert got[g]["lower"] == vs[vs >= q1 - 1.5 * (q3 - q1)].min() and got[g]["upper"] == vs[vs <= q3 + 1.5 * (q3 - q1)].max()


def test_violin_of_equal_values(spark):
    got = violin_density(spark.createDataFrame([("a", 4.0), ("a", 4.0), ("b", 0.0), ("b", 0.0)], "g string, v double"), ["g"], "v", points=5).collect()
    assert len(got) == 10 and all(r["scaled"] == 1.0 for r in got)
    h = {"a": 0.9 * 4 * 2**-0.2, "b": 0.9 * 2**-0.2}
    assert all(r["density"] == pytest.approx(1 / (h[r["g"]] * math.sqrt(2 * math.pi))) for r in got)


def test_violin(measured):
    data, df = measured
    got = violin_density(df, ["g"], "v", points=512).collect()
    assert {r["g"] for r in got} == {"a", "b"}
    vs = np.array([v for s, v in data if s == "a"])
    iqr = np.subtract(*np.quantile(vs, [0.75, 0.25]))
    h = 0.9 * min(vs.std(ddof=1), iqr / 1.34) * len(vs) ** -0.2
    a = sorted((r["i"], r["x"], r["density"], r["scaled"]) for r in got if r["g"] == "a")
    assert len(a) == 512 and max(r[3] for r in a) == 1.0
    for _, x, density, _ in a[::50]:
        exact = np.exp(-0.5 * ((x - vs) / h) ** 2).sum() / (len(vs) * h * math.sqrt(2 * math.pi))
        assert density == pytest.approx(exact, rel=1e-3)
