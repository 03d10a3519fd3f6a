"""Missing-value rules, text, units and coordinate transforms."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from strataweave.functions import crs
from strataweave.functions.nulls import lenient_double, nan_to_null, number_text, paste, row_mean, summary
from strataweave.functions.text import number_after, separate, token
from strataweave.functions.units import FLUX_FACTOR
from strataweave.operators.clean import choose, relabel, rename_tail, western_longitude
from strataweave.operators.groups import weighted_index, zscore


def one(df):
    return df.first()[0]


def test_nan_is_missing(spark):
    df = nan_to_null(spark.createDataFrame([(1.0,), (float("nan"),), (None,), (-0.0,)], "v double"))
    assert df.filter("v is null").count() == 2
    assert one(df.agg(F.max("v"))) == 1.0


@pytest.mark.parametrize(
    "stat, strict, lenient", [("mean", None, 2.0), ("min", None, 1.0), ("max", None, 3.0), ("sum", None, 4.0)]
)
def test_strict_and_lenient_summaries(spark, stat, strict, lenient):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "v double")
    assert one(df.agg(summary(stat, "v", na_rm=False))) == strict
    assert one(df.agg(summary(stat, "v"))) == lenient


def test_empty_sum_is_zero_and_single_sd_is_missing(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert one(df.agg(summary("sum", "v"))) == 0.0
    assert one(spark.createDataFrame([(2.0,)], "v double").agg(summary("sd", "v"))) is None


def test_text_rules(spark):
    df = spark.createDataFrame([("a", None, 12.0, 1.5)], "a string, b string, w double, f double")
    assert one(df.select(paste("a", F.lit("_"), "b"))) == "a_NA"
    assert one(df.select(number_text("w"))) == "12"
    assert one(df.select(number_text("f"))) == "1.5"
    assert one(df.select(lenient_double("a"))) is None
    assert one(df.select(number_after(F.lit("prec_07"), "prec_"))) == 7.0


def test_separate(spark):
    names = ["60141_3_TOP", "60141-3-BTM", "abc_x", "a__b", "", None, "p-1-TOP-extra"]
    df = separate(spark.createDataFrame([(n,) for n in names], "n string"), "n", ["a", "b", "c"])
    assert df.columns == ["a", "b", "c"]
    got = [tuple(r) for r in df.collect()]
    assert got[:4] == [("60141", "3", "TOP"), ("60141", "3", "BTM"), ("abc", "x", None), ("a", "b", None)]
    assert got[5] == (None, None, None)
    assert got[6] == ("p", "1", "TOP")


def test_token(spark):
    df = spark.createDataFrame([("prj_1_ABBY_TOP",), ("a_b_",), ("a_b__",), ("",), (None,)], "n string")
    assert [r[0] for r in df.select(token("n", 3)).collect()] == ["ABBY", None, "", None, None]
    assert [r[0] for r in df.select(token("n", 1)).collect()] == ["prj", "a", "a", None, None]


def test_row_mean_skips_missing(spark):
    df = spark.createDataFrame([(1.0, None, 3.0), (None, None, None)], "a double, b double, c double")
    assert [r[0] for r in df.select(row_mean("a", "b", "c")).collect()] == [2.0, None]


def test_clean_columns(spark):
    df = spark.createDataFrame([(-76.6,), (76.6,), (0.0,), (None,)], "lon double")
    assert [r[0] for r in df.select(western_longitude("lon")).collect()] == [-76.6, -76.6, 0.0, None]
    s = spark.createDataFrame([("own",), ("x",), (None,)], "s string")
    assert [r[0] for r in s.select(relabel("s", "own", "a", "b")).collect()] == ["a", "b", None]
    assert [r[0] for r in s.select(choose("s", {"own": F.lit(1)})).collect()] == [1, None, None]
    t = rename_tail(spark.createDataFrame([("k", "1", "x", "2.5")], "k string, a string, b string, c string"), ["p", "q", "r"])
    assert t.columns == ["k", "p", "q", "r"] and tuple(t.first()) == ("k", 1.0, None, 2.5)


def test_flux_factor():
    assert FLUX_FACTOR == pytest.approx(2.05994e-5, rel=1e-5)


def test_weighted_index_known_answer(spark):
    rows = [
        ("both", "TOP", 3.0, 6.0),
        ("both", "BTM", 6.0, 3.0),
        ("top", "TOP", 3.0, 6.0),
        ("twice", "TOP", 3.0, 6.0),
        ("twice", "TOP", 3.0, 6.0),
        ("odd", "MID", 3.0, 6.0),
        ("gap", "TOP", 3.0, None),
    ]
    df = spark.createDataFrame(rows, "site string, sec string, a double, b double")
    got = {r[0]: r[1] for r in weighted_index(df, "site", "sec", ("a", "b")).collect()}
    assert got == pytest.approx({"both": 4.65, "top": 3.25, "twice": 6.5, "odd": 0.0})
    scaled = {r[0]: r[1] for r in weighted_index(df, "site", "sec", ("a", "b"), normalise=True).collect()}
    assert scaled["top"] == pytest.approx(5.0) and scaled["odd"] is None


def test_zscore_is_strict(spark):
    rows = [("a", 1.0), ("a", 3.0), ("b", 1.0), ("b", None), ("c", 5.0), ("c", 5.0)]
    df = spark.createDataFrame(rows, "s string, v double")
    z = {}
    for r in zscore(df, ["s"], "v").collect():
        z.setdefault(r["s"], []).append(r["z"])
    assert sorted(z["a"]) == pytest.approx([-math.sqrt(0.5), math.sqrt(0.5)])
    assert z["b"] == [None, None]
    assert z["c"] == [None, None]
    assert [r["z"] for r in zscore(df, ["s"], "v", na_rm=True).filter("s = 'b'").collect()] == [None, None]


def test_albers_worked_example(spark):
    f = 1 / 294.9786982
    cone = crs.AlbersCone(a=6378206.4, e2=f * (2 - f), lat1=29.5, lat2=45.5, lat0=23.0, lon0=-96.0)
    r = crs.to_albers(spark.createDataFrame([(-75.0, 35.0)], "x double, y double"), cone=cone).first()
    assert (r["x"], r["y"]) == pytest.approx((1885472.7, 1535925.0), abs=0.1)


@pytest.mark.parametrize("name", [crs.ALBERS, crs.GOODE])
def test_round_trip(spark, name):
    lats = [*range(24, 50), 40.7366, 40.7367]
    points = [(float(lon), float(lat)) for lon in range(-125, -65) for lat in lats]
    if name == crs.GOODE:
        points += [(float(lon), float(lat)) for lon in (-179, -101, -99, -21, -19, 79, 81, 179) for lat in (-85, -45, -10, 10, 80)]
    df = spark.createDataFrame([(x, y, x, y) for x, y in points], "lon double, lat double, x double, y double")
    back = crs.reproject(crs.reproject(df, crs.GEOGRAPHIC, name), name, crs.GEOGRAPHIC)
    worst = back.select(F.max(F.abs(F.col("x") - F.col("lon"))), F.max(F.abs(F.col("y") - F.col("lat")))).first()
    assert max(worst) < 1e-9


def test_goode_corners_of_the_study_window(spark):
    df = spark.createDataFrame([(-125.0, 49.0), (-66.0, 24.0), (-125.0, 24.0)], "x double, y double")
    got = [(r["x"], r["y"]) for r in crs.to_goode(df).collect()]
    assert got[0][1] == pytest.approx(5431564, abs=1)
    assert got[1][1] == pytest.approx(2671668, abs=1)
    assert got[2][0] == pytest.approx(-13674334, abs=1)


def test_filter_on_projected_coordinates_stays_above(spark):
    df = crs.from_albers(crs.to_albers(spark.createDataFrame([(-100.0, 40.0)], "x double, y double")))
    assert df.filter("x between -101 and -99 and y between 39 and 41").filter("x * y < 0").count() == 1
