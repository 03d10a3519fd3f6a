"""Readers, checkpoints and sample preparation."""

from __future__ import annotations

import json

import pytest
from conftest import rows

from strataweave.functions.crs import GEOGRAPHIC
from strataweave.functions.geometry import rectangle, with_box
from strataweave.plans.samples import located_samples, missing_counterpart, normalise_samples, normalise_sites
from strataweave.sources.checkpoints import load_tables, save_tables
from strataweave.sources.polygons import edge_rows, read_geojson_lines, read_polygons
from strataweave.sources.tables import read_csv


def test_csv(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text('extra,Sample_Name,Clay_percent\n1,60141_3_TOP,12.5\n2,NA,NA\n3,,x\n4,"a, ""b""\nc",NaN\n')
    got = rows(read_csv(spark, str(path), "clay_properties", multi_line=True), "Sample_Name", "Clay_percent")
    assert got == sorted([("60141_3_TOP", 12.5), (None, None), ("", None), ('a, "b"\nc', None)], key=repr)
    blank = read_csv(spark, str(path), "clay_properties", blank_strings="null", multi_line=True)
    assert blank.filter("Sample_Name is null").count() == 2


def test_csv_files_of_one_header(spark, tmp_path):
    for name, text in (("a", "Sample_Name,Clay_percent\nx,1\n"), ("b", "Sample_Name,Clay_percent\ny,2\n")):
        (tmp_path / f"{name}.csv").write_text(text)
    assert rows(read_csv(spark, str(tmp_path), "clay_properties"), "Sample_Name", "Clay_percent") == [("x", 1.0), ("y", 2.0)]
    (tmp_path / "c.csv").write_text("Clay_percent,Sample_Name\n3,z\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_csv(spark, str(tmp_path), "clay_properties").collect()


def test_geojson(spark, tmp_path):
    square = [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]
    hole = [[0.5, 0.5], [1, 0.5], [1, 1]]
    features = [
        {"type": "Feature", "properties": {"code": "a", "n": 1}, "geometry": {"type": "Polygon", "coordinates": [square, hole]}},
        {"type": "Feature", "properties": {"code": "b"}, "geometry": {"type": "MultiPolygon", "coordinates": [[square], [hole]]}},
        {"type": "Feature", "properties": {"code": "c"}, "geometry": {"type": "Point", "coordinates": [1, 2]}},
    ]
    path = tmp_path / "z.geojsonl"
    path.write_text("\n".join(json.dumps(f) for f in features))
    layer = read_geojson_lines(spark, str(path), {"code": "string", "n": "int"})
    assert rows(layer, "code", "n", "xmin", "ymax") == [("a", 1, 0.0, 2.0), ("b", None, 0.0, 2.0)]
    assert edge_rows(layer, "code").groupBy("code").count().filter("count = 7").count() == 2
    layer.select("code", "edges").write.parquet(str(tmp_path / "p"))
    assert read_polygons(spark, str(tmp_path / "p")).filter("xmax = 2.0").count() == 2


def test_checkpoints_are_written_once(spark, tmp_path):
    folder = str(tmp_path / "out")
    with pytest.raises(FileNotFoundError, match="b"):
        load_tables(spark, ["b"], folder)
    save_tables({"a": spark.range(3)}, folder)
    with pytest.raises(FileExistsError, match="a"):
        save_tables({"b": spark.range(1), "a": spark.range(3)}, folder)
    with pytest.raises(FileNotFoundError):
        load_tables(spark, ["a", "b"], folder)
    assert load_tables(spark, ["a"], folder)["a"].count() == 3


def test_preparation(spark):
    raw = spark.createDataFrame([("P1-S1", 7.0, None, "TOP"), ("P2_S2", 6.0, 3.0, "BTM"), ("P3-S9", 5.0, 1.0, "TOP")], "set string, ph double, ppm double, sec string")
    places = spark.createDataFrame([("S1", -100.0, 40.0), ("S2", -90.0, 35.0), ("S3", -80.0, 30.0)], "site string, lon double, lat double")
    got = normalise_sites(raw, places, GEOGRAPHIC, {"pH": "ph", "core_section": "sec"}, "set", "site", "lon", "lat", "ppm", "own", ("ppm", "rate"), ["S3"])
    assert rows(got, "pH", "sample", "label", "x") == [(6.0, "P2_S2", "ppm", -90.0), (7.0, "P1_S1", "rate", -100.0)]

    props = spark.createDataFrame([("60141_3_TOP", 7.1), ("60141-4_BTM", 6.0), ("abc_3_TOP", 5.0)], "name string, pH double")
    coords = spark.createDataFrame([(60141, 3, 40.0, 76.6), (60141, 4, 60.0, -76.6)], "proposal_id long, sampling_set long, latitude double, longitude double")
    prepared = normalise_samples(props, coords, "name", "pH", "own")
    assert rows(prepared, "proposal_id", "sample", "core_section", "longitude") == [
        (60141.0, "3", "TOP", -76.6), (60141.0, "4", "BTM", -76.6), (None, "3", "TOP", None)
    ]
    country = with_box(spark.createDataFrame([("c",)], "state string").withColumn("edges", rectangle(-130, 20, -60, 50)))
    both = located_samples(prepared, got.select("sample", "core_section", "pH", "source", "x", "y"), "pH", country, GEOGRAPHIC, "drop")
    assert rows(both, "sample", "pH") == [("3", 7.1), ("P1_S1", 7.0), ("P2_S2", 6.0)]


def test_missing_counterpart_repeats_equal_keys(spark):
    columns = "core_section string, clay double, source string, sample string, extracted double"
    top = spark.createDataFrame([("TOP", 5.0, "own", "P1-AB1", None), ("TOP", 5.0, "own", "P1-AB1", None), ("TOP", 6.0, "own", "P2-AC1", 3.0)], columns)
    places = spark.createDataFrame([("AB1", "urban")], "site_code string, kind string")
    got = missing_counterpart({"TOP": top}, top.drop("extracted"), places, "clay")
    assert rows(got, "site_code", "location", "samples", "kind") == [("AB1", "AB", "n = 4", "urban")] * 4
