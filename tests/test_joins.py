"""Joins with missing keys, suffixes, and the spread path."""

from __future__ import annotations

import pytest
from conftest import rows

from strataweave.operators import joins
from strataweave.operators.groups import partition_count
from strataweave.operators.reshape import pivot_counts, sample_sizes, union_fill, union_strict, unpivot, with_row_id
from strataweave.plans.climate import combine_rates
from strataweave.session import stage


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (4, "d")], "k int, v string")
    right = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z"), (3, "w")], "k int, v string")
    return left, right


def test_missing_matches_missing(sides):
    left, right = sides
    assert rows(joins.left_join(left, right, "k"), "k", "v_x", "v_y") == rows(
        left.sparkSession.createDataFrame(
            [(1, "a", "x"), (1, "a", "y"), (2, "b", None), (None, "c", "z"), (4, "d", None)], "k int, v_x string, v_y string"
        ),
        "k",
        "v_x",
        "v_y",
    )
    assert rows(joins.semi_join(left, right, "k"), "v") == [("a",), ("c",)]
    assert rows(joins.anti_join(left, right, "k"), "v") == [("b",), ("d",)]


def test_renamed_keys_and_left_key_name_on_the_right(sides):
    left, right = sides
    other = right.withColumnsRenamed({"k": "code", "v": "k"})
    got = joins.inner_join(left, other, {"k": "code"})
    assert got.columns == ["k", "v", "k_y"]
    assert rows(got, "v", "k_y") == [("a", "x"), ("a", "y"), ("c", "z")]


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_spread_join_gives_the_same_rows(spark, how):
    left = spark.range(4000).selectExpr("id", "case when id % 3 = 0 then 7 else id % 50 end as k")
    right = spark.range(30).selectExpr("cast(id as bigint) as k", "id * 10 as w")
    plain = joins.equi_join(left, right, "k", how)
    spread = joins.equi_join(left, right, "k", how, spread=True, hot_rows=100)
    assert spread.columns == plain.columns
    assert rows(spread, *plain.columns) == rows(plain, *plain.columns)


def test_spread_join_keeps_exact_copies(spark):
    left = spark.range(3000).selectExpr("'same' as k", "1 as v").repartition(6)
    right = spark.createDataFrame([("same", 2), ("other", 3)], "k string, w int")
    got = joins.equi_join(left, right, "k", spread=True, hot_rows=100)
    assert got.count() == 3000 and got.filter("w = 2").count() == 3000


def test_lookup_join_beyond_the_limit(spark, monkeypatch):
    monkeypatch.setattr("strataweave.session.BROADCAST_BYTES", 5)
    left = spark.range(1000).selectExpr("id", "id % 20 as k")
    table = left.groupBy("k").count()
    got = joins.lookup_join(left, table, "k", hot_rows=10)
    assert got.count() == 1000 and got.filter("count = 50").count() == 1000


def test_distinct_right_side_fans_out(spark):
    left = spark.createDataFrame([("s",)], "k string")
    right = spark.createDataFrame([("s", 1), ("s", 1), ("s", 2)], "k string, m int")
    assert joins.left_join_distinct(left, right, "k", ["m"]).count() == 2


def test_located_only(spark):
    left = spark.createDataFrame([("a",), ("b",)], "s string")
    places = spark.createDataFrame([("a", 1.0, 2.0)], "s string, x double, y double")
    assert rows(joins.located_only(left, places, "s"), "s", "x") == [("a", 1.0)]


def test_unions_and_pivots(spark):
    a = spark.createDataFrame([("z", "own")] * 3 + [("z", "grid")] + [("y", "own"), ("x", "grid")], "c string, s string")
    b = spark.createDataFrame([(1,)], "n int")
    assert union_fill(a, b).count() == 7 and union_fill(a, b).columns == ["c", "s", "n"]
    assert union_fill(spark.range(1), b).columns == ["id", "n"]
    with pytest.raises(ValueError):
        union_strict(a, b)
    assert rows(pivot_counts(a, "c", "s", ["own", "grid"]), "c", "own", "grid") == [("x", None, 1), ("y", 1, None), ("z", 3, 1)]
    assert rows(sample_sizes(a, "c", "s", "own", "grid"), "axis_label") == [("z\nown = 3, grid = 1",)]
    wide = spark.createDataFrame([(1, 2.0, None)], "id int, p double, t double")
    assert rows(unpivot(wide, ["id"], ["p", "t"], "n", "v"), "n", "v") == [("p", 2.0), ("t", None)]


def test_partition_count_and_row_ids(spark):
    df = spark.range(100).selectExpr("concat('s', lpad(id, 3, '0')) as k", "id % 3 as g")
    assert partition_count(df, "g").filter("samples = 'n = 34'").count() == 34
    numbered = with_row_id(df, ["k"], partitions=5)
    assert [r["id"] for r in numbered.orderBy("k").collect()] == list(range(1, 101))


def test_well_compressed_tables_are_not_broadcast(spark, monkeypatch, capsys):
    """A staged table of a few bytes a thousand rows is measured by its rows, not by its file."""
    left = spark.range(2000).selectExpr("id % 500 as k", "id as v")
    table = stage(spark.range(500).selectExpr("id as k", "1L as w"))
    small = [joins.left_join(left, table, "k"), joins.lookup_join(left, table, "k", staged=False)]
    monkeypatch.setattr("strataweave.session.BROADCAST_BYTES", 1000)
    large = [joins.left_join(left, table, "k"), joins.lookup_join(left, table, "k", staged=False), joins.equi_join(left, table, "k", spread=True)]
    for found, broadcast in [(s, True) for s in small] + [(x, False) for x in large]:
        capsys.readouterr()
        found.explain()
        assert ("BroadcastHashJoin" in capsys.readouterr().out) == broadcast
        assert found.filter("w = 1").count() == 2000


def test_sites_meet_the_index_once(spark, monkeypatch):
    """Rows of the buffers are computed once, though the join reads its left side twice; many samples of a site give one row."""
    monkeypatch.setattr("strataweave.session.BROADCAST_BYTES", 5)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    columns = "site string, gridded_mean double, gridded_count long, gridded_sd double"
    buffers = spark.range(300).selectExpr("'s' || id % 3 as site", "1D as gridded_mean", "4L as gridded_count", "0D as gridded_sd")
    index = spark.createDataFrame([("s0", 5.0, 1.0, 2.0, "own", 5.0), ("s1", 6.0, 1.0, 2.0, "own", 6.0)],
                                  "site string, rs_index double, MAT double, MAP double, source string, respiration_rate double")
    got = combine_rates(index, buffers.mapInArrow(counted, columns), "site", "gridded")
    assert rows(got.filter("source = 'gridded'"), "site") == [("s0",), ("s1",)] and got.count() == 4
    assert read.value == 300
