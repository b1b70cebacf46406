from __future__ import annotations

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellmill.functions.filters import FilterSpec
from cellmill.functions.grid import GridSpec
from cellmill.functions.reductions import CustomReduction, Reduction
from cellmill.operators.reduce import finalize_states, merge_states, partial_states, reduce_points, tile_batches, tile_counts

GRID = GridSpec.of(0, 0, 10, 10, 1, -1, 5, 5)
NAN = float("nan")


def cloud(spark, rows, schema="x double, y double, v float"):
    return spark.createDataFrame(rows, schema)


def test_one_point_per_cell(spark):
    pts = cloud(spark, [(j + 0.5, 9.5 - i, float(10 * i + j)) for i in range(10) for j in range(10)])
    rows = reduce_points(pts, GRID, [Reduction("v", k) for k in ("sum", "max", "count", "average")]).collect()
    assert len(rows) == 100 and all(r.v_sum == r.v_max == r.v_average == 10 * r.row + r.col and r.v_count == 1 for r in rows)


def test_two_values_average(spark):
    pts = cloud(spark, [(j + 0.5, 9.5 - i, v) for i in range(10) for j in range(10) for v in (10.0, 20.0)])
    assert {r.m for r in reduce_points(pts, GRID, [Reduction("v", band="m")]).collect()} == {15.0}


def test_nan_null_and_empty(spark):
    pts = cloud(spark, [(0.5, 0.5, 1.0), (0.5, 0.5, NAN), (1.5, 0.5, NAN), (2.5, 0.5, None), (NAN, 0.5, 1.0), (0.5, None, 1.0), (11.0, 1.0, 1.0)])
    kinds = ("sum", "max", "min", "count", "average", "median")
    got = {r.col: r for r in reduce_points(pts, GRID, [Reduction("v", k, band=k) for k in kinds]).collect()}
    assert set(got) == {0, 1, 2}
    assert math.isnan(got[0]["sum"]) and got[0]["max"] == got[0]["min"] == 1 and got[0]["count"] == 2 and math.isnan(got[0]["average"])
    assert got[1]["max"] is None and got[1]["count"] == 1
    assert got[2]["sum"] is None and got[2]["count"] is None and got[2]["average"] is None
    assert reduce_points(pts.where("false"), GRID, [Reduction("v", "sum")]).count() == 0


def test_weights(spark):
    pts = cloud(spark, [(0.5, 0.5, 1.0, 3.0), (0.5, 0.5, 5.0, 1.0), (1.5, 0.5, 2.0, 0.0), (2.5, 0.5, None, 2.0)], "x double, y double, v double, w double")
    got = {r.col: r for r in reduce_points(pts, GRID, [Reduction("v", "weighted_average", weight="w", band="a"), Reduction("v", "weighted_average", band="b")]).collect()}
    assert got[0].a == 2 and got[0].b == 3 and got[1].a is None and got[1].b == 2 and got[2].a is None


def test_most_recent_and_priority(spark):
    rows = [(0.5, 0.5, 1.0, 10, 2), (0.5, 0.5, 2.0, 30, 1), (0.5, 0.5, 3.0, 30, 0), (0.5, 0.5, None, 99, 9), (1.5, 0.5, 7.0, None, 1)]
    pts = cloud(spark, rows, "x double, y double, v double, t long, p int")
    rs = [Reduction("v", "most_recent", order="t", ties=("p",), band="a"), Reduction("v", "most_recent", order="t", band="b"), Reduction("v", "priority_merge", order="p", band="c")]
    got = {r.col: (r.a, r.b, r.c) for r in reduce_points(pts, GRID, rs).collect()}
    assert got == {0: (3.0, 3.0, 1.0), 1: (None, None, 7.0)}


def test_percentile_and_custom(spark):
    pts = cloud(spark, [(0.5, 0.5, float(v)) for v in (1, 2, 3, 10)])
    mean_square = CustomReduction(lambda v: [F.sum(v * v), F.count(v)], lambda s, n: s / n, lambda s, n: [F.sum(s), F.sum(n)])
    rs = [Reduction("v", "median", band="m"), Reduction("v", "percentile", percentile=0.25, band="p"), Reduction("v", "custom", band="q", custom=mean_square)]
    r = reduce_points(pts, GRID, rs).first()
    assert (r.m, r.p, r.q) == (2.5, 1.75, 28.5)


def test_names_and_errors(spark):
    pts = cloud(spark, [(0.5, 0.5, 1.0)]).withColumn("name", F.lit("a"))
    assert Reduction("v", "sum").name == "v_sum"
    for bad in ([], [Reduction("u")], [Reduction("name")], [Reduction("v", "mode")], [Reduction("v", "most_recent")], [Reduction("v"), Reduction("v")], [Reduction("v", "percentile", percentile=2)]):
        with pytest.raises(ValueError):
            reduce_points(pts, GRID, bad)
    with pytest.raises(ValueError):
        merge_states(pts, [Reduction("v", "median")])


def test_clashing_columns(spark):
    """Channels may be called like the columns of the result, and others stay out of the way."""
    pts = cloud(spark, [(0.5, 9.5, 1.0, 7, 8, 9)], "x double, y double, v double, row int, col int, w int")
    assert reduce_points(pts, GRID, [Reduction("v", "sum")]).first().asDict() == {"row": 0, "col": 0, "v_sum": 1.0}
    got = reduce_points(pts, GRID, [Reduction("row", "sum"), Reduction("col", "max"), Reduction("w", "weighted_average", weight="w")]).first()
    assert got.asDict() == {"row": 0, "col": 0, "row_sum": 7.0, "col_max": 8.0, "w_weighted_average": 9.0}


points = st.lists(st.tuples(st.floats(0, 10), st.floats(0, 10), st.integers(-50, 50), st.integers(0, 9)), min_size=1, max_size=30)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(points, st.integers(0, 30))
def test_split_ingest_equals_whole(spark, rows, at):
    rs = [Reduction("v", k, band=k) for k in ("sum", "max", "min", "count", "average")] + [Reduction("v", "most_recent", order="t", band="last")]
    pts = [(x, y, float(v), t) for x, y, v, t in rows]
    schema = "x double, y double, v double, t int"
    parts = [partial_states(spark.createDataFrame(p, schema), GRID, rs) for p in (pts[:at], pts[at:])]
    both, other = parts[0].unionByName(parts[1]), parts[1].unionByName(parts[0])
    whole = sorted(map(tuple, reduce_points(spark.createDataFrame(pts, schema), GRID, rs).collect()))
    assert sorted(map(tuple, finalize_states(merge_states(both, rs), rs).collect())) == whole
    assert sorted(map(tuple, finalize_states(merge_states(other, rs), rs).collect())) == whole


IEEE = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


@pytest.mark.parametrize("op", IEEE)
@pytest.mark.parametrize("kind", ["double", "float", "int"])
def test_comparisons_are_ieee(spark, op, kind):
    values = [1, 2, 3, -1] if kind == "int" else [1.0, 2.0, 3.0, -0.0, NAN, math.inf, -math.inf]
    df = spark.createDataFrame([(v,) for v in [*values, None]], f"c {kind}")
    for limit in (2.0, NAN, math.inf):
        got = [r.c for r in FilterSpec().add("c", op, limit).apply(df).collect()]
        want = [v for v in values if IEEE[op](v, limit)]
        assert list(map(repr, got)) == list(map(repr, want))


def test_sets_conjunction_and_errors(spark):
    df = spark.createDataFrame([(float(i), i % 4) for i in range(100)] + [(NAN, 0), (None, None)], "v double, k int")
    assert FilterSpec().add_not_in_set("k", [0, 1]).apply(df).count() == 50
    assert FilterSpec().add_in_set("v", [1, 2, NAN]).apply(df).count() == 2
    assert FilterSpec().add_not_in_set("v", [1, 2]).apply(df).count() == 99
    assert FilterSpec().add("v", ">=", 50).add("v", "<", 60).add_in_set("k", [2]).apply(df).count() == 3
    assert FilterSpec().apply(df).count() == 102 and FilterSpec().add_in_set("v", []).apply(df).count() == 0
    assert FilterSpec().add("v", "<", 3).selected(df).count() == 3
    with pytest.raises(ValueError):
        FilterSpec().add("none", "<", 1).apply(df)
    with pytest.raises(ValueError):
        FilterSpec().add("v", "~", 1)


def test_filter_comes_first(spark):
    pts = spark.createDataFrame([(j + 0.5, 9.5 - i, 1.0, float((10 * i + j) % 2)) for i in range(10) for j in range(10)], "x double, y double, v double, k double")
    rows = reduce_points(pts, GRID, [Reduction("v", "count", band="n")], FilterSpec().add("k", "==", 1.0)).collect()
    assert sum(r.n for r in rows) == 50 and all(r.col % 2 for r in rows)


def test_tiles(spark):
    pts = cloud(spark, [(0.5, 0.5, 1.0), (0.6, 0.6, 1.0), (9.5, 9.5, 1.0), (4.5, 0.5, 1.0)])
    assert sorted(map(tuple, tile_counts(pts, GRID).collect())) == [(0, 1, 1, 1), (1, 0, 3, 2)]
    seen = tile_batches(pts, GRID, partitions=3).withColumn("part", F.spark_partition_id()).collect()
    assert len({(r.tile_row, r.tile_col, r.part) for r in seen}) == len({(r.tile_row, r.tile_col) for r in seen})
