from __future__ import annotations

import math

import pytest
from hypothesis import given
from hypothesis import strategies as st

from cellmill.functions.crs import CRS
from cellmill.functions.grid import BBox, GridSpec

SMALL = GridSpec.of(0, 0, 10, 10, 1, -1, 5, 5)


def test_box():
    assert not BBox().valid and BBox().expand(1, 2) == BBox(1, 2, 1, 2)
    b = BBox(0, 0, 2, 3).expand(BBox(-1, 1, 1, 5))
    assert b == BBox(-1, 0, 2, 5) and (b.width, b.height) == (3, 5)
    assert all(b.contains(x, y) for x in (-1, 2) for y in (0, 5)) and not b.contains(float("nan"), 1)
    assert b.padded(1, 2) == BBox(-2, -2, 3, 7)


def test_dimensions():
    assert (SMALL.width, SMALL.height, SMALL.tiles_x, SMALL.tiles_y) == (10, 10, 2, 2)
    odd = GridSpec.of(0, 0, 10.5, 7.2, 2, -2, 4, 3)
    assert (odd.width, odd.height, odd.tiles_x, odd.tiles_y) == (6, 4, 2, 2)
    assert odd.tile_cells(1, 1) == (3, 4, 1, 2)
    assert odd.tile_bounds(0, 0) == BBox(0, 7.2 - 6, 8, 7.2)
    assert GridSpec(BBox(), 1, -1).width == 0
    assert SMALL.geotransform == (0, 1, 0, 10, 0, -1)
    with pytest.raises(IndexError):
        SMALL.tile_cells(2, 0)


def test_cells_and_edges():
    assert SMALL.cell_of(0, 10) == (0, 0) and SMALL.cell_of(10, 0) == (9, 9)
    assert SMALL.cell_of(3, 5) == (5, 3)  # right of a vertical edge, below a horizontal one
    assert SMALL.cell_of(10.0001, 5) is None and SMALL.cell_of(math.nan, 5) is None
    assert SMALL.center_of(0, 0) == (0.5, 9.5)


@given(st.floats(-1, 11), st.floats(-1, 11))
def test_center_of_a_cell_lies_in_it(x, y):
    at = SMALL.cell_of(x, y)
    assert (at is None) == (not SMALL.bounds.contains(x, y))
    if at:
        assert SMALL.cell_of(*SMALL.center_of(*at)) == at


@pytest.mark.parametrize("bad", [
    dict(bounds=BBox()), dict(cell_x=0), dict(cell_x=-1), dict(cell_y=1), dict(cell_y=0), dict(tile_width=0), dict(bounds=BBox(0, 0, math.inf, 1)), dict(bounds=BBox(1, 1, 1, 1)),
])
def test_validation(bad):
    with pytest.raises(ValueError):
        GridSpec(**({"bounds": BBox(0, 0, 1, 1), "cell_x": 1, "cell_y": -1} | bad)).validate()


def test_columns_agree_with_scalars(spark):
    grid = GridSpec.of(-3, 2, 20.5, 31, 2.5, -1.5, 4, 3)
    xs = [-3.0, -3.0000001, 20.5, 0.0, 2.0, 7.25, 19.9, float("nan"), None]
    df = spark.createDataFrame([(x, y) for x in xs for y in (2.0, 31.0, 30.9, 16.25, 1.9)], "x double, y double")
    rows = grid.assign(df).select("*", grid.local_cell().alias("local"), grid.tile_id().alias("tile"), grid.cell_id().alias("cell"), grid.center_x().alias("cx"), grid.center_y().alias("cy")).collect()
    assert len(rows) == sum(x is not None and grid.cell_of(x, y) is not None for x in xs for y in (2.0, 31.0, 30.9, 16.25, 1.9))
    for r in rows:
        row, col = grid.cell_of(r.x, r.y)
        h, w = grid.tile_cells(row // 3, col // 4)[2:]
        assert (r.row, r.col, r.cell) == (row, col, row * grid.width + col) and (r.cx, r.cy) == pytest.approx(grid.center_of(row, col))
        assert r.local == row % 3 * w + col % 4 and r.tile == row // 3 * grid.tiles_x + col // 4 and h <= 3
    assert grid.cells(spark).count() == grid.width * grid.height


def test_bounds_reach_the_reader(spark, sf):
    from cellmill.plans.queries import LINEITEM, QUERIES, lineitem

    plan = LINEITEM.assign(lineitem(spark, sf))._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(l_extendedprice" in plan and "LessThanOrEqual(l_quantity" in plan
    narrow = QUERIES["cell_sum"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_discount:double>" in narrow and narrow.count("Exchange hashpartitioning") == 1


def test_crs():
    a, b = CRS.from_epsg(32610), CRS.from_epsg(4326)
    assert a.is_projected and not a.is_geographic and b.is_geographic and not b.is_projected
    assert CRS.from_wkt(a.wkt).epsg == 32610 and CRS.from_wkt(a.wkt).equivalent_to(a) and not a.equivalent_to(b)
    assert not CRS().known and not CRS().is_projected and CRS().equivalent_to(CRS())
