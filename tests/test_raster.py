from __future__ import annotations

import math

import numpy as np
import pytest

from cellmill.functions.grid import GridSpec
from cellmill.operators import raster as R

GRID = GridSpec.of(0, 0, 8, 6, 1, -1, 4, 3)
NAN = float("nan")


@pytest.fixture(scope="module")
def sparse(spark):
    return spark.createDataFrame([(0, 0, 1.0, 2.0), (0, 1, None, 3.0), (5, 7, NAN, math.inf), (2, 2, 4.0, -1.0)], "row int, col int, s double, m double")


def test_dense(sparse):
    dense = R.to_dense(sparse, GRID)
    assert dense.count() == 48
    a = R.to_numpy(dense, GRID, "s")
    assert a.shape == (6, 8) and a[0, 0] == 1 and a[2, 2] == 4 and np.isnan(a).sum() == 46
    touched = R.to_numpy(R.to_dense(sparse, GRID, "touched_zero", ("s",)), GRID, "s")
    assert touched[1, 3] == 0 and touched[0, 1] == 0 and touched[4, 5] == 0 and np.isnan(touched[0, 5]) and np.isnan(touched[5, 7])
    with pytest.raises(ValueError):
        R.to_dense(sparse, GRID, "zero")


def test_mask_fill_stride(sparse):
    assert sorted(map(tuple, R.valid_mask(sparse).collect())) == [(0, 0, 1, 1), (0, 1, 0, 1), (2, 2, 1, 1), (5, 7, 0, 0)]
    assert {(r.s, r.m) for r in R.fill(sparse, 7.0, "s").collect()} == {(7.0, 2.0), (7.0, 3.0), (7.0, math.inf), (7.0, -1.0)}
    assert R.strided(sparse, 2).count() == 2


def test_stats(spark):
    a = np.random.default_rng(1).normal(size=(6, 8))
    a[0, :3] = np.nan
    r = R.raster_stats(R.from_numpy(spark, a), "value").first()
    known = a[~np.isnan(a)]
    assert (r.cells, r.covered) == (48, 45) and r.coverage == pytest.approx(100 * 45 / 48)
    assert [r.minimum, r.maximum, r["mean"], r.p5, r.p95] == pytest.approx([known.min(), known.max(), known.mean(), *np.percentile(known, [5, 95])])
    empty = R.raster_stats(R.from_numpy(spark, a).where("false"), "value").first()
    assert (empty.cells, empty.covered, empty.coverage) == (0, 0, None)


def test_diff(spark):
    a = np.array([[1.0, 2.0], [np.nan, 4.0]])
    diff = lambda x, y, **k: R.raster_diff(R.from_numpy(spark, x), R.from_numpy(spark, y), "value", **k).first()
    assert diff(a, a).passed and diff(a, a + 1e-5).passed and not diff(a, a + 1e-3).passed
    r = diff(a, np.array([[1.0, np.nan], [3.0, 4.5]]))
    assert (r.compared, r.max_diff, r.above_tolerance, r.only_left, r.only_right, r.passed) == (2, 0.5, 1, 1, 1, False)
    assert not diff(a[:, :1] * np.nan, a[:, :1]).passed


def test_overviews(spark):
    a = np.arange(48.0).reshape(6, 8)
    a[0, 0] = np.nan
    got = R.to_numpy(R.overview(R.from_numpy(spark, a), 2), GridSpec.of(0, 0, 8, 6, 2, -2), "value")
    want = np.nanmean(a.reshape(3, 2, 4, 2).transpose(0, 2, 1, 3).reshape(3, 4, 4), 2)
    assert np.allclose(got, want)
    levels = R.pyramid(R.from_numpy(spark, a), GRID, least=1)
    assert list(levels) == R.overview_levels(GRID, 1) == [2, 4]
    assert np.allclose(R.to_numpy(levels[2], GridSpec.of(0, 0, 8, 6, 2, -2), "value"), want)
    four = {(r.row, r.col): r.value for r in levels[4].collect()}
    assert four[0, 0] == pytest.approx(np.nanmean(a[:4, :4])) and four[1, 1] == pytest.approx(a[4:, 4:].mean())
    assert R.overview_levels(GridSpec.of(0, 0, 2048, 1024, 1, -1)) == [2, 4]
