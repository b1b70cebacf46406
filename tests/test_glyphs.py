from __future__ import annotations

import math
import random

import pytest

from cellmill.functions.grid import GridSpec
from cellmill.functions.reductions import Reduction
from cellmill.operators.glyphs import GlyphSpec, custom_glyph, footprint_rows, gaussian_glyph, line_glyph, splat
from cellmill.operators import kernels
from cellmill.operators.reduce import finalize_states, partial_states, reduce_points

GRID = GridSpec.of(0, 0, 20, 15, 1, -1, 8, 6)


def cells(grid, glyph, x, y, sx, sy, rot, direction, half):
    """The footprint of one point by plain loops."""
    at = grid.cell_of(x, y)
    if at is None:
        return {}
    fc, fr = (x - grid.bounds.min_x) * (1 / grid.cell_x), (y - grid.bounds.max_y) * (1 / grid.cell_y)
    out = {}
    center = glyph.anchor == "center"
    if glyph.kind == "gaussian":
        ic, ir = math.floor(fc), math.floor(fr)
        ax, ay = sx / grid.cell_x, sy / grid.cell_y
        r = math.ceil(min(3 * (max(abs(ax), abs(ay)) if glyph.strict_radius else max(ax, ay)), glyph.max_radius))
        for dy in range(-r, r + 1):
            for dx in range(-r, r + 1):
                rx, ry = dx + 0.5 * center - (fc - ic), dy + 0.5 * center - (fr - ir)
                u, v = rx * math.cos(-rot) - ry * math.sin(-rot), rx * math.sin(-rot) + ry * math.cos(-rot)
                w = math.exp(-0.5 * ((u / ax) ** 2 + (v / ay) ** 2))
                if w >= 1e-6:
                    out[ir + dy, ic + dx] = w
    else:
        hx, hy = min(half / grid.cell_x, glyph.max_radius), half / grid.cell_y
        hy = max(hy, -glyph.max_radius) if glyph.strict_radius else min(hy, glyph.max_radius)
        half_away = lambda v: math.floor(abs(v) + 0.5) * (1 if v >= 0 else -1)
        end = math.floor if center else half_away
        c, r = end(fc - hx * math.cos(direction)), end(fr - hy * math.sin(direction))
        c1, r1 = end(fc + hx * math.cos(direction)), end(fr + hy * math.sin(direction))
        dx, dy = abs(c1 - c), abs(r1 - r)
        error = dx - dy
        while True:
            out[r, c] = 1.0
            if (c, r) == (c1, r1):
                break
            twice = 2 * error
            if twice >= -dy:
                error -= dy
                c += 1 if c1 > c else -1
            if twice <= dx:
                error += dx
                r += 1 if r1 > r else -1
    tile = lambda r, c: (r // grid.tile_height, c // grid.tile_width)
    out = {(r, c): w for (r, c), w in out.items() if 0 <= r < grid.height and 0 <= c < grid.width and (not glyph.clip_to_tile or tile(r, c) == tile(*at))}
    if glyph.normalize:
        total = sum(out.values())
        out = {k: w / total for k, w in out.items()}
    return out


@pytest.fixture(scope="module")
def points(spark):
    r = random.Random(1)
    rows = [(i, r.uniform(-1, 21), r.uniform(-1, 16), r.uniform(-5, 5), r.choice([-1.0, r.uniform(0.2, 2)]), r.uniform(0.2, 2), r.uniform(-4, 4), r.uniform(-4, 4), r.uniform(0, 4)) for i in range(60)]
    rows += [(100, 20.0, 0.0, 1.0, 1.0, 1.0, 0.0, 0.0, 2.0), (101, 0.0, 15.0, 1.0, 1.0, 1.0, 0.0, 1.0, 0.0), (102, 8.5, 9.5, 1.0, 1.0, 1.0, 0.0, math.pi / 2, 3.0)]
    rows.append((103, 8.5, 9.5, 1.0, None, None, None, None, None))
    return rows, spark.createDataFrame(rows, "id int, x double, y double, v double, sx double, sy double, rot double, dir double, half double")


SPECS = [GlyphSpec("gaussian", "sx", "sy", "rot"), GlyphSpec("line", direction_channel="dir", half_length_channel="half"), gaussian_glyph(sigma_x=0.7, sigma_y=1.6), line_glyph(0.4, 2.5)]


@pytest.mark.parametrize("spec", SPECS)
@pytest.mark.parametrize("change", [{}, {"clip_to_tile": False}, {"anchor": "center"}, {"strict_radius": True, "max_radius": 2.0}, {"normalize": True}])
def test_footprints_against_loops(spark, points, spec, change):
    from dataclasses import replace

    rows, df = points
    glyph = replace(spec, **change)
    got: dict[int, dict] = {}
    for r in splat(df, GRID, glyph).select("id", "row", "col", "w").collect():
        assert (r.row, r.col) not in got.setdefault(r.id, {})
        got[r.id][r.row, r.col] = r.w
    for i, x, y, _, sx, sy, rot, direction, half in rows:
        own = [
            sx if glyph.sigma_x_channel and sx and sx > 0 else glyph.default_sigma_x, sy if glyph.sigma_y_channel and sy and sy > 0 else glyph.default_sigma_y,
            rot if glyph.rotation_channel and rot is not None else glyph.default_rotation, direction if glyph.direction_channel and direction is not None else glyph.default_direction,
            half if glyph.half_length_channel and half is not None else glyph.default_half_length,
        ]
        want = cells(GRID, glyph, x, y, *own)
        assert got.get(i, {}).keys() == want.keys()
        assert all(got[i][k] == pytest.approx(w, rel=1e-9) for k, w in want.items())


def test_corner_weights(spark):
    """A point at a cell centre weighs its cell and the three towards the lower right alike."""
    w = {(r.row, r.col): r.w for r in splat(spark.createDataFrame([(4.5, 10.5)], "x double, y double"), GRID, gaussian_glyph(1.0)).collect()}
    assert [round(w[k], 4) for k in ((4, 4), (4, 5), (5, 4), (5, 5))] == [0.7788] * 4
    w = {(r.row, r.col): r.w for r in splat(spark.createDataFrame([(4.5, 10.5)], "x double, y double"), GRID, gaussian_glyph(1.0, anchor="center")).collect()}
    assert w[4, 4] == 1 and w[4, 5] == w[5, 4] == pytest.approx(math.exp(-0.5))


def test_reductions_of_footprints(spark, points):
    rows, df = points
    glyph = gaussian_glyph(0.8)
    got = {(r.row, r.col): r for r in reduce_points(df, GRID, [Reduction("v", k, band=k, glyph=glyph) for k in ("sum", "count", "average", "weighted_average")]).collect()}
    sums: dict = {}
    for _, x, y, v, *_ in rows:
        for k, w in cells(GRID, glyph, x, y, 0.8, 0.8, 0, 0, 1).items():
            a = sums.setdefault(k, [0, 0])
            a[0] += v * w
            a[1] += w
    assert got.keys() == sums.keys()
    for k, (vw, w) in sums.items():
        r = got[k]
        assert (r["sum"], r["count"], r["average"], r["weighted_average"]) == pytest.approx((vw, w, vw / w, vw / w))


def test_different_footprints_in_one_run(spark, points):
    _, df = points
    rs = [Reduction("v", "count", band="n"), Reduction("v", "count", band="g", glyph=gaussian_glyph(1.0)), Reduction("v", "count", band="l", glyph=line_glyph(0, 2))]
    both = {(r.row, r.col): r for r in reduce_points(df, GRID, rs).collect()}
    for r in rs:
        alone = {(x.row, x.col): x[r.name] for x in reduce_points(df, GRID, [r]).collect()}
        assert {k: v[r.name] for k, v in both.items() if v[r.name] is not None} == pytest.approx(alone)


def test_splat_helpers(spark, points):
    from cellmill.api import gaussian_splat, line_splat

    _, df = points
    for short, long in (
        (gaussian_splat("v", 0.8, band="a"), Reduction("v", "weighted_average", band="a", glyph=gaussian_glyph(0.8))),
        (line_splat("v", 0.3, 2.0, band="a", direction_channel="dir"), Reduction("v", "weighted_average", band="a", glyph=line_glyph(0.3, 2.0, direction_channel="dir"))),
    ):
        assert short == long and reduce_points(df, GRID, [short]).count() > 0


def test_what_footprints_cannot_do(spark, points):
    _, df = points
    for kind in ("max", "min", "median"):
        with pytest.raises(NotImplementedError):
            reduce_points(df, GRID, [Reduction("v", kind, glyph=gaussian_glyph(1.0))])
    with pytest.raises(ValueError):
        splat(df, GRID, GlyphSpec("disc"))
    assert footprint_rows(gaussian_glyph(1.0), GRID) == 49


def test_no_python_in_the_plan(spark, points):
    _, df = points
    for spec in SPECS:
        plan = finalize_states(partial_states(df, GRID, [Reduction("v", "sum", glyph=spec)], dense=False), [Reduction("v", "sum", glyph=spec)])._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


@pytest.mark.parametrize("spec", SPECS)
@pytest.mark.parametrize("change", [{}, {"clip_to_tile": False}, {"anchor": "center"}, {"strict_radius": True, "max_radius": 2.0}, {"normalize": True}])
def test_windows_equal_rows(spark, points, spec, change, monkeypatch):
    from dataclasses import replace

    from pyspark.sql import functions as F

    _, df = points
    df = df.withColumn("v", F.when(F.col("id") % 7 != 0, F.col("v"))).repartition(2)
    rs = [Reduction("v", k, band=k, glyph=replace(spec, **change)) for k in ("sum", "count", "average")]
    rows = lambda dense: {(r.row, r.col): (r["sum"], r["count"], r["average"]) for r in finalize_states(partial_states(df, GRID, rs, dense=dense), rs).collect()}
    want, got = rows(False), rows(True)
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert [x is None for x in got[k]] == [x is None for x in w] and [x for x in got[k] if x is not None] == pytest.approx([x for x in w if x is not None])


def test_windows_of_bounded_size(points, monkeypatch):
    """Windows that are too small for the grid are sent and begun anew; the sums stay."""
    import pyarrow as pa

    from cellmill.operators.kernels import splat_sums

    class Frame:
        columns = ["x", "y", "v"]

        def mapInArrow(self, f, schema):
            return f

    rows, _ = points
    batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.float64()) for k in (1, 2, 3)], ["x", "y", "v"])
    totals = []
    for size in (4_000_000, 60):
        monkeypatch.setattr(kernels, "WINDOW", size)
        out = list(splat_sums(Frame(), GRID, gaussian_glyph(0.8, clip_to_tile=False), ["v"], "x", "y")(iter([batch, batch.slice(0, 20)])))
        sums: dict = {}
        for r in pa.Table.from_batches(out).to_pylist():
            sums[r["row"], r["col"]] = sums.get((r["row"], r["col"]), 0) + r["v__w"]
        totals.append((len(out), sums))
    assert totals[0][0] == 1 < totals[1][0] and totals[0][1].keys() == totals[1][1].keys()
    assert all(totals[1][1][k] == pytest.approx(v) for k, v in totals[0][1].items())


def test_custom_kernel(spark, points):
    """A cone of radius 2.5 cells, by loops; and the Gaussian written as a kernel."""
    from pyspark.sql import functions as F

    rows, df = points
    cone = custom_glyph(lambda dx, dy: F.greatest(1 - F.sqrt(dx * dx + dy * dy) / 2.5, F.lit(0.0)), 3, normalize=True)
    got = {(r.id, r.row, r.col): r.w for r in splat(df, GRID, cone).collect()}
    want = {}
    for i, x, y, *_ in rows:
        if GRID.cell_of(x, y) is None:
            continue
        fc, fr, own = x, 15 - y, {}
        r0, c0 = GRID.cell_of(x, y)
        for r in range(math.floor(fr) - 3, math.floor(fr) + 4):
            for c in range(math.floor(fc) - 3, math.floor(fc) + 4):
                w = 1 - math.hypot(c - fc, r - fr) / 2.5
                if w >= 1e-6 and 0 <= r < 15 and 0 <= c < 20 and (r // 6, c // 8) == (r0 // 6, c0 // 8):
                    own[i, r, c] = w
        want |= {k: w / sum(own.values()) for k, w in own.items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    bell = custom_glyph(lambda dx, dy: F.exp(-0.5 * (dx * dx + dy * dy)), 3)
    rs = lambda g: [Reduction("v", k, band=k, glyph=g) for k in ("sum", "weighted_average", "count")]
    a, b = ({(r.row, r.col): tuple(r)[2:] for r in reduce_points(df, GRID, rs(g)).collect()} for g in (bell, gaussian_glyph(1.0)))
    assert a.keys() == b.keys() and all(abs(x - y) < 1e-9 for k in a for x, y in zip(a[k], b[k], strict=True))
    with pytest.raises(ValueError):
        splat(df, GRID, GlyphSpec("custom"))
    assert footprint_rows(cone, GRID) == 49


def test_normalized_lines_need_no_shuffle(points):
    plan = splat(points[1], GRID, line_glyph(0.3, 2.0, normalize=True))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


@pytest.mark.parametrize("dealt", [True, False])
@pytest.mark.parametrize("glyph", [gaussian_glyph(0.7), gaussian_glyph(1.3, clip_to_tile=False), gaussian_glyph(1.0, sigma_x_channel="sx", rotation_channel="rot"), line_glyph(0.8, 3.0)])
def test_dealt_and_whole_windows(points, glyph, dealt, monkeypatch):
    """Windows of dealt points and of unordered ones give what exploded rows give."""
    monkeypatch.setattr(kernels, "deal", (lambda df, *_: (df, False)) if not dealt else kernels.deal)
    df = points[1].repartition(3)
    rs = [Reduction("v", k, band=k, glyph=glyph) for k in ("sum", "weighted_average", "count")]
    a, b = ({(r.row, r.col): tuple(r)[2:] for r in finalize_states(partial_states(df, GRID, rs, dense=d), rs).collect()} for d in (True, False))
    assert a.keys() == b.keys()
    assert all((x is None) == (y is None) and (x is None or abs(x - y) < 1e-9) for k in a for x, y in zip(a[k], b[k], strict=True))
