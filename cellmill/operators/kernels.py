"""Footprints summed up in numpy, for footprints of many cells.

An exploded footprint makes a row for each of its cells before the partial
aggregation takes them up.  Here a task adds the weights of its points to a
dense window around them and sends the window's cells as partial states, so no
point is shuffled and rows only leave for cells, not for points times cells.
Windows have bounded size: points that lie further apart are split, and a window
is sent when the next points would stretch it too far.  The final aggregation
merges states, whatever task or window they come from.

Points without any order in space make every task's window as large as the grid.
Where that is more than the points themselves, they are dealt out by ranges of
cells first (``deal``), so that each task has a window of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmill.functions.grid import GridSpec
from cellmill.operators.glyphs import LEAST_WEIGHT, GlyphSpec

#: Cells of a window, and points times footprint width that are worked on together.
WINDOW, AT_ONCE = 4_000_000, 4_000_000


class _Points:
    """Columns of points, with what their footprints need."""

    def __init__(self, grid: GridSpec, glyph: GlyphSpec, columns: dict[str, np.ndarray], values: list[str], x: str, y: str):
        b, px, py = grid.bounds, columns[x], columns[y]
        keep = (px >= b.min_x) & (px <= b.max_x) & (py >= b.min_y) & (py <= b.max_y)
        columns = {k: v[keep] for k, v in columns.items()}
        px, py = columns[x], columns[y]
        self.grid, self.glyph, self.n = grid, glyph, len(px)
        self.col = np.clip(np.floor((px - b.min_x) / grid.cell_x), 0, grid.width - 1).astype(np.int64)
        self.row = np.clip(np.floor((py - b.max_y) / grid.cell_y), 0, grid.height - 1).astype(np.int64)
        self.fc, self.fr = (px - b.min_x) * (1.0 / grid.cell_x), (py - b.max_y) * (1.0 / grid.cell_y)
        self.values = {v: columns[v] for v in values}

        def parameter(channel: str | None, default: float, positive: bool = False) -> np.ndarray:
            if not channel or channel not in columns:
                return np.full(self.n, float(default))
            c = columns[channel]
            known = ~np.isnan(c) & (c > 0) if positive else ~np.isnan(c)
            return np.where(known, c, default)

        cap, half = glyph.max_radius, 0.5 if glyph.anchor == "center" else 0.0
        if glyph.kind == "gaussian":
            self.sx = parameter(glyph.sigma_x_channel, glyph.default_sigma_x, True) / grid.cell_x
            self.sy = parameter(glyph.sigma_y_channel, glyph.default_sigma_y, True) / grid.cell_y
            turn = -parameter(glyph.rotation_channel, glyph.default_rotation)
            self.cos, self.sin = np.cos(turn), np.sin(turn)
            widest = np.maximum(np.abs(self.sx), np.abs(self.sy)) if glyph.strict_radius else np.maximum(self.sx, self.sy)
            self.r = np.ceil(np.minimum(3.0 * widest, cap)).astype(np.int64)
            self.ic, self.ir = np.floor(self.fc).astype(np.int64), np.floor(self.fr).astype(np.int64)
            self.ox, self.oy = half - (self.fc - self.ic), half - (self.fr - self.ir)
            self.reach = int(self.r.max(initial=0))
        else:
            direction = parameter(glyph.direction_channel, glyph.default_direction)
            length = parameter(glyph.half_length_channel, glyph.default_half_length)
            hx, hy = np.minimum(length / grid.cell_x, cap), length / grid.cell_y
            hy = np.maximum(hy, -cap) if glyph.strict_radius else np.minimum(hy, cap)
            end = np.floor if half else lambda v: np.trunc(v + np.copysign(0.5, v))
            dx, dy = hx * np.cos(direction), hy * np.sin(direction)
            self.x0, self.y0, self.x1, self.y1 = (end(v).astype(np.int64) for v in (self.fc - dx, self.fr - dy, self.fc + dx, self.fr + dy))
            self.ax, self.ay = np.abs(self.x1 - self.x0), np.abs(self.y1 - self.y0)
            self.steps = np.maximum(self.ax, self.ay)
            self.reach = int(max((np.abs(v).max(initial=0) for v in (self.x0 - self.col, self.x1 - self.col, self.y0 - self.row, self.y1 - self.row)), default=0))

    def box(self) -> tuple[int, int, int, int]:
        """First row, end row, first column, end column that footprints may reach."""
        r, g = self.reach, self.grid
        return max(0, int(self.row.min()) - r), min(g.height, int(self.row.max()) + r + 1), max(0, int(self.col.min()) - r), min(g.width, int(self.col.max()) + r + 1)

    def clear(self) -> np.ndarray:
        """Points whose footprint lies wholly in the grid and, where it is clipped, in the point's tile."""
        g = self.grid
        if self.glyph.kind != "gaussian":
            return np.zeros(self.n, bool)
        up, left = (self.row // g.tile_height * g.tile_height, self.col // g.tile_width * g.tile_width) if self.glyph.clip_to_tile else (0, 0)
        down, right = (np.minimum(up + g.tile_height, g.height), np.minimum(left + g.tile_width, g.width)) if self.glyph.clip_to_tile else (g.height, g.width)
        return (self.ir - self.r >= up) & (self.ir + self.r < down) & (self.ic - self.r >= left) & (self.ic + self.r < right)

    def split(self) -> Iterator[np.ndarray]:
        """Masks of two halves along the longer side."""
        a, b, c, d = self.box()
        at = self.row if b - a >= d - c else self.col
        low = at <= (int(at.min()) + int(at.max())) // 2
        yield low
        yield ~low

    def take(self, mask: np.ndarray) -> _Points:
        out = object.__new__(_Points)
        out.__dict__ = {k: v[mask] if isinstance(v, np.ndarray) else v for k, v in self.__dict__.items()}
        out.values = {k: v[mask] for k, v in self.values.items()}
        out.n = int(mask.sum())
        return out

    def cells(self) -> Iterator[tuple[np.ndarray | None, np.ndarray, np.ndarray, np.ndarray | float]]:
        """(points or None for all, row, column, weight) of one place of every footprint after another."""
        if self.glyph.kind == "line":
            for k in range(int(self.steps.max(initial=0)) + 1):
                on = np.flatnonzero(self.steps >= k)
                n = np.maximum(2 * self.steps[on], 1)
                x = self.x0[on] + np.sign(self.x1[on] - self.x0[on]) * ((2 * k * self.ax[on] + self.steps[on]) // n)
                y = self.y0[on] + np.sign(self.y1[on] - self.y0[on]) * ((2 * k * self.ay[on] + self.steps[on]) // n)
                yield on, y, x, 1.0
            return
        for dy, dx, w in self.weights():
            ok = w > 0
            if ok.all():
                yield None, self.ir + dy, self.ic + dx, w
            elif ok.any():
                on = np.flatnonzero(ok)
                yield on, self.ir[on] + dy, self.ic[on] + dx, w[on]

    def weights(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(row step, column step, weight of every point) of Gaussian footprints; 0 where a point has no such cell."""
        r = self.reach
        straight = bool((self.sin == 0).all())
        same = bool((self.r == r).all())
        if straight:
            side = [np.exp(-0.5 * ((d + self.ox) / self.sx) ** 2) for d in range(-r, r + 1)]
        for dy in range(-r, r + 1):
            ry = dy + self.oy
            up = np.exp(-0.5 * (ry / self.sy) ** 2) if straight else None
            for dx in range(-r, r + 1):
                if straight:
                    w = side[dx + r] * up
                else:
                    rx = dx + self.ox
                    w = np.exp(-0.5 * (((rx * self.cos - ry * self.sin) / self.sx) ** 2 + ((rx * self.sin + ry * self.cos) / self.sy) ** 2))
                few = w < LEAST_WEIGHT
                if not same:
                    few |= self.r < max(abs(dx), abs(dy))
                if few.any():
                    w = np.where(few, 0.0, w)
                yield dy, dx, w

    def inside(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """cells() within the grid and, where footprints are clipped, within the point's tile."""
        g = self.grid
        if self.glyph.clip_to_tile:
            top, left = self.row // g.tile_height * g.tile_height, self.col // g.tile_width * g.tile_width
            bottom, right = np.minimum(top + g.tile_height, g.height), np.minimum(left + g.tile_width, g.width)
        else:
            top, left, bottom, right = (np.full(self.n, v) for v in (0, 0, g.height, g.width))
        every = np.arange(self.n)
        for on, y, x, w in self.cells():
            a, b, c, d = (top, bottom, left, right) if on is None else (top[on], bottom[on], left[on], right[on])
            ok = (y >= a) & (y < b) & (x >= c) & (x < d)
            on = every if on is None else on
            w = np.broadcast_to(w, y.shape)
            if ok.all():
                yield on, y, x, w
            elif ok.any():
                yield on[ok], y[ok], x[ok], w[ok]


class _Window:
    def __init__(self, box: tuple[int, int, int, int], values: list[str]):
        self.box = box
        size = (box[1] - box[0]) * (box[3] - box[2])
        self.touched = np.zeros(size, bool)
        self.sums = {v: (np.zeros(size), np.zeros(size)) for v in values}

    def add(self, p: _Points) -> None:
        clear = p.clear() if not p.glyph.normalize else np.zeros(p.n, bool)
        if clear.any():
            part = p.take(clear)
            part.known = {v: part.values.get(f"{v}?") for v in self.sums}
            self._add_whole(part)
            if clear.all():
                return
            known, p = p.known, p.take(~clear)
            p.known = {v: None if k is None else p.values[f"{v}?"] for v, k in known.items()}
        self._add(p)

    def _add_whole(self, p: _Points) -> None:
        """Gaussian footprints that nothing cuts: points of a cell are added up before they meet the window."""
        a, _, c, d = self.box
        order = np.argsort((p.ir - a) * (d - c) + (p.ic - c), kind="stable")
        known = p.known
        p = p.take(order)
        base = (p.ir - a) * (d - c) + (p.ic - c)
        first = np.flatnonzero(np.concatenate([[True], base[1:] != base[:-1]]))
        base = base[first]
        values = {v: (p.values[v] if known[v] is None else np.where(p.values[f"{v}?"], p.values[v], 0.0)) for v in self.sums}
        for dy, dx, w in p.weights():
            at = base + (dy * (d - c) + dx)
            ok = w > 0
            every = bool(ok.all())
            some = slice(None) if every else np.logical_or.reduceat(ok, first)  # cells that are too far for all points of theirs
            at = at[some]
            self.touched[at] = True
            for v, (weighted, weights) in self.sums.items():
                weighted[at] += np.add.reduceat((values[v] if every else np.where(ok, values[v], 0.0)) * w, first)[some]
                weights[at] += np.add.reduceat(w if known[v] is None else w * p.values[f"{v}?"], first)[some]

    def _add(self, p: _Points) -> None:
        a, _, c, d = self.box
        scale = np.ones(p.n)
        if p.glyph.normalize:
            total = np.zeros(p.n)
            for on, _, _, w in p.inside():
                np.add.at(total, on, w)
            scale = np.divide(1.0, total, out=scale, where=total > 0)
        for on, y, x, w in p.inside():
            at = (y - a) * (d - c) + (x - c)
            self.touched[at] = True
            w = w * scale[on] if p.glyph.normalize else w
            for v, (weighted, weights) in self.sums.items():
                values = p.values[v]
                there = p.known[v]
                if there is None:
                    np.add.at(weighted, at, values[on] * w)
                    np.add.at(weights, at, w)
                else:
                    k = there[on]
                    np.add.at(weighted, at[k], values[on][k] * w[k])
                    np.add.at(weights, at[k], w[k])

    def rows(self) -> pa.RecordBatch:
        at = np.flatnonzero(self.touched)
        a, _, c, d = self.box
        out = [pa.array((at // (d - c) + a).astype(np.int32)), pa.array((at % (d - c) + c).astype(np.int32))]
        names = ["row", "col"]
        for v, (weighted, weights) in self.sums.items():
            none = weights[at] == 0
            out += [pa.array(weighted[at], mask=none), pa.array(weights[at], mask=none)]
            names += [f"{v}__vw", f"{v}__w"]
        return pa.RecordBatch.from_arrays(out, names)


def deal(points: DataFrame, grid: GridSpec, x: str, y: str) -> tuple[DataFrame, bool]:
    """points, and whether they are now dealt out by ranges of cells: if the estimated bytes of the points are fewer than
    those of a window of each task that reads them.  Points of one cell may go to several tasks, so no cell is too many.
    """
    spark = points.sparkSession
    size = int(str(points._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    tasks = max(spark.sparkContext.defaultParallelism, size >> 27)
    if size > tasks * 24 * grid.height * grid.width:
        return points, False
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    every = [F.col(f"`{c}`") for c in points.columns]
    return points.repartitionByRange(parts, grid.cell_id(grid.row(y), grid.col(x)), F.xxhash64(*every)), True


def splat_sums(points: DataFrame, grid: GridSpec, glyph: GlyphSpec, values: list[str], x: str, y: str, dealt: bool = False) -> DataFrame:
    """row, col and, of each value channel, the sums <value>__vw and <value>__w of weighted values and weights.

    A cell may come in several rows.  points needs double columns only.  dealt: the points of a task lie close together.
    """
    names = points.columns

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window: _Window | None = None
        held: list[pa.RecordBatch] = []

        def work() -> Iterator[pa.RecordBatch]:
            nonlocal window
            table = pa.Table.from_batches(held).combine_chunks()
            # null and NaN are told apart for values only: a null value contributes nothing, a NaN spreads
            there = {v: None if table.column(v).null_count == 0 else ~table.column(v).is_null().to_numpy() for v in values}
            columns = {c: table.column(c).to_numpy() for c in names}
            for v in values:
                if there[v] is not None:
                    columns[f"{v}?"] = there[v]
            whole = _Points(grid, glyph, columns, values + [f"{v}?" for v in values if there[v] is not None], x, y)
            stack = [whole] if whole.n else []
            while stack:
                p = stack.pop()
                a, b, c, d = p.box()
                if (b - a) * (d - c) > WINDOW and p.n > 1 and (p.row.min() < p.row.max() or p.col.min() < p.col.max()):
                    stack += [half for half in map(p.take, p.split()) if half.n]
                    continue
                p.known = {v: p.values.get(f"{v}?") for v in values}
                if window:
                    e, f, g, h = window.box
                    if not (e <= a and b <= f and g <= c and d <= h):
                        yield window.rows()
                        window = None
                if window is None:
                    if dealt:  # the next points of the task lie about here
                        more = (b - a) // 8
                        wide = max(0, a - more), min(grid.height, b + more), 0, grid.width
                    else:  # the whole grid where it is small, so that one window serves all points of the task
                        wide = 0, grid.height, 0, grid.width
                    window = _Window(wide if (wide[1] - wide[0]) * grid.width <= WINDOW else (a, b, c, d), values)
                step = max(1, AT_ONCE // (2 * p.reach + 1))
                if p.n <= step:
                    window.add(p)
                    continue
                for k in range(0, p.n, step):
                    mask = np.zeros(p.n, bool)
                    mask[k : k + step] = True
                    part = p.take(mask)
                    part.known = {v: part.values.get(f"{v}?") for v in values}
                    window.add(part)

        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= 200_000:
                yield from work()
                held, n = [], 0
        if n:
            yield from work()
        if window:
            yield window.rows()

    schema = "row int, col int" + "".join(f", `{v}__vw` double, `{v}__w` double" for v in values)
    return points.mapInArrow(add, schema)
