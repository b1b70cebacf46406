"""Footprints: one point becomes several weighted cells.

A footprint is enumerated by explode over a sequence whose length follows from
the point's own parameters, so there is no join and no Python; the weights stay
inside code generation and partial aggregation takes them up before any shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmill.functions.grid import GridSpec
from cellmill.functions.reductions import Reduction

#: Fixed value: lighter cells of a Gaussian footprint are left out.
LEAST_WEIGHT = 1e-6


@dataclass(frozen=True)
class GlyphSpec:
    """kind: point, gaussian, line or custom.

    Channels give a parameter per point; where one is absent or null the default counts, for sigmas also where it isn't
    positive.  Lengths are in world units, angles in radians; direction 0 is east and pi/2 north.

    normalize: the weights of a point add up to 1.
    clip_to_tile: a footprint stays in the tile of its point; False lets it cross tile borders.
    anchor: ``corner`` measures from a cell's upper left corner and rounds line ends, ``center`` from its centre.
    strict_radius: both sigmas and both halves of a line obey max_radius; otherwise only their x parts do.
    kernel, radius: a custom footprint is the square of 2 * radius + 1 cells around the point's; kernel makes a cell's weight, a
    column, of the columns of its distances from the point to the right and downward, in cells.
    """

    kind: str = "point"
    sigma_x_channel: str | None = None
    sigma_y_channel: str | None = None
    rotation_channel: str | None = None
    direction_channel: str | None = None
    half_length_channel: str | None = None
    default_sigma_x: float = 1.0
    default_sigma_y: float = 1.0
    default_rotation: float = 0.0
    default_direction: float = 0.0
    default_half_length: float = 1.0
    max_radius: float = 32.0
    normalize: bool = False
    clip_to_tile: bool = True
    anchor: str = "corner"
    strict_radius: bool = False
    kernel: Callable[[Column, Column], Column] | None = None
    radius: int = 0

    def check(self) -> None:
        if self.kind not in ("point", "gaussian", "line", "custom"):
            raise ValueError(f"unknown glyph {self.kind!r}")
        if self.kind == "custom" and (self.kernel is None or self.radius < 0):
            raise ValueError("a custom glyph needs a kernel and a radius of at least 0")
        if self.anchor not in ("corner", "center"):
            raise ValueError("anchor is 'corner' or 'center'")

    def channels(self) -> list[str]:
        own = (self.sigma_x_channel, self.sigma_y_channel, self.rotation_channel, self.direction_channel, self.half_length_channel)
        return [c for c in own if c]


def gaussian_glyph(sigma: float = 1.0, sigma_x: float | None = None, sigma_y: float | None = None, **kw) -> GlyphSpec:
    return GlyphSpec("gaussian", default_sigma_x=sigma_x or sigma, default_sigma_y=sigma_y or sigma, **kw)


def line_glyph(direction: float = 0.0, half_length: float = 1.0, **kw) -> GlyphSpec:
    return GlyphSpec("line", default_direction=direction, default_half_length=half_length, **kw)


def custom_glyph(kernel: Callable[[Column, Column], Column], radius: int, **kw) -> GlyphSpec:
    return GlyphSpec("custom", kernel=kernel, radius=radius, **kw)


def gaussian_splat(value: str, sigma: float = 1.0, sigma_x: float | None = None, sigma_y: float | None = None, band: str | None = None, **kw) -> Reduction:
    """The weighted average of a channel under Gaussian footprints; channels and other options as in GlyphSpec."""
    return Reduction(value, "weighted_average", band=band, glyph=gaussian_glyph(sigma, sigma_x, sigma_y, **kw))


def line_splat(value: str, direction: float = 0.0, half_length: float = 1.0, band: str | None = None, **kw) -> Reduction:
    """The weighted average of a channel under line footprints."""
    return Reduction(value, "weighted_average", band=band, glyph=line_glyph(direction, half_length, **kw))


def _parameter(df: DataFrame, channel: str | None, default: float, positive: bool = False) -> Column:
    if not channel or channel not in df.columns:
        return F.lit(float(default))
    c = F.col(f"`{channel}`").cast("double")
    return F.when(c > 0, c).otherwise(F.lit(float(default))) if positive else F.coalesce(c, F.lit(float(default)))


def _inside(grid: GridSpec, glyph: GlyphSpec, row: Column, col: Column) -> Column:
    ok = row.between(0, grid.height - 1) & col.between(0, grid.width - 1)
    if glyph.clip_to_tile:
        ok &= (F.floor(row / grid.tile_height) == F.col("_tile_row")) & (F.floor(col / grid.tile_width) == F.col("_tile_col"))
    return ok


#: Columns with what a footprint needs, how many places it has, and row, column and weight of the k-th.
Footprint = tuple[DataFrame, Column, Callable[[Column], tuple[Column, Column, Column]]]


def _offsets(glyph: GlyphSpec, k: Column, radius: Column) -> tuple[Column, Column, Column, Column]:
    """Of the k-th cell of a square: row and column, and the distances of the point to its corner or centre, in cells."""
    n = 2 * radius + 1
    dx, dy = k % n - radius, F.floor(k / n) - radius
    half = 0.5 if glyph.anchor == "center" else 0.0
    rx, ry = dx + half - (F.col("_fc") - F.col("_ic")), dy + half - (F.col("_fr") - F.col("_ir"))
    return (F.col("_ir") + dy).cast("int"), (F.col("_ic") + dx).cast("int"), rx, ry


def _gaussian(df: DataFrame, grid: GridSpec, glyph: GlyphSpec) -> Footprint:
    sx = _parameter(df, glyph.sigma_x_channel, glyph.default_sigma_x, True) / grid.cell_x
    sy = _parameter(df, glyph.sigma_y_channel, glyph.default_sigma_y, True) / grid.cell_y
    rotation = _parameter(df, glyph.rotation_channel, glyph.default_rotation)
    widest = F.greatest(F.abs(sx), F.abs(sy)) if glyph.strict_radius else F.greatest(sx, sy)
    df = df.withColumns({
        "_ic": F.floor("_fc"), "_ir": F.floor("_fr"), "_sx": sx, "_sy": sy, "_cos": F.cos(-rotation), "_sin": F.sin(-rotation),
        "_r": F.ceil(F.least(3.0 * widest, F.lit(float(glyph.max_radius)))).cast("int"),
    })

    def cell(k: Column) -> tuple[Column, Column, Column]:
        row, col, rx, ry = _offsets(glyph, k, F.col("_r"))
        u, v = rx * F.col("_cos") - ry * F.col("_sin"), rx * F.col("_sin") + ry * F.col("_cos")
        a, b = u / F.col("_sx"), v / F.col("_sy")
        return row, col, F.exp(-0.5 * (a * a + b * b))

    return df, (2 * F.col("_r") + 1) * (2 * F.col("_r") + 1), cell


def _custom(df: DataFrame, grid: GridSpec, glyph: GlyphSpec) -> Footprint:
    df = df.withColumns({"_ic": F.floor("_fc"), "_ir": F.floor("_fr")})

    def cell(k: Column) -> tuple[Column, Column, Column]:
        row, col, rx, ry = _offsets(glyph, k, F.lit(glyph.radius))
        return row, col, glyph.kernel(rx, ry).cast("double")

    return df, F.lit((2 * glyph.radius + 1) ** 2), cell


def _line(df: DataFrame, grid: GridSpec, glyph: GlyphSpec) -> Footprint:
    direction = _parameter(df, glyph.direction_channel, glyph.default_direction)
    half = _parameter(df, glyph.half_length_channel, glyph.default_half_length)
    cap = F.lit(float(glyph.max_radius))
    hx, hy = F.least(half / grid.cell_x, cap), half / grid.cell_y
    hy = F.greatest(hy, -cap) if glyph.strict_radius else F.least(hy, cap)
    end = F.floor if glyph.anchor == "center" else lambda c: F.round(c).cast("long")
    ox, oy = hx * F.cos(direction), hy * F.sin(direction)
    df = df.withColumns({"_x0": end(F.col("_fc") - ox), "_y0": end(F.col("_fr") - oy), "_x1": end(F.col("_fc") + ox), "_y1": end(F.col("_fr") + oy)})
    ax, ay = F.abs(F.col("_x1") - F.col("_x0")), F.abs(F.col("_y1") - F.col("_y0"))
    df = df.withColumns({"_ax": ax, "_ay": ay, "_n": F.greatest(ax, ay)})

    def cell(k: Column) -> tuple[Column, Column, Column]:
        # the step of an integer line along either axis, halves upward
        along = lambda a: F.when(F.col("_n") == 0, 0).otherwise(F.floor((2 * k * F.col(a) + F.col("_n")) / F.greatest(2 * F.col("_n"), F.lit(1))))
        x = F.col("_x0") + F.signum(F.col("_x1") - F.col("_x0")) * along("_ax")
        y = F.col("_y0") + F.signum(F.col("_y1") - F.col("_y0")) * along("_ay")
        return y.cast("int"), x.cast("int"), F.lit(1.0)

    return df, F.col("_n") + 1, cell


def splat(points: DataFrame, grid: GridSpec, glyph: GlyphSpec, x: str = "x", y: str = "y") -> DataFrame:
    """points inside the bounds, once for each cell of their footprint, with row, col and w.

    A point outside the bounds contributes nothing, even where its footprint would reach in.  A normalized footprint is an
    array of the point's row first, so that its sum needs no shuffle.
    """
    glyph.check()
    inside = grid.assign(points, x, y)
    if glyph.kind == "point":
        return inside.withColumn("w", F.lit(1.0))
    own = [F.col(f"`{c}`") for c in inside.columns[:-2]]
    placed = inside.withColumns({"_tile_row": grid.tile_row(), "_tile_col": grid.tile_col()}).drop("row", "col")
    placed = placed.withColumns({"_fc": grid.fractional_col(x), "_fr": grid.fractional_row(y)})
    df, n, cell = {"gaussian": _gaussian, "line": _line, "custom": _custom}[glyph.kind](placed, grid, glyph)
    every = F.sequence(F.lit(0).cast("long"), (n - 1).cast("long"))
    kept = lambda row, col, w: (w >= LEAST_WEIGHT) & _inside(grid, glyph, row, col)
    if not glyph.normalize:
        df = df.withColumn("_k", F.explode(every))
        row, col, w = cell(F.col("_k"))
        out = df.select(*own, "_tile_row", "_tile_col", row.alias("row"), col.alias("col"), w.alias("w"))
        return out.where(kept(F.col("row"), F.col("col"), F.col("w"))).drop("_tile_row", "_tile_col")
    cells = F.transform(every, lambda k: F.struct(*[c.alias(name) for c, name in zip(cell(k), ("row", "col", "w"), strict=True)]))
    df = df.select(*own, F.filter(cells, lambda c: kept(c["row"], c["col"], c["w"])).alias("_cells"))
    df = df.withColumn("_sum", F.aggregate("_cells", F.lit(0.0), lambda s, c: s + c["w"]))
    return df.select(*own, "_sum", F.inline("_cells")).withColumn("w", F.col("w") / F.col("_sum")).drop("_sum")


def footprint_rows(glyph: GlyphSpec, grid: GridSpec) -> int:
    """Rows per point with default parameters: what the explode multiplies the input by."""
    if glyph.kind == "custom":
        return (2 * glyph.radius + 1) ** 2
    if glyph.kind == "gaussian":
        widest = max(glyph.default_sigma_x / grid.cell_x, abs(glyph.default_sigma_y / grid.cell_y) if glyph.strict_radius else 0)
        return (2 * math.ceil(min(3 * widest, glyph.max_radius)) + 1) ** 2
    return 2 * math.ceil(glyph.default_half_length / min(grid.cell_x, -grid.cell_y)) + 2 if glyph.kind == "line" else 1
