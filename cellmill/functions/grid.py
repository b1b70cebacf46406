"""Regular grids over world coordinates, as column expressions.

A grid's numbers become literals of a plan, so that assigning a point to its
cell needs no join and no Python.  Rows count downward from max_y.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmill.functions.crs import CRS


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@dataclass(frozen=True)
class BBox:
    """An axis-aligned box; the default is empty and grows by expand."""

    min_x: float = math.inf
    min_y: float = math.inf
    max_x: float = -math.inf
    max_y: float = -math.inf

    @property
    def valid(self) -> bool:
        return self.min_x <= self.max_x and self.min_y <= self.max_y

    @property
    def width(self) -> float:
        return self.max_x - self.min_x

    @property
    def height(self) -> float:
        return self.max_y - self.min_y

    def contains(self, x: float, y: float) -> bool:
        """All four edges belong to the box; NaN lies nowhere."""
        return self.min_x <= x <= self.max_x and self.min_y <= y <= self.max_y

    def expand(self, x: float | BBox, y: float | None = None) -> BBox:
        o = x if isinstance(x, BBox) else BBox(x, y, x, y)
        return BBox(min(self.min_x, o.min_x), min(self.min_y, o.min_y), max(self.max_x, o.max_x), max(self.max_y, o.max_y))

    def padded(self, by_x: float, by_y: float) -> BBox:
        return BBox(self.min_x - by_x, self.min_y - by_y, self.max_x + by_x, self.max_y + by_y)

    def predicate(self, x: Column | str = "x", y: Column | str = "y") -> Column:
        """Four comparisons with literals; over stored double columns they reach the Parquet reader."""
        return _col(x).between(float(self.min_x), float(self.max_x)) & _col(y).between(float(self.min_y), float(self.max_y))


@dataclass(frozen=True)
class GridSpec:
    bounds: BBox
    cell_x: float
    cell_y: float
    tile_width: int = 4096
    tile_height: int = 4096
    crs: CRS = field(default_factory=CRS)

    @classmethod
    def of(cls, min_x, min_y, max_x, max_y, cell_x, cell_y, tile_width=4096, tile_height=4096, crs=None) -> GridSpec:
        return cls(BBox(min_x, min_y, max_x, max_y), cell_x, cell_y, tile_width, tile_height, crs or CRS())

    @classmethod
    def around(cls, box: BBox, cell: float, pad_cells: int = 1, **kw) -> GridSpec:
        """A north-up grid over a box that is padded by some cells."""
        return cls(box.padded(cell * pad_cells, cell * pad_cells), cell, -cell, **kw)

    def covering(self, box: BBox) -> GridSpec:
        """The grid grown by whole tiles until its bounds hold the box; itself if they do, or if the box is empty.

        Edges of cells and tiles stay where they are, but rows and columns are counted from the new corner.
        """
        b, x, y = self.bounds, self.tile_width * abs(self.cell_x), self.tile_height * abs(self.cell_y)
        if not box.valid:
            return self
        if not all(map(math.isfinite, (box.min_x, box.min_y, box.max_x, box.max_y))):
            raise ValueError("the box is not finite")
        more = lambda missing, tile: max(0, math.ceil(missing / tile)) * tile
        grown = BBox(b.min_x - more(b.min_x - box.min_x, x), b.min_y - more(b.min_y - box.min_y, y), b.max_x + more(box.max_x - b.max_x, x), b.max_y + more(box.max_y - b.max_y, y))
        return self if grown == b else replace(self, bounds=grown)

    def validate(self) -> GridSpec:
        b = self.bounds
        if not b.valid or not all(map(math.isfinite, (b.min_x, b.min_y, b.max_x, b.max_y))):
            raise ValueError("grid bounds are empty or not finite")
        if not self.cell_x > 0 or not self.cell_y < 0:
            raise ValueError("cell_x must be positive and cell_y negative: rows count down from max_y")
        if self.tile_width < 1 or self.tile_height < 1:
            raise ValueError("tiles need at least one cell each way")
        if self.width < 1 or self.height < 1:
            raise ValueError("the grid has no cells")
        return self

    @property
    def width(self) -> int:
        return math.ceil(self.bounds.width / abs(self.cell_x)) if self.bounds.valid and self.cell_x else 0

    @property
    def height(self) -> int:
        return math.ceil(self.bounds.height / abs(self.cell_y)) if self.bounds.valid and self.cell_y else 0

    @property
    def tiles_x(self) -> int:
        return -(-self.width // self.tile_width)

    @property
    def tiles_y(self) -> int:
        return -(-self.height // self.tile_height)

    @property
    def geotransform(self) -> tuple[float, float, float, float, float, float]:
        return (self.bounds.min_x, self.cell_x, 0.0, self.bounds.max_y, 0.0, self.cell_y)

    # scalar forms

    def cell_of(self, x: float, y: float) -> tuple[int, int] | None:
        """(row, col), or None outside the bounds."""
        if not self.bounds.contains(x, y):
            return None
        col = min(max(math.floor((x - self.bounds.min_x) / self.cell_x), 0), self.width - 1)
        row = min(max(math.floor((y - self.bounds.max_y) / self.cell_y), 0), self.height - 1)
        return row, col

    def center_of(self, row: int, col: int) -> tuple[float, float]:
        return self.bounds.min_x + (col + 0.5) * self.cell_x, self.bounds.max_y + (row + 0.5) * self.cell_y

    def tile_cells(self, tile_row: int, tile_col: int) -> tuple[int, int, int, int]:
        """(first row, first col, rows, cols) of a tile; edge tiles are clipped."""
        r, c = tile_row * self.tile_height, tile_col * self.tile_width
        if not (0 <= r < self.height and 0 <= c < self.width) or tile_row < 0 or tile_col < 0:
            raise IndexError((tile_row, tile_col))
        return r, c, min(self.tile_height, self.height - r), min(self.tile_width, self.width - c)

    def tile_bounds(self, tile_row: int, tile_col: int) -> BBox:
        r, c, h, w = self.tile_cells(tile_row, tile_col)
        x, y = self.bounds.min_x + c * self.cell_x, self.bounds.max_y + r * self.cell_y
        return BBox(x, y + h * self.cell_y, x + w * self.cell_x, y)

    # column forms

    def in_bounds(self, x: Column | str = "x", y: Column | str = "y") -> Column:
        return self.bounds.predicate(x, y)

    def col(self, x: Column | str = "x") -> Column:
        at = F.floor((_col(x) - self.bounds.min_x) / self.cell_x)
        return F.least(F.greatest(at, F.lit(0)), F.lit(self.width - 1)).cast("int")

    def row(self, y: Column | str = "y") -> Column:
        at = F.floor((_col(y) - self.bounds.max_y) / self.cell_y)
        return F.least(F.greatest(at, F.lit(0)), F.lit(self.height - 1)).cast("int")

    def fractional_col(self, x: Column | str = "x") -> Column:
        return (_col(x) - self.bounds.min_x) * (1.0 / self.cell_x)

    def fractional_row(self, y: Column | str = "y") -> Column:
        return (_col(y) - self.bounds.max_y) * (1.0 / self.cell_y)

    def tile_row(self, row: Column | str = "row") -> Column:
        return F.floor(_col(row) / self.tile_height).cast("int")

    def tile_col(self, col: Column | str = "col") -> Column:
        return F.floor(_col(col) / self.tile_width).cast("int")

    def cell_id(self, row: Column | str = "row", col: Column | str = "col") -> Column:
        """row * width + col as a long, for any grid size."""
        return _col(row).cast("long") * self.width + _col(col)

    def tile_id(self, row: Column | str = "row", col: Column | str = "col") -> Column:
        return self.tile_row(row).cast("long") * self.tiles_x + self.tile_col(col)

    def local_cell(self, row: Column | str = "row", col: Column | str = "col") -> Column:
        """Cell number inside its tile, by the tile's clipped width."""
        tc = self.tile_col(col)
        width = F.least(F.lit(self.tile_width), F.lit(self.width) - tc * self.tile_width)
        return ((_col(row) - self.tile_row(row) * self.tile_height) * width + (_col(col) - tc * self.tile_width)).cast("int")

    def center_x(self, col: Column | str = "col") -> Column:
        return F.lit(float(self.bounds.min_x)) + (_col(col) + 0.5) * self.cell_x

    def center_y(self, row: Column | str = "row") -> Column:
        return F.lit(float(self.bounds.max_y)) + (_col(row) + 0.5) * self.cell_y

    def assign(self, points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
        """points inside the bounds, with row and col."""
        return points.where(self.in_bounds(x, y)).withColumns({"row": self.row(y), "col": self.col(x)})

    def cells(self, spark: SparkSession) -> DataFrame:
        """Every cell of the grid as (row, col), made in parallel."""
        return spark.range(self.width * self.height).select(
            F.floor(F.col("id") / self.width).cast("int").alias("row"), (F.col("id") % self.width).cast("int").alias("col")
        )
