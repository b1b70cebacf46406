"""Operations on rasters held as rows of cells."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmill.functions.grid import GridSpec

KEYS = ["row", "col"]
NAN = float("nan")


def bands_of(raster: DataFrame) -> list[str]:
    return [c for c in raster.columns if c not in KEYS]


def to_dense(raster: DataFrame, grid: GridSpec, empty_sum: str = "nan", sums: tuple[str, ...] = ()) -> DataFrame:
    """Every cell of the grid; bands without a value are NaN.

    empty_sum: with ``touched_zero`` the bands named in sums are 0 in empty cells of tiles in which any cell has a value.
    Cells are generated in parallel and joined; no side is broadcast unless Spark finds it small.
    """
    if empty_sum not in ("nan", "touched_zero"):
        raise ValueError("empty_sum is 'nan' or 'touched_zero'")
    out = grid.cells(raster.sparkSession).join(raster, KEYS, "left")
    fill = {b: F.lit(NAN) for b in bands_of(raster)}
    if empty_sum == "touched_zero" and sums:
        tiles = raster.select(grid.tile_row().alias("_tr"), grid.tile_col().alias("_tc")).distinct().withColumn("_touched", F.lit(True))
        out = out.withColumns({"_tr": grid.tile_row(), "_tc": grid.tile_col()}).join(tiles, ["_tr", "_tc"], "left")
        for b in sums:
            fill[b] = F.when(F.col("_touched"), F.lit(0.0)).otherwise(F.lit(NAN))
    return out.select(*KEYS, *[F.coalesce(F.col(f"`{b}`").cast("double"), f).alias(b) for b, f in fill.items()])


def is_valid(c: Column) -> Column:
    """Finite: neither null, NaN nor infinite."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def valid_mask(raster: DataFrame) -> DataFrame:
    """1 where a band is finite, else 0."""
    return raster.select(*KEYS, *[is_valid(F.col(f"`{b}`").cast("double")).cast("int").alias(b) for b in bands_of(raster)])


def fill(raster: DataFrame, value: float, band: str | None = None) -> DataFrame:
    """A constant in one band, or in all."""
    return raster.withColumns({b: F.lit(float(value)) for b in bands_of(raster) if band in (None, b)})


def raster_stats(raster: DataFrame, band: str, cells: int | None = None, accuracy: int | None = None) -> DataFrame:
    """cells, covered, coverage (percent), minimum, maximum, mean, p5 and p95 of a band, over values that are not NaN.

    cells: of the grid, where the raster is sparse.  accuracy: with it, p5 and p95 are values of cells whose ranks are wrong
    by 1 / accuracy of all at most, from sketches that merge before they meet; without it they are exact and interpolated,
    for which one task holds the distinct values of the band, so large rasters should name an accuracy, 10000 say.
    """
    v = F.col(f"`{band}`").cast("double")
    v = F.when(~F.isnan(v), v)
    at = lambda q: F.percentile(v, q) if accuracy is None else F.percentile_approx(v, q, accuracy)
    n = F.lit(cells).cast("long") if cells is not None else F.count(F.lit(1))
    return raster.agg(
        n.alias("cells"), F.count(v).alias("covered"), F.try_divide(100.0 * F.count(v), n.cast("double")).alias("coverage"),
        F.min(v).alias("minimum"), F.max(v).alias("maximum"), F.avg(v).alias("mean"), at(0.05).alias("p5"), at(0.95).alias("p95"),
    )


def raster_diff(left: DataFrame, right: DataFrame, band: str, other: str | None = None, tolerance: float = 1e-4) -> DataFrame:
    """compared, max_diff, mean_diff, above_tolerance, only_left, only_right and passed.

    It passes if the same cells have values and none differs by more than the tolerance.  Rasters may be sparse.
    """
    known = lambda df, b, name: df.select(*KEYS, F.col(f"`{b}`").cast("double").alias(name)).where(~F.isnan(name))
    both = known(left, band, "a").join(known(right, other or band, "b"), KEYS, "full_outer")
    d = F.abs(F.col("a") - F.col("b"))
    out = both.agg(
        F.count(d).alias("compared"), F.coalesce(F.max(d), F.lit(0.0)).alias("max_diff"), F.coalesce(F.avg(d), F.lit(0.0)).alias("mean_diff"),
        F.count(F.when(d > tolerance, 1)).alias("above_tolerance"), F.count(F.when(F.col("b").isNull(), 1)).alias("only_left"), F.count(F.when(F.col("a").isNull(), 1)).alias("only_right"),
    )
    return out.withColumn("passed", (F.col("above_tolerance") == 0) & (F.col("only_left") == 0) & (F.col("only_right") == 0))


def overview(raster: DataFrame, factor: int, bands: list[str] | None = None) -> DataFrame:
    """factor x factor cells become one: the mean of their values that are not NaN.  row and col are of the coarse grid."""
    bands = bands or bands_of(raster)
    number = lambda b: F.when(~F.isnan(F.col(f"`{b}`").cast("double")), F.col(f"`{b}`").cast("double"))
    at = [F.floor(F.col(k) / factor).cast("int").alias(k) for k in KEYS]
    return raster.groupBy(*at).agg(*[F.avg(number(b)).alias(b) for b in bands])


def overview_levels(grid: GridSpec, least: int = 256) -> list[int]:
    """2, 4, 8 ... as long as the shorter side keeps that many cells."""
    out, level = [], 2
    while min(grid.width, grid.height) // level >= least:
        out.append(level)
        level *= 2
    return out


def pyramid(raster: DataFrame, grid: GridSpec, least: int = 256) -> dict[int, DataFrame]:
    """The overview of each level.  Sums and counts are carried from level to level, so that only the first reads all cells."""
    bands = bands_of(raster)
    value = lambda b: F.col(f"`{b}`").cast("double")
    at = [F.floor(F.col(k) / 2).cast("int").alias(k) for k in KEYS]
    state = raster.select(*KEYS, *[F.when(~F.isnan(value(b)), value(b)).alias(f"{b}__s") for b in bands], *[F.when(~F.isnan(value(b)), 1).alias(f"{b}__n") for b in bands])
    out = {}
    for level in overview_levels(grid, least):
        state = state.groupBy(*at).agg(*[F.sum(f"`{b}__{k}`").alias(f"{b}__{k}") for b in bands for k in "sn"])
        out[level] = state.select(*KEYS, *[F.try_divide(F.col(f"`{b}__s`"), F.col(f"`{b}__n`")).alias(b) for b in bands])
    return out


def strided(raster: DataFrame, factor: int) -> DataFrame:
    """Every factor-th row and column."""
    return raster.where((F.col("row") % factor == 0) & (F.col("col") % factor == 0))


def to_numpy(raster: DataFrame, grid: GridSpec, band: str, dtype=np.float32) -> np.ndarray:
    """A band as an array (height, width), NaN where the raster has no row.  The array must fit the driver."""
    out = np.full((grid.height, grid.width), np.nan, dtype)
    got = raster.select(*KEYS, F.col(f"`{band}`").cast("double").alias("v")).toPandas()
    out[got["row"].to_numpy(), got["col"].to_numpy()] = got["v"].to_numpy(dtype=np.float64, na_value=np.nan)
    return out


def from_numpy(spark, array: np.ndarray, band: str = "value") -> DataFrame:
    """The inverse of to_numpy; NaN cells stay rows."""
    import pyarrow as pa

    h, w = array.shape
    t = pa.table({"row": np.repeat(np.arange(h, dtype=np.int32), w), "col": np.tile(np.arange(w, dtype=np.int32), h), band: array.astype(np.float64).ravel()})
    return spark.createDataFrame(t)
