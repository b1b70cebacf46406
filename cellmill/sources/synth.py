"""Synthetic point clouds: patterns are column expressions over spark.range, made where they are used."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmill.functions.grid import BBox

MARGIN = 1e-6  # fixed value: points keep this distance from the box
#: Block letters, five rows of five.
LETTERS = {
    "P": ["11110", "10001", "11110", "10000", "10000"], "C": ["01111", "10000", "10000", "10000", "01111"], "R": ["11110", "10001", "11110", "10010", "10001"],
    "E": ["11111", "10000", "11110", "10000", "11111"], "L": ["10000", "10000", "10000", "10000", "11111"], "I": ["11111", "00100", "00100", "00100", "11111"],
}


def _dims(box: BBox, cell: float) -> tuple[int, int]:
    return int(box.width / cell), int(box.height / cell)


def _between(low: float, high: float, seed: int) -> Column:
    return F.lit(low + MARGIN) + F.rand(seed) * (high - low - 2 * MARGIN)


def uniform_points(spark: SparkSession, box: BBox, n: int, seed: int = 42, partitions: int | None = None) -> DataFrame:
    """id, x, y: n points spread evenly.  The same seed and partitions give the same points."""
    ids = spark.range(0, n, 1, partitions or max(1, min(4096, n // 500_000 + 1)))
    return ids.select("id", _between(box.min_x, box.max_x, seed).alias("x"), _between(box.min_y, box.max_y, seed + 1).alias("y"))


def _cloud(spark: SparkSession, box: BBox, cell: float, per_cell: int, seed: int, value) -> DataFrame:
    w, h = _dims(box, cell)
    points = uniform_points(spark, box, w * h * per_cell, seed)
    return points.select("x", "y", value(F.col("x"), F.col("y")).cast("float").alias("value"))


def _index(c: Column, low: float, cell: float) -> Column:
    return F.floor((c - low) / cell)


def _pick(even: Column, low: float, high: float) -> Column:
    return F.when(even, F.lit(float(high))).otherwise(F.lit(float(low)))


def checkerboard(spark, box: BBox, cell=1.0, per_cell=10, square=8, low=0.0, high=100.0, seed=42) -> DataFrame:
    side = lambda c, origin: F.floor(_index(c, origin, cell) / square)
    return _cloud(spark, box, cell, per_cell, seed, lambda x, y: _pick((side(x, box.min_x) + side(y, box.min_y)) % 2 == 0, low, high))


def stripes(spark, box: BBox, cell=1.0, per_cell=10, stripe=5, orientation="horizontal", low=0.0, high=100.0, seed=42) -> DataFrame:
    at = {"horizontal": lambda r, c: r, "vertical": lambda r, c: c, "diagonal": lambda r, c: r + c}
    if orientation not in at:
        raise ValueError(f"unknown orientation {orientation!r}")
    which = lambda x, y: F.floor(at[orientation](_index(y, box.min_y, cell), _index(x, box.min_x, cell)) / stripe)
    return _cloud(spark, box, cell, per_cell, seed, lambda x, y: _pick(which(x, y) % 2 == 0, low, high))


def _distance(box: BBox, x: Column, y: Column) -> Column:
    return F.hypot(x - (box.min_x + box.max_x) / 2, y - (box.min_y + box.max_y) / 2)


def bullseye(spark, box: BBox, cell=1.0, per_cell=10, rings=5, low=0.0, high=100.0, seed=42) -> DataFrame:
    width = min(box.width, box.height) / 2 / rings
    return _cloud(spark, box, cell, per_cell, seed, lambda x, y: _pick(F.least(F.floor(_distance(box, x, y) / width), F.lit(rings - 1)) % 2 == 0, low, high))


def gradient(spark, box: BBox, cell=1.0, per_cell=10, kind="linear", angle=0.0, low=0.0, high=100.0, seed=42) -> DataFrame:
    """angle in degrees, 0 from left to right."""
    if kind == "linear":
        c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
        along = lambda x, y: (x - box.min_x) / box.width * c + (y - box.min_y) / box.height * s
    elif kind == "radial":
        along = lambda x, y: _distance(box, x, y) / (min(box.width, box.height) / 2)
    else:
        raise ValueError(f"unknown gradient {kind!r}")
    return _cloud(spark, box, cell, per_cell, seed, lambda x, y: low + F.least(F.greatest(along(x, y), F.lit(0.0)), F.lit(1.0)) * (high - low))


def text(spark, box: BBox, letters="CELL", cell=1.0, per_cell=10, low=0.0, high=100.0, seed=42) -> DataFrame:
    """Letters of LETTERS side by side, six columns each, over the whole box."""
    if unknown := set(letters) - LETTERS.keys():
        raise ValueError(f"no mask for {sorted(unknown)}")
    columns = 6 * len(letters)
    mask = F.array(*[F.lit(int(k % 6 < 5 and LETTERS[letters[k // 6]][r][k % 6])) if k % 6 < 5 else F.lit(0) for r in range(5) for k in range(columns)])

    def value(x: Column, y: Column) -> Column:
        k = F.least(F.floor((x - box.min_x) / box.width * columns), F.lit(columns - 1))
        r = F.least(F.floor((box.max_y - y) / box.height * 5), F.lit(4))
        return _pick(F.get(mask, (r * columns + k).cast("int")) == 1, low, high)

    return _cloud(spark, box, cell, per_cell, seed, value)


def shape(spark, box: BBox, kind="circle", cell=1.0, per_cell=10, outside=0.0, inside=100.0, seed=42) -> DataFrame:
    nx = lambda x: 2 * (x - (box.min_x + box.max_x) / 2) / box.width
    ny = lambda y: 2 * (y - (box.min_y + box.max_y) / 2) / box.height
    tests = {
        "circle": lambda x, y: F.hypot(nx(x), ny(y)) <= 0.7,
        "square": lambda x, y: (F.abs(nx(x)) <= 0.7) & (F.abs(ny(y)) <= 0.7),
        "triangle": lambda x, y: (ny(y) <= 0.5) & (ny(y) >= -0.8 * F.abs(nx(x)) + 0.5),
    }
    if kind not in tests:
        raise ValueError(f"unknown shape {kind!r}")
    return _cloud(spark, box, cell, per_cell, seed, lambda x, y: _pick(tests[kind](x, y), outside, inside))


def uniform(spark, box: BBox, cell=1.0, per_cell=10, value=50.0, seed=42) -> DataFrame:
    return _cloud(spark, box, cell, per_cell, seed, lambda x, y: F.lit(float(value)))


def clusters(spark, box: BBox, n=5, per_cluster=1000, spread=None, low=0.0, high=100.0, seed=42) -> DataFrame:
    """Normally distributed clusters around evenly drawn centres, kept inside the box; values rise from cluster to cluster."""
    spread = spread or min(box.width, box.height) / 20
    k = F.floor(F.col("id") / per_cluster)
    centre = lambda lo, hi, salt: lo + F.pmod(F.xxhash64(k, F.lit(seed), F.lit(salt)), F.lit(1 << 20)) / float(1 << 20) * (hi - lo)
    keep = lambda c, lo, hi: F.least(F.greatest(c, F.lit(lo + MARGIN)), F.lit(hi - MARGIN))
    points = spark.range(n * per_cluster)
    return points.select(
        keep(centre(box.min_x, box.max_x, 1) + F.randn(seed) * spread, box.min_x, box.max_x).alias("x"),
        keep(centre(box.min_y, box.max_y, 2) + F.randn(seed + 1) * spread, box.min_y, box.max_y).alias("y"),
        (low + k * ((high - low) / max(n - 1, 1))).cast("float").alias("value"),
    )


def plane(spark, box: BBox, cell=1.0, per_cell=10, slope_x=1.0, slope_y=0.5, noise=5.0, base=50.0, seed=42) -> DataFrame:
    return _cloud(spark, box, cell, per_cell, seed, lambda x, y: base + slope_x * x + slope_y * y + F.randn(seed + 2) * noise)


def edge_case(spark, box: BBox, case: str, cell=1.0, seed=42) -> DataFrame:
    """single_point, cell_boundaries, sparse, dense or mixed_density; all values are 50."""
    w, h = _dims(box, cell)
    value = F.lit(50.0).cast("float").alias("value")
    middle = ((box.min_x + box.max_x) / 2, (box.min_y + box.max_y) / 2)
    if case == "single_point":
        return spark.range(1).select(F.lit(middle[0]).alias("x"), F.lit(middle[1]).alias("y"), value)
    if case == "cell_boundaries":
        return spark.range(min(w, h, 100)).select((box.min_x + F.col("id") * cell).alias("x"), (box.min_y + F.col("id") * cell).alias("y"), value)
    if case == "sparse":
        return uniform_points(spark, box, int(w * h * 0.3), seed).select("x", "y", value)
    if case == "dense":
        return spark.range(10_000).select((middle[0] + F.rand(seed) * cell).alias("x"), (middle[1] + F.rand(seed + 1) * cell).alias("y"), value)
    if case == "mixed_density":
        rows, cols = min(h, 20), min(w, 20)
        cells = spark.range(rows * cols).select(F.floor(F.col("id") / cols).alias("r"), (F.col("id") % cols).alias("c"))
        draw = F.pmod(F.xxhash64("r", "c", F.lit(seed)), F.lit(1 << 20))
        kind = (F.col("r") + F.col("c")) % 3
        n = F.when(kind == 0, 0).when(kind == 1, draw % 5 + 1).otherwise(draw % 901 + 100)
        points = cells.select("r", "c", F.explode(F.array_repeat(F.lit(1), n.cast("int"))))
        return points.select((box.min_x + (F.col("c") + F.rand(seed)) * cell).alias("x"), (box.min_y + (F.col("r") + F.rand(seed + 1)) * cell).alias("y"), value)
    raise ValueError(f"unknown case {case!r}")
