"""Every operator as a query over the test tables, each with its oracle in SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmill.functions.filters import FilterSpec
from cellmill.functions.grid import GridSpec
from cellmill.functions.reductions import CustomReduction, Reduction
from cellmill.operators import raster as R
from cellmill.operators.glyphs import GlyphSpec, splat
from cellmill.operators.reduce import finalize_states, merge_states, partial_states, reduce_points, tile_counts

LINEITEM = GridSpec.of(0, 0, 105000, 51, 1000, -1, 32, 16)
EVENTS = GridSpec.of(0, 0, 720, 150, 6, -10, 40, 5)
#: Finer than EVENTS and wider than the table: holds empty cells and empty tiles when all events are reduced.
WIDE = GridSpec.of(-240, -50, 960, 200, 2, -2, 40, 5)
VECTORS = GridSpec.of(-0.5, -0.5, 0.5, 0.5, 0.05, -0.05, 10, 10)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x, y stay the stored columns, so bounds reach the reader."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"), F.col("l_discount").alias("value"), F.col("l_quantity").alias("weight"),
        F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("ts"), F.col("l_linenumber").alias("class"), F.col("l_tax").alias("tax"), F.col("l_orderkey").alias("okey"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        ((micros - 1704067200000000) / 3600000000.0).alias("x"), (F.col("user_id") + 0.5).alias("y"), "value", micros.alias("ts"), "event_id"
    )


def covered(cloud: DataFrame, grid: GridSpec) -> GridSpec:
    """The grid, grown where the table has points outside of it: no row is dropped at any scale."""
    from cellmill.sources.points import combined_bbox as box

    return grid.covering(box(cloud))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.get(e, 0).cast("double").alias("x"), F.get(e, 1).cast("double").alias("y"), F.get(e, 2).cast("double").alias("value"),
        (F.abs(F.get(e, 3).cast("double")) / 4 + 0.01).alias("sigma"), (F.get(e, 4).cast("double") * 3).alias("angle"), F.abs(F.get(e, 5).cast("double")).alias("half"), "vec_id",
    )


def _cells(grid: GridSpec) -> str:
    """SQL that adds row and col to points p."""
    b = grid.bounds
    return f"""c AS (SELECT *, CAST(least(greatest(floor((x - ({b.min_x})) / {grid.cell_x}), 0), {grid.width - 1}) AS INTEGER) AS col,
        CAST(least(greatest(floor((y - ({b.max_y})) / ({grid.cell_y})), 0), {grid.height - 1}) AS INTEGER) AS "row"
        FROM p WHERE x BETWEEN {b.min_x} AND {b.max_x} AND y BETWEEN {b.min_y} AND {b.max_y})"""


def _covered(grid: GridSpec) -> str:
    """As _cells, on the grid grown to cover p; g has one row with its corner, width and height, and all_cells every cell."""
    b, x, y = grid.bounds, grid.tile_width * grid.cell_x, -grid.tile_height * grid.cell_y
    return f"""b AS (SELECT {b.min_x} - {x} * greatest(ceil(({b.min_x} - min(x)) / {x}), 0) AS x0, {b.max_x} + {x} * greatest(ceil((max(x) - {b.max_x}) / {x}), 0) AS x1,
            {b.min_y} - {y} * greatest(ceil(({b.min_y} - min(y)) / {y}), 0) AS y0, {b.max_y} + {y} * greatest(ceil((max(y) - {b.max_y}) / {y}), 0) AS y1 FROM p),
        g AS (SELECT x0, y1, CAST(ceil((x1 - x0) / {grid.cell_x}) AS BIGINT) AS width, CAST(ceil((y1 - y0) / {-grid.cell_y}) AS BIGINT) AS height FROM b),
        all_cells AS (SELECT CAST(id // width AS INTEGER) AS "row", CAST(id % width AS INTEGER) AS col FROM (SELECT width, unnest(range(width * height)) AS id FROM g)),
        c AS (SELECT p.*, CAST(least(floor((x - x0) / {grid.cell_x}), width - 1) AS INTEGER) AS col, CAST(least(floor((y - y1) / ({grid.cell_y})), height - 1) AS INTEGER) AS "row"
            FROM p, g WHERE x IS NOT NULL AND y IS NOT NULL)"""


P_LINE = """p AS (SELECT l_extendedprice AS x, l_quantity AS y, l_discount AS value, l_quantity AS weight, epoch_us(l_shipdate) AS ts,
    l_linenumber AS class, l_tax AS tax, l_orderkey AS okey FROM lineitem)"""
P_EVENT = "p AS (SELECT (epoch_us(ts) - 1704067200000000) / 3600000000.0::DOUBLE AS x, user_id + 0.5::DOUBLE AS y, value, epoch_us(ts) AS ts, event_id FROM events)"
P_VECTOR = """p AS (SELECT embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS value, abs(embedding[4]::DOUBLE) / 4 + 0.01::DOUBLE AS sigma,
    embedding[5]::DOUBLE * 3 AS angle, abs(embedding[6]::DOUBLE) AS half, vec_id FROM embeddings)"""
LINE, EVENT, VECTOR = f"WITH {P_LINE}, {_cells(LINEITEM)}", f"WITH {P_EVENT}, {_cells(EVENTS)}", f"WITH {P_VECTOR}, {_cells(VECTORS)}"


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _round(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    rounded = {n: F.round(F.col(n).cast("double"), digits) for n in names}
    return df.withColumns({n: F.when(c == 0, 0.0).otherwise(c) for n, c in rounded.items()})  # no -0.0


def _reduced(name: str, cloud, grid: GridSpec, reduction: Reduction, select: str, head: str, digits: int = 9, group: str = "GROUP BY 2, 1") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        points = cloud(spark, sf_dir)
        at = covered(points, grid) if grid is EVENTS else grid
        return _round(reduce_points(points, at, [reduction]), reduction.name, digits=digits)

    QUERIES[name] = run
    ORACLE_SQL[name] = f'{head} SELECT "row", col, round(CAST({select} AS DOUBLE), {digits}) AS {reduction.name} FROM c {group}'


_reduced("cell_sum", lineitem, LINEITEM, Reduction("value", "sum", band="v"), "sum(value)", LINE)
_reduced("cell_max", lineitem, LINEITEM, Reduction("value", "max", band="v"), "max(value)", LINE)
_reduced("cell_min", lineitem, LINEITEM, Reduction("value", "min", band="v"), "min(value)", LINE)
_reduced("cell_count", lineitem, LINEITEM, Reduction("value", "count", band="v"), "count(value)", LINE)
_reduced("cell_avg", lineitem, LINEITEM, Reduction("value", "average", band="v"), "avg(value)", LINE)
_reduced("cell_wavg", lineitem, LINEITEM, Reduction("value", "weighted_average", weight="weight", band="v"), "sum(value * weight) / sum(weight)", LINE)
_reduced("cell_median", lineitem, LINEITEM, Reduction("value", "median", band="v"), "quantile_cont(value, 0.5)", LINE)
_reduced("cell_percentile", lineitem, LINEITEM, Reduction("value", "percentile", percentile=0.9, band="v"), "quantile_cont(value, 0.9)", LINE)
_reduced("cell_most_recent", lineitem, LINEITEM, Reduction("value", "most_recent", order="ts", ties=("okey",), band="v"), "value", LINE,
         group='QUALIFY row_number() OVER (PARTITION BY "row", col ORDER BY ts DESC, okey, value DESC) = 1')
_reduced("cell_priority", lineitem, LINEITEM, Reduction("value", "priority_merge", order="class", band="v"), "value", LINE,
         group='QUALIFY row_number() OVER (PARTITION BY "row", col ORDER BY class DESC, value DESC) = 1')
_reduced("event_avg", events, EVENTS, Reduction("value", "average", band="v"), "avg(value)", EVENT)
_reduced("event_most_recent", events, EVENTS, Reduction("value", "most_recent", order="ts", ties=("event_id",), band="v"), "value", EVENT,
         group='QUALIFY row_number() OVER (PARTITION BY "row", col ORDER BY ts DESC, event_id, value DESC) = 1')
VARIANCE = CustomReduction(lambda v: [F.var_samp(v)])
_reduced("cell_custom_var", lineitem, LINEITEM, Reduction("value", "custom", custom=VARIANCE, band="v"), "var_samp(value)", LINE)


@query(f"""{LINE} SELECT "row", col, round(sum(value), 6) AS total, count(value)::DOUBLE AS n, round(avg(value), 6) AS mean, max(tax) AS top
    FROM c GROUP BY 1, 2""")
def multi_reduction(spark, sf_dir):
    rs = [Reduction("value", "sum", band="total"), Reduction("value", "count", band="n"), Reduction("value", "average", band="mean"), Reduction("tax", "max", band="top")]
    return _round(reduce_points(lineitem(spark, sf_dir), LINEITEM, rs), "total", "n", "mean")


def _filtered(name: str, spec: FilterSpec, where: str) -> None:
    def run(spark, sf_dir):
        return reduce_points(lineitem(spark, sf_dir), LINEITEM, [Reduction("value", "count", band="n")], spec)

    QUERIES[name] = run
    ORACLE_SQL[name] = f'{LINE} SELECT "row", col, count(value) AS n FROM c WHERE {where} GROUP BY 1, 2'


for _name, _op, _sql in (("eq", "==", "="), ("ne", "!=", "<>"), ("lt", "<", "<"), ("le", "<=", "<="), ("gt", ">", ">"), ("ge", ">=", ">=")):
    _filtered(f"filter_{_name}", FilterSpec().add("value", _op, 0.05), f"value {_sql} 0.05::DOUBLE")
_filtered("filter_in", FilterSpec().add_in_set("class", [1, 3, 5]), "class IN (1, 3, 5)")
_filtered("filter_not_in", FilterSpec().add_not_in_set("class", [1, 3, 5]), "class NOT IN (1, 3, 5)")
_filtered("filter_and", FilterSpec().add("value", ">=", 0.03).add("tax", "<", 0.05).add_in_set("class", [1, 2]), "value >= 0.03::DOUBLE AND tax < 0.05::DOUBLE AND class IN (1, 2)")

_TESTS = {"eq": ("==", 0.05), "ne": ("!=", 0.05), "lt": ("<", 0.05), "le": ("<=", 0.05), "gt": (">", 0.05), "ge": (">=", 0.05)}


@query("""WITH t AS (SELECT CASE WHEN l_linenumber = 3 THEN 'NaN'::DOUBLE WHEN l_linenumber = 4 THEN NULL ELSE l_discount END AS v FROM lineitem)
    SELECT 'eq' AS test, count(*) AS n FROM t WHERE NOT isnan(v) AND v = 0.05::DOUBLE UNION ALL SELECT 'ne', count(*) FROM t WHERE isnan(v) OR v <> 0.05::DOUBLE
    UNION ALL SELECT 'lt', count(*) FROM t WHERE NOT isnan(v) AND v < 0.05::DOUBLE UNION ALL SELECT 'le', count(*) FROM t WHERE NOT isnan(v) AND v <= 0.05::DOUBLE
    UNION ALL SELECT 'gt', count(*) FROM t WHERE NOT isnan(v) AND v > 0.05::DOUBLE UNION ALL SELECT 'ge', count(*) FROM t WHERE NOT isnan(v) AND v >= 0.05::DOUBLE
    UNION ALL SELECT 'in', count(*) FROM t WHERE NOT isnan(v) AND v IN (0.05::DOUBLE, 0.07::DOUBLE)
    UNION ALL SELECT 'not in', count(*) FROM t WHERE isnan(v) OR v NOT IN (0.05::DOUBLE, 0.07::DOUBLE)
    UNION ALL SELECT 'ne nan', count(*) FROM t WHERE v IS NOT NULL UNION ALL SELECT 'eq nan', 0::BIGINT""")
def filter_nan(spark, sf_dir):
    base = lineitem(spark, sf_dir).select(F.when(F.col("class") == 3, float("nan")).when(F.col("class") == 4, None).otherwise(F.col("value")).alias("v"))
    specs = {k: FilterSpec().add("v", op, x) for k, (op, x) in _TESTS.items()}
    specs |= {"in": FilterSpec().add_in_set("v", [0.05, 0.07, float("nan")]), "not in": FilterSpec().add_not_in_set("v", [0.05, 0.07, float("nan")])}
    specs |= {"ne nan": FilterSpec().add("v", "!=", float("nan")), "eq nan": FilterSpec().add("v", "==", float("nan"))}
    counts = base.agg(*[F.count(F.when(s.column(base), 1)).alias(k) for k, s in specs.items()])
    return counts.unpivot([], list(specs), "test", "n")


@query("""WITH g AS (SELECT * FROM (VALUES (0.0), (-0.001), (10.0), (10.001), (5.0), (0.999999), (1.0)) a(x), (VALUES (0.0), (10.0), (-0.5), (9.0), (9.5)) b(y))
    SELECT x::DOUBLE AS x, y::DOUBLE AS y, CAST(least(floor(x), 9) AS INTEGER) AS col, CAST(least(greatest(floor((y - 10) / -1), 0), 9) AS INTEGER) AS "row"
    FROM g WHERE x BETWEEN 0 AND 10 AND y BETWEEN 0 AND 10""")
def bounds_inclusive(spark, sf_dir):
    xs, ys = [0.0, -0.001, 10.0, 10.001, 5.0, 0.999999, 1.0], [0.0, 10.0, -0.5, 9.0, 9.5]
    return GridSpec.of(0, 0, 10, 10, 1, -1, 5, 5).assign(spark.createDataFrame([(x, y) for x in xs for y in ys], "x double, y double"))


@query(f'{LINE} SELECT x, y, okey, class, "row", col, "row"::BIGINT * 105 + col AS cell, ("row" // 16)::BIGINT * 4 + col // 32 AS tile FROM c')
def assign_cells(spark, sf_dir):
    placed = LINEITEM.assign(lineitem(spark, sf_dir).select("x", "y", "okey", "class"))
    return placed.withColumns({"cell": LINEITEM.cell_id(), "tile": LINEITEM.tile_id()})


@query(f"""{LINE} SELECT okey, class, x, CAST(("row" % 16) * least(32, 105 - (col // 32) * 32) + col % 32 AS INTEGER) AS local FROM c""")
def local_cells(spark, sf_dir):
    return LINEITEM.assign(lineitem(spark, sf_dir)).select("okey", "class", "x", LINEITEM.local_cell().alias("local"))


@query(f"""{LINE} SELECT DISTINCT "row", col, (col + 0.5::DOUBLE) * 1000 AS cx, 51 + ("row" + 0.5::DOUBLE) * -1 AS cy FROM c""")
def cell_centers(spark, sf_dir):
    cells = LINEITEM.assign(lineitem(spark, sf_dir)).select("row", "col").distinct()
    return cells.withColumns({"cx": LINEITEM.center_x(), "cy": LINEITEM.center_y()})


@query(f"""{LINE} SELECT CAST("row" // 16 AS INTEGER) AS tile_row, CAST(col // 32 AS INTEGER) AS tile_col, count(*) AS points, count(DISTINCT ("row", col)) AS cells FROM c GROUP BY 1, 2""")
def tiles(spark, sf_dir):
    return tile_counts(lineitem(spark, sf_dir), LINEITEM)


# footprints


def _gauss_sql(sigma_x: str, sigma_y: str, rotation: str, inside: str, anchor: float = 0.0, reach: str = "greatest(sx, sy)") -> str:
    return f"""{VECTOR}, f AS (SELECT *, (x - (-0.5)) * (1.0::DOUBLE / 0.05) AS fc, (y - 0.5) * (1.0::DOUBLE / -0.05) AS fr, ({sigma_x}) / 0.05 AS sx, ({sigma_y}) / -0.05 AS sy, {rotation} AS rot FROM c),
    r AS (SELECT *, floor(fc) AS ic, floor(fr) AS ir, CAST(ceil(least(3.0 * {reach}, 32.0)) AS INTEGER) AS r FROM f),
    k AS (SELECT *, unnest(range(-r, r + 1)) AS dx FROM r), kk AS (SELECT *, unnest(range(-r, r + 1)) AS dy FROM k),
    d AS (SELECT *, dx + {anchor} - (fc - ic) AS rx, dy + {anchor} - (fr - ir) AS ry, CAST(ic + dx AS INTEGER) AS gc, CAST(ir + dy AS INTEGER) AS gr FROM kk),
    u AS (SELECT *, (rx * cos(-rot) - ry * sin(-rot)) / sx AS a, (rx * sin(-rot) + ry * cos(-rot)) / sy AS b FROM d),
    w AS (SELECT *, exp(-0.5 * (a * a + b * b)) AS w FROM u WHERE gc BETWEEN 0 AND 19 AND gr BETWEEN 0 AND 19 AND {inside}),
    s AS (SELECT gr AS "row", gc AS col, w, value, vec_id FROM w WHERE w >= 1e-6)"""


TILE = '(gr // 10 = "row" // 10 AND gc // 10 = col // 10)'
BY_KIND = {
    "weighted_average": "sum(value * w) / sum(w)",
    "average": "sum(value * w) / sum(w)",
    "sum": "sum(value * w)",
    "count": "sum(w)",
}


def _splatted(name: str, glyph: GlyphSpec, kind: str, source: str) -> None:
    def run(spark, sf_dir):
        return _round(reduce_points(vectors(spark, sf_dir), VECTORS, [Reduction("value", kind, band="v", glyph=glyph)]), "v", digits=5)

    QUERIES[name] = run
    ORACLE_SQL[name] = f'{source} SELECT "row", col, CASE WHEN round({BY_KIND[kind]}, 5) = 0 THEN 0 ELSE round({BY_KIND[kind]}, 5) END AS v FROM s GROUP BY 1, 2'


_plain = GlyphSpec("gaussian", default_sigma_x=0.05, default_sigma_y=0.05)
for _name, _kind in (("wavg", "weighted_average"), ("sum", "sum"), ("count", "count"), ("avg", "average")):
    _splatted(f"glyph_gauss_{_name}", _plain, _kind, _gauss_sql("0.05", "0.05", "0.0", TILE))
_splatted("glyph_gauss_aniso_rot", GlyphSpec("gaussian", default_sigma_x=0.1, default_sigma_y=0.04, default_rotation=0.6), "weighted_average", _gauss_sql("0.1", "0.04", "0.6", TILE))
_splatted("glyph_gauss_per_point", GlyphSpec("gaussian", sigma_x_channel="sigma", sigma_y_channel="sigma", rotation_channel="angle"), "sum", _gauss_sql("sigma", "sigma", "angle", TILE))
_splatted("glyph_gauss_seamless", GlyphSpec("gaussian", default_sigma_x=0.05, default_sigma_y=0.05, clip_to_tile=False), "count", _gauss_sql("0.05", "0.05", "0.0", "TRUE"))
_splatted("glyph_gauss_centered", GlyphSpec("gaussian", default_sigma_x=0.05, default_sigma_y=0.1, anchor="center", strict_radius=True), "count",
          _gauss_sql("0.05", "0.1", "0.0", TILE, 0.5, "greatest(abs(sx), abs(sy))"))


@query(_gauss_sql("0.05", "0.05", "0.0", TILE) + """, t AS (SELECT *, w / sum(w) OVER (PARTITION BY vec_id) AS nw FROM s)
    SELECT "row", col, CASE WHEN round(sum(value * nw), 5) = 0 THEN 0 ELSE round(sum(value * nw), 5) END AS v FROM t GROUP BY 1, 2""")
def glyph_gauss_normalized(spark, sf_dir):
    glyph = GlyphSpec("gaussian", default_sigma_x=0.05, default_sigma_y=0.05, normalize=True)
    return _round(reduce_points(vectors(spark, sf_dir), VECTORS, [Reduction("value", "sum", band="v", glyph=glyph)]), "v", digits=5)


def _line_sql(direction: str, half: str, inside: str = TILE, end: str = "round") -> str:
    """Bresenham step by step, as a recursive query."""
    return f"""WITH RECURSIVE {P_VECTOR}, {_cells(VECTORS)}, f AS (SELECT *, (x - (-0.5)) * (1.0::DOUBLE / 0.05) AS fc, (y - 0.5) * (1.0::DOUBLE / -0.05) AS fr,
        least(({half}) / 0.05, 32.0) AS hx, least(({half}) / -0.05, 32.0) AS hy, ({direction})::DOUBLE AS dir FROM c),
    e AS (SELECT *, CAST({end}(fc - hx * cos(dir)) AS BIGINT) AS x0, CAST({end}(fr - hy * sin(dir)) AS BIGINT) AS y0, CAST({end}(fc + hx * cos(dir)) AS BIGINT) AS x1, CAST({end}(fr + hy * sin(dir)) AS BIGINT) AS y1 FROM f),
    b(vec_id, value, hr, hc, px, py, x1, y1, ax, ay, err) AS (
        SELECT vec_id, value, "row", col, x0, y0, x1, y1, abs(x1 - x0), -abs(y1 - y0), abs(x1 - x0) - abs(y1 - y0) FROM e
        UNION ALL SELECT vec_id, value, hr, hc, px + CASE WHEN 2 * err >= ay THEN sign(x1 - px) ELSE 0 END, py + CASE WHEN 2 * err <= ax THEN sign(y1 - py) ELSE 0 END, x1, y1, ax, ay,
            err + CASE WHEN 2 * err >= ay THEN ay ELSE 0 END + CASE WHEN 2 * err <= ax THEN ax ELSE 0 END FROM b WHERE px <> x1 OR py <> y1),
    g AS (SELECT CAST(py AS INTEGER) AS gr, CAST(px AS INTEGER) AS gc, hr AS "row", hc AS col, 1.0::DOUBLE AS w, value, vec_id FROM b),
    s AS (SELECT gr AS "row", gc AS col, w, value, vec_id FROM g WHERE gc BETWEEN 0 AND 19 AND gr BETWEEN 0 AND 19 AND {inside})"""


_segment = GlyphSpec("line", default_direction=0.7, default_half_length=0.15)
for _name, _kind in (("wavg", "weighted_average"), ("sum", "sum"), ("count", "count")):
    _splatted(f"glyph_line_{_name}", _segment, _kind, _line_sql("0.7", "0.15"))
_splatted("glyph_line_per_point", GlyphSpec("line", direction_channel="angle", half_length_channel="half"), "count", _line_sql("angle", "half"))
_splatted("glyph_line_seamless", GlyphSpec("line", default_direction=0.7, default_half_length=0.15, clip_to_tile=False, anchor="center"), "sum", _line_sql("0.7", "0.15", "TRUE", "floor"))


@query(_gauss_sql("0.05", "0.05", "0.0", TILE) + ' SELECT vec_id, "row", col, round(w, 6) AS w FROM s')
def footprint(spark, sf_dir):
    return _round(splat(vectors(spark, sf_dir).select("vec_id", "x", "y"), VECTORS, _plain).select("vec_id", "row", "col", "w"), "w")


# states, unions, rasters

SUM_AVG = [Reduction("value", "sum", band="total"), Reduction("value", "average", band="mean"), Reduction("tax", "min", band="low")]
SUM_AVG_SQL = 'round(sum(value), 6) AS total, round(avg(value), 6) AS mean, min(tax) AS low FROM c GROUP BY 1, 2'


@query(f'{LINE} SELECT "row", col, {SUM_AVG_SQL}')
def merge_partial_states(spark, sf_dir):
    cloud = lineitem(spark, sf_dir)
    parts = [partial_states(cloud.where(F.col("okey") % 3 == k), LINEITEM, SUM_AVG) for k in range(3)]
    merged = merge_states(functools.reduce(lambda a, b: a.unionByName(b), parts), SUM_AVG)
    return _round(finalize_states(merged, SUM_AVG), "total", "mean")


@query(f"""WITH p AS (SELECT l_extendedprice AS x, l_quantity AS y, l_discount AS value FROM lineitem UNION ALL
    SELECT o_totalprice / 4, 25.5::DOUBLE, 1.0 FROM orders), {_cells(LINEITEM)} SELECT "row", col, round(sum(value), 6) AS v, count(value) AS n FROM c GROUP BY 1, 2""")
def two_collections(spark, sf_dir):
    from cellmill.plans.pipeline import Pipeline, PipelineConfig

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_totalprice") / 4).alias("x"), F.lit(25.5).alias("y"), F.lit(1.0).alias("value"))
    pipe = Pipeline.create(spark, PipelineConfig(LINEITEM, [Reduction("value", "sum", band="v"), Reduction("value", "count", band="n")]))
    return _round(pipe.run([lineitem(spark, sf_dir).select("x", "y", "value"), orders]), "v")


@query(f"""{EVENT}, s AS (SELECT "row", col, sum(value) AS v FROM c WHERE x < 200 AND y < 60 GROUP BY 1, 2), t AS (SELECT DISTINCT "row" // 5 AS tr, col // 40 AS tc FROM s),
    g AS (SELECT CAST(id // 120 AS INTEGER) AS "row", CAST(id % 120 AS INTEGER) AS col FROM range(1800) r(id))
    SELECT g."row", g.col, round(CASE WHEN s.v IS NOT NULL THEN s.v WHEN t.tr IS NOT NULL THEN 0 END, 6) AS v
    FROM g LEFT JOIN s USING ("row", col) LEFT JOIN t ON t.tr = g."row" // 5 AND t.tc = g.col // 40""")
def dense_sum_touched(spark, sf_dir):
    cloud = events(spark, sf_dir)
    grid, part = covered(cloud, EVENTS), cloud.where("x < 200 AND y < 60")
    dense = R.to_dense(reduce_points(part, grid, [Reduction("value", "sum", band="v")]), grid, "touched_zero", ("v",))
    return _round(dense.withColumn("v", F.when(~F.isnan("v"), F.col("v"))), "v")


@query(f"""{EVENT}, s AS (SELECT "row", col, avg(value) AS v FROM c GROUP BY 1, 2) SELECT 1800::BIGINT AS cells, count(v) AS covered, round(100.0 * count(v) / 1800, 6) AS coverage,
    min(v) AS minimum, max(v) AS maximum, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.05), 6) AS p5, round(quantile_cont(v, 0.95), 6) AS p95 FROM s""".replace("min(v)", "round(min(v), 6)").replace("max(v)", "round(max(v), 6)"))
def raster_stats(spark, sf_dir):
    cloud = events(spark, sf_dir)
    grid = covered(cloud, EVENTS)
    raster = reduce_points(cloud, grid, [Reduction("value", "average", band="v")])
    return _round(R.raster_stats(raster, "v", grid.width * grid.height), "coverage", "minimum", "maximum", "mean", "p5", "p95")


@query(f"""{EVENT}, a AS (SELECT "row", col, avg(value) AS a FROM c WHERE event_id % 2 = 0 GROUP BY 1, 2), b AS (SELECT "row", col, avg(value) AS b FROM c WHERE event_id % 3 = 0 GROUP BY 1, 2),
    j AS (SELECT a, b, abs(a - b) AS d FROM a FULL JOIN b USING ("row", col)) SELECT count(d) AS compared, round(max(d), 6) AS max_diff, round(avg(d), 6) AS mean_diff,
    count(*) FILTER (d > 1) AS above_tolerance, count(*) FILTER (b IS NULL) AS only_left, count(*) FILTER (a IS NULL) AS only_right, FALSE AS passed FROM j""")
def raster_diff(spark, sf_dir):
    mean = [Reduction("value", "average", band="v")]
    cloud = events(spark, sf_dir)
    grid = covered(cloud, EVENTS)
    halves = [reduce_points(cloud.where(F.col("event_id") % k == 0), grid, mean) for k in (2, 3)]
    return _round(R.raster_diff(*halves, "v", tolerance=1.0), "max_diff", "mean_diff")


@query(f"""{LINE}, s AS (SELECT "row", col, avg(value) AS v FROM c GROUP BY 1, 2) SELECT CAST("row" // 4 AS INTEGER) AS "row", CAST(col // 4 AS INTEGER) AS col, round(avg(v), 6) AS v FROM s GROUP BY 1, 2""")
def overview_4(spark, sf_dir):
    return _round(R.overview(reduce_points(lineitem(spark, sf_dir), LINEITEM, [Reduction("value", "average", band="v")]), 4), "v")


@query(f"""{EVENT}, s AS (SELECT "row", col, max(value) AS v FROM c WHERE event_id % 5 = 0 GROUP BY 1, 2), g AS (SELECT CAST(id // 120 AS INTEGER) AS "row", CAST(id % 120 AS INTEGER) AS col FROM range(1800) r(id))
    SELECT "row", col, CAST(v IS NOT NULL AS INTEGER) AS v FROM g LEFT JOIN s USING ("row", col)""")
def valid_mask(spark, sf_dir):
    cloud = events(spark, sf_dir)
    grid, part = covered(cloud, EVENTS), cloud.where(F.col("event_id") % 5 == 0)
    return R.valid_mask(R.to_dense(reduce_points(part, grid, [Reduction("value", "max", band="v")]), grid))


# the same three over all events


@query(f"""WITH {P_EVENT}, {_covered(WIDE)}, s AS (SELECT "row", col, sum(value) AS v FROM c GROUP BY 1, 2), t AS (SELECT DISTINCT "row" // 5 AS tr, col // 40 AS tc FROM s)
    SELECT a."row", a.col, round(CASE WHEN s.v IS NOT NULL THEN s.v WHEN t.tr IS NOT NULL THEN 0 END, 6) AS v
    FROM all_cells a LEFT JOIN s USING ("row", col) LEFT JOIN t ON t.tr = a."row" // 5 AND t.tc = a.col // 40""")
def dense_sum_touched_all(spark, sf_dir):
    cloud = events(spark, sf_dir)
    grid = covered(cloud, WIDE)
    dense = R.to_dense(reduce_points(cloud, grid, [Reduction("value", "sum", band="v")]), grid, "touched_zero", ("v",))
    return _round(dense.withColumn("v", F.when(~F.isnan("v"), F.col("v"))), "v")


@query(f"""WITH {P_EVENT}, {_covered(EVENTS)}, j AS (SELECT avg(value) AS a, quantile_cont(value, 0.5) AS b, abs(a - b) AS d FROM c GROUP BY "row", col)
    SELECT count(d) AS compared, round(max(d), 6) AS max_diff, round(avg(d), 6) AS mean_diff, count(*) FILTER (d > 1) AS above_tolerance,
    count(*) FILTER (a IS NOT NULL AND b IS NULL) AS only_left, count(*) FILTER (a IS NULL AND b IS NOT NULL) AS only_right, above_tolerance = 0 AND only_left = 0 AND only_right = 0 AS passed FROM j""")
def raster_diff_all(spark, sf_dir):
    cloud = events(spark, sf_dir)
    grid = covered(cloud, EVENTS)
    both = [reduce_points(cloud, grid, [Reduction("value", kind, band="v")]) for kind in ("average", "median")]
    return _round(R.raster_diff(*both, "v", tolerance=1.0), "max_diff", "mean_diff")


@query(f"""WITH {P_EVENT}, {_covered(WIDE)}, s AS (SELECT "row", col, max(value) AS v FROM c GROUP BY 1, 2)
    SELECT "row", col, CAST(v IS NOT NULL AS INTEGER) AS v FROM all_cells LEFT JOIN s USING ("row", col)""")
def valid_mask_all(spark, sf_dir):
    cloud = events(spark, sf_dir)
    grid = covered(cloud, WIDE)
    return R.valid_mask(R.to_dense(reduce_points(cloud, grid, [Reduction("value", "max", band="v")]), grid))


@query(f"""{LINE}, s AS (SELECT "row", col, count(*) AS n FROM c GROUP BY 1, 2) SELECT * FROM s WHERE "row" % 3 = 0 AND col % 3 = 0""")
def strided(spark, sf_dir):
    return R.strided(reduce_points(lineitem(spark, sf_dir), LINEITEM, [Reduction("value", "count", band="n")]), 3)


@query("SELECT min(l_extendedprice) AS min_x, min(l_quantity) AS min_y, max(l_extendedprice) AS max_x, max(l_quantity) AS max_y FROM lineitem")
def combined_bbox(spark, sf_dir):
    from cellmill.sources.points import combined_bbox as box

    b = box(lineitem(spark, sf_dir))
    return spark.createDataFrame([(b.min_x, b.min_y, b.max_x, b.max_y)], "min_x double, min_y double, max_x double, max_y double")


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors see: under spark.checkpoint.dir, or in local mode a temporary one."""
    import tempfile
    import uuid

    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return f"{named.rstrip('/')}/cellmill-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="cellmill-")


CELL_SUM_SQL = f'{LINE} SELECT "row", col, round(sum(value), 6) AS v FROM c GROUP BY 1, 2'
CELL_SUM = [Reduction("value", "sum", band="v")]


@query(CELL_SUM_SQL)
def stream_ingest(spark, sf_dir):
    from cellmill.streaming.ingest import ingest_stream, read_stream
    from cellmill.streaming.state import StateStore

    folder = _folder(spark)
    cloud = lineitem(spark, sf_dir).select("x", "y", "value")
    cloud.repartition(4).write.parquet(f"{folder}/in")
    store = StateStore(spark, f"{folder}/state", LINEITEM, CELL_SUM)
    ingest_stream(read_stream(spark, f"{folder}/in", cloud.schema, files_per_trigger=1), store, f"{folder}/checkpoint").awaitTermination()
    return _round(store.result(), "v")


@query(CELL_SUM_SQL)
def resumed_state(spark, sf_dir):
    from cellmill.streaming.state import StateStore

    folder, cloud = _folder(spark), lineitem(spark, sf_dir)
    first = StateStore(spark, folder, LINEITEM, CELL_SUM)
    first.ingest(cloud.where("okey % 2 = 0"), 0)
    first.ingest(cloud.where("okey % 2 = 0"), 0)  # delivered again: replaced
    second = StateStore(spark, folder, LINEITEM, CELL_SUM, resume=True)
    second.ingest(cloud.where("okey % 2 = 1"), 1)
    second.compact()
    return _round(second.result(), "v")


@query(CELL_SUM_SQL)
def csv_roundtrip(spark, sf_dir):
    from cellmill.sources.points import read_points, write_csv

    path = f"{_folder(spark)}/cloud.csv"
    write_csv(lineitem(spark, sf_dir).select("x", "y", "value"), path)
    return _round(reduce_points(read_points(spark, path), LINEITEM, CELL_SUM), "v")


@query(CELL_SUM_SQL)
def binary_roundtrip(spark, sf_dir):
    from cellmill.sources.binary import read_binary, write_binary

    folder = f"{_folder(spark)}/clouds"
    write_binary(lineitem(spark, sf_dir).select("x", "y", "value", "class"), folder)
    return _round(reduce_points(read_binary(spark, folder, ["x", "y", "value"]), LINEITEM, CELL_SUM), "v")


@query(f"""{LINE}, s AS (SELECT "row", col, avg(value)::FLOAT AS v FROM c GROUP BY 1, 2) SELECT "row", col, round(v::DOUBLE, 5) AS v FROM s""")
def geotiff_roundtrip(spark, sf_dir):
    from cellmill.sources.geotiff import read_geotiff, write_geotiff

    raster = reduce_points(lineitem(spark, sf_dir), LINEITEM, [Reduction("value", "average", band="v")])
    path = f"{_folder(spark)}.tif"
    write_geotiff(raster, LINEITEM, path)
    return _round(read_geotiff(spark, path), "v", digits=5)


@query('SELECT r::INTEGER AS "row", c::INTEGER AS col, 100.0::DOUBLE * ((r + c) % 2) AS v FROM range(2) a(r), range(2) b(c)')
def synthetic_checkerboard(spark, sf_dir):
    """16 x 16 cells in squares of 8: every coarse cell is constant."""
    from cellmill.functions.grid import BBox
    from cellmill.sources.synth import checkerboard

    grid = GridSpec.of(0, 0, 16, 16, 8, -8)
    return reduce_points(checkerboard(spark, BBox(0, 0, 16, 16), per_cell=20), grid, [Reduction("value", "average", band="v")])
