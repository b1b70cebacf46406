"""Queries for readers, writers, generators and raster tools, each with its oracle in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellmill.functions.filters import FilterSpec
from cellmill.functions.grid import BBox, GridSpec
from cellmill.functions.reductions import Reduction
from cellmill.operators import raster as R
from cellmill.operators.glyphs import custom_glyph, line_glyph
from cellmill.operators.reduce import reduce_points, tile_batches
from cellmill.plans.queries import CELL_SUM, CELL_SUM_SQL, LINE, LINEITEM, P_VECTOR, TILE, VECTORS, _cells, _folder, _line_sql, _round, events, lineitem, query, vectors
from cellmill.sources import synth

BOX = BBox(0, 0, 20, 20)
UNIT = GridSpec.of(0, 0, 20, 20, 1, -1)
#: A grid of a few hundred thousand cells over lineitem, large enough for overviews.
FINE = GridSpec.of(0, 0, 105000, 51.2, 150, -0.1, 256, 128)
MEAN = [Reduction("value", "average", band="v")]
_EVERY = 'FROM range(20) a(r), range(20) b(c)'


# generators: cells whose points all have one value


@query(f'SELECT r::INTEGER AS "row", c::INTEGER AS col, CASE WHEN ((19 - r) // 5) % 2 = 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS v {_EVERY}')
def synthetic_stripes(spark, sf_dir):
    return reduce_points(synth.stripes(spark, BOX, per_cell=40), UNIT, MEAN)


@query(f'SELECT r::INTEGER AS "row", c::INTEGER AS col, CASE WHEN ((19 - r + c) // 4) % 2 = 0 THEN 7.0::DOUBLE ELSE 1.0::DOUBLE END AS v {_EVERY}')
def synthetic_diagonal_stripes(spark, sf_dir):
    return reduce_points(synth.stripes(spark, BOX, per_cell=40, stripe=4, orientation="diagonal", low=1.0, high=7.0), UNIT, MEAN)


@query(f'SELECT r::INTEGER AS "row", c::INTEGER AS col, CASE WHEN r BETWEEN 3 AND 16 AND c BETWEEN 3 AND 16 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS v {_EVERY}')
def synthetic_square(spark, sf_dir):
    return reduce_points(synth.shape(spark, BOX, "square", per_cell=40), UNIT, MEAN)


@query(f'SELECT r::INTEGER AS "row", c::INTEGER AS col, 50.0::DOUBLE AS v {_EVERY}')
def synthetic_uniform(spark, sf_dir):
    return reduce_points(synth.uniform(spark, BOX, per_cell=40), UNIT, MEAN)


@query("SELECT k::BIGINT AS ring, CASE WHEN k % 2 = 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS low, CASE WHEN k % 2 = 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS high FROM range(5) t(k)")
def synthetic_bullseye(spark, sf_dir):
    """Of the points in each ring, the least and the greatest value."""
    ring = F.least(F.floor(F.hypot(F.col("x") - 10, F.col("y") - 10) / 2), F.lit(4))
    return synth.bullseye(spark, BOX, per_cell=40).groupBy(ring.alias("ring")).agg(F.min("value").cast("double").alias("low"), F.max("value").cast("double").alias("high"))


@query("SELECT c::INTEGER AS col, 5.0::DOUBLE * c AS low, 5.0::DOUBLE * (c + 1) AS high, 0.0::DOUBLE AS error FROM range(20) t(c)")
def synthetic_gradient(spark, sf_dir):
    """Columns of the grid: bounds that hold all values of theirs, and the largest distance from 5 x."""
    points = UNIT.assign(synth.gradient(spark, BOX, per_cell=40))
    inside = points.groupBy("col").agg(F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.max(F.abs(F.col("value") - 5 * F.col("x"))), 4).alias("error"))
    low, high = 5.0 * F.col("col"), 5.0 * (F.col("col") + 1)
    return inside.select("col", F.when(F.col("least") >= low - 1e-4, low).alias("low"), F.when(F.col("most") <= high + 1e-4, high).alias("high"), "error")


@query("SELECT 16000::BIGINT AS n, 0.0::DOUBLE AS error, TRUE AS inside")
def synthetic_plane(spark, sf_dir):
    points = synth.plane(spark, BOX, per_cell=40, noise=0.0)
    off = F.abs(F.col("value") - (50 + F.col("x") + 0.5 * F.col("y")))
    return points.agg(F.count(F.lit(1)).alias("n"), F.round(F.max(off), 4).alias("error"), F.every(UNIT.in_bounds("x", "y")).alias("inside"))


@query("SELECT 25.0::DOUBLE * k AS value, 1000::BIGINT AS n FROM range(5) t(k)")
def synthetic_clusters(spark, sf_dir):
    return synth.clusters(spark, BOX).groupBy(F.col("value").cast("double").alias("value")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT * FROM (VALUES ('single_point', 1::BIGINT, 1::BIGINT), ('cell_boundaries', 20, 20), ('dense', 10000, 1)) t(kind, points, cells)")
def synthetic_edge_cases(spark, sf_dir):
    parts = [synth.edge_case(spark, BOX, k).withColumn("kind", F.lit(k)) for k in ("single_point", "cell_boundaries", "dense")]
    cells = UNIT.assign(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    return cells.groupBy("kind").agg(F.count(F.lit(1)).alias("points"), F.count_distinct("row", "col").alias("cells"))


_MASK = ", ".join(f"({r}, {6 * k + c}, {int(bit)})" for k, letter in enumerate("CELL") for r, line in enumerate(synth.LETTERS[letter]) for c, bit in enumerate(line))


@query(f'SELECT r::INTEGER AS "row", c::INTEGER AS col, 100.0::DOUBLE * coalesce(bit, 0) AS v FROM range(5) a(r), range(24) b(c) LEFT JOIN (VALUES {_MASK}) m(mr, mc, bit) ON mr = r AND mc = c')
def synthetic_text(spark, sf_dir):
    box = BBox(0, 0, 24, 5)
    return reduce_points(synth.text(spark, box, per_cell=60), GridSpec.of(0, 0, 24, 5, 1, -1), MEAN)


# files


@query("SELECT count(*) AS points, 'value,class' AS channels, 'csv' AS format FROM lineitem")
def csv_info(spark, sf_dir):
    import os

    from cellmill.sources.points import csv_info, detect_format, write_csv

    path = f"{_folder(spark)}/cloud.csv"
    write_csv(lineitem(spark, sf_dir).select("x", "y", "value", "class"), path)
    info = csv_info(spark, path)
    return spark.createDataFrame([(info["points"], ",".join(info["channels"]), detect_format(os.path.basename(path)))], "points long, channels string, format string")


@query("SELECT count(*) AS points, 'value,class' AS channels, 'binary' AS format FROM lineitem")
def binary_header(spark, sf_dir):
    from cellmill.sources.binary import read_header, write_binary
    from cellmill.sources.points import detect_format

    made = write_binary(lineitem(spark, sf_dir).select("x", "y", "value", "class"), f"{_folder(spark)}/clouds", rows=10_000).collect()
    heads = [read_header(r.path) for r in made]
    kinds = {(",".join(c for c, _ in h.channels), detect_format(r.path)) for h, r in zip(heads, made, strict=True)}
    return spark.createDataFrame([(sum(h.points for h in heads), *k) for k in kinds], "points long, channels string, format string")


@query(CELL_SUM_SQL)
def chunks_roundtrip(spark, sf_dir):
    """A binary file read in chunks, each reduced by itself, through arrays."""
    from cellmill.operators.reduce import finalize_states, merge_states, partial_states
    from cellmill.sources.binary import write_binary
    from cellmill.sources.points import from_arrays, open_points

    made = write_binary(lineitem(spark, sf_dir).select("x", "y", "value").coalesce(1), f"{_folder(spark)}/one", rows=1 << 40).collect()
    reader, states = open_points(made[0].path), None
    chunk = max(1, made[0].points // 3 + 1)
    while not reader.eof:
        batch = reader.read_chunk(chunk)
        own = partial_states(from_arrays(spark, *[batch.column(k).to_numpy() for k in range(2)], value=batch.column(2).to_numpy()), LINEITEM, CELL_SUM)
        states = own if states is None else states.unionByName(own)
    return _round(finalize_states(merge_states(states, CELL_SUM), CELL_SUM), "v")




@query("SELECT round(l_extendedprice::DOUBLE, 2) AS x, l_quantity::DOUBLE AS y, round(l_discount::DOUBLE, 2) AS z, l_linenumber::INTEGER AS classification FROM lineitem WHERE l_linenumber = 2")
def las_ground(spark, sf_dir):
    from cellmill.sources.las import read_las, write_las_folder

    folder = f"{_folder(spark)}/las"
    write_las_folder(lineitem(spark, sf_dir).select("x", "y", F.col("value").alias("z"), F.lit(9).alias("intensity"), F.col("class").alias("classification")), folder, rows=10_000)
    ground = read_las(spark, folder, ground_only=True)
    return ground.select(*[F.round(c, 2).alias(c) for c in "xyz"], "classification")


@query(f"""{LINE}, s AS (SELECT "row", col, sum(value)::FLOAT AS v FROM c GROUP BY 1, 2) SELECT "row", col, round(v::DOUBLE, 4) AS v FROM s""")
def tile_files_roundtrip(spark, sf_dir):
    """States as one file per tile, and the folder read back by many tasks."""
    from cellmill.operators.reduce import partial_states
    from cellmill.sources.tile_files import tile_rows, write_tiles

    folder = f"{_folder(spark)}/tiles"
    write_tiles(partial_states(lineitem(spark, sf_dir), LINEITEM, CELL_SUM), LINEITEM, folder, "sum", ["v__s0"])
    rows = tile_rows(spark, folder, LINEITEM.tile_width, LINEITEM.tile_height, ["v__s0"]).where("NOT isnan(v__s0)")
    return _round(rows.select("row", "col", F.col("v__s0").alias("v")), "v", digits=4)


def _fine_sql(level: int) -> str:
    return f"""WITH p AS (SELECT l_extendedprice AS x, l_quantity AS y, l_discount AS value FROM lineitem), {_cells(FINE)},
        s AS (SELECT "row", col, avg(value) AS v FROM c GROUP BY 1, 2)
        SELECT CAST("row" // {level} AS INTEGER) AS "row", CAST(col // {level} AS INTEGER) AS col, round(avg(v)::FLOAT::DOUBLE, 4) AS v FROM s GROUP BY 1, 2"""


@query(_fine_sql(2))
def cog_overview(spark, sf_dir):
    """The first overview of a file that one job has written, read back."""
    from cellmill.sources.geotiff import GeoTiffOptions, read_geotiff, write_geotiff

    path = f"{_folder(spark)}.tif"
    write_geotiff(reduce_points(lineitem(spark, sf_dir), FINE, MEAN), FINE, path, GeoTiffOptions(overviews=True))
    return _round(read_geotiff(spark, path, level=1), "v", digits=4)


@query(f"SELECT {FINE.width}::BIGINT AS width, {FINE.height}::BIGINT AS height, 'v' AS bands, 2::BIGINT AS levels, 0.0::DOUBLE AS min_x, 0.0::DOUBLE AS min_y, 105000.0::DOUBLE AS max_x, 51.2::DOUBLE AS max_y")
def geotiff_info(spark, sf_dir):
    from cellmill.sources.geotiff import GeoTiffOptions, read_geotiff_info, write_geotiff

    path = f"{_folder(spark)}.tif"
    write_geotiff(reduce_points(lineitem(spark, sf_dir), FINE, MEAN), FINE, path, GeoTiffOptions(overviews=True))
    i = read_geotiff_info(path)
    box = [round(float(v), 6) for v in (i.bounds.min_x, i.bounds.min_y, i.bounds.max_x, i.bounds.max_y)]
    return spark.createDataFrame([(i.width, i.height, ",".join(i.bands), i.levels, *box)], "width long, height long, bands string, levels long, min_x double, min_y double, max_x double, max_y double")


# rasters, grids, filters


@query(_fine_sql(2).replace("::FLOAT::DOUBLE", ""))
def pyramid_first(spark, sf_dir):
    """Means of hundredths often lie halfway between two results, so their rounding errors go first."""
    first = R.pyramid(reduce_points(lineitem(spark, sf_dir), FINE, MEAN), FINE)[2]
    return _round(_round(first, "v", digits=14), "v", digits=4)


@query(CELL_SUM_SQL)
def numpy_roundtrip(spark, sf_dir):
    import numpy as np

    raster = reduce_points(lineitem(spark, sf_dir), LINEITEM, CELL_SUM)
    back = R.from_numpy(spark, R.to_numpy(raster, LINEITEM, "v", np.float64), "v")
    return _round(back.where(~F.isnan("v")), "v")


@query(f'{LINE} SELECT DISTINCT "row", col, 3.5::DOUBLE AS v FROM c')
def filled(spark, sf_dir):
    return R.fill(reduce_points(lineitem(spark, sf_dir), LINEITEM, CELL_SUM), 3.5, "v")


@query("""WITH p AS (SELECT event_id, value FROM events) SELECT count(*) AS n, count(*) AS rows_named FROM p WHERE value > 50""")
def selected_rows(spark, sf_dir):
    """Numbers of the rows that pass, which are distinct."""
    found = FilterSpec().add("value", ">", 50.0).selected(events(spark, sf_dir).select("event_id", "value"))
    return found.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("index").alias("rows_named"))


@query("""SELECT CAST(t // 4 AS INTEGER) AS tile_row, CAST(t % 4 AS INTEGER) AS tile_col, CAST(32000.0 * (t % 4) AS DOUBLE) AS min_x,
    CAST(greatest(51 - 16 * (t // 4 + 1), 0) AS DOUBLE) AS min_y, CAST(least(32000.0 * (t % 4 + 1), 105000) AS DOUBLE) AS max_x, CAST(51 - 16 * (t // 4) AS DOUBLE) AS max_y FROM range(16) r(t)""")
def tile_boxes(spark, sf_dir):
    rows = []
    for t in range(LINEITEM.tiles_x * LINEITEM.tiles_y):
        b = LINEITEM.tile_bounds(t // LINEITEM.tiles_x, t % LINEITEM.tiles_x)
        rows.append((t // LINEITEM.tiles_x, t % LINEITEM.tiles_x, *map(float, (b.min_x, b.min_y, b.max_x, b.max_y))))
    return spark.createDataFrame(rows, "tile_row int, tile_col int, min_x double, min_y double, max_x double, max_y double")


@query(f"""{LINE} SELECT CAST("row" // 16 AS INTEGER) AS tile_row, CAST(col // 32 AS INTEGER) AS tile_col, count(*) AS points, round(sum(value), 4) AS total FROM c GROUP BY 1, 2""")
def tile_batches_summed(spark, sf_dir):
    """Points dealt out by tile, each tile summed by a kernel of its own."""
    import pyarrow as pa

    batches = tile_batches(lineitem(spark, sf_dir).select("x", "y", "value"), LINEITEM)

    def kernel(t: pa.Table) -> pa.Table:
        import pyarrow.compute as pc

        return pa.table({"tile_row": t.column("tile_row")[:1], "tile_col": t.column("tile_col")[:1], "points": pa.array([t.num_rows], pa.int64()), "total": pa.array([pc.sum(t.column("value")).as_py()], pa.float64())})

    return _round(batches.groupBy("tile_row", "tile_col").applyInArrow(kernel, "tile_row int, tile_col int, points long, total double"), "total", digits=4)


@query(_line_sql("0.7", "0.15") + """, t AS (SELECT *, w / sum(w) OVER (PARTITION BY vec_id) AS nw FROM s)
    SELECT "row", col, CASE WHEN round(sum(value * nw), 5) = 0 THEN 0 ELSE round(sum(value * nw), 5) END AS v FROM t GROUP BY 1, 2""")
def glyph_line_normalized(spark, sf_dir):
    glyph = line_glyph(0.7, 0.15, normalize=True)
    return _round(reduce_points(vectors(spark, sf_dir), VECTORS, [Reduction("value", "sum", band="v", glyph=glyph)]), "v", digits=5)


@query(f"""WITH {P_VECTOR}, {_cells(VECTORS)}, f AS (SELECT *, (x - (-0.5)) * (1.0::DOUBLE / 0.05) AS fc, (y - 0.5) * (1.0::DOUBLE / -0.05) AS fr FROM c),
    g AS (SELECT f.*, CAST(floor(fr) + dy AS INTEGER) AS gr, CAST(floor(fc) + dx AS INTEGER) AS gc, 1 - greatest(abs(dx - (fc - floor(fc))), abs(dy - (fr - floor(fr)))) / 2.5 AS w
        FROM f, range(-2, 3) a(dx), range(-2, 3) b(dy)),
    s AS (SELECT gr AS "row", gc AS col, w, value FROM g WHERE w >= 1e-6 AND gc BETWEEN 0 AND 19 AND gr BETWEEN 0 AND 19 AND {TILE})
    SELECT "row", col, CASE WHEN round(sum(value * w) / sum(w), 5) = 0 THEN 0 ELSE round(sum(value * w) / sum(w), 5) END AS v FROM s GROUP BY 1, 2""")
def glyph_custom_pyramid(spark, sf_dir):
    """A kernel of the caller's: a square pyramid."""
    glyph = custom_glyph(lambda dx, dy: 1 - F.greatest(F.abs(dx), F.abs(dy)) / 2.5, 2)
    return _round(reduce_points(vectors(spark, sf_dir), VECTORS, [Reduction("value", "weighted_average", band="v", glyph=glyph)]), "v", digits=5)


@query(CELL_SUM_SQL)
def redelivered_after_compaction(spark, sf_dir):
    """Batches that a base has already taken are not counted a second time."""
    from cellmill.streaming.state import StateStore

    store, cloud = StateStore(spark, _folder(spark), LINEITEM, CELL_SUM), lineitem(spark, sf_dir)
    for k in (0, 1):
        store.ingest(cloud.where(F.col("okey") % 3 == k), k)
    store.compact()
    store.ingest(cloud.where("okey % 3 = 1"), 1)
    store.ingest(cloud.where("okey % 3 = 2"), 2)
    return _round(store.result(), "v")
