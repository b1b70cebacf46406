from __future__ import annotations

import math
import struct

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellmill.functions.crs import CRS
from cellmill.functions.grid import BBox, GridSpec
from cellmill.functions.reductions import Reduction
from cellmill.operators.reduce import reduce_points
from cellmill.sources import binary, geotiff, las, points, synth, tile_files

BOX = BBox(0, 0, 20, 10)


@pytest.fixture(scope="module")
def cloud(spark):
    return spark.range(1000).select(F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("y"), (F.col("id") * 0.1).cast("float").alias("v"), F.col("id").cast("int").alias("k"))


def test_csv(spark, cloud, tmp_path):
    path = str(tmp_path / "c.csv")
    points.write_csv(cloud.union(spark.createDataFrame([(1.0, 2.0, float("nan"), 3)], cloud.schema)), path)
    back = points.read_points(spark, path)
    assert back.columns == ["x", "y", "v", "k"] and {t for _, t in back.dtypes} == {"double"} and points.csv_info(spark, path) == {"points": 1001, "channels": ["v", "k"]}
    assert back.where("isnan(v)").count() == 1 and back.where("v = k * 0.1D OR abs(v - k / 10) < 1e-5").count() >= 1000
    (tmp_path / "bad.csv").write_text("a,y\n1,2\n")
    (tmp_path / "junk.csv").write_text("x,y\n1,abc\n")
    with pytest.raises(ValueError):
        points.read_csv(spark, str(tmp_path / "bad.csv"))
    with pytest.raises(Exception, match="abc"):
        points.read_csv(spark, str(tmp_path / "junk.csv")).collect()
    with pytest.raises(ValueError):
        points.write_csv(cloud.withColumn("s", F.lit("a")), path)


def test_binary(spark, cloud, tmp_path):
    folder = str(tmp_path / "b")
    assert binary.write_binary(cloud.repartition(3), folder, "WKT").agg(F.sum("points")).first()[0] == 1000
    back = binary.read_binary(spark, folder, rows=100)
    assert back.rdd.getNumPartitions() >= 10 and sorted(map(tuple, back.collect())) == sorted(map(tuple, cloud.collect()))
    assert binary.read_binary(spark, folder, ["y", "k"]).agg(F.sum("y"), F.sum("k")).first() == (999000.0, 499500)
    one = sorted((tmp_path / "b").iterdir())[0]
    head = binary.read_header(str(one))
    assert head.wkt == "WKT" and head.channels == (("v", 0), ("k", 2))
    reader = binary.CloudReader(str(one))
    chunks = []
    while not reader.eof:
        chunks.append(reader.read_chunk(7))
    whole = pa.Table.from_batches(chunks)
    assert whole.num_rows == head.points and (whole["y"].to_numpy() == 2 * whole["x"].to_numpy()).all()
    reader.rewind()
    assert reader.read_chunk(10**9).num_rows == head.points
    raw = one.read_bytes()
    for bad in (raw[:10], b"x" * 50, raw[:-1]):
        (tmp_path / "bad").write_bytes(bad)
        with pytest.raises(ValueError):
            binary.read_header(str(tmp_path / "bad"))
    binary.write_cloud(str(tmp_path / "u.cloud"), pa.table({"x": [1.0], "y": [2.0], "a": pa.array([200], pa.uint8()), "b": pa.array([60000], pa.uint16())}))
    assert binary.read_binary(spark, str(tmp_path / "u.cloud")).first() == (1.0, 2.0, 200, 60000)


def test_chunk_readers(tmp_path):
    n = 1000
    table = pa.table({"x": np.arange(n) * 1.0, "y": np.arange(n) * 2.0, "v": np.arange(n) * 0.5})
    binary.write_cloud(str(tmp_path / "a.cloud"), table)
    (tmp_path / "a.csv").write_text("x,y,v\n" + "".join(f"{i}.0,{2 * i},{i / 2}\n" for i in range(n)))
    for name in ("a.cloud", "a.csv"):
        reader = points.open_points(str(tmp_path / name))
        for _ in range(2):
            chunks = []
            while not reader.eof:
                chunks.append(reader.read_chunk(300))
            assert [c.num_rows for c in chunks] == [300, 300, 300, 100] and pa.Table.from_batches(chunks).equals(table)
            reader.rewind()
    (tmp_path / "b.csv").write_text("y,x\n1,2\n")
    with pytest.raises(ValueError):
        points.open_points(str(tmp_path / "b.csv"))
    with pytest.raises(NotImplementedError):
        points.open_points("a.las")


def test_detection(spark, cloud, tmp_path):
    binary.write_cloud(str(tmp_path / "named.dat"), pa.table({"x": [1.0], "y": [2.0]}))
    (tmp_path / "las.bin").write_bytes(b"LASF")
    for name, want in (("a.CSV", "csv"), ("a.LAZ", "laz"), ("b.cloud", "binary"), ("named.dat", "binary"), ("las.bin", "las"), ("none", "csv"), ("p.parquet", "parquet")):
        assert points.detect_format(str(tmp_path / name)) == want


def test_las(spark, tmp_path):
    r = np.random.default_rng(1)
    x, y, z = r.uniform(1000, 2000, (3, 500))
    kind = r.integers(1, 4, 500)
    las.write_las(str(tmp_path / "a.las"), x, y, z, np.arange(500), kind)
    back = las.read_las(spark, str(tmp_path), rows=77).orderBy("intensity").toPandas()
    assert len(back) == 500 and np.allclose(back["x"], x, atol=6e-4) and np.allclose(back["z"], z, atol=6e-4) and (back["classification"] == kind).all()
    assert las.read_las(spark, str(tmp_path / "a.las"), ground_only=True).count() == (kind == 2).sum()
    head = las.read_las_header(str(tmp_path / "a.las"))
    assert head.points == 500 and head.bounds[1] == pytest.approx(x.min())
    raw = bytearray((tmp_path / "a.las").read_bytes())
    raw[104] |= 0x80
    (tmp_path / "c.las").write_bytes(raw)
    with pytest.raises(NotImplementedError):
        las.read_las_header(str(tmp_path / "c.las"))
    with pytest.raises(NotImplementedError):
        las.read_las(spark, "x.laz")


def test_las_newer_records(tmp_path):
    head = bytearray(375)
    head[:4], head[24:26] = b"LASF", bytes([1, 4])
    struct.pack_into("<H", head, 94, 375), struct.pack_into("<I", head, 96, 375), struct.pack_into("<BHI", head, 104, 6, 30, 0)
    struct.pack_into("<12d", head, 131, 0.01, 0.01, 0.01, *([0.0] * 9)), struct.pack_into("<Q", head, 247, 1)
    record = struct.pack("<iiiHBBBBhHd", 123, 456, 789, 7, 0x21, 0, 2, 0, 0, 0, 5.5)
    (tmp_path / "n.las").write_bytes(bytes(head) + record)
    h = las.read_las_header(str(tmp_path / "n.las"))
    got = las.read_las_rows(str(tmp_path / "n.las"), h, 0, 1).to_pylist()[0]
    assert h.points == 1 and (got["x"], got["classification"], got["return_number"], got["gps_time"], got["intensity"]) == (1.23, 2, 1, 5.5, 7)


def test_arrays_and_frames(spark):
    df = points.from_arrays(spark, np.array([1, 2]), np.array([3.0, 4.0]), a=np.array([250, 3], np.uint8), b=np.array([1, 2], np.uint32))
    assert dict(df.dtypes) == {"x": "double", "y": "double", "a": "smallint", "b": "bigint"} and df.first() == (1.0, 3.0, 250, 1)
    with pytest.raises(ValueError):
        points.from_arrays(spark, np.zeros(2), np.zeros(3))
    other = points.from_dataframe(df, "b", "y", value="a")
    assert dict(other.dtypes) == {"x": "double", "y": "double", "value": "smallint"}
    assert points.combined_bbox(df) == BBox(1, 3, 2, 4) and points.combined_bbox(df.where("false")) == BBox()
    grid = GridSpec.around(points.combined_bbox(df), 0.5)
    assert grid.bounds == BBox(0.5, 2.5, 2.5, 4.5) and grid.width == 4


@pytest.mark.parametrize("compress", ["NONE", "DEFLATE", "LZW", "ZSTD"])
def test_geotiff(spark, tmp_path, compress):
    grid = GridSpec.of(500, 1000, 500 + 700 * 2, 1000 + 600 * 2, 2, -2, crs=CRS.from_epsg(32610))
    r = np.random.default_rng(2)
    rows = [(int(a), int(b), float(np.float32(v)), float("inf")) for a, b, v in zip(r.integers(0, 600, 400), r.integers(0, 300, 400), r.normal(size=400), strict=True)]
    raster = spark.createDataFrame(list({(a, b): (a, b, v, w) for a, b, v, w in rows}.values()), "row int, col int, mean double, `a & b` float")
    path = str(tmp_path / "r.tif")
    geotiff.write_geotiff(raster, grid, path, geotiff.GeoTiffOptions(compress, 64, overviews=True))
    info = geotiff.read_geotiff_info(path)
    assert (info.width, info.height, info.bands, info.crs.epsg, info.bounds, info.levels) == (700, 600, ("mean", "a & b"), 32610, grid.bounds, 2)
    back = geotiff.read_geotiff(spark, path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, raster.collect()))
    a = geotiff.read_geotiff_band(path, 0)
    assert a.shape == (600, 700) and np.isnan(a).sum() == a.size - raster.count()
    assert geotiff.read_geotiff(spark, path, skip_nan=False).count() == 420_000


def test_tiled_writer(tmp_path):
    grid, path = GridSpec.of(0, 0, 20, 10, 1, -1), str(tmp_path / "t.tif")
    writer = geotiff.TiledGeoTiffWriter(path, grid, ["v"], geotiff.GeoTiffOptions("DEFLATE", 16))
    writer.write_tile(0, 1, np.ones((1, 10, 4), np.float32))
    writer.close()
    a = geotiff.read_geotiff_band(path)
    assert (a[:, 16:] == 1).all() and np.isnan(a[:, :16]).all()
    (tmp_path / "bad.tif").write_bytes(b"nothing")
    with pytest.raises(ValueError):
        geotiff.read_geotiff_info(str(tmp_path / "bad.tif"))


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300) | st.integers(0, 40000).map(lambda n: np.random.default_rng(n).integers(0, 1 + n % 256, n).astype(np.uint8).tobytes()))
def test_lzw_round_trip(data):
    assert geotiff.unlzw(geotiff.lzw(data)) == data


def test_tile_files(spark, tmp_path):
    path = tile_files.tile_file(str(tmp_path), 2, 13)
    assert path.endswith("tile_0002_0013.tile")
    head = tile_files.TileHeader(2, 13, 3, 2, 2, "average")
    states = np.arange(12, dtype=np.float32).reshape(2, 2, 3)
    states[0, 0, 0] = np.nan
    tile_files.write_tile(path, head, states)
    got, back = tile_files.read_tile(path)
    assert got == head == tile_files.read_tile_header(path) and np.array_equal(back, states, equal_nan=True)
    assert tile_files.tile_rows(spark, path, 3, 2, ["s", "n"]).where("row = 5 AND col = 41").first() == (5, 41, 5.0, 11.0)
    raw = open(path, "rb").read()
    for bad in (raw[:20], b"abcd" + raw[4:]):
        open(path, "wb").write(bad)
        with pytest.raises(ValueError):
            tile_files.read_tile_header(path)
    open(path, "wb").write(raw[:-4])
    with pytest.raises(ValueError):
        tile_files.read_tile(path)


def test_patterns(spark):
    grid = GridSpec.of(0, 0, 20, 10, 1, -1)
    mean = [Reduction("value", band="v")]
    cells = lambda df: {(r.row, r.col): r.v for r in reduce_points(df, grid, mean).collect()}
    board = cells(synth.checkerboard(spark, BOX, square=5))
    assert all(v == (100.0 if (c // 5 + (9 - r) // 5) % 2 == 0 else 0.0) for (r, c), v in board.items()) and len(board) > 190
    assert all(v == (100.0 if c // 5 % 2 == 0 else 0.0) for (r, c), v in cells(synth.stripes(spark, BOX, orientation="vertical")).items())
    flat = synth.uniform(spark, BOX, per_cell=3)
    assert flat.count() == 600 and set(cells(flat).values()) == {50.0}
    assert sorted(map(tuple, flat.collect())) == sorted(map(tuple, synth.uniform(spark, BOX, per_cell=3).collect()))
    ramp = cells(synth.gradient(spark, BOX, per_cell=30))
    assert ramp[5, 0] < 10 < 90 < ramp[5, 19]
    near = cells(synth.gradient(spark, BOX, kind="radial", per_cell=30))
    assert near[4, 9] < 25 and near[0, 0] == 100
    rings = cells(synth.bullseye(spark, BOX, per_cell=30, rings=1))
    assert set(rings.values()) == {100.0}
    assert set(cells(synth.shape(spark, BOX, per_cell=5)).values()) >= {0.0, 100.0}
    letters = cells(synth.text(spark, BOX, "LI", per_cell=20))
    assert letters[9, 1] == 100.0 and letters[0, 4] == 0.0
    slope = cells(synth.plane(spark, BOX, noise=0.0, per_cell=50))
    assert slope[0, 19] > slope[9, 0]
    spots = synth.clusters(spark, BOX, n=3, per_cluster=50)
    assert spots.count() == 150 and {r.value for r in spots.select("value").distinct().collect()} == {0.0, 50.0, 100.0}
    assert spots.where(f"x < 0 OR x > {BOX.max_x} OR y < 0 OR y > {BOX.max_y}").count() == 0
    sizes = {k: synth.edge_case(spark, BOX, k).count() for k in ("single_point", "cell_boundaries", "sparse", "dense")}
    assert sizes == {"single_point": 1, "cell_boundaries": 10, "sparse": 60, "dense": 10000}
    mixed = {(9 - r.row + r.col) % 3: r.n for r in reduce_points(synth.edge_case(spark, BOX, "mixed_density"), grid, [Reduction("value", "count", band="n")]).collect()}
    assert set(mixed) == {1, 2} and mixed[1] <= 5 and 100 <= mixed[2] <= 1000
    for bad in (lambda: synth.stripes(spark, BOX, orientation="x"), lambda: synth.gradient(spark, BOX, kind="x"), lambda: synth.shape(spark, BOX, "x"), lambda: synth.text(spark, BOX, "?"), lambda: synth.edge_case(spark, BOX, "x")):
        with pytest.raises(ValueError):
            bad()
    assert math.isclose(spots.agg(F.avg("value")).first()[0], 50.0)
