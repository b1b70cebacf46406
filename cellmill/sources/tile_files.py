"""States of one tile as a binary file, for exchange; the engine's own states are Parquet (cellmill.streaming.state)."""

from __future__ import annotations

import glob
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmill.functions.grid import GridSpec

#: Fixed values of the format: magic, version, and the reductions' codes in order.
MAGIC, VERSION = 0x54524350, 1
KINDS = ("sum", "max", "min", "average", "weighted_average", "count", "median", "percentile", "most_recent", "priority_merge", "custom")
_HEAD = struct.Struct("<IIiiiiiB7x")


@dataclass(frozen=True)
class TileHeader:
    tile_row: int
    tile_col: int
    cols: int
    rows: int
    states: int
    kind: str


def tile_file(folder: str, tile_row: int, tile_col: int) -> str:
    return f"{folder.rstrip('/')}/tile_{tile_row:04d}_{tile_col:04d}.tile"


def write_tile(path: str, head: TileHeader, states: np.ndarray) -> None:
    """states: (states, rows, cols), stored as float32, one state after another."""
    if states.shape != (head.states, head.rows, head.cols):
        raise ValueError(f"states have the shape {states.shape}")
    with open(path, "wb") as f:
        f.write(_HEAD.pack(MAGIC, VERSION, head.tile_row, head.tile_col, head.cols, head.rows, head.states, KINDS.index(head.kind)))
        f.write(np.ascontiguousarray(states, "<f4").tobytes())


def read_tile_header(path: str) -> TileHeader:
    with open(path, "rb") as f:
        raw = f.read(_HEAD.size)
    if len(raw) < _HEAD.size:
        raise ValueError(f"{path}: too short")
    magic, version, *rest, kind = _HEAD.unpack(raw)
    if magic != MAGIC or version != VERSION or kind >= len(KINDS):
        raise ValueError(f"{path}: no tile of version {VERSION}")
    return TileHeader(*rest, KINDS[kind])


def read_tile(path: str) -> tuple[TileHeader, np.ndarray]:
    head = read_tile_header(path)
    states = np.fromfile(path, "<f4", offset=_HEAD.size)
    if states.size < head.states * head.rows * head.cols:
        raise ValueError(f"{path}: cut off")
    return head, states[: head.states * head.rows * head.cols].reshape(head.states, head.rows, head.cols)


def tile_rows(spark: SparkSession, path: str, tile_width: int, tile_height: int, names: list[str]) -> DataFrame:
    """A tile, or all tiles of a folder, as rows of global row, col and one column per state; each task reads some files.
    All executors must see the path."""
    plain = path.removeprefix("file://")
    files = sorted(glob.glob(f"{plain}/*.tile")) if os.path.isdir(plain) else [plain]
    for f in files[:1]:
        if read_tile_header(f).states != len(names):
            raise ValueError(f"{f}: the tile has other states than {names}")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.column(0).to_pylist():
                head, states = read_tile(f)
                r, c = np.indices((head.rows, head.cols), np.int32)
                columns = [(r + head.tile_row * tile_height).ravel(), (c + head.tile_col * tile_width).ravel()]
                columns += [s.astype(np.float64).ravel() for s in states]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["row", "col", *names])

    listed = spark.createDataFrame([(f,) for f in files], "path string").repartition(max(1, min(len(files), 4096)))
    return listed.mapInArrow(read, "row int, col int" + "".join(f", `{n}` double" for n in names))


def write_tiles(states: DataFrame, grid: GridSpec, folder: str, kind: str, names: list[str]) -> DataFrame:
    """Every tile that has states as a file; path of each.  Cells without a state hold NaN.  All executors must see the folder."""
    plain = folder.removeprefix("file://").rstrip("/")
    placed = states.select(grid.tile_row().alias("_tr"), grid.tile_col().alias("_tc"), "row", "col", *[F.col(f"`{n}`").cast("double").alias(n) for n in names])

    def save(t: pa.Table) -> pa.Table:
        tr, tc = t.column("_tr")[0].as_py(), t.column("_tc")[0].as_py()
        top, left, rows, cols = grid.tile_cells(tr, tc)
        values = np.full((len(names), rows, cols), np.nan, "<f4")
        for k, n in enumerate(names):
            values[k, t.column("row").to_numpy() - top, t.column("col").to_numpy() - left] = t.column(n).to_numpy()
        os.makedirs(plain, exist_ok=True)
        path = tile_file(plain, tr, tc)
        partial = f"{path}.{uuid.uuid4().hex}"
        write_tile(partial, TileHeader(tr, tc, cols, rows, len(names), kind), values)
        os.replace(partial, path)
        return pa.table({"path": [path]})

    done = placed.groupBy("_tr", "_tc").applyInArrow(save, "path string").collect()
    return states.sparkSession.createDataFrame(done, "path string")
