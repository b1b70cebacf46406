"""LAS 1.2 to 1.4 point files (uncompressed), by row ranges."""

from __future__ import annotations

import glob
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

GROUND = 2  # fixed value: the class of ground points
SCHEMA = "x double, y double, z double, intensity int, classification int, return_number int, gps_time double"


@dataclass(frozen=True)
class LasHeader:
    points: int
    point_format: int
    record: int
    offset: int
    scale: tuple[float, float, float]
    shift: tuple[float, float, float]
    bounds: tuple[float, float, float, float, float, float]  # max x, min x, max y, min y, max z, min z


def read_las_header(path: str) -> LasHeader:
    with open(path.removeprefix("file://"), "rb") as f:
        raw = f.read(375)
    if raw[:4] != b"LASF" or len(raw) < 227:
        raise ValueError(f"{path}: no LAS file")
    minor = raw[25]
    (offset,) = struct.unpack_from("<I", raw, 96)
    form, record, legacy = struct.unpack_from("<BHI", raw, 104)
    if form & 0x80:
        raise NotImplementedError("compressed points (LAZ) cannot be read")
    points = legacy if minor < 4 or legacy else struct.unpack_from("<Q", raw, 247)[0]
    numbers = struct.unpack_from("<12d", raw, 131)
    return LasHeader(points, form, record, offset, numbers[:3], numbers[3:6], numbers[6:])


def read_las_rows(path: str, head: LasHeader, start: int, count: int) -> pa.RecordBatch:
    with open(path.removeprefix("file://"), "rb") as f:
        f.seek(head.offset + start * head.record)
        raw = np.frombuffer(f.read(count * head.record), np.uint8).reshape(-1, head.record)
    field = lambda at, kind: np.ascontiguousarray(raw[:, at : at + np.dtype(kind).itemsize]).view(kind).ravel()
    xyz = [field(4 * k, "<i4") * head.scale[k] + head.shift[k] for k in range(3)]
    new = head.point_format >= 6
    kind = field(16, "u1").astype(np.int32) if new else (field(15, "u1") & 31).astype(np.int32)
    returned = (field(14, "u1") & (15 if new else 7)).astype(np.int32)
    at = 22 if new else 20
    time = field(at, "<f8") if new or head.point_format in (1, 3, 4, 5) else np.full(len(raw), np.nan)
    columns = [*xyz, field(12, "<u2").astype(np.int32), kind, returned, time]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["x", "y", "z", "intensity", "classification", "return_number", "gps_time"])


class _Rows(InputPartition):
    def __init__(self, path: str, start: int, count: int):
        self.path, self.start, self.count = path, start, count


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        path = options["path"].removeprefix("file://")
        self.files = sorted(glob.glob(os.path.join(path, "*.la[sS]")) if os.path.isdir(path) else glob.glob(path)) or [path]
        self.rows = int(options.get("rows", 1_000_000))

    def partitions(self):
        heads = [(p, read_las_header(p).points) for p in self.files]
        return [_Rows(p, a, min(self.rows, n - a)) for p, n in heads for a in range(0, n, self.rows)]

    def read(self, part: _Rows) -> Iterator[pa.RecordBatch]:
        head, step = read_las_header(part.path), 65_536
        for a in range(part.start, part.start + part.count, step):
            yield read_las_rows(part.path, head, a, min(step, part.start + part.count - a))


class LasSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cellmill_las"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_las(spark: SparkSession, path: str, ground_only: bool = False, rows: int = 1_000_000) -> DataFrame:
    """A file, a pattern or a folder of LAS files."""
    if path.lower().endswith(".laz"):
        raise NotImplementedError("compressed points (LAZ) cannot be read")
    spark.dataSource.register(LasSource)
    df = spark.read.format("cellmill_las").option("rows", rows).load(path)
    return df.where(F.col("classification") == GROUND) if ground_only else df


def write_las(path: str, x: np.ndarray, y: np.ndarray, z: np.ndarray, intensity: np.ndarray, classification: np.ndarray, scale: float = 0.001) -> None:
    """LAS 1.2, point format 0; for tests and small exports."""
    n = len(x)
    low = [float(a.min()) if n else 0.0 for a in (x, y, z)]
    high = [float(a.max()) if n else 0.0 for a in (x, y, z)]
    head = bytearray(227)
    head[:4], head[24:26] = b"LASF", bytes([1, 2])
    struct.pack_into("<HII", head, 94, 227, 227, 0)
    struct.pack_into("<BHI", head, 104, 0, 20, n)
    bounds = [v for k in range(3) for v in (high[k], low[k])]
    struct.pack_into("<12d", head, 131, scale, scale, scale, *low, *bounds)
    rec = np.zeros(n, np.dtype([("xyz", "<i4", 3), ("i", "<u2"), ("f", "u1"), ("c", "u1"), ("rest", "u1", 4)]))
    for k, a in enumerate((x, y, z)):
        rec["xyz"][:, k] = np.rint((a - low[k]) / scale)
    rec["i"], rec["c"], rec["f"] = intensity, classification, 1
    with open(path.removeprefix("file://"), "wb") as f:
        f.write(bytes(head) + rec.tobytes())


def write_las_folder(points: DataFrame, folder: str, scale: float = 0.001, rows: int = 4_000_000) -> DataFrame:
    """x, y, z, intensity and classification as LAS files of about ``rows`` points at most in a folder that all executors see.
    Returns path and points of each; a file gets its name when it is whole."""
    from pyspark import TaskContext

    plain, names = folder.removeprefix("file://").rstrip("/"), ["x", "y", "z", "intensity", "classification"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, held, n, files = TaskContext.get(), [], 0, 0

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            os.makedirs(plain, exist_ok=True)
            path = f"{plain}/part-{context.partitionId():05d}-{files:05d}.las"
            write_las(f"{path}.{context.taskAttemptId()}", *[table.column(c).to_numpy() for c in names], scale)
            os.replace(f"{path}.{context.taskAttemptId()}", path)
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([table.num_rows], pa.int64())], ["path", "points"])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= rows:
                yield flush()
                held, n, files = [], 0, files + 1
        if n:
            yield flush()

    kinds = dict.fromkeys(names[:3], "double") | dict.fromkeys(names[3:], "int")
    done = points.select(*[F.col(c).cast(k).alias(c) for c, k in kinds.items()]).mapInArrow(write, "path string, points long").collect()
    return points.sparkSession.createDataFrame(done, "path string, points long")
