"""A column-wise binary point file, read by row ranges and columns.

Layout, little-endian: magic u32, version u32, points u64, channels u32, length
of the WKT u32, the WKT; per channel the length of its name u16, the name and a
type code u8; then x and y as f64 and each channel as an array.  Any range of
rows of any column lies at a known place, so a reader seeks to what it needs.
"""

from __future__ import annotations

import glob
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Fixed values of the format.
MAGIC, VERSION = 0x50524350, 1
MAGIC_BYTES = struct.pack("<I", MAGIC)
ENDING = ".cloud"
_HEAD = struct.Struct("<IIQII")
#: Type codes, in order, with the type here and in Spark (which has no unsigned types).
TYPES = [("<f4", "float"), ("<f8", "double"), ("<i4", "int"), ("<u4", "bigint"), ("<i2", "smallint"), ("<u2", "int"), ("u1", "smallint")]


@dataclass(frozen=True)
class CloudHeader:
    points: int
    wkt: str
    channels: tuple[tuple[str, int], ...]
    body: int

    def place(self, column: str) -> tuple[int, np.dtype, str]:
        at = self.body
        for name, code in (("x", 1), ("y", 1), *self.channels):
            kind = np.dtype(TYPES[code][0])
            if name == column:
                return at, kind, TYPES[code][1]
            at += self.points * kind.itemsize
        raise KeyError(column)

    @property
    def schema(self) -> str:
        return ", ".join(f"`{n}` {TYPES[c][1]}" for n, c in (("x", 1), ("y", 1), *self.channels))

    @property
    def size(self) -> int:
        return self.body + self.points * (16 + sum(np.dtype(TYPES[c][0]).itemsize for _, c in self.channels))


def read_header(path: str) -> CloudHeader:
    """The header alone; raises ValueError for anything that is no whole point file."""
    path = path.removeprefix("file://")
    with open(path, "rb") as f:
        raw = f.read(_HEAD.size)
        if len(raw) < _HEAD.size:
            raise ValueError(f"{path}: too short")
        magic, version, points, n, wkt_size = _HEAD.unpack(raw)
        if magic != MAGIC or version != VERSION:
            raise ValueError(f"{path}: no point file of version {VERSION}")
        wkt, channels = f.read(wkt_size).decode(), []
        for _ in range(n):
            (size,) = struct.unpack("<H", f.read(2))
            name = f.read(size).decode()
            code = f.read(1)[0]
            if code >= len(TYPES):
                raise ValueError(f"{path}: unknown type code {code}")
            channels.append((name, code))
        head = CloudHeader(points, wkt, tuple(channels), f.tell())
    if os.path.getsize(path) < head.size:
        raise ValueError(f"{path}: cut off")
    return head


def read_rows(path: str, head: CloudHeader, start: int, count: int, columns: list[str]) -> pa.RecordBatch:
    """Rows start .. start + count - 1 of some columns."""
    arrays = []
    with open(path.removeprefix("file://"), "rb") as f:
        for c in columns:
            at, kind, spark = head.place(c)
            f.seek(at + start * kind.itemsize)
            a = np.frombuffer(f.read(count * kind.itemsize), kind)
            wide = {"float": "f4", "double": "f8", "int": "i4", "bigint": "i8", "smallint": "i2"}[spark]
            arrays.append(pa.array(a.astype(wide)))
    return pa.RecordBatch.from_arrays(arrays, columns)


class CloudReader:
    """Reads a file in chunks of rows."""

    def __init__(self, path: str):
        self.path, self.head, self.at = path, read_header(path), 0

    @property
    def eof(self) -> bool:
        return self.at >= self.head.points

    def rewind(self) -> None:
        self.at = 0

    def read_chunk(self, rows: int) -> pa.RecordBatch:
        n = min(rows, self.head.points - self.at)
        out = read_rows(self.path, self.head, self.at, n, ["x", "y", *[c for c, _ in self.head.channels]])
        self.at += n
        return out


def write_cloud(path: str, table: pa.Table, wkt: str = "") -> None:
    """One file from a table with x and y, written by this process."""
    codes = {"float": 0, "double": 1, "int32": 2, "int64": 3, "int16": 4, "uint32": 3, "uint16": 5, "uint8": 6}
    rest = [c for c in table.column_names if c not in ("x", "y")]
    channels = []
    for c in rest:
        kind = str(table.schema.field(c).type)
        if kind not in codes:
            raise ValueError(f"channel {c!r} of type {kind} has no code")
        channels.append((c, codes[kind]))
    raw = wkt.encode()
    with open(path.removeprefix("file://"), "wb") as f:
        f.write(_HEAD.pack(MAGIC, VERSION, table.num_rows, len(rest), len(raw)) + raw)
        for name, code in channels:
            f.write(struct.pack("<H", len(name.encode())) + name.encode() + bytes([code]))
        for name, code in (("x", 1), ("y", 1), *channels):
            values = table.column(name).to_numpy()
            kind = np.dtype(TYPES[code][0])
            if kind.kind == "u" and len(values) and (values.min() < 0 or values.max() > np.iinfo(kind).max):
                raise ValueError(f"channel {name!r} does not fit {kind}")
            f.write(np.ascontiguousarray(values, kind).tobytes())


def _files(path: str) -> list[str]:
    path = path.removeprefix("file://")
    if os.path.isdir(path):
        return sorted(glob.glob(os.path.join(path, f"*{ENDING}")))
    return sorted(glob.glob(path)) or [path]


@dataclass
class _Rows(InputPartition):
    path: str
    start: int
    count: int

    def __init__(self, path: str, start: int, count: int):
        self.path, self.start, self.count = path, start, count


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.files = _files(options["path"])
        self.columns = [f.name for f in schema.fields]
        self.rows = int(options.get("rows", 1_000_000))

    def partitions(self):
        out = []
        for path in self.files:
            n = read_header(path).points
            out += [_Rows(path, a, min(self.rows, n - a)) for a in range(0, n, self.rows)]
        return out

    def read(self, part: _Rows) -> Iterator[pa.RecordBatch]:
        head, step = read_header(part.path), 65_536
        for a in range(part.start, part.start + part.count, step):
            yield read_rows(part.path, head, a, min(step, part.start + part.count - a), self.columns)


class CloudSource(DataSource):
    """spark.read.format("cellcloud").load(path); a given schema reads only its columns."""

    @classmethod
    def name(cls) -> str:
        return "cellcloud"

    def schema(self) -> str:
        return read_header(_files(self.options["path"])[0]).schema

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options), schema)


def read_binary(spark: SparkSession, path: str, columns: list[str] | None = None, rows: int = 1_000_000) -> DataFrame:
    """Point files as a table, one partition per so many rows.  columns: only these are read from the files."""
    spark.dataSource.register(CloudSource)
    reader = spark.read.format("cellcloud").option("rows", rows)
    if columns:
        head = read_header(_files(path)[0])
        reader = reader.schema(", ".join(f"`{c}` {head.place(c)[2]}" for c in columns))
    return reader.load(path)


def write_binary(points: DataFrame, folder: str, wkt: str = "", rows: int = 4_000_000) -> DataFrame:
    """Files of about ``rows`` points at most, from each partition one or more, in a folder that all executors see.  Returns
    path and points of each; a file gets its name when it is whole."""
    from pyspark import TaskContext

    folder = folder.removeprefix("file://")
    rest = [c for c in points.columns if c not in ("x", "y")]
    schema = points.select("x", "y", *rest).schema

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, held, n, files = TaskContext.get(), [], 0, 0

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            os.makedirs(folder, exist_ok=True)
            path = f"{folder}/part-{context.partitionId():05d}-{files:05d}{ENDING}"
            write_cloud(f"{path}.{context.taskAttemptId()}", table, wkt)
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

    done = points.select(*schema.names).mapInArrow(write, "path string, points long").collect()
    return points.sparkSession.createDataFrame(done, "path string, points long")
