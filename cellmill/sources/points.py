"""Point tables from files and arrays."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, NumericType, StructField, StructType

from cellmill.functions.grid import BBox

_BY_END = {".csv": "csv", ".txt": "csv", ".las": "las", ".laz": "laz", ".parquet": "parquet"}


def detect_format(path: str) -> str:
    """By the name's end in any case, else by the first bytes, else csv."""
    from cellmill.sources.binary import ENDING, MAGIC_BYTES

    end = os.path.splitext(path.rstrip("/"))[1].lower()
    if end == ENDING:
        return "binary"
    if end in _BY_END:
        return _BY_END[end]
    try:
        with open(path.removeprefix("file://"), "rb") as f:
            head = f.read(4)
    except OSError:
        head = b""
    return {MAGIC_BYTES: "binary", b"LASF": "las", b"PAR1": "parquet"}.get(head, "csv")


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A header, then numbers; the first two columns are x and y and all are double.

    columns: the header's names, where they are known; else the first line is read for them.
    """
    if columns is None:
        first = spark.read.text(path).first()
        columns = [c.strip() for c in first[0].split(",")] if first else []
    if [c.lower() for c in columns[:2]] != ["x", "y"]:
        raise ValueError("the first two columns must be x and y")
    if len(set(columns)) < len(columns):
        raise ValueError("column names repeat")
    schema = StructType([StructField(c, DoubleType()) for c in columns])
    return spark.read.csv(path, schema, header=True, mode="FAILFAST", ignoreLeadingWhiteSpace=True, enforceSchema=True)


def write_csv(points: DataFrame, path: str) -> None:
    """x and y first; every other column must be numeric."""
    rest = [c for c in points.columns if c not in ("x", "y")]
    for c in rest:
        if not isinstance(points.schema[c].dataType, NumericType):
            raise ValueError(f"channel {c!r} is not numeric")
    points.select("x", "y", *rest).write.csv(path, header=True, mode="overwrite")


def csv_info(spark: SparkSession, path: str) -> dict:
    df = read_csv(spark, path)
    return {"points": df.count(), "channels": df.columns[2:]}


def read_points(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    from cellmill.sources import binary, las

    fmt = fmt or detect_format(path)
    if fmt == "csv":
        return read_csv(spark, path)
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt == "binary":
        return binary.read_binary(spark, path)
    if fmt == "las":
        return las.read_las(spark, path)
    raise NotImplementedError(f"no reader for {fmt}")


def from_arrays(spark: SparkSession, x: np.ndarray, y: np.ndarray, **channels: np.ndarray) -> DataFrame:
    """A point table from arrays of equal length; unsigned integers widen."""
    import pyarrow as pa

    sizes = {len(a) for a in (x, y, *channels.values())}
    if len(sizes) > 1:
        raise ValueError(f"arrays differ in length: {sorted(sizes)}")
    if {"x", "y"} & channels.keys():
        raise ValueError("x and y are no channels")
    wide = {"uint8": np.int16, "uint16": np.int32, "uint32": np.int64}
    columns = {k: np.asarray(v).astype(wide.get(np.asarray(v).dtype.name, np.asarray(v).dtype)) for k, v in channels.items()}
    return spark.createDataFrame(pa.table({"x": np.asarray(x, np.float64), "y": np.asarray(y, np.float64), **columns}))


def from_dataframe(df: DataFrame, x: str, y: str, **channels: str) -> DataFrame:
    """Any table as points: x, y and the named channels.  Columns keep their types where they have the right one, so that
    range predicates still reach the reader."""
    as_double = lambda c: F.col(c) if isinstance(df.schema[c].dataType, DoubleType) else F.col(c).cast("double")
    return df.select(as_double(x).alias("x"), as_double(y).alias("y"), *[F.col(f"`{c}`").alias(name) for name, c in channels.items()])


class CsvReader:
    """Reads a CSV file in chunks of rows, in one process; all columns are double."""

    def __init__(self, path: str):
        self.path = path.removeprefix("file://")
        self.rewind()

    def rewind(self) -> None:
        import pyarrow as pa
        from pyarrow import csv

        with open(self.path, encoding="utf-8") as f:
            self.columns = [c.strip() for c in f.readline().split(",")]
        if [c.lower() for c in self.columns[:2]] != ["x", "y"]:
            raise ValueError("the first two columns must be x and y")
        types = csv.ConvertOptions(column_types={c: pa.float64() for c in self.columns})
        self._stream = csv.open_csv(self.path, csv.ReadOptions(column_names=self.columns, skip_rows=1), convert_options=types)
        self._rest = None
        self._more()

    def _more(self) -> None:
        import pyarrow as pa

        try:
            batch = self._stream.read_next_batch()
        except StopIteration:
            self._over = True
            return
        self._over = False
        self._rest = batch if not self._rest or not self._rest.num_rows else pa.Table.from_batches([self._rest, batch]).combine_chunks().to_batches()[0]

    @property
    def eof(self) -> bool:
        return self._over and not (self._rest and self._rest.num_rows)

    def read_chunk(self, rows: int):
        while not self._over and (self._rest is None or self._rest.num_rows < rows):
            self._more()
        out, self._rest = self._rest.slice(0, rows), self._rest.slice(rows)
        return out


def open_points(path: str):
    """A reader of chunks by the file's format: eof, read_chunk(rows), rewind()."""
    from cellmill.sources.binary import CloudReader

    fmt = detect_format(path)
    if fmt not in ("binary", "csv"):
        raise NotImplementedError(f"no chunk reader for {fmt}")
    return CloudReader(path) if fmt == "binary" else CsvReader(path)


def combined_bbox(points: DataFrame, x: str = "x", y: str = "y") -> BBox:
    """The box of all points, in one aggregation; empty for none.  NaN coordinates don't count."""
    real = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    r = points.agg(F.min(real(x)), F.min(real(y)), F.max(real(x)), F.max(real(y))).first()
    return BBox() if r[0] is None or r[1] is None else BBox(*map(float, r))
