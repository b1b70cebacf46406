"""What the corpus operators share: the shared folder, written tables, sizing and Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    The cluster names it in ``spark.checkpoint.dir``.  Where it is unset, a
    temporary folder is used in local mode only; a cluster without the setting
    is an error, because a machine-local folder would lose data there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="cellmill-")
    return f"file://{_LOCAL[app]}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/cellmill/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends here, and a lost executor costs nothing that is written."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    if _OPEN:
        _OPEN[-1].paths[path] = out
    return out


class scratch:  # noqa: N801
    """Tables that are written inside the block are deleted at its end, but for those that are kept; these belong to the
    block around it, if there is one."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.kept = spark, {}, {}

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept |= {p: d for p, d in self.paths.items() if d is df}
        return df

    def __enter__(self) -> scratch:
        _OPEN.append(self)
        return self

    def __exit__(self, kind, *_) -> None:
        _OPEN.pop()
        if _OPEN:
            _OPEN[-1].paths |= self.kept
        for path in self.paths.keys() - self.kept.keys() if kind is None else ():
            delete(self.spark, path)


_OPEN: list[scratch] = []


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def open_shared(uri: str):
    """(pyarrow file system, path) of a folder or file in the shared store."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def slots(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(df: DataFrame, text_col: str):
    """Null counts as empty."""
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))
