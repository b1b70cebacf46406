"""Streams of points into a state store.

States are bounded by the grid, so no watermark is needed.  The batch number of
the stream names the batch of the store: after a failure Spark delivers a batch
again under its number, and the store replaces it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from cellmill.functions.filters import FilterSpec
from cellmill.functions.grid import GridSpec
from cellmill.functions.reductions import Reduction
from cellmill.operators.reduce import finalize_states, partial_states
from cellmill.streaming.state import StateStore


@dataclass(frozen=True)
class Progress:
    """What a callback hears after each batch."""

    batch_id: int
    points: int
    batches: int


def read_stream(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """A folder of files as a stream of chunks."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def ingest_stream(
    points: DataFrame, store: StateStore, checkpoint: str, filters: FilterSpec | None = None, x: str = "x", y: str = "y",
    on_progress: Callable[[Progress], bool | None] | None = None, available_now: bool = True,
) -> StreamingQuery:
    """Folds each micro-batch into the store.  A callback that returns False cancels after the batch it heard of."""
    seen = {"points": 0, "batches": 0, "cancelled": False}

    def take(batch: DataFrame, batch_id: int) -> None:
        if seen["cancelled"]:
            raise InterruptedError("cancelled by the progress callback")
        batch = (filters or FilterSpec()).apply(batch)
        if on_progress is None:
            store.ingest(batch, batch_id, None, x, y)
            return
        batch = batch.persist()
        try:
            store.ingest(batch, batch_id, None, x, y)
            seen["points"] += batch.count()
        finally:
            batch.unpersist()
        seen["batches"] += 1
        seen["cancelled"] = on_progress(Progress(batch_id, seen["points"], seen["batches"])) is False

    writer = points.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def live_cells(points: DataFrame, grid: GridSpec, reductions: list[Reduction], filters: FilterSpec | None = None, x: str = "x", y: str = "y") -> DataFrame:
    """A streaming raster (output modes complete and update), its states in Spark's own state store."""
    if any(not r.mergeable for r in reductions):
        raise ValueError("only mergeable reductions can be streamed")
    if len({r.glyph for r in reductions}) > 1:
        raise ValueError("a stream takes one footprint")
    return finalize_states(partial_states(points, grid, reductions, filters, x, y), reductions)


def windowed_cells(
    points: DataFrame, grid: GridSpec, reductions: list[Reduction], time_col: str, window: str, late: str, x: str = "x", y: str = "y"
) -> DataFrame:
    """A raster per event-time window; a watermark closes windows and drops what comes later than ``late``."""
    placed = grid.assign(points.withWatermark(time_col, late), x, y)
    aggs = [s.alias(f"{r.name}__s{k}") for r in reductions for k, s in enumerate(r.partial())]
    states = placed.groupBy(F.window(time_col, window), "row", "col").agg(*aggs)
    bands = [r.finalize([F.col(f"`{r.name}__s{k}`") for k in range(r.states)]).alias(r.name) for r in reductions]
    return states.select(F.col("window.start").alias("window_start"), "row", "col", *bands)
