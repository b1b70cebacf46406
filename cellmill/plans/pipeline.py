"""A facade that gathers points in collections and hands out a raster."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce as fold

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmill.functions.filters import FilterSpec
from cellmill.functions.grid import GridSpec
from cellmill.functions.reductions import Reduction
from cellmill.operators import raster as R
from cellmill.operators.reduce import check, reduce_points
from cellmill.streaming.state import StateStore

log = logging.getLogger("cellmill")
#: Settings of hardware, which Spark decides by itself.
IGNORED = (
    "exec_mode", "gpu_memory_budget", "host_cache_budget", "chunk_size", "gpu_pool_size_bytes", "cuda_device_id", "use_cuda_streams",
    "gpu_fallback_to_cpu", "gpu_require_strict", "cpu_threads", "hybrid_cpu_threads", "target_crs", "auto_reproject",
)


@dataclass
class PipelineConfig:
    """grid, reductions and filter say what to compute.

    state_dir: keeps partial states there, so that later runs may resume; without it the collections stay lazy and are
    reduced together.  output_path: finalize writes a GeoTIFF (write_cog adds overviews and compression).
    hardware: settings in IGNORED, accepted without effect.
    """

    grid: GridSpec
    reductions: list[Reduction] = field(default_factory=list)
    filter: FilterSpec = field(default_factory=FilterSpec)
    state_dir: str | None = None
    reduction_id: str = "default"
    resume: bool = False
    output_path: str | None = None
    write_cog: bool = False
    x: str = "x"
    y: str = "y"
    hardware: dict = field(default_factory=dict)


@dataclass(frozen=True)
class ProgressInfo:
    collections_processed: int
    points_processed: int


class Pipeline:
    @classmethod
    def create(cls, spark: SparkSession, config: PipelineConfig) -> Pipeline:
        return cls(spark, config)

    def __init__(self, spark: SparkSession, config: PipelineConfig):
        self.spark, self.config = spark, config
        if unknown := set(config.hardware) - set(IGNORED):
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        if config.hardware:
            log.info("Spark decides about %s", ", ".join(sorted(config.hardware)))
        self.validate()
        c = config
        self._store = StateStore(spark, c.state_dir, c.grid, c.reductions, c.reduction_id, c.resume) if c.state_dir else None
        self._next = self._store.next_batch() if self._store else 0
        self._clouds: list[DataFrame] = []
        self._callback: Callable[[ProgressInfo], bool | None] | None = None
        self._collections = self._points = 0
        self._result: DataFrame | None = None

    def validate(self) -> None:
        self.config.grid.validate()
        if not self.config.reductions:
            raise ValueError("at least one reduction is needed")
        for r in self.config.reductions:
            r.check()

    def set_progress_callback(self, callback: Callable[[ProgressInfo], bool | None]) -> None:
        """Heard after each collection; False cancels, and the collection it heard of stays applied."""
        self._callback = callback

    def ingest(self, points: DataFrame) -> None:
        c = self.config
        check(points, c.reductions, c.x, c.y)
        passed = c.filter.apply(points)
        if self._store:
            self._store.ingest(passed, self._next, None, c.x, c.y)
            self._next += 1
        else:
            self._clouds.append(passed)
        self._collections += 1
        if self._callback:
            self._points += passed.count()
            if self._callback(ProgressInfo(self._collections, self._points)) is False:
                raise InterruptedError("cancelled by the progress callback")

    def finalize(self) -> DataFrame:
        """The sparse raster of all that was ingested."""
        c = self.config
        if self._store:
            self._result = self._store.result()
        elif self._clouds:
            cloud = fold(lambda a, b: a.unionByName(b, allowMissingColumns=True), self._clouds)
            self._result = reduce_points(cloud, c.grid, c.reductions, None, c.x, c.y)
        else:
            raise ValueError("nothing was ingested")
        if c.output_path:
            from cellmill.sources.geotiff import GeoTiffOptions, write_geotiff

            write_geotiff(self._result, c.grid, c.output_path, GeoTiffOptions(compress="DEFLATE" if c.write_cog else "NONE", overviews=c.write_cog))
        return self._result

    def run(self, clouds: Iterable[DataFrame]) -> DataFrame:
        for cloud in clouds:
            self.ingest(cloud)
        return self.finalize()

    def result(self) -> DataFrame | None:
        return self._result

    def dense(self, empty_sum: str = "nan") -> DataFrame:
        sums = tuple(r.name for r in self.config.reductions if r.kind == "sum")
        return R.to_dense(self._done(), self.config.grid, empty_sum, sums)

    def band_array(self, band: str) -> np.ndarray:
        return R.to_numpy(self._done(), self.config.grid, band)

    def _done(self) -> DataFrame:
        if self._result is None:
            raise ValueError("finalize comes first")
        return self._result

    def stats(self) -> dict[str, int]:
        """collections and points_processed: points that pass the filter, those outside the grid included."""
        if not self._callback and self._clouds:
            self._points = sum(d.agg(F.count(F.lit(1)).alias("n")).first()["n"] for d in self._clouds)
        return {"collections_processed": self._collections, "points_processed": self._points} | (self._store.stats() if self._store else {})
