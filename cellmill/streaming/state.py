"""Partial states between runs: a Parquet table in which a batch is replaced, never added twice.

Layout: <path>/reduction_id=.../batch_id=.../tile_row=.../tile_col=...  A
batch that is written again takes the place of its former rows, so repeated
deliveries do not count double.  Readers merge the states of a cell.

Compaction merges batches into a base, batch_id=-1, -2, ... for the first, the
second, ...  A base counts from the moment its manifest _base-1, _base-2, ...
has its name, which one rename does; the manifest lists the batches that went
into it.  Until then the batches count, from then on they don't, whether their
folders are gone or not, and a listed batch that is delivered again is not taken
a second time.  A crash at any point leaves one of the two states.  One writer at
a time is assumed.
"""

from __future__ import annotations

import json
from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmill.functions.filters import FilterSpec
from cellmill.functions.grid import GridSpec
from cellmill.functions.reductions import Reduction
from cellmill.operators.reduce import KEYS, finalize_states, merge_states, partial_states

def _within(batch_id: int, ranges: list[list[int]]) -> bool:
    i = bisect_right(ranges, [batch_id, float("inf")])
    return i > 0 and ranges[i - 1][0] <= batch_id <= ranges[i - 1][1]


def _ranges(ranges: list[list[int]], more: list[int]) -> list[list[int]]:
    """Ascending [first, last] of consecutive numbers, so that a stream's batches stay one range."""
    out: list[list[int]] = []
    for a, b in sorted([*ranges, *([b, b] for b in more)]):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


class StateStore:
    def __init__(self, spark: SparkSession, path: str, grid: GridSpec, reductions: list[Reduction], reduction_id: str = "default", resume: bool = False):
        """resume: goes on with what the store holds; otherwise the states of this reduction_id are deleted."""
        for r in reductions:
            r.check()
            if not r.mergeable:
                raise ValueError(f"{r.kind} has no states that merge, so it cannot be reduced in batches")
        self.spark, self.grid, self.reductions = spark, grid.validate(), reductions
        self.path, self.home = path, f"{path}/reduction_id={reduction_id}"
        self._mark = json.dumps([grid.bounds.__dict__, grid.cell_x, grid.cell_y, [[r.name, r.kind, r.value, r.weight, r.order] for r in reductions]], sort_keys=True)
        if not resume:
            self.reset()
        elif self._exists(f"{self.home}/_kept") and self._read(f"{self.home}/_kept") != self._mark:
            raise ValueError("the stored states belong to another grid or other reductions")
        self._write(f"{self.home}/_kept", self._mark)

    # the store's own folder, by way of Hadoop's file systems

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _delete(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def _write(self, path: str, text: str) -> None:
        fs, p = self._fs(path)
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()

    def _read(self, path: str) -> str:
        fs, p = self._fs(path)
        stream = fs.open(p)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _batch(self, batch_id: int) -> str:
        return f"{self.home}/batch_id={batch_id}"

    def _names(self) -> list[str]:
        if not self._exists(self.home):
            return []
        fs, p = self._fs(self.home)
        return [s.getPath().getName() for s in fs.listStatus(p)]

    def _base(self, names: list[str]) -> tuple[int, list[list[int]]]:
        """The number of the base, 0 if there is none, and ranges of the batches that went into it."""
        n = max((int(x.split("-")[1]) for x in names if x.startswith("_base-")), default=0)
        return (n, json.loads(self._read(f"{self.home}/_base-{n}"))) if n else (0, [])

    def put(self, states: DataFrame, batch_id: int) -> bool:
        """States of one batch; rows of the same batch_id are replaced.  False, and nothing is done, if a base has it already."""
        if batch_id < 0:
            raise ValueError("batches are numbered from 0")
        if _within(batch_id, self._base(self._names())[1]):
            return False
        tiled = states.withColumns({"tile_row": self.grid.tile_row(), "tile_col": self.grid.tile_col()})
        tiled.repartition("tile_row", "tile_col").write.mode("overwrite").partitionBy("tile_row", "tile_col").parquet(self._batch(batch_id))
        return True

    def ingest(self, points: DataFrame, batch_id: int, filters: FilterSpec | None = None, x: str = "x", y: str = "y") -> bool:
        return self.put(partial_states(points, self.grid, self.reductions, filters, x, y), batch_id)

    def batches(self) -> list[int]:
        """The base, as a negative number, and the batches that did not go into it."""
        names = self._names()
        n, merged = self._base(names)
        found = sorted(int(x.split("=")[1]) for x in names if x.startswith("batch_id="))
        return [-n] * (n > 0) + [b for b in found if b >= 0 and not _within(b, merged)]

    def next_batch(self) -> int:
        """A number after all that the store has or its base took."""
        _, merged = self._base(self._names())
        return max([-1, *self.batches(), *(b for _, b in merged)]) + 1

    def rows(self, tile: tuple[int, int] | None = None) -> DataFrame:
        """Stored states as they are; of one tile, only its folders are read."""
        found = self.batches()
        if not found:
            raise ValueError("the store holds no states")
        df = self.spark.read.option("basePath", self.home).parquet(*[self._batch(b) for b in found])
        return df if tile is None else df.where((F.col("tile_row") == tile[0]) & (F.col("tile_col") == tile[1]))

    def states(self, tile: tuple[int, int] | None = None) -> DataFrame:
        return merge_states(self.rows(tile), self.reductions)

    def result(self, tile: tuple[int, int] | None = None) -> DataFrame:
        return finalize_states(self.states(tile), self.reductions)

    def tiles(self) -> DataFrame:
        """Tiles that have states."""
        return self.rows().select("tile_row", "tile_col").distinct()

    def compact(self) -> None:
        """One state per cell in a new base; what it replaces goes once its manifest is there."""
        before = self.batches()
        if any(b >= 0 for b in before):
            n, merged = self._base(self._names())
            tiled = self.states().withColumns({"tile_row": self.grid.tile_row(), "tile_col": self.grid.tile_col()})
            tiled.repartition("tile_row", "tile_col").write.mode("overwrite").partitionBy("tile_row", "tile_col").parquet(self._batch(-n - 1))
            self._write(f"{self.home}/_new", json.dumps(_ranges(merged, [b for b in before if b >= 0])))
            self._rename(f"{self.home}/_new", f"{self.home}/_base-{n + 1}")
        self._sweep()

    def _rename(self, old: str, new: str) -> None:
        fs, p = self._fs(old)
        if not fs.rename(p, self._fs(new)[1]):
            raise OSError(f"{old} could not be renamed")

    def _sweep(self) -> None:
        """Deletes folders and manifests that do not count any more."""
        names = self._names()
        n, merged = self._base(names)
        for x in names:
            b = int(x.split("=")[1]) if x.startswith("batch_id=") else None
            if b is not None and (_within(b, merged) or b < 0 and b != -n) or x.startswith("_base-") and x != f"_base-{n}":
                self._delete(f"{self.home}/{x}")

    def reset(self) -> None:
        self._delete(self.home)

    def stats(self) -> dict[str, int]:
        if not self.batches():
            return {"batches": 0, "tiles": 0, "cells": 0}
        r = self.states().select(self.grid.tile_id().alias("t")).agg(F.count_distinct("t").alias("tiles"), F.count(F.lit(1)).alias("cells")).first()
        return {"batches": len(self.batches()), "tiles": r["tiles"], "cells": r["cells"]}
