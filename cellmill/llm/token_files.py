"""Token ids of a corpus as binary shards with Elias-Fano document boundaries.

A shard is: the ids of its documents one after another (16-bit where the
vocabulary allows, else 32-bit, little-endian), then the Elias-Fano codes of
the n + 1 document boundaries and of the document ids, then a JSON footer and
its length.  A task writes a range of ascending document ids as one shard or,
beyond a size, as several, so that shard order is corpus order; the manifest
table holds one row per shard.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellmill.llm import elias_fano
from cellmill.llm.bpe import codec
from cellmill.llm.common import new_path, open_shared, text_of, written

MAGIC = b"CMTOKENS"
_TAIL = struct.Struct("<I8s")
MANIFEST = "shard long, path string, n_docs long, n_tokens long"
PARTS = 1 << 32  # shard = task * PARTS + part of the task's range


class ShardWriter:
    """Ids go to the file as they come; only boundaries and document ids wait in memory.  The file gets its name when it is whole."""

    def __init__(self, folder: str, shard: int, wide: bool):
        self.fs, base = open_shared(folder)
        self.fs.create_dir(base, recursive=True)
        context = TaskContext.get()
        self.name = f"{base}/shard-{shard // PARTS:06d}-{shard % PARTS:06d}.tok"
        self.partial = f"{base}/_{shard:016d}-{context.taskAttemptId() if context else os.getpid()}"
        self.out = self.fs.open_output_stream(self.partial, compression=None)
        self.kind, self.nulls = "<u4" if wide else "<u2", 0
        self.ends, self.ids, self.n = [0], [], 0

    def add(self, doc_ids: list[int | None], ids: np.ndarray, ends: np.ndarray) -> None:
        """Documents one after another; ends: where each ends in ids."""
        if self.kind == "<u2" and len(ids) and int(ids.max()) > 0xFFFF:
            raise ValueError("an id needs more than 16 bits")
        self.out.write(ids.astype(self.kind).tobytes())
        self.ends += (self.n + ends).tolist()
        self.n += len(ids)
        named = [i for i in doc_ids if i is not None]
        self.nulls += len(doc_ids) - len(named)
        self.ids += named

    def close(self) -> int:
        least = self.ids[0] if self.ids else 0
        parts = [elias_fano.encode(np.array(self.ends, np.uint64)), elias_fano.encode(np.array([i - least for i in self.ids], np.uint64))]
        size = self.n * np.dtype(self.kind).itemsize
        foot = {"n_docs": len(self.ends) - 1, "n_tokens": self.n, "kind": self.kind, "nulls": self.nulls, "least": least}
        foot |= {"bounds": [size, len(parts[0])], "ids": [size + len(parts[0]), len(parts[1])]}
        raw = json.dumps(foot).encode()
        self.out.write(b"".join([*parts, raw, _TAIL.pack(len(raw), MAGIC)]))
        self.out.close()
        self.fs.move(self.partial, self.name)
        return foot["n_docs"]


class ShardReader:
    def __init__(self, fs, path: str):
        self.f = fs.open_input_file(path)
        size = self.f.size()
        length, magic = _TAIL.unpack(self.f.read_at(_TAIL.size, size - _TAIL.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no token shard")
        self.foot = json.loads(self.f.read_at(length, size - _TAIL.size - length))
        self.bounds = elias_fano.EliasFano(self.f.read_at(*self.foot["bounds"][::-1]))
        self.ids = elias_fano.EliasFano(self.f.read_at(*self.foot["ids"][::-1]))
        self.width = np.dtype(self.foot["kind"]).itemsize

    def tokens(self, start: int, end: int) -> np.ndarray:
        return np.frombuffer(self.f.read_at((end - start) * self.width, start * self.width), self.foot["kind"])

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document of the shard, by two selects and one read."""
        return self.tokens(self.bounds.select(i), self.bounds.select(i + 1))

    def documents(self, block: int = 1024) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start, ids), reading runs of documents of at most about a million ids, and single longer ones."""
        n, nulls, least = self.foot["n_docs"], self.foot["nulls"], self.foot["least"]
        for first in range(0, n, block):
            at = self.bounds.block(first, block + 1).astype(np.int64)
            names = [None] * max(0, min(block, nulls - first))
            names += [int(x) + least for x in self.ids.block(max(0, first - nulls), len(at) - 1 - len(names))]
            i = 0
            while i < len(at) - 1:
                j = max(i + 1, int(np.searchsorted(at, at[i] + (1 << 20), "right")) - 1)
                ids = self.tokens(int(at[i]), int(at[j]))
                for k in range(i, j):
                    yield names[k], int(at[k]), ids[at[k] - at[i] : at[k + 1] - at[i]]
                i = j


def write_tokens(
    df: DataFrame,
    path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 2,
    added: bool = True,
    shard_tokens: int = 1 << 28,
) -> DataFrame:
    """Encodes all texts, writes them as shards under the shared folder in ascending id order and returns the manifest
    (shard, path, n_docs, n_tokens) as a written table.

    Each document ends with end_id.  added: strings of the vocabulary's added tokens become their ids.  A shard is closed
    once it has shard_tokens ids; ids take 32 bits each if the vocabulary or end_id needs more than 16.  Null text counts
    as empty: the end id alone.  Rows with null ids come first; rows that repeat an id stand next to each other, in any
    order.  An empty table has no shards.  A very long text is held as a whole with its ids by the task that encodes it.
    """
    spark = df.sparkSession
    folder = new_path(spark, "tokens")

    def write(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, out, shard, made = codec(path, pattern, added), None, TaskContext.get().partitionId() * PARTS, []
        wide = max(c.size - 1, end_id) > 0xFFFF

        def close() -> None:
            n = out.close()
            made.append((shard, out.name.rsplit("/", 1)[-1], n, out.n))

        for batch in rows:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                names = some.column(0).to_pylist()
                ids, edges = c.encode_batch(some.column(1).to_pylist(), end_id)
                first = 0
                while first < len(names):
                    out = out or ShardWriter(folder, shard, wide)
                    # up to the document that reaches the size
                    last = first + int(np.searchsorted(edges[first + 1 :], edges[first] + shard_tokens - out.n)) + 1
                    out.add(names[first:last], ids[edges[first] : edges[min(last, len(names))]], edges[first + 1 : last + 1] - edges[first])
                    first = last
                    if out.n >= shard_tokens:
                        close()
                        out, shard = None, shard + 1
        if out:
            close()
        if made:
            columns = [pa.array(x, t) for x, t in zip(zip(*made, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "path", "n_docs", "n_tokens"])

    rows = df.select(F.col(id_col).cast("long").alias("_id"), text_of(df, text_col).alias("_text"))
    made = rows.repartitionByRange("_id").sortWithinPartitions("_id").mapInArrow(write, MANIFEST)
    return written(made.withColumn("path", F.concat(F.lit(folder + "/"), "path")), "manifest")


def read_tokens(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document of the shards: id_col, start (ids of all documents before it), n_tokens, ids array<int>.

    The manifest has a row per shard, so its running sum in one task is small at any corpus size.
    """
    spark: SparkSession = manifest.sparkSession
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    n = max(1, manifest.count())

    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, at = open_shared(path)
                docs, starts, ids, held = [], [], [], 0
                for doc_id, start, own in ShardReader(fs, at).documents():
                    docs.append(doc_id), starts.append(base + start), ids.append(own.astype("<i4"))
                    held += len(own)
                    if held > 1 << 19:
                        yield _rows(docs, starts, ids, id_col)
                        docs, starts, ids, held = [], [], [], 0
                if docs:
                    yield _rows(docs, starts, ids, id_col)

    spread = shards.select("path", "base").repartition(n)
    return spread.mapInArrow(read, f"`{id_col}` long, start long, n_tokens long, ids array<int>, ids_crc32 long")


def _rows(docs, starts, ids, id_col) -> pa.RecordBatch:
    sizes = np.array([len(x) for x in ids], np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
    crc = pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())
    columns = [pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), lists, crc]
    return pa.RecordBatch.from_arrays(columns, [id_col, "start", "n_tokens", "ids", "ids_crc32"])
