"""Encoding and decoding of a text column by byte-level BPE, over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmill.llm.bpe import codec
from cellmill.llm.common import text_of


def lists(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """array<int> of flat values and n + 1 places."""
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.ascontiguousarray(values).astype(np.int32, copy=False)))


def _few(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def bpe_encode(
    df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = True, decoded: bool = False
) -> DataFrame:
    """One row per input row: id_col, ids array<int>; with offsets, also the first character and the end of each token
    (starts, ends array<int>; a token inside a character covers it); with decoded, the ids' bytes as decoded binary.

    path: a ``tokenizers`` JSON file or a ``tiktoken`` rank file.  No special tokens: their strings are ordinary text.
    Null text counts as empty and gives empty arrays; ids may be null or repeat; other columns are not read; an empty table
    gives an empty result.  A very long text is split in parts of a million characters, cut before white space; its row
    holds 4 bytes per token, with offsets some 24 bytes per byte of a batch of 512 rows.
    """
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, ids array<int>" + ", starts array<int>, ends array<int>" * offsets + ", decoded binary" * decoded

    def encode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for whole in rows:
            for batch in _few(whole):
                texts = batch.column(1).to_pylist()
                ids, edges = c.encode_batch(texts)
                out = [batch.column(0), lists(ids, edges)]
                if offsets:
                    at = c.offsets(texts, ids, edges)
                    out += [lists(at[:, k], edges) for k in (0, 1)]
                if decoded:
                    raw, ends = c.decode_batch(ids, edges)
                    out.append(pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw)]))
                yield pa.RecordBatch.from_arrays(out, ["id", "ids", *["starts", "ends"] * offsets, *["decoded"] * decoded])

    def named(rows):
        for batch in encode(rows):
            yield batch.rename_columns([id_col, *batch.schema.names[1:]])

    return df.select(F.col(id_col), text_of(df, text_col).alias("_text")).mapInArrow(named, schema)


def bpe_decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col, decoded binary.  Bytes are joined before any reading as characters, so characters that tokens split meet
    again; null ids count as none.  An id outside the table is an error."""
    kind = df.schema[id_col].dataType.simpleString()

    def decode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for whole in rows:
            for batch in _few(whole):
                got = [c.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.binary())], [id_col, "decoded"])

    return df.select(F.col(id_col), F.col(ids_col).alias("_ids")).mapInArrow(decode, f"`{id_col}` {kind}, decoded binary")
