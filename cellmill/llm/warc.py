"""WARC archives of page tables, written and read as chunks.

A record's payload travels as rows (record id, chunk number, bytes), so neither
writer nor reader ever holds a whole record: each works with one chunk, a
streaming compressor and an incremental SHA-256.  Each chunk row carries the
digest of the payload up to and including that chunk; the last one's is the
payload digest, which is compared with the record header.

Every record is a gzip member of its own (WARC 1.1).  Of records with equal
payloads the one with the smallest id is a ``response``; the others are
``revisit`` records that refer to it and carry no payload.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmill.llm.common import new_path, open_shared, written

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BLOCK = 1 << 16
MANIFEST = "path string, records long"


def plan_records(df: DataFrame, id_col: str, payload_col: str, url_col: str | None, least: int) -> DataFrame:
    """id, url, payload binary, payload_bytes, payload_digest, record_type, refers_to for each row of df.

    Native: a partial aggregation finds the smallest id of each digest, and the join back may be split where one payload
    has very many rows.  Payloads under ``least`` bytes are always responses.  A null id never becomes the record that
    others refer to; if all ids of equal payloads are null, all are responses.  Rows that repeat the smallest id are all
    responses.
    """
    rows = df.select(
        F.col(id_col).cast("long").alias("id"),
        (F.col(url_col).cast("string") if url_col else F.lit(None).cast("string")).alias("url"),
        F.coalesce(F.col(payload_col).cast("string").cast("binary"), F.lit(b"")).alias("payload"),
    ).select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    first = rows.groupBy("payload_digest").agg(F.min("id").alias("_first"))
    repeated = (F.col("payload_bytes") >= least) & F.col("_first").isNotNull() & ~F.col("id").eqNullSafe(F.col("_first"))
    return rows.join(first, "payload_digest").select(
        "id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(repeated, "revisit").otherwise("response").alias("record_type"), F.when(repeated, F.col("_first")).alias("refers_to"),
    )


def chunk_rows(records: DataFrame, chunk_bytes: int = 1 << 20) -> DataFrame:
    """Records as chunk rows in chunk order, without a shuffle; revisits have one empty chunk."""
    size = F.when(F.col("record_type") == "revisit", 0).otherwise(F.col("payload_bytes"))
    last = F.greatest(F.ceil(size / F.lit(chunk_bytes)).cast("int") - 1, F.lit(0))
    numbered = records.withColumn("_last", last).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("_last"))))
    part = F.substring("payload", F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes))
    return numbered.select(
        "id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "chunk_no",
        (F.col("chunk_no") == F.col("_last")).alias("last"),
        F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(part).alias("chunk"),
    )


def _clean(value: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def _name(record_id: int | None) -> str:
    return f"<urn:record:{'none' if record_id is None else record_id}>"


def _header(row: dict, date: str) -> bytes:
    own = b"" if row["record_type"] == "revisit" else f"Content-Length: {row['payload_bytes']}\r\n".encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + own + b"\r\n"
    body = 0 if row["record_type"] == "revisit" else row["payload_bytes"]
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {_name(row['id'])}", f"WARC-Date: {date}"]
    if row["url"] is not None:
        lines.append(f"WARC-Target-URI: {_clean(row['url'])}")
    if row["record_type"] == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(row['refers_to'])}"]
    lines += [f"WARC-Payload-Digest: sha256:{row['payload_digest']}", f"X-Payload-Length: {row['payload_bytes']}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + body}", "", ""]
    return "\r\n".join(lines).encode() + http


class _Archive:
    """One WARC file; it gets its name when it is whole, so a lost task leaves no half archive behind."""

    def __init__(self, folder: str, name: str):
        self.fs, base = open_shared(folder)
        self.fs.create_dir(base, recursive=True)
        self.name, self.partial = name, f"{base}/_{TaskContext.get().taskAttemptId()}-{name}"
        self.path, self.records, self.size = f"{base}/{name}", 0, 0
        self.out = self.fs.open_output_stream(self.partial, compression=None)

    def put(self, raw: bytes) -> None:
        self.size += len(raw)
        self.out.write(raw)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.partial, self.path)


def write_warc(
    df: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str | None = "url", least: int = 100,
    chunk_bytes: int = 1 << 20, file_bytes: int = 1 << 30, date: str = "2024-01-01T00:00:00Z", level: int = 4,
) -> DataFrame:
    """Writes a record per row into archives under the shared folder; returns the written manifest (path, records).

    Null payload counts as empty; null urls are left out and control characters of urls are percent-encoded.
    An archive is closed and the next begun once it has file_bytes.  An empty table has no archives.
    """
    folder = new_path(df.sparkSession, "warc")
    chunks = chunk_rows(plan_records(df, id_col, payload_col, url_col, least), chunk_bytes)

    def write(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, made, packer, digest, sent = None, [], None, None, 0
        part = TaskContext.get().partitionId()
        for whole in rows:
            for at in range(0, whole.num_rows, 64):
                for row in whole.slice(at, 64).to_pylist():
                    if row["chunk_no"] == 0:
                        if archive is None or archive.size >= file_bytes:
                            if archive:
                                archive.close()
                            archive = _Archive(folder, f"part-{part:06d}-{len(made):04d}.warc.gz")
                            made.append(archive)
                        packer, digest, sent = zlib.compressobj(level, zlib.DEFLATED, 31), hashlib.sha256(), 0
                        archive.put(packer.compress(_header(row, date)))
                    chunk = row["chunk"]
                    digest.update(chunk)
                    sent += len(chunk)
                    archive.put(packer.compress(chunk))
                    if row["last"]:
                        if row["record_type"] == "response" and (sent, digest.hexdigest()) != (row["payload_bytes"], row["payload_digest"]):
                            raise ValueError(f"record {row['id']}: its chunks don't make up its payload")
                        archive.put(packer.compress(b"\r\n\r\n") + packer.flush())
                        archive.records += 1
        if archive:
            archive.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{a.name}" for a in made]), pa.array([a.records for a in made], pa.int64())], ["path", "records"])

    return written(chunks.mapInArrow(write, MANIFEST), "warc-manifest")


class _Stream:
    """Bytes of a gzip file of many members, read block by block."""

    def __init__(self, raw):
        self.raw, self.held, self.unpack, self.rest, self.over = raw, b"", zlib.decompressobj(31), b"", False

    def _more(self) -> bool:
        while not self.over:
            block = self.rest or self.raw.read(BLOCK)
            self.rest = b""
            if not block:
                self.over = True
                break
            got = self.unpack.decompress(block, BLOCK * 4)
            if self.unpack.eof:
                self.rest, self.unpack = self.unpack.unused_data, zlib.decompressobj(31)
            else:
                self.rest = self.unpack.unconsumed_tail
            if got:
                self.held += got
                return True
        return False

    def line(self) -> bytes:
        while (i := self.held.find(b"\n")) < 0 and self._more():
            pass
        i = i + 1 if i >= 0 else len(self.held)
        out, self.held = self.held[:i], self.held[i:]
        return out

    def take(self, most: int) -> bytes:
        if not self.held:
            self._more()
        out, self.held = self.held[:most], self.held[most:]
        return out


def records_of(raw, chunk_bytes: int) -> Iterator[tuple[dict, int, int, bytes, str, bool]]:
    """(header, chunk number, payload bytes so far, chunk, digest so far, last) of each chunk of an archive."""
    stream = _Stream(raw)
    while line := stream.line():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.line().rstrip(b"\r\n")):
            key, _, value = line.decode().partition(":")
            head[key.lower()] = value.strip()
        left = int(head["content-length"])
        while left:  # the HTTP header
            line = stream.line()
            left -= len(line)
            if not line.strip():
                break
        digest, seen, k = hashlib.sha256(), 0, 0
        while True:
            parts, want = [], min(left, chunk_bytes)
            while want:
                if not (got := stream.take(want)):
                    raise ValueError("the archive ends inside a record")
                parts.append(got)
                want -= len(got)
                left -= len(got)
            chunk = b"".join(parts)
            digest.update(chunk)
            seen += len(chunk)
            last = left == 0
            if last and head["warc-type"] == "response" and head["warc-payload-digest"] != f"sha256:{digest.hexdigest()}":
                raise ValueError(f"payload digest of {head['warc-record-id']} is wrong")
            yield head, k, seen, chunk, digest.hexdigest(), last
            k += 1
            if last:
                break


def read_warc(manifest: DataFrame, id_col: str = "page_id", chunk_bytes: int = 1 << 20, payload: bool = True) -> DataFrame:
    """The archives of a manifest as chunk rows: id_col, record_type, refers_to, chunk_no, last, payload_bytes and
    payload_digest (both up to and including the chunk; of revisits, what the header says of the full payload), url, and
    chunk binary if payload is asked for."""
    n = max(1, manifest.count())
    number = lambda name: None if name is None or name.endswith(":none>") else int(name.rpartition(":")[2][:-1])
    names = [id_col, "record_type", "refers_to", "chunk_no", "last", "payload_bytes", "payload_digest", "url"] + ["chunk"] * payload
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.string()] + [pa.binary()] * payload

    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flush = lambda held: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
        for batch in rows:
            for path in batch.column(0).to_pylist():
                fs, at = open_shared(path)
                held, size = [], 0
                with fs.open_input_stream(at, compression=None) as raw:
                    for head, k, seen, chunk, digest, last in records_of(raw, chunk_bytes):
                        if head["warc-type"] == "revisit":
                            seen, digest = int(head["x-payload-length"]), head["warc-payload-digest"].partition(":")[2]
                        row = (number(head["warc-record-id"]), head["warc-type"], number(head.get("warc-refers-to")), k, last, seen, digest, head.get("warc-target-uri"))
                        held.append((*row, chunk) if payload else row)
                        size += len(chunk) * payload + 200
                        if size > 8 << 20:
                            yield flush(held)
                            held, size = [], 0
                if held:
                    yield flush(held)

    schema = f"`{id_col}` long, record_type string, refers_to long, chunk_no int, last boolean, payload_bytes long, payload_digest string, url string"
    return manifest.select("path").repartition(n).mapInArrow(read, schema + ", chunk binary" * payload)
