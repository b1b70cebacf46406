from __future__ import annotations

import gzip
import hashlib

import pytest

from cellmill.llm.common import open_shared
from cellmill.llm.warc import read_warc, records_of, write_warc

LONG = "é" * 70_000
ROWS = [
    (1, "http://a/1", "x" * 100), (2, "http://a/ b\r\nX: y", "x" * 100), (3, None, "x" * 99), (4, "u", "x" * 99), (5, "u", None), (6, "u", ""),
    (7, "u", LONG), (8, "u", LONG), (8, "u", LONG), (None, "u", LONG), (None, "u", "n" * 200), (None, "u", "n" * 200), (-3, "ü", "WARC/1.1\r\n\r\n" * 30), (9, "u", "\r\n\r\n"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "z") for r in ROWS], "page_id long, url string, html string, payload string")


def wanted():
    out = []
    for i, _, html in ROWS:
        raw = (html or "").encode()
        ids = [j for j, _, h in ROWS if (h or "") == (html or "") and j is not None]
        again = len(raw) >= 100 and bool(ids) and i != min(ids)
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", min(ids) if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk", [7, 1000, 1 << 20])
def test_round_trip_in_chunks(pages, chunk):
    rows = read_warc(write_warc(pages, chunk_bytes=chunk, file_bytes=600), chunk_bytes=chunk).collect()
    last = [r for r in rows if r.last]
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in last], key=repr) == wanted()
    assert all(len(r.chunk) <= chunk for r in rows)
    for r in last:
        if r.record_type == "response" and r.page_id is not None:
            own = sorted((x for x in rows if x.page_id == r.page_id and x.record_type == "response"), key=lambda x: x.chunk_no)
            n = len(own) // (sum(x.last for x in own))
            so_far = hashlib.sha256()
            for k, x in enumerate(own[:: len(own) // n]):
                so_far.update(bytes(x.chunk))
                assert (x.chunk_no, x.payload_digest) == (k, so_far.hexdigest())
            assert so_far.hexdigest() == r.payload_digest


def test_archives_are_gzip_members_of_warc(pages):
    for row in write_warc(pages).collect():
        fs, path = open_shared(row.path)
        with fs.open_input_stream(path, compression=None) as f:
            whole = gzip.decompress(f.read())
        assert whole.count(b"WARC-Record-ID: ") == row.records and b"\nX: y" not in whole


def test_damage_is_found(pages):
    row = write_warc(pages).first()
    fs, path = open_shared(row.path)
    with fs.open_input_stream(path, compression=None) as f:
        whole = gzip.decompress(f.read())
    import io

    bad = gzip.compress(whole.replace(b"xxx", b"xyx").replace("ééé".encode(), "éaaé".encode()).replace(b"nnn", b"nmn"))
    if bad != gzip.compress(whole):
        with pytest.raises(ValueError):
            list(records_of(io.BytesIO(bad), 100))
    with pytest.raises((ValueError, EOFError)):
        list(records_of(io.BytesIO(gzip.compress(whole[:-20])), 100))


def test_empty_table(pages):
    manifest = write_warc(pages.where("false"))
    assert manifest.count() == 0 and read_warc(manifest).count() == 0


def test_query(spark, sf):
    from cellmill.llm.queries import op2_warc

    rows = op2_warc(spark, sf).collect()
    html = {r.page_id: r.html or "" for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert len(rows) == len(html) and all(r.payload_digest == hashlib.sha256(html[r.page_id].encode()).hexdigest() for r in rows)
