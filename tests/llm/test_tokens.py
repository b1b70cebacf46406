from __future__ import annotations

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cellmill.llm import elias_fano
from cellmill.llm.common import table
from cellmill.llm.packing import complete, pack, places, sequences, token_pieces

P = pytest.importorskip("public_tokenizers")
JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
ODD = [
    None, "", " ", "\n\n\n", "a", "I'm we'll DON'T", "<|endoftext|> x", "a<|endoftext|>b<|endoftext|><|endoftext|>", " <|endoftext|>\n<|endoftext|", "naïve ß 漢字 😀👩‍👩‍👧", "tab\tx\x0b\x0c\x1c\x85\xa0 y",
    "ال́ 123 456abc", "word " * 9000, "x" * 30000, "a", "a",
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i if i != 3 else None, t, "ids") for i, t in enumerate(ODD)], "doc_id long, text string, ids string")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def ordinary():
    """Strings of added tokens are ordinary text."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def ranks():
    import tiktoken

    with open(RANKS, "rb") as f:
        table_ = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=table_, special_tokens={}).encode_ordinary


def fuzz():
    r, pool = random.Random(3), " \t\n\r\x0b\x1c\x1f\x85\xa0 ​　'stredvml0123abcéß漢😀ا́#-<>"
    return ["".join(r.choice(pool) for _ in range(r.randint(0, 50))) for _ in range(3000)]


def test_codec_is_the_libraries(library, ordinary, ranks):
    from cellmill.llm.bpe import Codec, codec

    one, two, three = codec(JSON, P.PATTERN), codec(RANKS, P.PATTERN), Codec(JSON, P.PATTERN, added=True)
    four = Codec(JSON, P.PATTERN + "|$^")  # by a regular expression
    texts = [*fuzz(), *(t or "" for t in ODD)]
    for text in texts:
        assert one.encode(text).tolist() == ordinary(text)
        assert two.encode(text).tolist() == ranks(text)
        assert three.encode(text).tolist() == library(text)
        assert four.encode(text).tolist() == ordinary(text)
        for c in (two, three):
            assert c.decode(c.encode(text)) == text.encode()
    ids, edges = three.encode_batch(texts, 7)
    assert [ids[a:b].tolist() for a, b in zip(edges, edges[1:], strict=False)] == [[*library(t), 7] for t in texts]
    with pytest.raises(IndexError):
        two.decode(np.array([50256]))


def test_blocks_and_forgetting(ranks, monkeypatch):
    from cellmill.llm import bpe

    monkeypatch.setattr(bpe, "BLOCK", 64)
    monkeypatch.setattr(bpe, "KNOWN", 300)
    c = bpe.Codec(RANKS, P.PATTERN)
    texts = [*fuzz(), "word  two\t" * 300, "it's " * 90, "x" * 500 + " y"]
    for _ in range(2):
        ids, edges = c.encode_batch(texts)
        assert [ids[a:b].tolist() for a, b in zip(edges, edges[1:], strict=False)] == list(map(ranks, texts))
    assert c.known.n < 1200


def test_table_keeps_what_was_met_again():
    from cellmill.llm.splits import Table

    t, r = Table(bits=8), np.random.default_rng(2)
    k = np.unique(r.integers(1, 1 << 60, (100, 2)).astype(np.uint64), axis=0)
    ends = np.cumsum(r.integers(1, 5, len(k)))
    values = np.arange(ends[-1], dtype=np.uint32)
    slot = t.put(k, values, ends)
    assert (t.find(k) == slot).all() and (t.find(k + np.uint64(1)) < 0).all()
    t.met[slot[:30]] = True
    t.forget()
    assert t.n == 30 and (t.find(k[30:]) < 0).all()
    t.room(150)
    assert t.bits == 8 and t.n == 30
    got, count = t.gather(t.find(k[:30]))
    assert (got == values[: ends[29]]).all() and (np.cumsum(count) == ends[:30]).all()
    t.room(1000)
    assert t.bits == 11 and t.n == 0
    more = np.unique(r.integers(1, 1 << 60, (1000, 2)).astype(np.uint64), axis=0)
    assert (t.find(more) < 0).all() and len(set(t.put(more, values[:0], np.zeros(len(more), np.int64)).tolist())) == len(more)


def test_encode_offsets_and_decode(spark, odd, ranks):
    from cellmill.llm.bpe_table import bpe_decode, bpe_encode

    coded = bpe_encode(odd, RANKS, P.PATTERN, decoded=True)
    rows = coded.collect()
    assert len(rows) == len(ODD)
    for row, text in zip(rows, ODD, strict=True):
        text = text or ""
        assert row.ids == ranks(text) and bytes(row.decoded) == text.encode()
        assert len(row.starts) == len(row.ids) and all(a < b for a, b in zip(row.starts, row.ends, strict=True))
        if text.isascii():
            assert "".join(text[a:b] for a, b in zip(row.starts, row.ends, strict=True)) == text
    back = {bytes(r.decoded) for r in bpe_decode(coded, RANKS, P.PATTERN).collect()}
    assert back == {(t or "").encode() for t in ODD}
    assert bpe_encode(odd.where("false"), RANKS, P.PATTERN).count() == 0


def test_op6_on_whole_table(spark, sf, ranks):
    from cellmill.llm.queries import op6_bpe_roundtrip

    texts = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    rows = op6_bpe_roundtrip(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = ranks(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 5000) | st.just(0), max_size=900), st.integers(0, 3))
def test_elias_fano(steps, shift):
    values = np.cumsum([s << (4 * shift) for s in steps]).astype(np.uint64)
    code = elias_fano.EliasFano(elias_fano.encode(values))
    assert [int(x) for x in code.block(0, len(values))] == values.tolist()
    for i in range(0, len(values), 37):
        assert code.select(i) == values[i]
        assert code.block(i, 70).tolist() == values[i : i + 70].tolist()
    with pytest.raises(IndexError):
        code.select(len(values))


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(1).integers(1, 2000, 100_000)).astype(np.uint64)
    assert len(elias_fano.encode(values)) * 8 / len(values) < 2.3 + np.log2(values[-1] / len(values))


def expected_tokens(rows, library, end):
    start, out = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*library(text), end], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_files(spark, sf, odd, library):
    from cellmill.llm.queries import op7_token_files
    from cellmill.llm.token_files import ShardReader, open_shared, read_tokens, write_tokens

    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    got = sorted(map(tuple, op7_token_files(spark, sf).collect()))
    assert got == expected_tokens(docs, library, 2)
    manifest = write_tokens(odd, JSON, P.PATTERN, shard_tokens=8)
    assert manifest.where("n_docs > 1").count() and manifest.count() > 3
    rows = read_tokens(manifest).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows] == expected_tokens([(i if i != 3 else None, t) for i, t in enumerate(ODD)], library, 2)
    at = 0
    for shard in manifest.orderBy("shard").collect():
        reader = ShardReader(*open_shared(shard.path))
        for i in range(shard.n_docs):
            assert reader.document(i).tolist() == rows[at].ids
            at += 1
    wide = write_tokens(odd, JSON, P.PATTERN, end_id=70_257)
    ends = [r.ids[-1] for r in read_tokens(wide).collect()]
    assert ends == [70_257] * len(ODD)
    empty = write_tokens(odd.where("false"), JSON, P.PATTERN)
    assert empty.count() == 0 and read_tokens(empty).count() == 0


def fill(histogram, capacity):
    patterns = complete(histogram, capacity)
    used: dict[int, int] = {}
    for pattern, times in patterns:
        assert sum(pattern) <= capacity
        for x in pattern:
            used[x] = used.get(x, 0) + times
    assert used == {k: v for k, v in histogram.items() if v}
    return sum(t for _, t in patterns)


def fewest(items, capacity):
    """Exact, by trying every bin for every item."""
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins)}.values():
            if bins[k] + items[i] <= capacity:
                bins[k] += items[i]
                go(i + 1, bins)
                bins[k] -= items[i]
        bins.append(items[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best[0] if items else 0


@settings(deadline=None, max_examples=80)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_bin_completion_is_optimal_on_small_cases(items):
    histogram = {x: items.count(x) for x in items}
    assert fill(histogram, 20) == fewest(items, 20)


def test_bin_completion_near_the_bound():
    r = np.random.default_rng(5)
    histogram = {int(k): int(n) for k, n in zip(*np.unique(np.clip(r.lognormal(6, 1, 50_000).astype(int), 1, 2048), return_counts=True), strict=True)}
    total = sum(k * n for k, n in histogram.items())
    assert fill(histogram, 2048) <= -(-total // 2048) * 1.01 + 1
    assert complete({}, 8) == [] and fill({8: 3}, 8) == 3
    with pytest.raises(ValueError):
        complete({9: 1}, 8)
    assert places([((3, 3, 2), 2)]) == [(3, 0, 2, 0, 0), (3, 2, 4, 0, 3), (2, 0, 2, 0, 6)]


def check_packed(rows, docs, library, capacity):
    ids = {i: np.array([*library(t), 0], "<u4") for i, t in docs}
    at: dict[int, list] = {}
    pieces: dict[int, list] = {}
    for r in rows:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for places_ in at.values():
        end = 0
        for offset, length in sorted(places_):
            assert offset == end
            end += length
        assert end <= capacity
    assert set(pieces) == set(ids)
    for doc_id, own in pieces.items():
        end = 0
        for k, (piece, start, length, crc) in enumerate(sorted(own)):
            assert (piece, start) == (k, end) and (length == capacity or k == 0)
            assert crc == zlib.crc32(ids[doc_id][start : start + length].tobytes())
            end += length
        assert end == len(ids[doc_id]) and (len(own) == 1) == (end <= capacity)
    return len(at), sum(map(len, ids.values()))


def test_packing(spark, sf, odd, library, ordinary):
    from cellmill.llm.queries import op9_best_fit_packing

    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    n, total = check_packed(op9_best_fit_packing(spark, sf).collect(), docs, library, 2048)
    assert n == -(-total // 2048)
    named = [(i if i != 3 else None, t) for i, t in enumerate(ODD)]
    packed = pack(token_pieces(odd, JSON, P.PATTERN, 64, ids=True), 64)
    rows = packed.collect()
    check_packed(rows, named, library, 64)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)
    whole = {r.sequence_id: bytes(r.ids) for r in sequences(packed).collect()}
    assert whole == {i: b"".join(bytes(r.ids) for r in sorted((r for r in rows if r.sequence_id == i), key=lambda r: r.offset)) for i in whole}
    ordinary_ = pack(token_pieces(odd, JSON, P.PATTERN, 64, added=False), 64)
    check_packed(ordinary_.collect(), named, ordinary, 64)
    assert pack(token_pieces(odd.where("false"), JSON, P.PATTERN)).count() == 0
