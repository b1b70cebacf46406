"""Removal of repeated byte strings: a depth-limited radix sort of suffixes, most significant digits first.

Only the first ``depth`` bytes of a suffix matter: suffixes that agree on them
form an equal group, and these groups are exactly the repeated windows.  Bytes
of all windows are ``depth`` times the text, more than can travel; so windows
that cannot have an equal elsewhere, or whose equals are known, are set apart
first, by digests:

1. The *anchor* of a window is, of the ``gram``-byte strings in it, the one with
   the least hash.  Equal windows have equal anchors at equal places, so
   consecutive windows with one anchor are one run.  Runs go to buckets by anchor;
   anchors of a single document drop out.  Runs whose whole contexts, all bytes
   of their windows, are equal are settled by a 96-bit digest of anchor and
   context: the least document keeps its bytes, all others lose the run.  One run
   of each context goes on if its anchor has others.
2. The bytes of the runs that go on travel to buckets by anchor, and their windows
   are sorted there: each pass orders the groups of the pass before by the next
   DIGIT bytes, and groups of one document drop out.  What is equal after ``depth``
   bytes is a repeated window, without any hash.  Windows of an anchor with very
   many contexts are dealt out by a digest of the window instead, after the same
   sort within a group of documents, so that no anchor is gathered in one task.

Each step first combines within a task: of equal ones only the least document
travels, whatever the size of a group.  Document ids travel as compressed
differences; answers come back to the documents as (id, 64-bit digest of the
run) and one bit for each of its windows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmill.llm.common import text_of, written
from cellmill.llm.splits import mix

U = np.uint64
_C = U(0xD6E8FEB86659FD93)
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.random.default_rng(11).integers(1, 1 << 63, 256).astype(U) * U(2) + U(1)
_POWERS: list[np.ndarray] = []
#: Bytes of a digit.
DIGIT = 8
_LOW48 = U((1 << 48) - 1)
NO_ID = np.iinfo(np.int64).max
_ZSTD = pa.Codec("zstd", 1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        out = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, U)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


@dataclass(frozen=True)
class RepeatParams:
    """depth: bytes of a repeated window.  gram: bytes of an anchor.  The rest bounds memory: runs that a map task holds
    before it sends them, runs of a bucket, runs of an anchor beyond which its windows are dealt out one by one, and MB of
    text that one group of documents holds."""

    depth: int = 50
    gram: int = 20
    held_runs: int = 1_500_000
    bucket_runs: int = 300_000
    anchor_runs: int = 10_000
    group_mb: float = 2.0


class Block:
    """Documents one after another, with sums from which the digest of any stretch follows by one multiplication."""

    def __init__(self, raws: list[bytes], p: RepeatParams):
        self.p = p
        self.size = np.array([len(r) for r in raws], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.raw = np.frombuffer(b"".join(raws), np.uint8)
        n = len(self.raw)
        up, self.down = powers(n + 1)
        self.sums = np.concatenate([np.zeros(1, U), np.cumsum(_BYTES[self.raw] * up[:n])])

    def _digest(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[begin]) * self.down[begin]

    def _starts(self) -> tuple[np.ndarray, np.ndarray]:
        """Place and document of each window."""
        n = np.maximum(self.size - self.p.depth + 1, 0)
        return _expand(self.at[:-1], n), np.repeat(np.arange(len(n)), n)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(anchor digest, context digest, document, first window, windows) of each run, by place."""
        p, n = self.p, len(self.raw)
        starts, doc = self._starts()
        if not len(starts):
            return np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        k, w = p.gram, p.depth - p.gram + 1
        gram = mix((self.sums[k:] - self.sums[:-k]) * self.down[: n - k + 1])
        bits = U(max(1, n.bit_length()))
        low = (gram >> bits << bits) | np.arange(len(gram), dtype=U)
        step = 1
        while step * 2 <= w:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        low = np.minimum(low[: len(low) - (w - step)], low[w - step :])
        anchor = (low[starts] & U((1 << int(bits)) - 1)).astype(np.int64)
        begin = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        count = np.diff(np.concatenate([begin, [len(anchor)]]))
        first, at = starts[begin], anchor[begin]
        context = mix(self._digest(first, first + count - 1 + p.depth) + mix((at - first).astype(U) * _C + count.astype(U)))
        return gram[at] & _LOW48, mix(context ^ gram[at]) & _LOW48, doc[begin], first, count

    def windows(self, starts: np.ndarray) -> np.ndarray:
        """Digests of the windows at these places."""
        return mix(self._digest(starts, starts + self.p.depth) ^ _C)


def _blocks(raws: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(raws):
        end, size = at, 0
        while end < len(raws) and (end == at or size + len(raws[end]) <= most):
            size += len(raws[end])
            end += 1
        yield at, end
        at = end


def _six(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(U).ravel()


def _ids_out(ids: np.ndarray) -> bytes:
    """Non-decreasing or at least grouped ids: differences of the distinct ones and how often each stands."""
    cut = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate([cut, [len(ids)]])).astype("<u4")
    step = np.diff(ids[cut].astype(U), prepend=U(0)).astype("<u8")  # wraps around; so does the sum
    plain = step.view(np.uint8).reshape(-1, 8).T.tobytes() + count.view(np.uint8).reshape(-1, 4).T.tobytes()
    return struct.pack("<I", len(cut)) + _ZSTD.compress(plain, asbytes=True)


def _ids_in(raw: bytes) -> np.ndarray:
    (n,) = struct.unpack_from("<I", raw)
    plain = np.frombuffer(_ZSTD.decompress(raw[4:], 12 * n, asbytes=True), np.uint8)
    step = np.ascontiguousarray(plain[: 8 * n].reshape(8, n).T).view("<u8").ravel()
    count = np.ascontiguousarray(plain[8 * n :].reshape(4, n).T).view("<u4").ravel()
    return np.repeat(np.cumsum(step.astype(U)).astype(np.int64), count)


def _text_out(raw: bytes) -> bytes:
    return struct.pack("<Q", len(raw)) + _ZSTD.compress(raw, asbytes=True)


def _text_in(raw: bytes) -> np.ndarray:
    return np.frombuffer(_ZSTD.decompress(raw[8:], struct.unpack("<Q", raw[:8])[0], asbytes=True), np.uint8)


def _pack(*parts: bytes) -> bytes:
    return struct.pack(f"<{len(parts)}I", *map(len, parts)) + b"".join(parts)


def _unpack(raw: bytes, n: int) -> list[bytes]:
    sizes = struct.unpack_from(f"<{n}I", raw)
    at, out = 4 * n, []
    for s in sizes:
        out.append(raw[at : at + s])
        at += s
    return out


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group starts) of rows with equal keys."""
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    change = np.zeros(len(order), bool)
    change[:1] = True
    for k in keys:
        k = k[order]
        change[1:] |= k[1:] != k[:-1]
    return order, np.flatnonzero(change)


def _least(order: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Of each row, the least id of its group."""
    out = np.empty(len(ids), np.int64)
    if len(ids):
        out[order] = np.repeat(np.minimum.reduceat(ids[order], starts), np.diff(np.concatenate([starts, [len(ids)]])))
    return out


def _split(part: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    order = np.argsort(part, kind="stable")
    sorted_ = part[order]
    cut = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(part) else np.zeros(0, np.int64)
    for a, b in zip(cut, np.append(cut[1:], len(part)), strict=False):
        yield (int(sorted_[a]), *[c[order[a:b]] for c in columns])


ROW = "part int, home int, blob binary"


def _rows(out: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) if out else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())], ["part", "home", "blob"])


def _home(ids: np.ndarray, homes: int) -> np.ndarray:
    return np.where(ids == NO_ID, 0, ids % homes)


def _answers(ids: np.ndarray, keys: np.ndarray, homes: int, flag: int) -> list[tuple[int, bytes]]:
    out = []
    for home, i, k in _split(_home(ids, homes), ids, keys):
        order = np.argsort(i, kind="stable")
        out.append((home, bytes([flag]) + _pack(_ids_out(i[order]), k[order].astype("<u8").tobytes())))
    return out


GONE, OPEN, HOT, MASK = range(4)


def repeated(raw: np.ndarray, starts: np.ndarray, ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows raw[start:start + depth], those that also belong to a smaller id; and of each group of equal windows of
    several ids, one of the least id, with all windows that are in no such group.

    Most significant digit first: a pass orders each group by its next digit, and only groups of several ids go on.
    """
    views = np.lib.stride_tricks.sliding_window_view(np.concatenate([raw, np.zeros(DIGIT, np.uint8)]), DIGIT)
    rows, group = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    gone, one = np.zeros(len(starts), bool), np.ones(len(starts), bool)
    for at in range(0, depth, DIGIT):
        if not len(rows):
            return gone, one
        digit = views[starts[rows] + at].view(">u8").ravel().astype(U) >> U(8 * max(0, at + DIGIT - depth))
        order = np.lexsort((digit, group))
        rows, group, digit = rows[order], group[order], digit[order]
        change = np.concatenate([[True], (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])])
        first = np.flatnonzero(change)
        size = np.diff(np.append(first, len(rows)))
        own = ids[rows]
        least = np.minimum.reduceat(own, first)
        several = np.repeat(least < np.maximum.reduceat(own, first), size)
        rows, group, least = rows[several], np.cumsum(change)[several], np.repeat(least, size)[several]
    gone[rows] = ids[rows] > least
    stay = rows[ids[rows] == least]
    one[rows] = False
    _, first = np.unique(group[ids[rows] == least], return_index=True)
    one[stay[first]] = True
    return gone, one


def _run_key(gram: np.ndarray, context: np.ndarray) -> np.ndarray:
    return mix(gram * _C + context)


def _send_runs(p: RepeatParams, buckets: int, homes: int):
    """First step, in the tasks that read documents: entries for the buckets (home -1), and runs that a smaller document of
    the task settles already."""

    def send(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n = 0

        def flush() -> pa.RecordBatch:
            gram, context, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            gone = ids > _least(*_groups(gram, context), ids)
            out = [(home % buckets, home, blob) for home, blob in _answers(ids[gone], _run_key(gram[gone], context[gone]), homes, GONE)]
            gram, context, ids = gram[~gone], context[~gone], ids[~gone]
            for part, g, c, i in _split((gram % U(buckets)).astype(np.int64), gram, context, ids):
                out.append((part, -1, _pack(_ids_out(i), _six(g), _six(c))))
            return _rows(out)

        for batch in rows:
            ids = batch.column(0).fill_null(NO_ID).to_numpy()
            for first in range(0, batch.num_rows, 512):
                raws = [t.encode("utf-8", "surrogatepass") for t in batch.column(1).slice(first, 512).to_pylist()]
                for a, b in _blocks(raws):
                    gram, context, doc, _, _ = Block(raws[a:b], p).runs()
                    held.append((gram, context, ids[first + a + doc]))
                    n += len(gram)
                    if n >= p.held_runs:
                        yield flush()
                        held, n = [], 0
        if n:
            yield flush()

    return send


def _sort_runs(p: RepeatParams, homes: int):
    """A bucket of the first step: anchors of several documents, and in them contexts."""

    def sort(table: pa.Table) -> pa.Table:
        out, ids, gram, context = [], [], [], []
        for home, blob in zip(table.column("home").to_pylist(), table.column("blob").to_pylist(), strict=True):
            if home >= 0:
                out.append((0, home, blob))
                continue
            a, b, c = _unpack(blob, 3)
            ids.append(_ids_in(a)), gram.append(_from_six(b)), context.append(_from_six(c))
        if ids:
            i, g, c = np.concatenate(ids), np.concatenate(gram), np.concatenate(context)
            by_gram = _groups(g)
            shared = np.flatnonzero((_least(*by_gram, i) < i) | (_least(*by_gram, -i) < -i))
            i, g, c = i[shared], g[shared], c[shared]
            least = _least(*_groups(g, c), i)
            order, starts = _groups(g)
            several = _least(order, starts, c.astype(np.int64)) < -_least(order, starts, -c.astype(np.int64))
            many = np.empty(len(g), bool)
            many[order] = np.repeat(np.diff(np.append(starts, len(g))) > p.anchor_runs, np.diff(np.append(starts, len(g))))
            key, go = _run_key(g, c), (i == least) & several
            for flag, rows in ((GONE, i > least), (OPEN, go & ~many), (HOT, go & many)):
                out += [(0, home, blob) for home, blob in _answers(i[rows], key[rows], homes, flag)]
        return pa.Table.from_batches([_rows(out)])

    return sort


def _masks(ids: np.ndarray, keys: np.ndarray, count: np.ndarray, gone: np.ndarray, homes: int) -> list[tuple[int, bytes]]:
    """Answers for runs: gone has a flag for each window, count how many each run has.  Runs that lose nothing get none."""
    at = np.cumsum(count) - count
    some = np.flatnonzero(np.add.reduceat(gone, at)) if len(at) else at
    out = []
    for home, rows in _split(_home(ids[some], homes), some):
        rows = rows[np.argsort(ids[rows], kind="stable")]
        bits = np.packbits(gone[_expand(at[rows], count[rows])]).tobytes()
        out.append((home, bytes([MASK]) + _pack(_ids_out(ids[rows]), keys[rows].astype("<u8").tobytes(), count[rows].astype("<u4").tobytes(), bits)))
    return out


def _entries(part: np.ndarray, ids: np.ndarray, keys: np.ndarray, count: np.ndarray, raw: np.ndarray, starts: np.ndarray, depth: int) -> list[tuple[int, int, bytes]]:
    """Runs of ``count`` windows from ``starts`` as rows for the buckets."""
    out = []
    for to, i, k, n, at in _split(part, ids, keys, count, starts):
        order = np.argsort(i, kind="stable")
        text = raw[_expand(at[order], n[order] + depth - 1)].tobytes()
        out.append((to, -1, _pack(_ids_out(i[order]), k[order].astype("<u8").tobytes(), n[order].astype("<u4").tobytes(), _text_out(text))))
    return out


def _sort_windows(p: RepeatParams, homes: int):
    """A bucket of the second step."""

    def sort(table: pa.Table) -> pa.Table:
        out, ids, keys, count, raw = [], [], [], [], []
        for home, blob in zip(table.column("home").to_pylist(), table.column("blob").to_pylist(), strict=True):
            if home >= 0:
                out.append((0, home, blob))
                continue
            a, b, c, d = _unpack(blob, 4)
            ids.append(_ids_in(a)), keys.append(np.frombuffer(b, "<u8")), count.append(np.frombuffer(c, "<u4"))
            raw.append(_text_in(d))
        if ids:
            i, k, n, text = np.concatenate(ids), np.concatenate(keys), np.concatenate(count).astype(np.int64), np.concatenate(raw)
            size = n + p.depth - 1
            gone, _ = repeated(text, _expand(np.cumsum(size) - size, n), np.repeat(i, n), p.depth)
            out += [(0, home, blob) for home, blob in _masks(i, k, n, gone, homes)]
        return pa.Table.from_batches([_rows(out)])

    return sort


class _Told:
    """The answers to a group of documents, by (id, digest)."""

    def __init__(self, blobs: list[bytes]):
        found: dict[int, list[np.ndarray]] = {GONE: [], OPEN: [], HOT: [], MASK: []}
        at, bits, n = [], [], 0
        for blob in blobs:
            if blob[0] == MASK:
                a, b, c, d = _unpack(blob[1:], 4)
                count = np.frombuffer(c, "<u4").astype(np.int64)
                at.append(n + np.cumsum(count) - count)
                bits.append(np.unpackbits(np.frombuffer(d, np.uint8), count=int(count.sum())).astype(bool))
                n += len(bits[-1])
            else:
                a, b = _unpack(blob[1:], 2)
            found[blob[0]].append(self.key(_ids_in(a), np.frombuffer(b, "<u8")))
        self.by = {k: np.unique(np.concatenate(v)) if v else np.zeros(0, U) for k, v in found.items()}
        if at:
            _, first = np.unique(np.concatenate(found[MASK]), return_index=True)
            self.at, self.bits = np.concatenate(at)[first], np.concatenate(bits)

    @staticmethod
    def key(ids: np.ndarray, digest: np.ndarray) -> np.ndarray:
        return mix(digest + ids.astype(U) * _C)

    def place(self, flag: int, keys: np.ndarray) -> np.ndarray:
        """The place of each key among those of the flag, -1 if it is not there."""
        known = self.by[flag]
        if not len(known) or not len(keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, at, -1)

    def has(self, flag: int, keys: np.ndarray) -> np.ndarray:
        return self.place(flag, keys) >= 0


def _expand(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()) if len(first) else np.zeros(0, np.int64)


def _docs(table: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    ids = table.column("_id").combine_chunks().fill_null(NO_ID).to_numpy() if table.num_rows else np.zeros(0, np.int64)
    return ids, [t.encode("utf-8", "surrogatepass") for t in table.column("_text").to_pylist()]


def _send_windows(p: RepeatParams, buckets: int, homes: int):
    def send(docs: pa.Table, answers: pa.Table) -> pa.Table:
        told = _Told(answers.column("blob").to_pylist())
        ids, raws = _docs(docs)
        out: list[tuple[int, int, bytes]] = []
        hot = []
        for a, b in _blocks(raws) if len(told.by[OPEN]) or len(told.by[HOT]) else ():
            block = Block(raws[a:b], p)
            gram, context, doc, first, count = block.runs()
            own, key = ids[a + doc], _run_key(gram, context)
            asked = told.key(own, key)
            go = np.flatnonzero(told.has(OPEN, asked))
            go = go[np.unique(asked[go], return_index=True)[1]]  # a run that a document repeats travels once
            out += _entries((gram[go] % U(buckets)).astype(np.int64), own[go], key[go], count[go], block.raw, first[go], p.depth)
            go = told.has(HOT, asked)
            if go.any():
                starts, owner = _expand(first[go], count[go]), np.repeat(own[go], count[go])
                once = np.unique(told.key(owner, block.windows(starts)), return_index=True)[1]
                starts, owner = starts[once], owner[once]
                hot.append((owner, block.windows(starts), block.raw[_expand(starts, np.full(len(starts), p.depth))]))
        if hot:
            owner, key, raw = (np.concatenate(x) for x in zip(*hot, strict=True))
            starts, single = np.arange(len(owner)) * p.depth, np.ones(len(owner), np.int64)
            gone, one = repeated(raw, starts, owner, p.depth)
            out += [(home % buckets, home, blob) for home, blob in _masks(owner, key, single, gone, homes)]
            out += _entries((key[one] % U(buckets)).astype(np.int64), owner[one], key[one], single[one], raw, starts[one], p.depth)
        return pa.Table.from_batches([_rows(out)])

    return send


def _cut(p: RepeatParams, id_col: str, carry: list[str], whole: bool):
    def cut(docs: pa.Table, answers: pa.Table) -> pa.Table:
        told = _Told(answers.column("blob").to_pylist())
        ids, raws = _docs(docs)
        spans, kept = [], []
        for a, b in _blocks(raws):
            block = Block(raws[a:b], p)
            edge = np.zeros(len(block.raw) + 1, np.int32)
            if len(told.by[GONE]) or len(told.by[MASK]):
                gram, context, doc, first, count = block.runs()
                own = ids[a + doc]
                key = told.key(own, _run_key(gram, context))
                gone = told.has(GONE, key)
                np.add.at(edge, first[gone], 1)
                np.add.at(edge, first[gone] + count[gone] - 1 + p.depth, -1)
                starts = []
                at = told.place(MASK, key)
                if (go := at >= 0).any():
                    starts.append(_expand(first[go], count[go])[told.bits[_expand(told.at[at[go]], count[go])]])
                if (go := told.has(HOT, key)).any():
                    every = _expand(first[go], count[go])
                    starts.append(every[told.has(MASK, told.key(np.repeat(own[go], count[go]), block.windows(every)))])
                for x in starts:
                    np.add.at(edge, x, 1)
                    np.add.at(edge, x + p.depth, -1)
            covered = np.cumsum(edge[:-1]) > 0
            if whole and len(covered):
                begins = np.flatnonzero((block.raw & 0xC0) != 0x80)
                covered = np.repeat(np.logical_and.reduceat(covered, begins), np.diff(np.append(begins, len(covered))))
            for k in range(b - a):
                lo, hi = int(block.at[k]), int(block.at[k + 1])
                own = covered[lo:hi]
                if not own.any():
                    spans.append([])
                    kept.append(raws[a + k])
                    continue
                step = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0))
                spans.append([{"start": int(x), "end": int(y)} for x, y in zip(step[::2], step[1::2], strict=True)])
                kept.append(block.raw[lo:hi][~own].tobytes())
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        size = pa.array([len(r) for r in raws], pa.int64())
        rest = [docs.column(f"_carry{k}") for k in range(len(carry))]
        return pa.Table.from_arrays([docs.column("_id"), size, pa.array(spans, kind), pa.array(kept, pa.binary()), *rest], [id_col, "n_bytes", "spans", "kept", *carry])

    return cut


def _prime(n: int) -> int:
    while n > 2 and any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def _buckets(n: float, each: float) -> int:
    """Buckets of about ``each``; beyond 4096 of them they grow first, up to 13 times."""
    return max(1, min(int(n / each) + 1, max(4096, int(n / (13 * each)))))


def repeated_bytes(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: RepeatParams = RepeatParams(), carry: list[str] | None = None, whole_characters: bool = False
) -> DataFrame:
    """One row per input row: id_col, n_bytes, spans array<struct<start, end>> (maximal runs of removed bytes), kept binary
    (the remaining bytes), and the columns named in carry.

    A byte is removed if a window of ``depth`` bytes that covers it also starts in a document with a smaller id; windows
    are those of the input and never cross documents.  With whole_characters, a character goes only if all its bytes do,
    so that what remains is UTF-8.  Null text counts as empty.  A null id counts as larger than all others; rows with equal
    ids, and rows with null ids among themselves, take nothing from each other.  An empty table gives an empty result.  A
    text is held as a whole, with some 60 bytes per byte.
    """
    carry = carry or []
    if p.depth <= p.gram:
        raise ValueError("an anchor must be shorter than a window")
    docs = df.select(F.col(id_col).cast("long").alias("_id"), text_of(df, text_col).alias("_text"))
    total = docs.agg(F.sum(F.octet_length("_text")).alias("n")).first()["n"] or 0
    homes = _prime(_buckets(total, p.group_mb * 1e6))
    density = 2 / (p.depth - p.gram + 2)
    buckets = _buckets(total * density, p.bucket_runs)
    sent = docs.mapInArrow(_send_runs(p, buckets, homes), ROW)
    answers = written(sent.groupBy("part").applyInArrow(_sort_runs(p, homes), ROW), "repeat-runs")

    # the windows and the cut read the same exchange of texts: both stand in one plan, in which Spark makes it once
    kinds = [df.schema[c].dataType.simpleString() for c in carry]
    home = F.coalesce(F.pmod(F.col("_id"), F.lit(homes)), F.lit(0)).cast("int").alias("home")
    own = [F.col(f"`{c}`").alias(f"_carry{k}") for k, c in enumerate(carry)]
    at_home = df.select(F.col(id_col).cast("long").alias("_id"), text_of(df, text_col).alias("_text"), *own).select("*", home).groupBy("home")
    windows = at_home.cogroup(answers.groupBy("home")).applyInArrow(_send_windows(p, buckets, homes), ROW)
    last = windows.groupBy("part").applyInArrow(_sort_windows(p, homes), ROW)
    told = answers.unionAll(last).groupBy("home")
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` long, n_bytes long, spans array<struct<start: int, end: int>>, kept binary" + "".join(f", `{c}` {k}" for c, k in zip(carry, kinds, strict=True))
    out = at_home.cogroup(told).applyInArrow(_cut(p, id_col, carry, whole_characters), schema)
    return out if kind == "bigint" else out.withColumn(id_col, F.col(f"`{id_col}`").cast(kind))
