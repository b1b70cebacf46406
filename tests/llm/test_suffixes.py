from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from cellmill.llm.suffixes import NO_ID, RepeatParams, _ids_in, _ids_out, repeated, repeated_bytes


def brute(rows, depth):
    """(id, n_bytes, spans, kept) of each row, from the least id of every window."""
    rows = [(i, (t or "").encode("utf-8", "surrogatepass")) for i, t in rows]
    order = lambda i: (i is None, i or 0)
    least: dict[bytes, tuple] = {}
    for i, raw in rows:
        for k in range(len(raw) - depth + 1):
            w = raw[k : k + depth]
            least[w] = min(least.get(w, order(i)), order(i))
    out = []
    for i, raw in rows:
        gone = np.zeros(len(raw) + 2, bool)
        for k in range(len(raw) - depth + 1):
            if least[raw[k : k + depth]] < order(i):
                gone[k + 1 : k + 1 + depth] = True
        step = np.flatnonzero(np.diff(gone))
        spans = [(int(a), int(b)) for a, b in zip(step[::2], step[1::2], strict=True)]
        out.append((i, len(raw), spans, bytes(b for b, g in zip(raw, gone[1:-1], strict=True) if not g)))
    return sorted(out, key=repr)


def found(df, p):
    rows = repeated_bytes(df, p=p).collect()
    return sorted([(r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in rows], key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_small_alphabets(spark, seed):
    """Few letters: anchors repeat everywhere, with many contexts."""
    r = random.Random(seed)
    rows = [(r.randrange(40), "".join(r.choice("ab" if seed else "abcé") for _ in range(r.randrange(0, 60)))) for _ in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for depth, gram, many in ((8, 3, 4), (12, 11, 10_000), (6, 1, 20)):
        p = RepeatParams(depth=depth, gram=gram, held_runs=50, bucket_runs=40, anchor_runs=many, group_mb=0.0007)
        assert found(df, p) == brute(rows, depth)


def test_passages_copies_and_odd_rows(spark):
    r = random.Random(9)
    words = [f"w{r.randrange(10**5)}" for _ in range(4000)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, base = text(30), text(150)
    rows = [(i, text(40) + " " + passage[: r.randrange(40, len(passage))] + " " + text(20)) for i in range(30)]
    rows += [(100 + i, base.replace(base[200:204], str(i))) for i in range(20)] + [(200 + i, base) for i in range(20)]
    rows += [(300, passage + " and again " + passage), (301, passage[:49]), (302, passage[:50]), (303, None), (304, ""), (305, "x" * 500), (306, "x" * 700), (307, "x" * 49)]
    rows += [(None, base), (None, base), (8, passage), (8, text(60)), (-5, passage), (400, "漢字é" * 40), (401, "字é漢" * 40), (402, text(60_000)), (403, passage)]
    df = spark.createDataFrame([(*x, "k") for x in rows], "doc_id long, text string, home string")
    want = brute(rows, 50)
    assert found(df, RepeatParams()) == want
    assert found(df, RepeatParams(held_runs=300, bucket_runs=500, anchor_runs=3, group_mb=0.01)) == want
    assert repeated_bytes(df.where("false")).count() == 0


@pytest.mark.parametrize("depth", [1, 7, 8, 9, 50])
def test_radix_passes(depth):
    r = np.random.default_rng(depth)
    raw = np.concatenate([r.integers(0, 2, 300), np.tile(r.integers(0, 256, 60), 5), np.zeros(90, np.int64)]).astype(np.uint8)
    starts = r.permutation(len(raw) - depth + 1)[:400]
    ids = r.integers(-3, 12, len(starts))
    gone, one = repeated(raw, starts, ids, depth)
    groups: dict[bytes, list[int]] = {}
    for k, at in enumerate(starts):
        groups.setdefault(raw[at : at + depth].tobytes(), []).append(k)
    for rows in groups.values():
        least = min(ids[rows])
        assert gone[rows].tolist() == (ids[rows] > least).tolist()
        several = len(set(ids[rows])) > 1
        assert one[rows].sum() == (1 if several else len(rows)) and (ids[rows][one[rows]] == least).all()
    assert all(len(x) == 0 for x in repeated(raw, starts[:0], ids[:0], depth))


def test_anchor_of_many_contexts_is_dealt_out(spark):
    """A passage shorter than a window in texts that are otherwise random: nothing repeats, and no bucket holds all."""
    import cellmill.llm.suffixes as m

    r = random.Random(6)
    text = lambda n: "".join(chr(97 + r.randrange(26)) for _ in range(n))
    passage = text(40)
    rows = [(i, text(30) + passage + text(30)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(not spans for _, _, spans, _ in found(df, RepeatParams(anchor_runs=50)))
    sent = m._send_windows(RepeatParams(), 16, 1)
    table = pa.table({"_id": pa.array([i for i, _ in rows]), "_text": [t for _, t in rows]})
    raws = [t.encode() for _, t in rows]
    gram, context, doc, _, _ = m.Block(raws, RepeatParams()).runs()
    hot = m._answers(doc, m._run_key(gram, context), 1, m.HOT)
    out = sent(table, pa.table({"blob": pa.array([b for _, b in hot], pa.binary())}))
    sizes = [len(m._unpack(b, 4)[1]) // 8 for b in out.column("blob").to_pylist()]
    assert len(sizes) == 16 and max(sizes) < 2 * sum(sizes) / 16


def test_query(spark, sf):
    from cellmill.llm.queries import op8_repeated_bytes

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(map(tuple, op8_repeated_bytes(spark, sf).collect()))
    want = [(i, n, sum(b - a for a, b in s), len(s), hashlib.sha256(k).hexdigest()) for i, n, s, k in brute(docs, 50)]
    assert got == sorted(want)


def test_ids_round_trip():
    for ids in ([], [5], [5, 5, 2, NO_ID, NO_ID, -7, 5]):
        assert _ids_in(_ids_out(np.array(ids, np.int64))).tolist() == ids
