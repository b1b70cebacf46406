from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from cellmill.llm.components import connected_components
from cellmill.llm.minhash import MinHashParams, near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text, k):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}


def brute(rows, k, similar):
    sets = {i: shingles(t, k) for i, t in rows}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    common = Counter((a, b) for own in holders.values() for n, a in enumerate(own) for b in own[n + 1 :])
    edges = [(a, b) for (a, b), n in common.items() if 100 * n >= similar * (len(sets[a]) + len(sets[b]) - n)]
    root = roots(sets, edges)
    return sorted((i, len(s), root[i], root[i] == i) for i, s in sets.items())


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(i, i + 1) for i in range(200, 260)] + [(r.randrange(150), r.randrange(150)) for _ in range(90)] + [(500, i) for i in range(501, 560)] + [(9, 9)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "u long, v long")).collect()))
    want = roots({n for e in edges for n in e}, edges)
    assert got == {n: want[n] for n in got} and set(got) == {n for a, b in edges if a != b for n in (a, b)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_table_against_brute_force(spark, sf):
    from cellmill.llm.queries import op5_minhash

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, op5_minhash(spark, sf).collect())) == brute(docs, 3, 85)


def test_groups_and_odd_rows(spark):
    r = random.Random(4)
    base = [f"w{r.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(60):  # near copies of a text that is not among them: some pairs are links, some are not
        own = list(base)
        own[r.randrange(120)] = f"x{i}"
        if i % 3 == 0:
            own[r.randrange(120)] = f"y{i}"
        rows.append((i, " ".join(own)))
    chain = [f"c{j}" for j in range(100)]
    for i in range(12):  # neighbours are linked, the ends are not
        rows.append((1000 - i, " ".join(chain[2 * i :] + [f"d{j}" for j in range(2 * i)])))
    rows += [(2000, "One two"), (2001, "one\x0btwo\n"), (2002, "one"), (2003, "one two three"), (2004, None), (2005, ""), (2006, " \n"), (2007, "é É"), (2008, "é é")]
    rows += [(3000 + i, rows[5][1].upper() if i % 2 else rows[5][1]) for i in range(30)] + [(4000, "long " * 30_000)]
    df = spark.createDataFrame([(*x, "c") for x in rows], "doc_id long, text string, component_id string")
    for k, similar in ((3, 85), (5, 80)):
        for sizes in ({"member_limit": 7, "small_bucket": 2, "block_rows": 11}, {"small_bucket": 100}, {"small_bucket": 3}):
            got = near_duplicates(df, p=MinHashParams(words=k, similar=similar, **sizes))
            assert sorted(map(tuple, got.collect())) == brute(rows, k, similar)


def test_words_that_a_polynomial_would_confuse(spark):
    """The Thue-Morse word and its complement have equal hashes under every polynomial modulo 2**64."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = word.translate({97: "b", 98: "a"})
    df = spark.createDataFrame([(1, word), (2, other), (3, word * 64), (4, other * 64)], "doc_id long, text string")
    assert sorted(map(tuple, near_duplicates(df).collect())) == [(i, 1, i, True) for i in (1, 2, 3, 4)]


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = sorted(map(tuple, near_duplicates(df).collect()), key=repr)
    assert got == sorted([(None, 2, None, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 0, None, True)], key=repr)
    assert near_duplicates(df.where("false")).count() == 0


def test_scratch_tables_go(spark, tmp_path, monkeypatch):
    import os

    monkeypatch.setattr("cellmill.llm.common.shared_dir", lambda spark: f"file://{tmp_path}")
    df = spark.createDataFrame([(i, f"a b c d e f {i // 2}") for i in range(8)], "doc_id long, text string")
    assert near_duplicates(df).where("kept").count() == 4
    assert sorted(x.rsplit("-", 1)[0] for x in os.listdir(tmp_path / "cellmill")) == ["near-components", "near-signatures"]
