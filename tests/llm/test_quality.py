from __future__ import annotations

import re
from collections import Counter

import pytest

from cellmill.llm.common import written
from cellmill.llm.quality import QualityRules, keep_good, quality_rules, thresholds, with_counts

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
CLEAN = " ".join(f"w{i}ord" for i in range(70))
ODD = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t\x0b ", None, None), (4, "a b c a b c", "en", "a"), (5, "x\nx\n\nx \nx", "de", None),
    (6, "#*$%&|<> ## é😀\xa0z", "en", "b"), (7, "a a a a", "en", "b"), (8, "one two", "en", "b"), (None, CLEAN, "en", "b"), (9, CLEAN, "en", "b"),
    (9, CLEAN, "en", "b"), (10, "word " * 5000, None, "b"), (11, CLEAN + " # " * 40, "en", "b"), (12, "\n".join([CLEAN[:50]] * 9), "en", "b"),
    (13, "a b a b a b c d e a b", "en", "b"), (14, "x\r\nx\r\ny\x0cz \x1c \x85", "en", "b"),
]


def brute(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    times = Counter(windows)
    covered = {j for i, w in enumerate(windows) if times[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    n = len(words)
    failed = n < 50 or 100 * len(covered) > 50 * n
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 1, "x") for r in ODD], "doc_id long, text string, lang string, source string, n_words int, _id string")


def test_counts_of_odd_texts(odd):
    got = sorted([tuple(r)[:7] for r in quality_rules(odd).collect()], key=repr)
    assert got == sorted([(i, *brute(t)) if i != 10 else (10, 5000, 20000, 0, 0, 5000, True) for i, t, *_ in ODD], key=repr)


def test_counts_of_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = quality_rules(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r)[1:7] == brute(texts[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_verdicts_follow_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality_rules(docs).where("not base_failed").join(labels, "doc_id").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.98 * len(good)
    assert sum(r.kept for r in bad) <= 0.5 * len(bad)


def test_bounds_adapt(spark):
    """The same symbols are normal in one source and junk in another."""
    line = lambda i, k: " ".join(f"a{i}b{j}" + "#" * k for j in range(60))
    rows = [(i, line(i, 2), "en", "code") for i in range(150)] + [(1000 + i, line(i, 0), "en", "prose") for i in range(150)] + [(5000, line(7, 2), "en", "prose")]
    got = {r.doc_id: r.kept for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(150)) and all(got[1000 + i] for i in range(150)) and not got[5000]


def test_every_bound_adapts_by_source(spark):
    """Sources differ in each measure, and so do their bounds; small sources lean on their language."""
    import random

    r = random.Random(2)

    def text(kind, i):
        words = [f"{chr(97 + r.randrange(26)) * r.randrange(2, 6)}{j}" for j in range(60)]
        if kind == "long":
            words = [w * (2 + i % 2) for w in words]
        if kind == "marked":
            words = [w + "#" * (i % 3) for w in words]
        if kind == "again":
            words += words[: 6 * (i % 4)]
        lines = [" ".join(words[k : k + 10]) for k in range(0, len(words), 10)]
        return "\n".join(lines + lines[:1] * (i % 3) if kind == "lines" else lines)

    kinds = ["plain", "long", "marked", "again", "lines"]
    rows = [(1000 * k + i, text(kind, i), "en", kind) for k, kind in enumerate(kinds) for i in range(300)] + [(9000, text("plain", 0), "en", "few")]
    counted = written(with_counts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), "text"), "test-counts")
    found = {x._q_source: x for x in thresholds(counted, "lang", "source", QualityRules()).collect()}
    for kind, measure in zip(kinds[1:], ("word_length", "symbol_ratio", "repeat_ratio", "dup_line_ratio"), strict=True):
        high = {k: x[f"_q_high_{measure}"] for k, x in found.items()}
        assert high[kind] > max(v for k, v in high.items() if k not in (kind, "few")) + 0.01
        assert high["plain"] <= high["few"]


def test_bounds_and_verdicts_of_table_by_hand(spark, sf):
    """Every bound and verdict from exact quantiles; at this size sketches hold every document."""
    import math

    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rules = QualityRules()
    data = {}
    for d in docs:
        n, chars, symbols, dup, repeat, failed = brute(d.text)
        lines = sum(bool(WORDS.search(x)) for x in (d.text or "").split("\n"))
        data[d.doc_id] = failed, n, lines, (chars / n, symbols / n, dup / lines, repeat / n) if n else None
    groups, langs = {}, {}
    for d in docs:
        if not data[d.doc_id][0]:
            groups.setdefault((d.lang, d.source), []).append(data[d.doc_id][3])
            langs.setdefault(d.lang, []).append(data[d.doc_id][3])

    def at(rows, k, q):
        values = sorted(x[k] for x in rows)
        return values[max(0, math.ceil(q * len(values) - 1e-9) - 1)]

    def fence(rows, k, q):
        return at(rows, k, q) + rules.reach * (at(rows, k, q) - at(rows, k, 0.5))

    def bound(d, k, q):
        own, whole = groups[d.lang, d.source], langs[d.lang]
        w = len(own) / (len(own) + rules.own_rows)
        drawn = (w * fence(own, k, q) + (1 - w) * fence(whole, k, q)) / rules.step
        return (math.ceil(drawn - 1e-9) if q > 0.5 else math.floor(drawn + 1e-9)) * rules.step

    got = {r.doc_id: r.kept for r in quality_rules(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    for d in docs:
        failed, n, lines, m = data[d.doc_id]
        if failed:
            assert not got[d.doc_id]
            continue
        own = (0, 1 / n, 1 / lines, 3 / n)
        over = max(m[k] - bound(d, k, rules.tail) - rules.reach * own[k] for k in range(4))
        beyond = max(over, bound(d, 0, 1 - rules.tail) - m[0])
        assert abs(beyond) < 1e-9 or got[d.doc_id] == (beyond < 0), d.doc_id


def test_filter_keeps_columns_and_agrees(spark, odd, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in quality_rules(docs).where("kept").collect()}
    rows = keep_good(docs)
    assert rows.columns == docs.columns and {r.doc_id for r in rows.collect()} == kept
    assert keep_good(odd.where("false")).count() == 0 and quality_rules(odd.where("false")).count() == 0
    assert keep_good(odd).columns == odd.columns


def test_native(odd):
    plan = keep_good(odd, rules=QualityRules(min_words=2))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
