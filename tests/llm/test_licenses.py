from __future__ import annotations

import re
from itertools import combinations

from hypothesis import given, settings
from hypothesis import strategies as st

from cellmill.llm.licenses import TEMPLATES, align, license_scan, rising, words_of


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@given(st.lists(st.integers(0, 9), max_size=9))
def test_rising_is_longest(values):
    got = [values[i] for i in rising(values)]
    assert got == sorted(set(got))
    longest = max(n for n in range(len(values) + 1) if any(list(c) == sorted(set(c)) for c in combinations(values, n)))
    assert len(got) == longest


words = st.lists(st.sampled_from("abcdefghij"), max_size=14)


@settings(max_examples=200)
@given(words, words)
def test_alignment_is_a_common_subsequence(text, template):
    got = align(text, template)
    assert all(text[i] == template[j] for i, j in got)
    assert all(a < c and b < d for (a, b), (c, d) in zip(got, got[1:], strict=False))
    assert len(got) <= lcs(text, template)
    if len(set(text)) == len(text) and len(set(template)) == len(template):
        assert len(got) == lcs(text, template)


def test_odd_rows(spark):
    apache, mit = TEMPLATES["Apache-2.0-notice"], TEMPLATES["MIT"]
    filler = " ".join(f"w{i}" for i in range(3000))
    texts = [
        None, "", "Licensed", apache, filler + " " + apache + " " + filler, f"{apache} x {apache} y {apache}", mit.upper(), mit.replace("merge", "fuse").replace("sell", "vend"),
        " ".join(words_of(apache)[0] + " " + filler for _ in range(3)), TEMPLATES["Apache-2.0-header"], filler + " released under our MIT license.", apache,
    ]
    df = spark.createDataFrame([(i if i else None, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, license string")
    got = license_scan(df).collect()
    assert [r.license for r in got] == [
        None, None, None, "Apache-2.0-notice", "Apache-2.0-notice", "Apache-2.0-notice", "MIT", "MIT", None, "Apache-2.0-header", "MIT-notice", "Apache-2.0-notice",
    ]
    assert got[3].coverage == 1 and (got[4].first_word, got[4].end_word) == (3000, 3007) and got[7].coverage < 1 and got[10].coverage == 0.8
    assert license_scan(df.where("false")).count() == 0


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r for r in license_scan(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert rows.keys() == texts.keys()
    squeeze = lambda t: " ".join(words_of(t))
    short = {k: squeeze(v) for k, v in TEMPLATES.items() if k.endswith("notice")}
    for doc_id, text in texts.items():
        if re.search("licens", text, re.I):
            inside = {k for k, v in short.items() if v in squeeze(text)}
            assert (rows[doc_id].license in inside) if inside else True
        elif rows[doc_id].license:
            assert rows[doc_id].coverage < 1


def test_all_findings(spark):
    filler = " ".join(f"w{i}" for i in range(40))
    mit, apache, gpl, notice = (TEMPLATES[k] for k in ("MIT", "Apache-2.0-header", "GPL-3.0-header", "Apache-2.0-notice"))
    texts = [f"{mit} {filler} {apache} {filler} {gpl}", f"{mit} {apache}", f"x {notice} {filler} {notice} {notice} y {notice}", "", f"license the {mit} {mit} {mit} the software"]
    texts += [mit.replace("subject to", f"{notice} subject to"), f"{gpl} {TEMPLATES['GPL-2.0-header']}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = [r for r in sorted(license_scan(df).collect())]
    named = [[f.license for f in sorted(r.findings, key=lambda f: f.first_word)] for r in rows]
    assert named == [
        ["MIT", "Apache-2.0-header", "GPL-3.0-header"], ["MIT", "Apache-2.0-header"], ["Apache-2.0-notice"] * 4, [], ["MIT"] * 3,
        ["MIT", "Apache-2.0-notice"], ["GPL-3.0-header", "GPL-2.0-header"],
    ]
    for r, text in zip(rows, texts, strict=True):
        assert all(f.coverage > 0.95 and 0 <= f.first_word < f.end_word <= len(words_of(text)) for f in r.findings)
        assert (r[1:6] == tuple(r.findings[0])) if r.findings else r.license is None


def test_every_template_is_found_as_itself(spark):
    df = spark.createDataFrame([(name, f"Copyright someone. {text} And more.") for name, text in TEMPLATES.items()], "doc_id string, text string")
    assert all([f.license for f in r.findings] == [r.doc_id] and r.coverage == 1 for r in license_scan(df).collect())
    assert {"GPL-2.0-header", "LGPL-2.1-header", "AGPL-3.0-header", "MPL-2.0-header", "EPL-2.0-header", "BSD-2-Clause", "BSD-3-Clause", "ISC-text"} <= TEMPLATES.keys()
