from __future__ import annotations

import hashlib

import pytest

from cellmill.llm.exact import exact_dedup

ROWS = [(1, "a"), (2, "a"), (3, ""), (4, None), (5, "a "), (5, "a "), (None, "b"), (6, "b"), (None, "c"), (None, "c"), (7, "é" * 40000), (8, "é" * 40000)]


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_small_cases(spark, keep):
    df = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "doc_id long, text string, keep_id string, _hash int")
    got = [tuple(r) for r in exact_dedup(df, keep=keep).collect()]
    want = []
    for i, t in ROWS:
        ids = [j for j, u in ROWS if (u or "") == (t or "")]
        known = [j for j in ids if j is not None]
        stays = (min if keep == "smallest" else max)(known) if known else None
        want.append((i, stays, len(ids), i == stays, hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_empty_and_arguments(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup(df).count() == 0
    with pytest.raises(ValueError):
        exact_dedup(df, keep="first")


def test_plan_is_native(spark):
    plan = exact_dedup(spark.createDataFrame(ROWS[:2], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
