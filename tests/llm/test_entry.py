"""The registered corpus queries against their oracles."""

from __future__ import annotations

import re

import duckdb
import pytest

import __spark_entry__
from cellmill.llm import queries


def test_registered():
    names = __spark_entry__.queries()
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in names if n.startswith("op")} == set(range(1, 11)) and "pipeline" in names


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_oracle(spark, sf, name, size):
    sf = sf.replace("sf0.001", size)
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf).toPandas(), c.sql(queries.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda df: sorted(map(repr, df[columns].astype(object).where(df[columns].notna(), None).values.tolist()))
    assert rows(got) == rows(want)
