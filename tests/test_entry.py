"""Every query of the core against its oracle, as the driver compares them."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__
from cellmill.plans import queries as core

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def test_flagship(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["row", "col", "mean", "n"] and df.count() > 0


def test_every_core_query_has_an_oracle():
    assert core.QUERIES.keys() == core.ORACLE_SQL.keys()
    assert core.QUERIES.keys() <= __spark_entry__.queries().keys() and core.ORACLE_SQL.keys() <= __spark_entry__.oracle_sql().keys()


@pytest.mark.parametrize("name", core.QUERIES)
def test_oracle(spark, sf, oracle, name):
    got = core.QUERIES[name](spark, sf).toPandas()
    want = oracle.sql(core.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and (got[columns].dtypes == want[columns].dtypes).all()
    rows = lambda df: sorted(map(repr, df[columns].astype(object).where(df[columns].notna(), None).values.tolist()))
    assert rows(got) == rows(want)
