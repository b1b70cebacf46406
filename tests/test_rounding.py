"""Results whose last digits would else depend on the order in which values are summed up."""

from __future__ import annotations

import math
from fractions import Fraction

import duckdb

from cellmill.plans.more_queries import FINE
from cellmill.plans.queries import QUERIES, _cells


def test_means_halfway_are_rounded_up(spark):
    """Against fractions, at a size where 791 of 16,836 cells lie halfway."""
    sf = "/root/testdata/sf0.01"
    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW lineitem AS SELECT l_extendedprice AS x, l_quantity AS y, CAST(round(l_discount * 100) AS BIGINT) AS cents FROM '{sf}/lineitem.parquet'")
        cells = c.sql(f'WITH p AS (FROM lineitem), {_cells(FINE)} SELECT "row", col, CAST(sum(cents) AS BIGINT), count(*) FROM c GROUP BY 1, 2').fetchall()
    means: dict[tuple[int, int], list[Fraction]] = {}
    for row, col, cents, n in cells:
        means.setdefault((row // 2, col // 2), []).append(Fraction(cents, 100 * n))
    exact = {k: sum(v) / len(v) for k, v in means.items()}
    assert sum((v * 20000).denominator == 1 and (v * 20000).numerator % 2 == 1 for v in exact.values()) == 791
    want = {k: math.floor(v * 10000 + Fraction(1, 2)) / 10000 for k, v in exact.items()}
    assert {(r.row, r.col): r.v for r in QUERIES["pyramid_first"](spark, sf).collect()} == want
