"""The event queries against their own SQL, where its fixed bounds do not decide."""

from __future__ import annotations

import re

import duckdb
import pytest

from cellmill.plans.queries import EVENTS, ORACLE_SQL, QUERIES, _cells, _covered

LARGE = "/root/testdata/sf0.1"
NAMES = ["event_most_recent", "raster_diff", "raster_stats", "valid_mask", "dense_sum_touched", "event_avg"]


def grown(name: str) -> str:
    """The query's SQL with the grid that covers the table in place of the fixed one."""
    sql = ORACLE_SQL[name].replace(_cells(EVENTS), _covered(EVENTS).replace("b AS (", "box AS (", 1).replace("FROM b)", "FROM box)"))
    sql = re.sub(r",\s+g AS \(SELECT [^)]*\) AS \"row\", [^)]*\) AS col FROM range\(1800\) r\(id\)\)", "", sql).replace("FROM g LEFT", "FROM all_cells g LEFT")
    return sql.replace("1800::BIGINT AS cells", "(SELECT width * height FROM g) AS cells").replace("/ 1800", "/ (SELECT width * height FROM g)")


def differing(got, want) -> int:
    """Rows of either side that the other does not have, numbers apart from rounding."""
    key = [c for c in ("row", "col") if c in want]
    numbers = [c for c in want if c not in key]
    both = got.merge(want, "outer", key, suffixes=("", "_sql"), indicator="_side") if key else got.join(want, rsuffix="_sql").assign(_side="both")
    wrong = both["_side"] != "both"
    for c in numbers:
        a, b = both[c].astype(float), both[f"{c}_sql"].astype(float)
        wrong |= ~(((a - b).abs() <= 1e-8) | (a.isna() & b.isna()))
    return int(wrong.sum())


@pytest.mark.parametrize("name", NAMES)
def test_sql_on_the_grown_grid(spark, name):
    assert "1800" not in grown(name) and "150" not in grown(name).split("c AS")[1]
    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW events AS SELECT * FROM '{LARGE}/events.parquet'")
        assert differing(QUERIES[name](spark, LARGE).toPandas(), c.sql(grown(name)).df()) == 0


def test_sql_as_it_is_where_no_event_lies_outside(spark, tmp_path):
    """All 10,014 events of sf0.1 that its bounds leave."""
    with duckdb.connect() as c:
        c.sql(f"COPY (SELECT * FROM '{LARGE}/events.parquet' WHERE user_id < 150) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
        c.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
        for name in NAMES:
            assert differing(QUERIES[name](spark, str(tmp_path)).toPandas(), c.sql(ORACLE_SQL[name]).df()) == 0, name


CELLWISE = ["dense_sum_touched", "event_most_recent", "valid_mask", "event_avg"]


@pytest.mark.parametrize("name", CELLWISE)
def test_cells_inside_the_bounds(spark, name):
    """Over the whole table, with the SQL as it is: the same cells and values there, with rows counted from the new corner."""
    got, above = QUERIES[name](spark, LARGE).toPandas(), 150 - EVENTS.height
    inside = got[got["row"] >= above]
    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW events AS SELECT * FROM '{LARGE}/events.parquet'")
        assert differing(inside.assign(row=inside["row"] - above), c.sql(ORACLE_SQL[name]).df()) == 0


def test_sums_lose_no_event_to_the_bounds(spark):
    """The filter of dense_sum_touched leaves no event outside them, so the cells beyond are empty."""
    part, inside = duckdb.sql(f"""WITH p AS (SELECT (epoch_us(ts) - 1704067200000000) / 3600000000.0 AS x, user_id + 0.5 AS y FROM '{LARGE}/events.parquet')
        SELECT count(*), count(*) FILTER (x BETWEEN 0 AND 720 AND y BETWEEN 0 AND 150) FROM p WHERE x < 200 AND y < 60""").fetchall()[0]
    assert part == inside == 1111
    got = QUERIES["dense_sum_touched"](spark, LARGE).toPandas()
    assert got[got["row"] < 150 - EVENTS.height]["v"].isna().sum() == len(got) - EVENTS.width * EVENTS.height == 16200
