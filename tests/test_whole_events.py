"""The event queries where the table reaches beyond the grid EVENTS."""

from __future__ import annotations

import duckdb
import pytest

from cellmill.functions.grid import BBox, GridSpec
from cellmill.plans.queries import EVENTS, ORACLE_SQL, QUERIES

LARGE = "/root/testdata/sf0.1"
CELLS = f"""WITH e AS (SELECT CAST(149 - user_id // 10 AS INTEGER) AS "row", CAST((epoch_us(ts) - 1704067200000000) // 21600000000 AS INTEGER) AS col, value, ts, event_id
    FROM '{LARGE}/events.parquet')"""


def test_covering():
    grid = GridSpec.of(0, 0, 6, 4, 1, -1, 3, 2)
    assert grid.covering(BBox()) is grid and grid.covering(BBox(0, 0, 6, 4)) is grid and grid.covering(BBox(1, 1, 2, 2)) is grid
    wider = grid.covering(BBox(-0.1, 1, 9, 6.5))
    assert wider.bounds == BBox(-3, 0, 9, 8) and (wider.width, wider.height, wider.tiles_x, wider.tiles_y) == (12, 8, 4, 4)
    with pytest.raises(ValueError, match="finite"):
        grid.covering(BBox(0, 0, float("inf"), 1))


def test_no_event_is_dropped(spark):
    sql = lambda q: {(r, c): v for r, c, v in duckdb.sql(f"{CELLS} {q}").fetchall()}
    got = lambda name: {(r.row, r.col): r.v for r in QUERIES[name](spark, LARGE).collect()}
    mean = sql('SELECT "row", col, avg(value) FROM e GROUP BY 1, 2')
    assert {r for r, _ in mean} == set(range(150))
    assert got("event_avg") == pytest.approx(mean, abs=1e-8)
    assert got("event_most_recent") == pytest.approx(sql('SELECT "row", col, arg_max(value, ts) FROM e GROUP BY 1, 2'), abs=1e-8)
    valid = sql('SELECT "row", col, 1 FROM e WHERE event_id % 5 = 0 GROUP BY 1, 2')
    assert got("valid_mask") == {(r, c): int((r, c) in valid) for r in range(150) for c in range(120)}
    stats = QUERIES["raster_stats"](spark, LARGE).first()
    assert (stats.cells, stats.covered) == (18000, len(mean)) and EVENTS.width * EVENTS.height == 1800
    odd = [sql(f'SELECT "row", col, 1 FROM e WHERE event_id % {k} = 0 GROUP BY 1, 2').keys() for k in (2, 3)]
    diff = QUERIES["raster_diff"](spark, LARGE).first()
    assert (diff.compared, diff.only_left, diff.only_right) == (len(odd[0] & odd[1]), len(odd[0] - odd[1]), len(odd[1] - odd[0]))
    assert len(got("dense_sum_touched")) == 18000


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_all_events_count(spark, scale):
    """Sums, masks and differences of all rows, by world coordinates instead of rows and columns."""
    path = f"/root/testdata/{scale}"
    n, total, fine, coarse = duckdb.sql(f"""SELECT count(*), sum(value), count(DISTINCT ((epoch_us(ts) - 1704067200000000) // 7200000000, user_id // 2)),
        count(DISTINCT ((epoch_us(ts) - 1704067200000000) // 21600000000, user_id // 10)) FROM '{path}/events.parquet'""").fetchall()[0]
    mask = [r.v for r in QUERIES["valid_mask_all"](spark, path).collect()]
    assert sum(mask) == fine < len(mask)
    sums = [r.v for r in QUERIES["dense_sum_touched_all"](spark, path).collect()]
    assert len(sums) == len(mask) and sum(v for v in sums if v is not None) == pytest.approx(total, rel=1e-9)
    assert None in sums and 0 in sums
    diff = QUERIES["raster_diff_all"](spark, path).first()
    assert (diff.compared, diff.only_left, diff.only_right) == (coarse, 0, 0) and n == 10000 * (10 if scale == "sf0.1" else 1)
    want = duckdb.connect()
    want.sql(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet'")
    for name in ("valid_mask_all", "dense_sum_touched_all", "raster_diff_all"):
        rows, sql = QUERIES[name](spark, path).toPandas(), want.sql(ORACLE_SQL[name]).df()
        key = ["row", "col"] if "row" in rows else ["compared"]
        assert rows[sql.columns].sort_values(key).reset_index(drop=True).equals(sql.sort_values(key).reset_index(drop=True))
