from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cellmill.functions.filters import FilterSpec
from cellmill.functions.grid import GridSpec
from cellmill.functions.reductions import Reduction
from cellmill.operators.reduce import reduce_points
from cellmill.plans.pipeline import Pipeline, PipelineConfig
from cellmill.streaming.ingest import ingest_stream, live_cells, read_stream, windowed_cells
from cellmill.streaming.state import StateStore

GRID = GridSpec.of(0, 0, 10, 10, 1, -1, 5, 5)
RS = [Reduction("v", k, band=k) for k in ("sum", "max", "count", "average")] + [Reduction("v", "most_recent", order="t", band="last")]


@pytest.fixture(scope="module")
def cloud(spark):
    return spark.range(500).select((F.col("id") * 37 % 100 / 10).alias("x"), (F.col("id") * 53 % 97 / 10).alias("y"), (F.col("id") % 13).cast("double").alias("v"), "id", F.col("id").alias("t"))


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_batches_replace_and_merge(spark, cloud, tmp_path):
    store = StateStore(spark, str(tmp_path), GRID, RS)
    assert store.batches() == [] and store.stats() == {"batches": 0, "tiles": 0, "cells": 0}
    for k in (0, 1, 1, 2):
        store.ingest(cloud.where(F.col("id") % 3 == k), k)
    want = rows(reduce_points(cloud, GRID, RS))
    assert rows(store.result()) == want and store.batches() == [0, 1, 2]
    assert store.tiles().count() == 4 and store.result((0, 1)).count() == sum(r[0] < 5 <= r[1] for r in want)
    plan = store.rows((0, 1))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tile_row" in plan
    store.compact()
    assert store.batches() == [-1] and rows(store.result()) == want
    again = StateStore(spark, str(tmp_path), GRID, RS, resume=True)
    again.ingest(cloud.limit(0), 5)
    assert rows(again.result()) == want
    with pytest.raises(ValueError):
        StateStore(spark, str(tmp_path), GRID, RS[:1], resume=True)
    assert StateStore(spark, str(tmp_path), GRID, RS[:1], reduction_id="other").batches() == [] and again.batches() == [-1, 5]
    assert StateStore(spark, str(tmp_path), GRID, RS).batches() == []
    with pytest.raises(ValueError):
        StateStore(spark, str(tmp_path), GRID, [Reduction("v", "median")])


def test_redelivery_after_compaction_counts_once(spark, cloud, tmp_path):
    store = StateStore(spark, str(tmp_path), GRID, RS)
    for k in (0, 1, 3):
        assert store.ingest(cloud.where(F.col("id") % 4 == k), k)
    store.compact()
    assert not store.ingest(cloud.where("id % 4 = 1"), 1)
    assert store.ingest(cloud.where("id % 4 = 2"), 2) and store.batches() == [-1, 2]
    assert rows(store.result()) == rows(reduce_points(cloud, GRID, RS))
    store.compact()
    store.compact()
    assert store.batches() == [-2] and rows(store.result()) == rows(reduce_points(cloud, GRID, RS))
    again = StateStore(spark, str(tmp_path), GRID, RS, resume=True)
    assert not any(again.ingest(cloud, k) for k in range(4)) and rows(again.result()) == rows(store.result())
    with pytest.raises(ValueError):
        store.ingest(cloud, -2)


@pytest.mark.parametrize("step", ["write", "rename", "delete 0", "delete 1", "delete 2"])
def test_crash_in_compaction(spark, cloud, tmp_path, monkeypatch, step):
    """Whatever the step that fails, the states are those before, and the next compaction ends well."""
    store = StateStore(spark, str(tmp_path), GRID, RS)
    store.ingest(cloud.where("id < 100"), 0)
    store.compact()
    store.ingest(cloud.where("id >= 100"), 1)
    want = rows(reduce_points(cloud, GRID, RS))
    left = [int(step[-1]) if step.startswith("delete") else 0]

    def fail(own):
        def go(*args):
            if left[0] == 0:
                raise OSError("crash")
            left[0] -= 1
            return own(*args)

        return go

    name = {"write": "_write", "rename": "_rename"}.get(step, "_delete")
    with monkeypatch.context() as m:
        m.setattr(store, name, fail(getattr(store, name)))
        with pytest.raises(OSError):
            store.compact()
    again = StateStore(spark, str(tmp_path), GRID, RS, resume=True)
    assert rows(again.result()) == want
    again.ingest(cloud.where("id >= 100"), 1)
    assert rows(again.result()) == want
    again.compact()
    assert rows(again.result()) == want and len(again.batches()) == 1
    left = sorted(x for x in __import__("os").listdir(tmp_path / "reduction_id=default") if not x.startswith("."))
    assert left == sorted(["_kept", f"_base{again.batches()[0]}", f"batch_id={again.batches()[0]}"])


def test_stream(spark, cloud, tmp_path):
    cloud.repartition(5).write.parquet(str(tmp_path / "in"))
    store, heard = StateStore(spark, str(tmp_path / "state"), GRID, RS), []
    stream = read_stream(spark, str(tmp_path / "in"), cloud.schema, files_per_trigger=2)
    spec = FilterSpec().add("v", "<", 10)
    ingest_stream(stream, store, str(tmp_path / "cp"), spec, on_progress=heard.append).awaitTermination()
    assert rows(store.result()) == rows(reduce_points(cloud, GRID, RS, spec))
    assert len(heard) == 3 and heard[-1].points == cloud.where("v < 10").count()
    # going on after the end: nothing is new, nothing counts twice
    ingest_stream(stream, store, str(tmp_path / "cp"), spec).awaitTermination()
    assert rows(store.result()) == rows(reduce_points(cloud, GRID, RS, spec))


def test_cancelled_stream(spark, cloud, tmp_path):
    cloud.repartition(4).write.parquet(str(tmp_path / "in"))
    store = StateStore(spark, str(tmp_path / "state"), GRID, RS)
    query = ingest_stream(read_stream(spark, str(tmp_path / "in"), cloud.schema, files_per_trigger=1), store, str(tmp_path / "cp"), on_progress=lambda p: p.batches < 2)
    with pytest.raises(Exception, match="cancelled"):
        query.awaitTermination()
    assert len(store.batches()) == 2


def test_live_and_windowed(spark, cloud, tmp_path):
    timed = cloud.withColumn("at", F.timestamp_seconds(F.col("id") * 10))
    timed.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = read_stream(spark, str(tmp_path / "in"), timed.schema, files_per_trigger=1)
    rs = RS[:4]
    q = live_cells(stream, GRID, rs).writeStream.outputMode("complete").format("memory").queryName("live").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "a")).start()
    q.awaitTermination()
    assert rows(spark.table("live")) == rows(reduce_points(cloud, GRID, rs))
    w = windowed_cells(stream, GRID, rs[:1], "at", "10 minutes", "2 hours")
    q = w.writeStream.outputMode("update").format("memory").queryName("windowed").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "b")).start()
    q.awaitTermination()
    last = spark.table("windowed").groupBy("window_start", "row", "col").agg(F.max("sum").alias("sum"))
    assert last.agg(F.sum("sum")).first()[0] == reduce_points(cloud, GRID, rs[:1]).agg(F.sum("sum")).first()[0]


def test_pipeline(spark, tmp_path):
    low = spark.createDataFrame([(j + 0.5, 9.5 - i, 10.0) for i in range(5) for j in range(10)], "x double, y double, v float")
    config = PipelineConfig(GRID, [Reduction("v", "sum")], hardware={"exec_mode": "gpu"})
    pipe, heard = Pipeline.create(spark, config), []
    pipe.set_progress_callback(lambda p: heard.append(p))
    assert pipe.result() is None
    with pytest.raises(ValueError):
        pipe.finalize()
    result = pipe.run([low, low.withColumn("v", F.lit(20.0))])
    assert result.count() == 50 and {r.v_sum for r in result.collect()} == {30.0} and heard[-1].points_processed == 100
    a = pipe.band_array("v_sum")
    assert (a[:5] == 30).all() and (a[5:] != a[5:]).all() and pipe.dense().count() == 100
    assert pipe.stats() == {"collections_processed": 2, "points_processed": 100}
    for bad in (dict(reductions=[]), dict(hardware={"gpu": 1}), dict(grid=GridSpec.of(0, 0, 1, 1, 1, 1))):
        with pytest.raises(ValueError):
            Pipeline.create(spark, PipelineConfig(**({"grid": GRID, "reductions": [Reduction("v")]} | bad)))
    with pytest.raises(ValueError):
        pipe.ingest(low.drop("v"))


def test_pipeline_with_states(spark, tmp_path):
    pts = spark.createDataFrame([(0.5, 0.5, 1.0), (1.5, 0.5, 2.0), (99.0, 0.0, 1.0)], "x double, y double, v double")
    config = PipelineConfig(GRID, [Reduction("v", "sum", band="s")], state_dir=str(tmp_path / "s"), output_path=str(tmp_path / "out.tif"), write_cog=True)
    first = Pipeline(spark, config)
    first.run([pts])
    config.resume = True
    second = Pipeline(spark, config)
    second.set_progress_callback(lambda p: False)
    with pytest.raises(InterruptedError):
        second.ingest(pts)
    assert {r.col: r.s for r in second.finalize().collect()} == {0: 2.0, 1: 4.0}
    assert second.stats()["points_processed"] == 3 and (tmp_path / "out.tif").exists()
