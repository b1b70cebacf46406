from __future__ import annotations

import os
import subprocess
import sys
import textwrap


def test_queries_run_where_workers_lack_the_package(tmp_path, sf):
    """Another folder, no PYTHONPATH: the package is sent along."""
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
        import sys
        sys.path.insert(0, {home!r})
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
        import __spark_entry__
        print("ROWS", __spark_entry__.queries()["glyph_gauss_count"](spark, {sf!r}).count())
    """
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "ROWS" in done.stdout and int(done.stdout.split("ROWS")[1]) > 0, done.stderr[-2000:]
