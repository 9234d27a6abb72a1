from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_entry_runs(spark):
    got = entry.entry(spark)
    assert got.columns == ["y", "x", "v"] and got.count() > 0


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= 43


def test_the_rest_works_without_the_subpackage(tmp_path):
    for name in ("mosaiq", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(ROOT / name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "mosaiq/llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pool_mean_4' in q and not any(n.startswith('op') for n in q), list(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})


def test_the_package_can_be_shipped(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as e
assert e.queries()["tile_pool"](spark, "/root/testdata/sf0.001").count() > 0
"""
    import os

    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env, timeout=240)
