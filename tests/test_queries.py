"""Each query with a SQL counterpart gives the rows that DuckDB gives on the smallest tables."""

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from sparkquill import catalogue

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DIR):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{name}'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return round(float(value), 9) if isinstance(value, float) or type(value).__name__ == "Decimal" else value


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in catalogue.SQL:
        assert got
        return
    want = duck.sql(catalogue.SQL[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).collect()


def test_rest_stands_without_the_corpus_operators(tmp_path):
    """With the corpus operators' folders and their pipeline taken away, the entry point has the other queries, and they run."""
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root, tmp_path / "repo", ignore=lambda d, names: [n for n in names if n in ("llm", ".git", "__pycache__", "corpus_pipeline.py")])
    job = (
        "import __spark_entry__ as e, bench\n"
        "from pyspark.sql import SparkSession\n"
        "q, s = e.queries(), e.oracle_sql()\n"
        "assert q and set(s) <= set(q) and not any(n.startswith('op') or n == 'pipeline' for n in q), sorted(q)\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        f"assert q['summary_by_verdict'](spark, '{DIR}').count()\n"
        "print(len(q))"
    )
    env = {**os.environ, "PYTHONPATH": str(tmp_path / "repo")}
    done = subprocess.run([sys.executable, "-c", job], cwd=tmp_path / "repo", env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout.split()[-1]) == len(catalogue.QUERIES)
    import __spark_entry__

    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
