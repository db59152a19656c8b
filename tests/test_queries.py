"""Every query with SQL gives the rows that DuckDB gives."""

import datetime as dt
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from strandline.pipeline_queries import ORACLE_SQL, QUERIES


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, sf_dir, duck, name):
    ours = QUERIES[name](spark, sf_dir)
    theirs = duck.sql(ORACLE_SQL[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    at = [theirs.columns.index(c) for c in columns]
    got = sorted((tuple(plain(r[c]) for c in columns) for r in ours.collect()), key=repr)
    want = sorted((tuple(plain(r[i]) for i in at) for r in theirs.fetchall()), key=repr)
    assert got == want


def test_entry_and_registration(spark):
    assert entry.entry(spark).columns == ["doc_id", "source", "redacted", "rules"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


def test_entry_needs_no_llm(tmp_path):
    """Without the training-data folders the entry still imports, with the library's own queries."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(entry.__file__)
    shutil.copytree(f"{root}/strandline", tmp_path / "strandline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    assert out.stdout.split() == [str(len(QUERIES)), str(len(ORACLE_SQL))]
