"""Every query with SQL against DuckDB at the smallest scale, and the others for rows and a stable schema."""

import glob
import os

import duckdb
import pytest

import __spark_entry__

TABLES = "/root/testdata/sf0.001"
CORE = sorted(n for n in __spark_entry__.queries() if not n.startswith("op") and n != "pipeline" or n == "origin")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{TABLES}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: round(v, 9) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, TABLES)
    rows = df.collect()
    sql = __spark_entry__.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    want = duck.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert plain(rows, df.columns) == plain(want.fetchall(), want.columns)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 18


def test_core_works_without_the_optional_folder(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    shutil.copytree(f"{root}/trailstat", tmp_path / "trailstat", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op1') for n in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert out.stdout.split() == [str(len(CORE)), "False"], out.stderr
