"""The entry module: parity with SQL on small data, and imports without the training-data subpackage."""

import glob
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from docgrid import queries

NAMES = sorted(queries.oracle_sql())


def normal(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_parity(spark, sf, con, name):
    df = __spark_entry__.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(repr([normal(v) for v in r]) for r in df.select(*columns).collect())
    want = con.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == sorted(repr([normal(r[i]) for i in at]) for r in want.fetchall())


def test_entry_and_registration(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_rest_imports_without_the_subpackage(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/docgrid", tmp_path / "docgrid", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and 'pipeline' not in q and not any(n.startswith('op') and n[2].isdigit() for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
