"""The driver's contract, and every query against its SQL."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

from .conftest import ROOT, SF


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def rows(columns, values):
    plain = lambda v: round(v, 5) if isinstance(v, float) else v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v
    return sorted(repr([plain(v) for _, v in sorted(zip(columns, row))]) for row in values)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_against_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    want = db.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n not in entry.oracle_sql() and not n.startswith("op") and n != "pipeline"))
def test_query_without_sql_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["id", "score"] and entry.entry(spark).first()["id"] == 0


def test_imports_without_the_corpus_subpackage(tmp_path):
    shutil.copytree(f"{ROOT}/sparkseek", f"{tmp_path}/sparkseek", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op1_') for n in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    assert out.stdout.split()[1] == "False" and int(out.stdout.split()[0]) > 40
