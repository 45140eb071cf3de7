"""Each query with SQL against DuckDB, at the smallest size."""

import os

import duckdb
import pytest

from kvspark.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(rows):
    return sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    frame = catalogue.queries()[name](spark, SF)
    names = sorted(frame.columns)
    table = duck.execute(catalogue.oracle_sql()[name])
    found = [c[0] for c in table.description]
    assert sorted(found) == names
    want = [[r[found.index(c)] for c in names] for r in table.fetchall()]
    assert plain([[r[c] for c in names] for r in frame.collect()]) == plain(want)


@pytest.mark.parametrize("name", sorted(catalogue.queries().keys() - catalogue.oracle_sql().keys()))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_the_rest_imports_without_the_training_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['kvspark.llm'] = None; import __spark_entry__ as e; print(sorted(e.queries())[0], any(k.startswith('op') for k in e.queries()))"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    assert done.stdout.split() == ["a13_recover_max_seq", "False"], done.stderr
