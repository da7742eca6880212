import glob
import importlib
import os
import sys

import duckdb
import pytest

from redloom.plans import catalogue, problems

QUERIES = {**catalogue.QUERIES, **problems.QUERIES}
SQL = {**catalogue.SQL, **problems.SQL}


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_its_sql(spark, data, name):
    df = QUERIES[name](spark, data)
    rows = [tuple(r) for r in df.collect()]
    if name not in SQL:
        return
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got = con.execute(SQL[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    want = [tuple(r[names.index(c)] for c in df.columns) for r in got.fetchall()]
    assert sorted(rows, key=repr) == sorted(want, key=repr)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries()) and {"p1_found", "p2_found", "p5_found"} <= set(e.queries())


def test_the_rest_stands_without_the_text_operators(monkeypatch):
    import __spark_entry__ as e

    for name in [m for m in sys.modules if m.startswith("redloom.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "redloom.llm", None)
    try:
        again = importlib.reload(e)
        assert "p1_found" in again.queries() and "p3_found" not in again.queries()
    finally:
        monkeypatch.undo()
        importlib.reload(e)
