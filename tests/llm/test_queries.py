import duckdb
import glob
import os

import pytest

from redloom.llm import queries as Q


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_query(spark, data, name):
    df = Q.QUERIES[name](spark, data)
    rows = [tuple(r) for r in df.collect()]
    assert rows
    if name in Q.SQL:
        con = duckdb.connect()
        for f in glob.glob(f"{data}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
        got = con.execute(Q.SQL[name])
        names = [c[0] for c in got.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted(tuple(r[names.index(c)] for c in df.columns) for r in got.fetchall()) == sorted(rows)
