"""Queries that SQL can express give DuckDB's rows, at the smallest scale."""

from pathlib import Path

import pytest

from paperloom.llm import queries

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    df = queries.QUERIES[name](spark, str(DATA))
    cols = sorted(df.columns)
    cursor = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cursor.description]
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in cursor.fetchall()), key=repr)
    assert cols == sorted(names) and sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == want
