"""Every query that has SQL gives DuckDB's rows, at the smallest scale."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as entry
from paperloom.plans import queries

DATA = Path("/root/testdata/sf0.001")


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 7)
    if isinstance(value, list):
        return tuple(plain(v) for v in value)
    return value


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, str(DATA))
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    cursor = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in cursor.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cursor.fetchall()), key=repr)
    assert cols == sorted(names)
    assert got == want and got


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and {r["kind"] for r in rows} >= {"paragraph"}


def test_html_blocks(spark):
    rows = queries.html_to_blocks(spark, str(DATA)).collect()
    assert len({r["page_id"] for r in rows}) == 50
    assert not any("track(" in r["text"] or "<" in r["text"] and ">" in r["text"] for r in rows)


def test_markdown_documents(spark):
    rows = queries.markdown_to_html(spark, str(DATA)).collect()
    assert len(rows) == 200 and all(r["error"] is None and r["n_blocks"] > 0 for r in rows)
