"""Merged ranges of keys too large for one task: the same rows, from many tasks."""

import random

import pytest
from pyspark.sql import functions as F

from paperloom import tables
from paperloom.operators import islands
from paperloom.plans import queries

DATA = "/root/testdata/sf0.001"
SHAPE = "k string, s long, e long"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def ranges_of(kind, rng):
    if kind == "apart":
        return [(rng.choice("aab"), s, s + 1) for s in rng.sample(range(0, 4000, 4), 900)]
    if kind == "one":
        return [("a", 0, 5000), *(("a", s, s + 2) for s in range(1, 900))]
    # chains over pieces, ranges that end before they start, unknown keys, starts and ends, many at one start
    some = [(rng.choice(["a", "a", "a", None, "b"]), s, s + rng.choice([-3, 0, 1, 2, 5, 40])) for s in (rng.randint(-50, 1500) for _ in range(900))]
    odd = [("a", None, None), ("a", None, 4), ("a", None, 5), (None, None, None), ("b", 7, None), ("a", 900, None), *[("a", 700, 690 + i % 30) for i in range(90)]]
    return some + odd


@pytest.mark.parametrize("kind", ["apart", "one", "mixed"])
def test_pieces(spark, monkeypatch, kind):
    rng = random.Random(1)
    ranges = ranges_of(kind, rng)
    rng.shuffle(ranges)
    df = spark.createDataFrame(ranges, SHAPE).coalesce(1)
    monkeypatch.setattr(tables, "LARGE", 100)
    monkeypatch.setattr(tables, "MOST_PARTS", 12)
    rest, pieces = tables.split(df, ["k"], ["s", "e"])
    assert pieces.groupBy("_piece").count().agg(F.max("count")).first()[0] < 250 and pieces.where("k = 'a'").select("_piece").distinct().count() > 5
    got = {g: islands.coalesce_ranges(rest, ["k"], "s", "e", g, pieces) for g in (0, 3)}
    for gap, merged in got.items():
        assert rows_of(merged) == rows_of(islands.coalesce_ranges(df.repartition(2, "k"), ["k"], "s", "e", gap))
    low, high = F.lit(0).cast("long"), F.lit(3000).cast("long")
    bare = islands.uncovered_ranges(rest, ["k"], low, high, "s", "e", pieces)
    assert rows_of(bare) == rows_of(islands.uncovered_ranges(df.repartition(2, "k"), ["k"], low, high, "s", "e"))


def test_only_large_keys_are_cut(spark, monkeypatch):
    monkeypatch.setattr(tables, "MOST_PARTS", 8)
    df = spark.createDataFrame([("a" if i % 2 else f"k{i}", i, i + 1) for i in range(400)], SHAPE)
    monkeypatch.setattr(tables, "LARGE", 150)
    rest, pieces = tables.split(df, ["k"], ["s", "e"])
    assert (rest.count(), pieces.count()) == (200, 200) and {r[0] for r in pieces.select("k").distinct().collect()} == {"a"}
    monkeypatch.setattr(tables, "LARGE", 200)
    rest, pieces = tables.split(df, ["k"], ["s", "e"])
    assert rest.count() == 400 and pieces is None


@pytest.mark.parametrize("name", ["coalesce_ranges", "uncovered_ranges"])
def test_one_key_is_merged_by_many_tasks(spark, monkeypatch, tmp_path, name):
    table = spark.read.parquet(f"{DATA}/lineitem.parquet").withColumn("l_suppkey", F.lit(7).cast("long"))
    table.write.parquet(f"{tmp_path}/lineitem.parquet")
    whole = rows_of(queries.QUERIES[name](spark, str(tmp_path)))
    held, merged = [], islands._merged
    monkeypatch.setattr(islands, "_merged", lambda ranges, keys, *a: held.append(ranges.groupBy(*keys).count()) or merged(ranges, keys, *a))
    monkeypatch.setattr(tables, "SORTED", 1 << 10)
    monkeypatch.setattr(tables, "LARGE", 1000, raising=False)
    assert rows_of(queries.QUERIES[name](spark, str(tmp_path))) == whole
    assert max(df.agg(F.max("count")).first()[0] or 0 for df in held) < 2000  # ranges that one window holds: all 6,000 before
