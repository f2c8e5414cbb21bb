"""List counters and merged ranges against plain Python; each sorts its rows once, in parts of bounded size."""

import random
import re

import pytest
from pyspark.sql import functions as F

from paperloom import tables
from paperloom.operators import islands, lists
from paperloom.plans import queries

DATA = "/root/testdata/sf0.001"


def sorts(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Sort [")


def test_counters(spark):
    rng = random.Random(1)
    items = [(k, i, rng.choice([0, 0, 1, 1, 2, 3, None])) for k in range(60) for i in range(rng.randint(1, 30))]
    want = {}
    for k in range(60):
        seen = [0] * 4
        for _, i, level in (x for x in items if x[0] == k):
            if level is not None:
                seen[level] += 1
                seen[level + 1 :] = [0] * (3 - level)
            want[k, i] = [max(3 + seen[j] - 1, 3) if level is not None and j <= level else None for j in range(4)]
    df = spark.createDataFrame(rng.sample(items, len(items)), "k long, i long, lvl int")
    counted = lists.list_counters(df, ["k"], ["i"], "lvl", 4, F.lit(3))
    assert {(r["k"], r["i"]): [r[f"counter_{j}"] for j in range(4)] for r in counted.collect()} == want
    assert sorts(counted) == 1


@pytest.mark.parametrize("gap", [0, 4])
def test_ranges(spark, gap):
    rng = random.Random(gap)
    ranges = [(rng.randint(0, 40), s, s + rng.randint(0, 12)) for s in (rng.randint(-10, 130) for _ in range(700))]
    merged, left = [], []
    for key in {k for k, _, _ in ranges}:
        own = []
        for s, e in sorted((s, e) for k, s, e in ranges if k == key):
            if own and s <= own[-1][1] + gap:
                own[-1] = [own[-1][0], max(own[-1][1], e), own[-1][2] + 1]
            else:
                own.append([s, e, 1])
        merged += [(key, *x) for x in own]
        edges = [0, *(x for s, e, _ in own for x in (s, e)), 100]
        left += [(key, max(a, 0), min(b, 100)) for a, b in zip(edges[::2], edges[1::2], strict=True) if max(a, 0) < min(b, 100)]
    df = spark.createDataFrame(ranges, "k long, s long, e long")
    got = islands.coalesce_ranges(df, ["k"], "s", "e", gap)
    assert sorted(map(tuple, got.collect())) == sorted(merged) and sorts(got) == 1
    if not gap:
        bare = islands.uncovered_ranges(df, ["k"], F.lit(0).cast("long"), F.lit(100).cast("long"), "s", "e")
        assert sorted(map(tuple, bare.collect())) == sorted(left) and sorts(bare) == 1


def test_unknown_starts_and_ends(spark):
    rows = [("a", None, 4), ("a", 3, 5), ("a", 9, None), ("a", 9, 2), ("a", 20, 21), (None, 1, 2)]
    got = islands.coalesce_ranges(spark.createDataFrame(rows, "k string, s long, e long"), ["k"], "s", "e")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("a", 3, 5, 2), ("a", 9, None, 1), ("a", 9, 2, 1), ("a", 20, 21, 1), (None, 1, 2, 1)], key=str)


@pytest.mark.parametrize("name", ["list_labels", "list_ordinals", "coalesce_ranges", "uncovered_ranges"])
def test_parts_grow_in_number(spark, monkeypatch, name):
    cores = spark.sparkContext.defaultParallelism
    few = queries.QUERIES[name](spark, DATA)
    monkeypatch.setattr(tables, "SORTED", 1 << 10)
    many = queries.QUERIES[name](spark, DATA)
    parts = {k: df.select(F.spark_partition_id().alias("p")).distinct().count() for k, df in (("few", few), ("many", many))}
    assert sorts(many) == 1 and parts["few"] <= cores < parts["many"]  # the session has but four shuffle partitions


@pytest.mark.parametrize("name", ["list_labels", "list_ordinals", "coalesce_ranges", "uncovered_ranges"])
def test_tasks_write_for_few_parts(spark, monkeypatch, name):
    def parts(size):
        monkeypatch.setattr(tables, "SORTED", size)
        plan = queries.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        return int(re.search(r", (\d+)\), REPARTITION_BY_NUM", plan)[1])

    size = parts(1 << 10) << 10
    # a task that writes for more than 200 parts holds all its rows: not before parts are four times larger
    assert parts(size // 300) == parts(size // 700) == 200 and 390 < parts(size // 1600) < 450
