"""Ranks, parts and charts against plain Python."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from paperloom import functions as fn
from paperloom.operators import charts, islands, parts, ranks


@pytest.mark.parametrize("n", [0, 1, 7, 900])
def test_running_sums_over_ranges(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice(["a", "b", None]) if i % 3 else "a", i, rng.randint(0, 9)) for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i long, x long").repartition(5)
    got = {r["i"]: r["before"] for r in ranks.running_before(df, ["k"], ["i"], F.col("x")).collect()}
    want, sums = {}, {}
    for k, i, x in sorted(rows, key=lambda r: r[1]):
        want[i] = sums.get(k, 0)
        sums[k] = want[i] + x
    assert got == want


@pytest.mark.parametrize("n", [0, 3, 20, 501])
def test_evenly_spaced(spark, n):
    ids = random.Random(n).sample(range(10 * n + 1), n)
    got = sorted(tuple(r) for r in ranks.evenly_spaced(spark.createDataFrame([(i,) for i in ids], "id long"), "id", 20).collect())
    order = sorted(ids)
    assert got == [(order[i], i) for i in sorted({k * n // 20 for k in range(20)}) if n]


def test_order_statistics(spark):
    rng = random.Random(4)
    groups = {"all": [rng.choice([1.5, 2.5, rng.random()]) for _ in range(800)], "one": [3.0], "two": [1.0, 2.0], "same": [7.0] * 50}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs] + [("none", None), ("one", None)], "k string, v double")
    for r in ranks.order_statistics(df, ["k"], "v", {"p10": 0.1, "p90": 0.9, "p100": 1.0}).collect():
        vs = sorted(groups[r["k"]])
        assert r["median"] == pytest.approx(statistics.median(vs)) and (r["low"], r["high"], r["p100"]) == (vs[0], vs[-1], vs[-1])
        assert r["mean"] == pytest.approx(statistics.mean(vs))
        assert (r["p10"], r["p90"]) == (vs[max(0, -(-len(vs) // 10) - 1)], vs[max(0, -(-9 * len(vs) // 10) - 1)])
        groups.pop(r["k"])
    assert not groups


def test_font_choice(spark):
    rng = random.Random(5)
    asked = [(i, rng.choice("ABCX"), rng.randint(0, 5), rng.randint(0, 2)) for i in range(80)]
    faces = [(100 + i, rng.choice("ABC"), rng.randint(0, 7), rng.randint(0, 3)) for i in range(25)]
    want = {}
    for i, family, size, kin in asked:
        ranked = sorted((0 if s == size else 1 if k == kin else 2, f) for f, fam, s, k in faces if fam == family)
        if ranked:
            want[i] = ranked[0][::-1]
    columns = "long, family string, size int, kin int"
    got = parts.font_choice(spark.createDataFrame(asked, f"id {columns}"), "id", spark.createDataFrame(faces, f"face {columns}"), "face", "family", "size", "kin")
    assert {r["id"]: (r["face"], r["rank"]) for r in got.collect()} == want


def test_parts_of_a_package(spark):
    names = spark.createDataFrame([("/word/Document.xml", 1), ("WORD\\document.XML", 0), ("word/media/a.PNG", 2)], "name string, place int")
    wanted = spark.createDataFrame([("word/document.xml",), ("\\word\\media\\A.png",), ("nothing",)], "w string")
    assert {r["w"]: r["found"] for r in parts.part_lookup(wanted, "w", names, "name", "place").collect()} == {"word/document.xml": 0, "\\word\\media\\A.png": 2}
    own = spark.createDataFrame([(1, "own/type")], "place int, kind string")
    usual = spark.createDataFrame([("PNG", "image/png"), ("xml", "text/xml")], "ext string, kind string")
    assert sorted((r["place"], r["kind"]) for r in parts.content_types(names, "place", "name", own, usual).collect()) == [(0, "text/xml"), (1, "own/type"), (2, "image/png")]
    media = spark.createDataFrame([(i, "s" if i < 6 else "t", "cab"[i % 3]) for i in range(9)], "i int, s string, d string")
    assert {r["i"]: r["media_id"] for r in parts.media_ids(media, ["s"], "d").collect()} == {i: "abc".index("cab"[i % 3]) for i in range(9)}
    assert {r["digest"]: (r["i"], r["n"]) for r in parts.media_dedup(media, F.col("d"), "i").collect()} == {"c": (0, 3), "a": (1, 3), "b": (2, 3)}


@pytest.mark.parametrize(("target", "base", "path"), [("media/a.png", "word", "word/media/a.png"), ("../a.xml", "word/x", "word/a.xml"), ("/b/./c", "word", "b/c"), ("../../../z", "w", "z"), ("", "w", "w")])
def test_targets(spark, target, base, path):
    assert spark.createDataFrame([(target, base)], "t string, b string").select(fn.resolved_path(F.col("t"), F.col("b"))).first()[0] == path


def test_charts(spark):
    cells = spark.createDataFrame([(c, s, float(v)) for c, s, v in [("q1", "a", 1), ("q1", "b", -3), ("q2", "a", 0), ("q3", "a", 5), ("q3", "a", 6)]], "c string, s string, v double")
    assert sorted(map(tuple, charts.chart_table(cells, "c", "s", F.sum("v"), ["a", "b"], 2).collect())) == [("q1", 1.0, -3.0), ("q2", 0.0, None)]
    assert {(r["c"], r["v"]): r["share"] for r in charts.percent_stack(cells, ["c"], "v").collect()}[("q1", -3.0)] == -0.75
    axis = charts.axes(cells, [], "v").first()
    assert (axis["low"], axis["high"], axis["step"], axis["first"]) == (-3.0, 6.0, 2.0, -2)
    stops = spark.createDataFrame([(1, 720, False), (1, 720, False), (1, 360, False), (1, 90, True), (2, 5, True)], "p int, at int, gone boolean")
    assert {r["p"]: r["stops"] for r in charts.tab_stops(stops, ["p"], F.col("at"), F.col("gone")).collect()} == {1: [360, 720], 2: None}
    pages = spark.createDataFrame([(1, i, i == 2) for i in range(5)], "d int, i int, last boolean")
    assert [(r["section"], r["number"]) for r in islands.page_numbers(pages, ["d"], ["i"], F.col("last")).orderBy("i").collect()] == [(0, 1), (0, 2), (0, 3), (1, 1), (1, 2)]


def test_sets_and_references(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int"), spark.createDataFrame([(2,), (3,), (None,)], "k int")
    assert {r["part"]: r["n"] for r in parts.set_counts(a, b).collect()} == {"both": 2, "left": 1, "any": 4}
    assert sorted(str(r["k"]) for r in parts.without_target(a, "k", b, "k").collect()) == ["1", "1", "None"]
    assert [r["k"] for r in parts.cited_by_all(a.distinct(), "k", [a, b], "k").collect()] == [2]
    assert [(r["k"], r["n"]) for r in parts.repeated(a, ["k"]).collect()] == [(1, 2)]
