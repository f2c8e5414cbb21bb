"""Near duplicates, decontamination, sharding, URLs and components against brute force."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from paperloom.llm import components, decontaminate, ngram_join, sharding, urls


def near_copies(rng, n, words=60):
    """Texts in families: copies, edited copies, and texts that share a long passage only."""
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    out = []
    while len(out) < n:
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, words))]
        if rng.random() < 0.4:
            base[1:1] = passage
        out.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 4, 12])):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                copy += [rng.choice(vocabulary)] * rng.randint(1, 9)
            out.append(" ".join(copy).upper() if rng.random() < 0.2 else "\t ".join(copy))
    rng.shuffle(out)
    return out[:n]


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    low = {}
    for (doc_id, _), x in zip(rows, label, strict=True):
        if doc_id is not None:
            low[x] = min(low.get(x, doc_id), doc_id)
    return [(d, len(s), low.get(x, d)) for (d, _), s, x in zip(rows, sets, label, strict=True)]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, component_id string, n long")


def test_join_by_brute_force(spark):
    rng = random.Random(11)
    rows = list(enumerate(near_copies(rng, 260)))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "one two"), (1004, "ONE\ttwo"), (1005, "long " * 4000), (7, rows[7][1]), (2000, rows[3][1])]
    got = sorted(tuple(r)[:3] for r in ngram_join.join(frame(spark, rows)).collect())
    assert got == sorted(brute_components(rows))


@pytest.mark.parametrize(("run", "least", "shingles"), [(4, 128, 2_000_000), (1 << 17, 7, 2_000_000), (4, 7, 2_000_000), (1 << 17, 128, 300)])
def test_tiles_of_a_crowded_shingle(spark, monkeypatch, run, least, shingles):
    """With runs of few classes, and groups cut into parts of few classes or shingles, tiles must still find every pair."""
    monkeypatch.setattr(ngram_join, "RUN", run)
    monkeypatch.setattr(ngram_join, "LEAST", least)
    monkeypatch.setattr(ngram_join, "SHINGLES", shingles)
    monkeypatch.setattr(ngram_join, "PARTS", 1000)
    monkeypatch.setattr(ngram_join, "AGAIN", 1)
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    monkeypatch.setattr(ngram_join, "STEP", 2)
    rng = random.Random(12)
    base = [f"v{i}" for i in range(80)]
    rows = []
    for i in range(60):
        copy = list(base)
        for k in rng.sample(range(80), 3):
            copy[k] = f"x{i}{k}"
        rows.append((i, " ".join(copy)))
    # halves that share much, but not enough: one group of several components
    for i in range(24):
        copy = [w if k < 50 else f"y{i % 3}{k}" for k, w in enumerate(base)]
        copy[rng.randrange(50)] = f"z{i}"
        rows.append((100 + i, " ".join(copy)))
    got = sorted(tuple(r)[:3] for r in ngram_join.join(frame(spark, rows)).collect())
    assert got == sorted(brute_components(rows))
    assert len({r[2] for r in got}) > 3


def test_filter_path_beyond_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SMALL", 0)
    rows = list(enumerate(near_copies(random.Random(13), 80)))
    got = sorted(tuple(r)[:3] for r in ngram_join.join(frame(spark, rows)).collect())
    assert got == sorted(brute_components(rows))


@pytest.mark.parametrize("small", [ngram_join.SMALL, 0])
def test_near_copies_without_ids(spark, monkeypatch, small):
    """Linked texts of which some, or all, stand under null ids only; ids that repeat with other texts."""
    monkeypatch.setattr(ngram_join, "SMALL", small)
    texts = near_copies(random.Random(14), 120)
    rows = [(None if i % 3 else i, t) for i, t in enumerate(texts)] + [(None, t) for t in texts[:30]] * 3
    rows += [(7, t) for t in near_copies(random.Random(15), 40)]
    lone = " ".join(f"n{i}" for i in range(40))
    rows += [(None, lone), (None, lone + " more"), (None, lone + " more"), (500, "and " + lone + " more")]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    got = sorted((tuple(r)[:3] for r in ngram_join.join(frame(spark, rows)).collect()), key=key)
    assert got == sorted(brute_components(rows), key=key)
    none = [(None, t) for _, t in rows]
    assert sorted(((r["n_shingles"], r["component_id"]) for r in ngram_join.join(frame(spark, none)).collect()), key=key) == sorted(((len(shingles(t)), None) for _, t in none), key=key)


def test_all_links_by_brute_force(spark, monkeypatch):
    """Links inside components too, over tiles, crowded shingles and null ids."""
    rng = random.Random(16)
    rows = [(None if i % 9 == 4 else i, t) for i, t in enumerate(near_copies(rng, 120))]
    base = [f"v{i}" for i in range(80)]
    for i in range(25):
        copy = list(base)
        copy[rng.randrange(80)] = f"x{i}"
        rows.append((1000 + i, " ".join(copy)))
    rows += [(2000, rows[-1][1]), (2001, None)]
    classes = {frozenset(shingles(t)) for _, t in rows} - {frozenset()}
    linked = {a: [b for b in classes if a != b and 4 * len(a & b) >= 3 * len(a | b)] for a in classes}
    low = {c: min((d for d, t in rows if d is not None and shingles(t) == c), default=None) for c in classes}
    key = lambda r: tuple((x is None, x or 0) for x in r)
    pairs = sorted((tuple(sorted((low[a], low[b]), key=lambda x: (x is None, x or 0))) for a in classes for b in linked[a]), key=key)[::2]
    assert len(pairs) > 300
    for run, least in ((ngram_join.RUN, 128), (4, 9)):
        monkeypatch.setattr(ngram_join, "RUN", run)
        monkeypatch.setattr(ngram_join, "LEAST", least)
        monkeypatch.setattr(ngram_join, "PARTS", 1000)
        got = ngram_join.links(frame(spark, rows)).collect()
        assert len({(r["class_a"], r["class_b"]) for r in got}) == len(got)
        assert sorted((tuple(sorted((r["doc_a"], r["doc_b"]), key=lambda x: (x is None, x or 0))) for r in got), key=key) == pairs
    counts = ngram_join.link_counts(frame(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["n_links"]) for r in counts), key=key) == sorted(((d, len(linked.get(frozenset(shingles(t)), []))) for d, t in rows), key=key)


def test_one_of_each(spark):
    rows = [(3, "a b c d e f"), (1, "A B C D E F"), (2, "other text of six words here"), (2, "other text of six words here"), (None, "a b c d e f"), (9, None), (8, "")]
    kept = ngram_join.one_of_each(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "component_id", "n"]
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "8", "9", "None"]
    empty = frame(spark, [])
    assert ngram_join.join(empty).count() == ngram_join.one_of_each(empty).count() == 0


def test_one_of_each_where_ids_repeat(spark):
    """A row goes by its own text, not by its id's other rows."""
    a, near, other = "a b c d e f g h i j k l", "a b c d e f g h i j k l m", "clean other text of seven words here"
    rows = [(1, a), (5, a), (5, other), (5, None), (6, near), (6, "six " * 2 + other), (6, "six " * 2 + other), (7, other), (8, "p q r s t u"), (8, "P Q R S T U"), (None, a), (None, a)]
    kept = ngram_join.one_of_each(frame(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in kept) == sorted(
        [("1", a), ("5", other), ("5", ""), ("6", "six " * 2 + other), ("8", "p q r s t u"), ("8", "P Q R S T U"), ("None", a), ("None", a)]
    )


def test_bound_never_rejects_a_link():
    from paperloom.llm.shingles import bitmaps

    rng = np.random.default_rng(5)
    for _ in range(400):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate((a[rng.random(len(a)) < 0.9], rng.integers(0, 2**63, int(rng.integers(0, 40)), dtype=np.uint64))))
        if not len(b):
            continue
        x, y = bitmaps([a, b], int(rng.choice([1, 30, n])))
        differ = int(np.bitwise_count(x ^ y).sum())
        both = len(np.intersect1d(a, b))
        assert ngram_join.overlap(a, b) == both <= (len(a) + len(b) - differ) // 2
        if 4 * both >= 3 * (len(a) + len(b) - both):
            assert both >= ngram_join.least_overlap(len(a), len(b)) and ngram_join.may_link(np.array(len(a)), np.array(len(b)), np.array(differ))


def test_first_shingles_of_linked_sets():
    """Linked sets share ``need`` of their first ``ext_size`` shingles; of sizes that differ as much as they may, too."""
    rng = np.random.default_rng(6)
    for _ in range(3000):
        n = int(rng.integers(1, 120))
        both = int(rng.integers(-(-3 * n // 4), n + 1))
        m = int(rng.integers(both, max(both, 4 * both // 3 + both - n) + 1))
        if 4 * both < 3 * (n + m - both):
            continue
        values = rng.permutation(n + m - both)
        a, b = np.sort(values[:n]), np.sort(values[n - both :])
        first = np.intersect1d(a[: ngram_join.ext_size(n)], b[: ngram_join.ext_size(m)])
        assert len(first) >= max(ngram_join.need(n), ngram_join.need(m))


def test_classes_that_share_their_first_bits():
    """Classes with the same 64 bits and size are chosen for together; each keeps what it would keep alone."""
    rng = np.random.default_rng(7)
    for _ in range(60):
        n = int(rng.integers(1, 200))
        rows = []
        for _ in range(2):
            own = np.zeros(int(rng.integers(0, ngram_join.ext_size(n) + 1)), ngram_join.SHARED)
            own["q"] = round(1000 * np.log2(n)) + np.where(rng.random(len(own)) < 0.2, ngram_join._CROWDED, 0)
            own["short"], own["token"] = 5, rng.choice(1 << 40, len(own), replace=False)
            own["df"] = own["token"] % 7 + 2
            rows.append(own)
        kept = [set(ngram_join._chosen(r, 8)[1]["token"].tolist()) for r in (*rows, np.concatenate(rows))]
        assert kept[0] <= kept[2] and kept[1] <= kept[2]


def test_words_that_collide_in_polynomial_hashes(spark):
    rows = []
    for k, n in enumerate((1024, 4096, 65536)):
        bits = [bin(i).count("1") & 1 for i in range(n)]
        for j, pair in enumerate(("ab", "ba")):
            rows.append((10 * k + j, " ".join(["".join(pair[b] for b in bits) + str(i) for i in range(3)] + ["tail"])))
    got = sorted(tuple(r)[:3] for r in ngram_join.join(frame(spark, rows)).collect())
    assert got == sorted(brute_components(rows))


def test_columns_with_the_names_in_use(spark):
    names = ["key", "row", "hit", "_hit", "p0", "_p1", "tile", "class", "text", "doc_id", "a.b"]
    rows = [("k", "r", "h", "x", 1, 2, 3, "c", t, i, "dot") for i, t in enumerate(["a b c d e f", "A b c d e f", "other words are here now ok", None, ""])]
    df = spark.createDataFrame(rows, "key string, row string, hit string, _hit string, p0 int, _p1 int, tile int, class string, text string, doc_id long, `a.b` string")
    kept = ngram_join.one_of_each(df)
    assert kept.columns == names
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3, 4]
    assert {tuple(r)[:8] + (r["a.b"],) for r in kept.collect()} == {("k", "r", "h", "x", 1, 2, 3, "c", "dot")}
    assert sorted(r["component_id"] for r in ngram_join.join(df).collect()) == [0, 0, 2, 3, 4]


@pytest.mark.parametrize(("limit", "hub"), [(1_000_000, 100_000), (0, 100_000), (0, 1)])
def test_components(spark, monkeypatch, limit, hub):
    monkeypatch.setattr(components, "ONE_TASK", limit)
    monkeypatch.setattr(components, "HUB", hub)
    rng = random.Random(21)
    edges = [(i, i + 1) for i in range(0, 40)] + [(rng.randint(100, 200), rng.randint(100, 200)) for _ in range(60)] + [(500, 500), (300, 301), (301, 300)]
    df = spark.createDataFrame([*edges, (None, 1)], "u long, v long")
    got = dict(tuple(r) for r in components.connected_components(df).collect())
    parent = {x: x for e in edges for x in e}
    for u, v in edges * 3:
        a, b = u, v
        while parent[a] != a:
            a = parent[a]
        while parent[b] != b:
            b = parent[b]
        parent[max(a, b)] = min(a, b)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    assert got == {x: root(x) for x in parent if x != 500}
    assert components.connected_components(df.limit(0)).count() == 0


# Decontamination ----------------------------------------------------------------------------


def plain_score(text, item):
    """Smith-Waterman by the textbook."""
    rows = [[0] * (len(item) + 1) for _ in range(len(text) + 1)]
    best = 0
    for i, a in enumerate(text, 1):
        for j, b in enumerate(item, 1):
            rows[i][j] = max(0, rows[i - 1][j - 1] + (2 if a == b else -1), rows[i - 1][j] - 1, rows[i][j - 1] - 1)
            best = max(best, rows[i][j])
    return best


def test_alignment_scores():
    rng = np.random.default_rng(3)
    texts = [rng.integers(1, 9, rng.integers(1, 40)).astype(np.uint64) for _ in range(300)]
    items = [rng.integers(1, 9, rng.integers(1, 20)).astype(np.uint64) for _ in range(300)]
    score, _ = decontaminate.align(texts, items)
    assert score.tolist() == [plain_score(t.tolist(), q.tolist()) for t, q in zip(texts, items, strict=True)]


def test_leaks(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(8)] + [(8, None), (9, "two words"), (10, "")]
    filler = lambda n: " ".join(word() for _ in range(n))
    edited = items[1][1].split()
    for k in (3, 11, 17, 25):
        edited[k] = word()
    del edited[20]
    docs = [
        (0, filler(200)), (1, filler(50) + " " + items[0][1] + " " + filler(50)), (2, filler(9000) + "\n" + " ".join(edited).upper()),
        (3, items[2][1].replace(" ", ",\n")), (4, None), (5, ""), (6, items[0][1]), (6, items[0][1]), (7, " ".join(items[3][1].split()[:6]) + " " + filler(100)),
    ]
    d, b = frame(spark, docs), spark.createDataFrame([(i, t, 5) for i, t in items], "item_id int, text string, doc_id int")
    got = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.leaks(d, b).collect())
    assert got == [(1, 0), (2, 1), (3, 2), (6, 0), (6, 0)]
    clean = decontaminate.clean(d, b)
    assert clean.columns == d.columns
    assert sorted(r["doc_id"] for r in clean.collect()) == [0, 4, 5, 7]
    assert decontaminate.leaks(d.limit(0), b).count() == decontaminate.leaks(d, b.limit(0)).count() == 0
    assert decontaminate.clean(d, b.limit(0)).count() == len(docs)


@pytest.mark.parametrize("copies", [5, 50, 1000])
def test_popular_leaks(spark, copies):
    """An edited and a partial form stay leaks however many documents hold them, also beside a whole copy."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(4)]
    edited = [t.split() for _, t in items]
    for i in (0, 2):
        for k in (3, 11, 17, 25):
            edited[i][k] = word()
    for i in (1, 3):
        edited[i] = edited[i][:18]
    docs = [(k, " ".join([word() for _ in range(9)] + edited[k % 4] + [word() for _ in range(9)])) for k in range(4 * copies)]
    docs += [(-1, items[2][1]), (-2, items[3][1]), (-3, " ".join(word() for _ in range(60)))]
    d, b = frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.leaks(d, b).collect())
    assert got == sorted([(k, k % 4) for k in range(4 * copies)] + [(-1, 2), (-2, 3)])
    assert [r["doc_id"] for r in decontaminate.clean(d, b).collect()] == [-3]


def test_windows_left_out_hold_no_leak(monkeypatch):
    """Leaving out windows by their words changes no result, over few words that repeat and in small chunks."""
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice("abcdefghijkl") for _ in range(n))
    items = decontaminate.Items(list(range(30)), [text(rng.randint(3, 25)) for _ in range(30)])
    buf, offsets = decontaminate.flat(pa.array([text(rng.randint(0, 90)) for _ in range(60)]))
    words, before = decontaminate.text_words(buf, offsets)
    everything = decontaminate.found_in(words, before, items, 0.0)
    monkeypatch.setattr(decontaminate, "WINDOW_WORDS", 50)
    for share in (0.3, 0.5, 0.7, 1.0):
        got = decontaminate.found_in(words, before, items, share)
        assert got and got == [r for r in everything if r[2] >= share]


def test_leaks_by_brute_force(spark):
    """The whole operator against the alignment of every document with every item, over words that repeat."""
    rng = random.Random(10)
    text = lambda n: [rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa la mu nu xi".split()) for _ in range(n)]
    items, docs = [text(rng.randint(4, 20)) for _ in range(12)], []
    for _ in range(70):
        words = text(rng.randint(0, 60))
        if rng.random() < 0.7:
            part = list(rng.choice(items))
            for _ in range(rng.randint(0, 4)):
                part[rng.randrange(len(part))] = rng.choice(["other", "mu", "xi"])
            k = rng.randint(0, len(words))
            words[k:k] = part
        docs.append(words)
    want = set()
    for d, words in enumerate(docs):
        for i, item in enumerate(items):
            seeds = {tuple(item[k : k + 3]) for k in range(len(item) - 2)}
            if seeds & {tuple(words[k : k + 3]) for k in range(len(words) - 2)} and plain_score(words, item) >= 0.5 * 2 * len(item):
                want.add((d, i))
    d = frame(spark, [(i, " ".join(w).upper() if i % 4 == 0 else ", ".join(w)) for i, w in enumerate(docs)])
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(d, b).collect()}
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) > 40
    assert {r["doc_id"] for r in decontaminate.clean(d, b).collect()} == set(range(70)) - {d for d, _ in got}


def test_clean_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "one two three four five six", "t", "r", 0.5), (2, "clean words only", "t", "r", 0.5)], "doc_id long, text string, _text string, row string, `a.b` double")
    b = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    out = decontaminate.clean(df, b)
    assert out.columns == df.columns and [tuple(r) for r in out.collect()] == [(2, "clean words only", "t", "r", 0.5)]
    assert decontaminate.leaks(df, b).count() == 1


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate.blocks, "__defaults__", (3,))
    items = [(i, f"alpha{i} beta{i} gamma{i} delta{i} epsilon{i}") for i in range(5)]
    b = spark.createDataFrame(items, "item_id long, text string")
    d = frame(spark, [(i, f"some {t} words") for i, t in items])
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.leaks(d, b).collect()) == [(i, i) for i in range(5)]


# Sharding -----------------------------------------------------------------------------------


def test_shards(spark):
    rng = random.Random(6)
    rows = [(i, "x" * rng.randint(0, 900)) for i in range(3000)] + [(5000, None), (5000, None), (None, "é"), (5001, "y" * 20000)]
    out = sharding.shard(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    by_id = {r["doc_id"]: r for r in out}
    assert by_id[5000]["size"] == 16 and by_id[5000]["text_crc32"] == 0 and by_id[None]["size"] == 18
    assert by_id[5001]["text_crc32"] == zlib.crc32(b"y" * 20000)
    loads, places = [0] * 40, {}
    for r in out:
        loads[r["shard"]] += r["size"]
        places.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(loads) - min(loads) < 2200
    assert sharding.shard(frame(spark, [])).count() == 0


def test_versions_of_the_map(spark, tmp_path):
    rng = random.Random(7)
    weights = {s: rng.randint(1, 100) for s in range(500)}
    first = sharding.first_map(weights, 10, 500)
    grown = sharding.rebalance(first, weights, 11)
    assert grown.version == 2 and all(grown.owner[s] == 10 for s in grown.moved)
    assert all(a == b for s, (a, b) in enumerate(zip(first.owner, grown.owner, strict=True)) if s not in grown.moved)
    assert max(grown.loads(weights)) < 1.15 * sum(weights.values()) / 11
    weights |= {s: 400 for s in range(20)}
    even = sharding.rebalance(grown, weights)
    assert max(even.loads(weights)) <= max(grown.loads(weights)) and len(even.moved) < 250
    path = str(tmp_path / "maps")
    for m in (first, grown, even):
        sharding.save_map(spark, m, path)
    assert sharding.load_map(spark, path).owner == even.owner and sharding.load_map(spark, path, 1).owner == first.owner


def test_the_stored_map_is_in_force(spark, tmp_path):
    """A second run keeps the first one's map; one more shard takes slots only into itself, as the next version."""
    path = str(tmp_path / "maps")
    docs = frame(spark, [(i, "x" * (i % 700)) for i in range(2000)])
    first = {r["doc_id"]: (r["shard"], r["map_version"]) for r in sharding.shard(docs, 5, 256, path).collect()}
    again = {r["doc_id"]: (r["shard"], r["map_version"]) for r in sharding.shard(docs, 5, 256, path).collect()}
    assert first == again and {v for _, v in first.values()} == {1}
    grown = {r["doc_id"]: (r["shard"], r["map_version"]) for r in sharding.shard(docs, 6, 256, path).collect()}
    assert {v for _, v in grown.values()} == {2}
    moved = {i for i in grown if grown[i][0] != first[i][0]}
    assert moved and all(grown[i][0] == 5 for i in moved)
    assert sharding.load_map(spark, path, 1).shards == 5


# URLs ---------------------------------------------------------------------------------------


def test_rules_and_aliases(spark):
    link = lambda h: f'<head><link href="{h}" rel="canonical"></head>'
    move = '<meta http-equiv="refresh" content="0; url=http://bad.com/de/1">'
    rows = [
        (0, "https://a.ORG/x?y#z", None), (1, "http://b.example.org/es/1", ""), (2, "http://example.org/en/12", ""), (3, "http://example.org/en/2", ""),
        (4, "http://x.com/fr/1", ""), (5, "http://x.com/de/1", ""), (6, None, link("http://x.com/de/1")), (7, "nohost", ""),
        (8, "http://m.net/a", link("http://x.com/de/1?utm_source=q")), (9, "https://m.net/a/#frag", ""), (10, "http://n.net/b", link("/c")), (11, "http://n.net/c", move),
        (12, "http://bad.com/de/1", ""), (13, "http://free.net/", link("http://q.com/fr/7")), (14, "http://free.net", link("http://x.com/de/9")), (15, "http://notorg/", ""),
        (16, "http://org", ""), (17, "http://org/", ""), (18, "http://lone.net/q", ""),
    ]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(df).collect()}
    assert len(got) == len(rows)
    assert got[0] == ("a.org", "/x", "org/", "allow") and got[1][2:] == ("example.org/es/", "block") and got[2][2:] == ("example.org/en/1", "block")
    assert got[3][2:] == ("org/", "allow") and got[4][2:] == ("com/fr/", "allow") and got[5][2:] == ("com/de/", "block")
    assert got[6] == got[7] == ("", "", None, "allow")
    assert got[8][3] == got[9][3] == "block"  # canonical link, and the same page by another spelling
    assert got[10][3] == got[11][3] == "block"  # over a redirect
    assert got[13][3] == got[14][3] == "allow"  # an explicit allow in the component goes first
    assert got[15] == ("notorg", "/", None, "allow") and got[16] == ("org", "", None, "allow") and got[17][2] == "org/" and got[18][3] == "allow"
    assert urls.judge(df.limit(0)).count() == 0


def brute_verdicts(pages):
    """Rules and aliases in plain Python: nodes by dictionary, components by flooding."""
    from urllib.parse import urljoin

    def split(url):
        if url is None or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]

    def node(url):
        host, path = split(url)
        query = url.split("#")[0].partition("?")[2]
        kept = sorted(p for p in query.split("&") if p and not re.match(r"(?i)(utm_[a-z]+|ref|gclid|fbclid|sessionid)=", p))
        return host + re.sub(r"(/index\.html?)?/*$", "", path, count=1) + ("?" + "&".join(kept) if kept else "")

    def rule(url):
        host, path = split(url)
        fits = [r for r in urls.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        return max(fits, key=lambda r: len(r[0] + r[1])) if fits else None

    near, said = {}, {}
    for _, url, html in pages:
        if url is None or "://" not in url:
            continue
        targets = re.findall(r'href="([^"]*)" rel="canonical"', html or "") + re.findall(r"url=([^\s\">]*)", html or "")
        for u in [url, *(urljoin(url, t) for t in targets)]:
            near.setdefault(node(u), set())
            if rule(u):
                said.setdefault(node(u), set()).add(rule(u)[2])
        for t in targets:
            a, b = node(url), node(urljoin(url, t))
            near[a].add(b), near[b].add(a)
    group = {}
    for start in near:
        todo = [start] if start not in group else []
        while todo:
            x = todo.pop()
            if x not in group:
                group[x] = start
                todo += near[x]
    verdicts = {}
    for n, g in group.items():
        verdicts.setdefault(g, set()).update(said.get(n, ()))
    out = {}
    for page, url, _ in pages:
        host, path = split(url)
        own = rule(url) if host or path else None
        found = verdicts[group[node(url)]] if url is not None and "://" in url else set()
        out[page] = (host, path, own and own[0] + own[1], own[2] if own else "block" if found == {"block"} else "allow")
    return out


def test_verdicts_by_brute_force(spark, monkeypatch):
    rng = random.Random(19)
    hosts = ["a.com", "b.com", "c.net", "d.example.org", "org", "E.Com", "f.info"]
    url = lambda: f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(['', '/', '/de/1', '/de/', '/fr/2', '/es/3', '/en/1', '/x', '/y/index.html'])}{rng.choice(['', '', '?q=1', '?utm_source=z', '#top'])}"
    pages = []
    for i in range(160):
        html = rng.choice([None, "", "<p>"])
        if rng.random() < 0.4:
            html = rng.choice(['<link href="{}" rel="canonical">', '<meta http-equiv="refresh" content="0; url={}">']).format(rng.choice([url(), "/z", "/de/7"]))
        pages.append((i, rng.choice([url(), url(), url(), None, "none"]) if i % 9 else "http://hub.net/", html))
    want = brute_verdicts(pages)
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for limit, hub in ((components.ONE_TASK, components.HUB), (0, 2)):
        monkeypatch.setattr(components, "ONE_TASK", limit)
        monkeypatch.setattr(components, "HUB", hub)
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(df).collect()}
        assert got == want
    assert {v[3] for v in want.values() if v[2] is None} == {"allow", "block"}
