"""Quality rules, personal data and secrets against plain Python."""

import hashlib
import re
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from paperloom.llm import pii, pii_model, quality, secrets

TEXTS = [
    None, "", " ", "\n\n", "a" * 5000, "1" * 3000, "é日本 🙂 a@b.c", "a@b.c_d@e.f @x a@@b.c. x@y.z-",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112 4111111111111111",
    "+1 (555) 123-4567, +123 +4 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "call me at 555-123-4567 today", "ssn 123-45-6789",
    'password = "abc" secret: token: abcdefgh API_KEY=xyz123456 apikey:"q"', "AKIA" + "A" * 15 + " AKIA" + "B" * 16 + "c",
    "deadbeef" * 3 + " g" + "0" * 24, "key Zx9Qw8Er7Ty6Ui5Op4As3Df2Gh1Jk0 end", "123e4567-e89b-12d3-a456-426614174000",
    "w " * 60, "one two three " * 30, "line\nline\n\nline\n", "x@" * 200, "TOKEN=" + "a" * 6,
]


def _digits(m):
    return re.sub("[^0-9]", "", m)


def _luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(_digits(m[0])) <= 19 and _luhn(_digits(m[0]))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(_digits(m[0])) <= 15),
]
SECRETS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
]


def brute(text, patterns):
    counts, spans = [], []
    for rank, (kind, pattern, keep) in enumerate(patterns):
        own = [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text or "") if keep(m)]
        counts.append(len(own))
        spans += own
    joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))
    return (*counts, hashlib.sha256(joined.encode()).hexdigest()), joined


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")


def check(spark, operator, texts, patterns):
    rows = sorted(operator(frame(spark, texts)).collect(), key=lambda r: r["doc_id"])
    assert len(rows) == len(texts)
    for r, t in zip(rows, texts, strict=True):
        want, joined = brute(t, patterns)
        assert tuple(r)[1 : len(want) + 1] == want, (t, r, joined)
        assert not joined or set(joined.split(",")) <= set(r["spans"].split(","))
    return rows


def test_base_spans_of_personal_data(spark):
    rows = check(spark, pii.find, TEXTS, PII)
    added = {t: r["spans"] for t, r in zip(TEXTS, rows, strict=True)}
    assert added["call me at 555-123-4567 today"] == "phone:11:23"
    assert added["ssn 123-45-6789"] == "id:4:15"


def test_base_spans_of_secrets(spark):
    rows = {t: r for t, r in zip(TEXTS, check(spark, secrets.scan, TEXTS, SECRETS), strict=True)}
    assert rows["key Zx9Qw8Er7Ty6Ui5Op4As3Df2Gh1Jk0 end"]["n_entropy"] == 1
    assert rows["123e4567-e89b-12d3-a456-426614174000"]["n_entropy"] == 0
    assert rows["a" * 5000]["n_entropy"] == 0


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aA1 .@+-(_:=\"'éf0\n", max_size=60), min_size=20, max_size=40))
def test_random_texts(spark, texts):
    check(spark, pii.find, texts, PII)
    check(spark, secrets.scan, [t.replace("A", "token").replace("a", "AKIA" * 3) for t in texts], SECRETS)


def test_empty_tables(spark):
    empty = frame(spark, []).withColumnRenamed("spans", "lang")
    assert pii.find(empty).count() == secrets.scan(empty).count() == quality.judge(empty).count() == quality.keep(empty).count() == 0
    assert pii.redact(empty).columns == empty.columns


def test_redaction(spark):
    df = spark.createDataFrame([(1, "mail a@b.co now", 15, 7), (2, None, 0, 8), (3, "clean", 5, 9)], "doc_id long, text string, n_chars long, spans int")
    rows = {r["doc_id"]: r for r in pii.redact(df).collect()}
    assert rows[1]["text"] == "mail [EMAIL] now" and rows[1]["n_chars"] == 16 and rows[1]["spans"] == 7
    assert rows[2]["text"] is None and rows[3]["text"] == "clean"


def test_classifier_on_held_out_samples(spark):
    import numpy as np

    model = pii.model()
    x, y = pii_model.feature_rows(spark, pii_model.sample(1200, seed=99))
    out = model["base"] + sum(pii_model.predict(t, x) for t in model["trees"])
    code = x[:, pii.FEATURES.index("generator")].astype(int)
    cut = np.array([model["thresholds"][name] for name, *_ in pii.GENERATORS])[code]
    said = out >= cut
    assert (y[said] == 1).mean() > 0.93 and said[y == 1].mean() > 0.6
    assert model["features"] == pii.FEATURES


def test_scores_and_thresholds_in_the_query(spark):
    """Every proposal of texts with many of each generator has the trees' score, and the threshold of its generator decides."""
    import numpy as np
    from pyspark.sql import functions as F

    model, texts = pii.model(), []
    rows = pii_model.sample(360, seed=5)
    for code in range(len(pii.GENERATORS)):
        own = [t for t, *_, c, _ in rows if c == code]
        texts += [" of it then . ".join(own[i : i + 20]) for i in range(0, len(own), 20)]
    texts.append("call me at 212-555-1000 today . " * 12)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    columns = [pii.spans_of("text", pattern, kind, rank).alias(name) for name, kind, rank, pattern in pii.GENERATORS]
    found = df.select("i", *columns, pii.proposals().alias("taken")).orderBy("i").collect()
    for r in found:
        want = []
        for code, (name, *_, pattern) in enumerate(pii.GENERATORS):
            spans = r[name]
            matches = list(re.finditer(pattern.replace("++", "+").replace("}+", "}"), texts[r["i"]]))
            assert [(s["start"], s["match"]) for s in spans] == [(m.start(), m[0]) for m in matches]
            ends = [0, *(m.end() for m in matches)]
            assert [s["before"] for s in spans] == [texts[r["i"]][max(e, m.start() - 40) : m.start()] for e, m in zip(ends, matches)]
            if spans:
                frame = spark.createDataFrame([(k, s["match"], s["before"]) for k, s in enumerate(spans)], "k int, m string, b string")
                x = np.array([y[1] for y in frame.select("k", pii.features(F.col("m"), F.col("b"), F.lit(code))).orderBy("k").collect()])
                out = model["base"] + sum(pii_model.predict(t, x) for t in model["trees"])
                want += [(round(float(v), 6), s["start"]) for v, s in zip(out, spans) if v >= model["thresholds"][name]]
        assert [(round(p["score"], 6), p["span"]["start"]) for p in r["taken"]] == want
    last = {r["doc_id"]: r for r in pii.find(spark.createDataFrame([(0, texts[-1])], "doc_id long, text string")).collect()}[0]
    assert last["n_added"] == 12 and last["spans"].count("phone:") == 12


def test_query_on_held_out_samples(spark):
    """Precision and recall of the query's own spans."""
    rows = pii_model.sample(1800, seed=77)
    got = {r["doc_id"]: r["spans"].split(",") for r in pii.find(spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "doc_id long, text string")).collect()}
    right = wrong = missed = 0
    for i, (_, start, end, _, code, label) in enumerate(rows):
        said = f"{pii.GENERATORS[code][1]}:{start}:{end}" in got[i]
        right, wrong, missed = right + (said and label), wrong + (said and not label), missed + (label and not said)
    assert right / (right + wrong) > 0.93 and right / (right + missed) > 0.6


def plain_choice(base, proposed):
    covered, held, out = 0, None, []
    for start, score, is_base, end, rank, kind in sorted([(s, float("-inf"), 0, e, r, k) for s, e, r, k in base] + [(s, -v, 1, e, r, k) for v, s, e, r, k in proposed]):
        clash = held is not None and held[1] > start
        if not is_base:
            out += [held[2]] if held is not None and not clash else []
            covered, held = max(covered, end), None
        elif start >= covered and not (clash and held[0] <= score):
            out += [held[2]] if held is not None and not clash else []
            held = (score, end, (start, end))
    return out + ([held[2]] if held else [])


def test_choice_among_overlaps(spark):
    import random

    from pyspark.sql import functions as F

    rng, rows = random.Random(3), []
    for i in range(120):
        n = rng.choice([3, 20, 700])
        base = sorted({(s := rng.randrange(5 * n), s + rng.randint(1, 5), 0, "email") for _ in range(rng.randint(0, n // 4))})
        proposed = [(rng.choice([0.5, 1.0, 2.0]), s := rng.randrange(5 * n), s + rng.randint(1, 9), 3, "phone") for _ in range(n)]
        rows.append((i, [(*b, "", "") for b in base], [(p[0], (*p[1:], "", "")) for p in proposed]))
    df = spark.createDataFrame(rows, f"i int, base {pii.SPAN}, proposed {pii.PROPOSAL}")
    for r in df.select("i", pii.chosen(F.col("base"), F.col("proposed")).alias("out")).collect():
        _, base, proposed = rows[r["i"]]
        want = plain_choice([b[:4] for b in base], [(v, *p[:4]) for v, p in proposed])
        got = [(s["start"], s["end"]) for s in r["out"]]
        assert got == want
        assert all(a[1] <= b[0] for a, b in zip(got, got[1:])) and not any(s < e2 and s2 < e for s, e in got for s2, e2, *_ in base)


def test_very_long_texts(spark):
    """Time grows with the matches, not with their square: twice the matches take about twice the time."""
    import time

    took = []
    for n in (4000, 16000):
        df = frame(spark, ["call me at 212-555-1000 or 10.0.0.1 today . " * n])
        begin = time.time()
        row = pii.find(df).collect()[0]
        took.append(time.time() - begin)
        assert row["n_ip"] == row["n_added"] == n
    assert took[1] < 8 * took[0] + 2
    found = pii.redact(df).collect()[0]["text"]
    assert found == "call me at [PHONE] or [IP] today . " * 16000
    row = secrets.scan(frame(spark, ["token=abc123XYZ and deadbeefdeadbeefdeadbeef " * 8000])).collect()[0]
    assert row["n_assign"] == row["n_hex"] == 8000


def test_repeated_rows_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "a@b.co", "s", 1, "x")] * 3, "doc_id long, text string, base_spans string, all_spans int, _row string")
    assert [r["n_email"] for r in pii.find(df).collect()] == [1, 1, 1]
    out = pii.redact(df)
    assert out.columns == df.columns and [tuple(r) for r in out.collect()] == [(1, "[EMAIL]", "s", 1, "x")] * 3
    assert [r["n_assign"] for r in secrets.scan(df).collect()] == [0, 0, 0]


def test_window_entropy_by_recounting(spark):
    import math

    from pyspark.sql import functions as F

    runs = ["a" * 30, "abcdefghijklmnopqrst", "aaaaabbbbbcccccdddddeeeee0123456789", "Zx9Qw8Er7Ty6Ui5Op4As3Df2Gh1Jk0"]
    got = [r[0] for r in spark.createDataFrame([(i, r) for i, r in enumerate(runs)], "i int, r string").orderBy("i").select(secrets.window_entropy(F.col("r"))).collect()]
    for run, h in zip(runs, got, strict=True):
        want = max(-sum(c / 20 * math.log2(c / 20) for c in Counter(run[i : i + 20]).values()) for i in range(len(run) - 19))
        assert h == pytest.approx(want)


QUALITY = [*TEXTS, "the of and to in is that was for it " * 8, "alpha | beta | gamma | delta ### " * 20, "a b c a b c " + " ".join(f"w{i}" for i in range(60))]


def test_quality_counts(spark):
    df = spark.createDataFrame([(i, t, "en" if i % 2 else None) for i, t in enumerate(QUALITY)], "doc_id long, text string, lang string")
    rows = {r["doc_id"]: r for r in quality.judge(df).collect()}
    for i, t in enumerate(QUALITY):
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {p for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        want = (i, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed)
        assert tuple(rows[i])[:7] == want, t[:40]
        assert not (failed and rows[i]["kept"])
    kept = {r["doc_id"] for r in quality.keep(df.withColumn("n_words", df.doc_id)).collect()}
    assert kept == {i for i, r in rows.items() if r["kept"]}


def test_distance_is_jensen_shannon(spark):
    import math

    from pyspark.sql import functions as F

    df = spark.createDataFrame([([1.0, 3.0, 0.0],)], "b array<double>")
    p, q = [0.25, 0.75, 0.0], [0.5, 0.25, 0.25]
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    kl = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m, strict=True) if a)
    assert df.select(quality.nearest(F.col("b"), [[1.0, 0.0, 0.0], q])).first()[0] == pytest.approx(math.sqrt((kl(p) + kl(q)) / 2))
