"""Training of the span classifier: gradient boosting of small trees on a bounded seeded sample.

``python -m paperloom.llm.pii_model`` writes ``pii_model.json`` anew, with the same bytes.
"""

from __future__ import annotations

import json
import random
from pathlib import Path

import numpy as np

from . import pii
from .common import CONTEXT

ROWS, SEED, TREES, DEPTH, RATE = 6000, 20, 30, 3, 0.3
PRECISION = 0.97

FILLER = "the report was sent on with a copy to all of them and it is as before for every part of that".split()
LEADS = {
    "contact": ["call me at", "phone:", "tel.", "fax", "mobile", "contact", "whatsapp"],
    "identity": ["ssn", "social security number", "passport", "national id", "tax id:"],
    "bank": ["iban", "account", "bank account:", "transfer to"],
    "mail": ["e-mail", "mail", "write to", "reach me under"],
    "trade": ["order", "invoice", "isbn", "issue", "page", "item", "tracking", "part", "model", "ref", "version", "serial", "ticket", "build", "no."],
    "plain": ["", "of", "the", "and then"],
}


def _digits(rng, n):
    return "".join(rng.choice("0123456789") for _ in range(n))


def sample(rows: int = ROWS, seed: int = SEED) -> list[tuple[str, int, int, str, int, int]]:
    """(text, start, end, match, generator, label): right spans and look-alikes, for each generator."""
    rng = random.Random(seed)
    out = []
    kinds = ["local_phone", "spelled_mail", "national_id", "bank_account", "long_number", "ip6"]
    friendly = {"local_phone": "contact", "spelled_mail": "mail", "national_id": "identity", "bank_account": "bank", "long_number": "identity", "ip6": "plain"}
    for i in range(rows):
        code = i % len(kinds)
        kind, label = kinds[code], rng.random() < 0.5
        lead = rng.choice([friendly[kind]] * 3 + ["plain"]) if label else rng.choice(["trade"] * 3 + ["plain"])
        if kind == "local_phone":
            sep = rng.choice("-. ")
            m = f"({_digits(rng, 3)}) {_digits(rng, 3)}-{_digits(rng, 4)}" if label and rng.random() < 0.5 else sep.join((_digits(rng, 3), _digits(rng, 3), _digits(rng, 4)))
        elif kind == "spelled_mail":
            a, b = ("[at]", "[dot]") if rng.random() < 0.5 else (" at ", " dot ")
            word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(3, 9)))
            if not label:
                a, b = " at ", " dot "
            m = f"{word()}{rng.choice(['', '.', _digits(rng, 2)]) if label else ''}{a}{word()}{b}{rng.choice(['com', 'org', 'net', 'de']) if label else word() + word()}"
        elif kind == "national_id":
            m = f"{_digits(rng, 3)}-{_digits(rng, 2)}-{_digits(rng, 4)}"
        elif kind == "bank_account":
            body = _digits(rng, 18) if label else "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ0123456789") for _ in range(rng.choice([8, 9, 12])))
            m = rng.choice(["DE", "FR", "ES", "GB", "XK", "QZ"]) + _digits(rng, 2) + body
            if label and rng.random() < 0.5:
                m = " ".join(m[k : k + 4] for k in range(0, len(m), 4))
        elif kind == "long_number":
            n = rng.randint(9, 12) if label else rng.randint(9, 19)
            m = _digits(rng, n)
            if not label and rng.random() < 0.3:
                m = rng.choice("0123456789") * n
            elif not label and rng.random() < 0.5:  # telephone numbers and national ids are other generators'
                if rng.random() < 0.5:
                    m, lead = rng.choice("-. ").join((_digits(rng, 3), _digits(rng, 3), _digits(rng, 4))), rng.choice(["contact", "plain"])
                else:
                    m, lead = "-".join((_digits(rng, 3), _digits(rng, 2), _digits(rng, 4))), rng.choice(["identity", "plain"])
            elif label and rng.random() < 0.3:
                m = " ".join(m[k : k + 3] for k in range(0, n, 3))
        else:
            group = (lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([1, 3, 4, 4])))) if label else (lambda: _digits(rng, rng.choice([1, 2])))
            m = ":".join(group() for _ in range(8))
        before = " ".join(rng.choice(FILLER) for _ in range(rng.randint(0, 8)))
        mark = rng.choice(["", "", "#", "= "]) if not label else ""
        head = f"{before} {rng.choice(LEADS[lead])} {mark}"
        out.append((f"{head}{m} {rng.choice(FILLER)}", len(head), len(head) + len(m), m, code, int(label)))
    return out


def _grow(x, g, h, depth, least=20):
    """A regression tree on gradients and Hessians, as nested lists."""
    leaf = float(round(RATE * g.sum() / (h.sum() + 1.0), 6))
    if depth == 0 or len(g) < 2 * least:
        return leaf
    best, gain0 = None, g.sum() ** 2 / (h.sum() + 1.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in ((values[:-1] + values[1:]) / 2)[:64]:
            left = x[:, f] <= cut
            if least <= left.sum() <= len(g) - least:
                gain = g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1) - gain0
                if best is None or gain > best[0] + 1e-9:
                    best = (gain, f, float(cut), left)
    if best is None or best[0] < 0.5:
        return leaf
    _, f, cut, left = best
    return [f, cut, _grow(x[left], g[left], h[left], depth - 1, least), _grow(x[~left], g[~left], h[~left], depth - 1, least)]


def predict(tree, x):
    if not isinstance(tree, list):
        return np.full(len(x), tree)
    left = x[:, tree[0]] <= tree[1]
    out = np.empty(len(x))
    out[left], out[~left] = predict(tree[2], x[left]), predict(tree[3], x[~left])
    return out


def feature_rows(spark, rows):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(i, t[max(0, a - CONTEXT) : a], m, code, label) for i, (t, a, _, m, code, label) in enumerate(rows)], "i int, before string, m string, code int, label int")
    got = frame.select("i", pii.features(F.col("m"), F.col("before"), F.col("code")).alias("x"), "label").orderBy("i").collect()
    return np.array([r["x"] for r in got]), np.array([r["label"] for r in got])


def train(spark, rows: int = ROWS, seed: int = SEED) -> dict:
    """Trees, base score, and thresholds calibrated on the held-out third for ``PRECISION``."""
    x, y = feature_rows(spark, sample(rows, seed))
    held = np.arange(len(y)) // len(pii.GENERATORS) % 3 == 2
    base = float(round(np.log(y[~held].mean() / (1 - y[~held].mean())), 6))
    s, trees = np.full((~held).sum(), base), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-s))
        tree = _grow(x[~held], y[~held] - p, p * (1 - p), DEPTH)
        trees.append(tree)
        s = s + predict(tree, x[~held])
    out = base + sum(predict(t, x[held]) for t in trees)
    thresholds, code = {}, x[held][:, pii.FEATURES.index("generator")]
    for i, (name, *_) in enumerate(pii.GENERATORS):
        own, right = out[code == i], y[held][code == i]
        order = np.argsort(-own)
        precision = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(precision >= PRECISION)
        thresholds[name] = float(round(own[order][good[-1]], 6)) if len(good) else 99.0
    return {"features": pii.FEATURES, "base": base, "trees": trees, "thresholds": thresholds}


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    session = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
    found = train(session)
    (Path(__file__).parent / "pii_model.json").write_text(json.dumps(found, indent=1) + "\n")
    print(found["thresholds"])
