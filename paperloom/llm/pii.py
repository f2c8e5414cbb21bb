"""Personal data: generators propose spans, boosted trees choose among them. DataFrame functions only.

Base spans (``email``, ``ip``, ``card``, ``phone``) are format matches with their checks and always stay.
High-recall generators propose further, overlapping spans (national phone numbers, obfuscated mail
addresses, national ids, bank accounts, long numbers, IPv6). Boosted trees score each proposal from its
format and the text before it (since the match before of its generator), and those from the calibrated
threshold of their generator on are candidates. In order of their starts, of a candidate and the one held
before it that overlap the better stays; one that overlaps a base span goes. The trees are trained by ``pii_model.train`` on a
bounded, seeded, labelled sample (parameter ``rows``) and kept in ``pii_model.json``; here they are
plain ``CASE`` expressions.

Defined cases: a null text is an empty one, without spans; repeated rows are scanned each; an empty
table gives an empty result; other columns are ignored by ``find`` and kept by ``redact``.
"""

from __future__ import annotations

import json
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPAN, SPAN_ROW, count_kind, fold, join_spans, let, read_text, spans_of

# The look-behinds and possessive quantifiers keep the scans linear; \G lets a match start where the
# last one ended, as leftmost non-overlapping search does.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: (generator, kind, rank, pattern)
GENERATORS = [
    ("local_phone", "phone", 3, r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20./-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
    ("spelled_mail", "email", 0, r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\[at\]|\(at\)|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}+\x20?(?:\[dot\]|\(dot\)|\x20dot\x20)\x20?[A-Za-z]{2,24}+"),
    ("national_id", "id", 4, r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("bank_account", "iban", 5, r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("long_number", "number", 6, r"(?<![0-9A-Za-z])[0-9](?:[\x20-]?[0-9]){8,18}(?![0-9A-Za-z])"),
    ("ip6", "ip", 1, r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
]
#: Words before a span, as features.
WORDS = {
    "contact": "phone|tel|call|fax|mobile|contact|whatsapp|telefon|llame|appel",
    "identity": "ssn|social|passport|national id|tax id|insurance",
    "bank": "iban|account|bank|konto|compte|cuenta|transfer",
    "mail": "mail|write to|reach",
    "trade": "order|invoice|isbn|issue|page|item|track|part|model|ref|version|serial|ticket|build|no\\.",
}
FEATURES = ["length", "digits", "separators", "letters", "variety", *WORDS, "marked", "generator"]


def luhn(digits: Column) -> Column:
    def step(acc, c, i):
        return F.when(i % 2 == 0, c).otherwise(F.when(c * 2 > 9, c * 2 - 9).otherwise(c * 2))

    values = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    terms = F.transform(F.filter(values, lambda c: c.isNotNull()), lambda c, i: step(None, c, i))
    return F.aggregate(terms, F.lit(0), lambda a, x: a + x) % 10 == 0


def only_digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def is_card(match: Column) -> Column:
    n = F.length(only_digits(match))
    return F.when((n >= 14) & (n <= 19), luhn(only_digits(match))).otherwise(F.lit(False))


def is_phone(match: Column) -> Column:
    return F.length(only_digits(match)).between(10, 15)


def is_ip(match: Column) -> Column:
    """Parts at most 255, whatever zeros lead."""
    return F.forall(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^([0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))


def features(match: Column, before: Column, generator: Column) -> Column:
    """Doubles in the order of ``FEATURES``."""

    def of(x: Column) -> Column:
        m, before = x["m"], x["before"]
        digits = F.length(only_digits(m))
        letters = F.length(F.regexp_replace(m, "[^A-Za-z]", ""))
        values = [
            F.length(m), digits, F.length(m) - digits - letters, letters,
            F.size(F.array_distinct(F.split(only_digits(m), ""))),
            *(before.rlike(words).cast("int") for words in WORDS.values()),
            before.rlike(r"[#$€£=/:]\s?$").cast("int"),
            generator,
        ]
        return F.array(*(v.cast("double") for v in values))

    return let(F.struct(match.alias("m"), F.lower(before).alias("before")), of)


@cache
def model() -> dict:
    return json.loads((Path(__file__).parent / "pii_model.json").read_text())


def score(x: Column, trees: list) -> Column:
    """The trees' sum. A tree is a leaf (number) or [feature, threshold, left if <=, right]."""

    def of(tree) -> Column:
        if not isinstance(tree, list):
            return F.lit(float(tree))
        at, limit, low, high = tree
        return F.when(F.get(x, F.lit(at)) <= limit, of(low)).otherwise(of(high))

    total = of(trees[0])
    for t in trees[1:]:
        total = total + of(t)
    return total


PROPOSAL = f"array<struct<score:double,span:{SPAN_ROW}>>"


def _scored(code: int):
    """Of a span of generator ``code``: the span with the trees' score. A lambda's further parameters would get
    the element's index, so what it needs is bound here."""
    m = model()

    def score_of(s: Column) -> Column:
        found = let(features(s["match"], s["before"], F.lit(code)), lambda x: m["base"] + score(x, m["trees"]))
        return F.struct(found.alias("score"), s.alias("span"))

    return score_of


def _above(cut: float):
    return lambda p: p["score"] >= F.lit(cut)


def proposals(text: str = "text") -> Column:
    """Proposals with their scores, those below their generator's threshold left out."""
    out = []
    for code, (name, kind, rank, pattern) in enumerate(GENERATORS):
        scored = F.transform(spans_of(text, pattern, kind, rank), _scored(code))
        out.append(F.filter(scored, _above(model()["thresholds"][name])).cast(PROPOSAL))
    return F.concat(*out)


def chosen(base: Column, proposed: Column) -> Column:
    """Candidates that overlap no base span and no better candidate, in one pass by start."""
    none = F.lit(None).cast("double")
    item = lambda start, score, base, span: F.struct(start.alias("start"), score.alias("score"), base.alias("base"), span.alias("span"))
    items = F.array_sort(
        F.concat(
            # at equal starts the base span first, then the better candidate
            F.transform(base, lambda s: item(s["start"], F.lit(float("-inf")), F.lit(True), s)),
            F.transform(proposed, lambda p: item(p["span"]["start"], -p["score"], F.lit(False), p["span"])),
        )
    )
    free = F.lit(None).cast(SPAN_ROW)
    nothing = F.expr(f"cast(array() as {SPAN})")
    state = lambda covered, held, score: F.struct(covered.alias("covered"), held.alias("held"), score.alias("score"))

    def step(now, x):
        held, s = now["held"], x["span"]
        clash = held.isNotNull() & (held["end"] > s["start"])
        stay = F.when(held.isNotNull() & ~clash, F.array(held)).otherwise(nothing)
        result = lambda covered, held, score, out: F.struct(state(covered, held, score).alias("state"), out.alias("out"))
        reach = F.greatest(now["covered"], s["end"])
        return (
            F.when(x["base"], result(reach, free, none, stay))
            .when(s["start"] < now["covered"], result(now["covered"], held, now["score"], nothing))
            .when(clash & (now["score"] <= x["score"]), result(now["covered"], held, now["score"], nothing))
            .otherwise(result(now["covered"], s, x["score"], stay))
        )

    last = lambda now: F.when(now["held"].isNotNull(), F.array(now["held"])).otherwise(nothing)
    return fold(items, state(F.lit(0), free, none), step, SPAN, last)


def with_spans(df: DataFrame) -> DataFrame:
    """Adds ``base_spans`` and ``all_spans`` to a frame with a ``text`` that isn't null."""
    df = df.withColumn("_email", spans_of("text", EMAIL, "email", 0, guard=F.col("text").contains("@")))
    df = df.withColumn("_ip", spans_of("text", IP, "ip", 1, keep=is_ip))
    df = df.withColumn("_card", spans_of("text", CARD, "card", 2, keep=is_card))
    df = df.withColumn("_phone", spans_of("text", PHONE, "phone", 3, keep=is_phone, guard=F.col("text").contains("+")))
    df = df.withColumn("base_spans", F.concat("_email", "_ip", "_card", "_phone")).drop("_email", "_ip", "_card", "_phone")
    df = df.withColumn("_proposed", proposals())
    added = F.when(F.size("_proposed") > 0, chosen(F.col("base_spans"), F.col("_proposed"))).otherwise(F.expr(f"cast(array() as {SPAN})"))
    return df.withColumn("all_spans", F.concat("base_spans", added)).drop("_proposed")


def find(docs: DataFrame) -> DataFrame:
    df = with_spans(read_text(docs))
    counts = [count_kind(F.col("base_spans"), k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    return df.select(
        "doc_id",
        *counts,
        F.sha2(join_spans(F.col("base_spans")), 256).alias("base_sha256"),
        join_spans(F.col("all_spans")).alias("spans"),
        (F.size("all_spans") - F.size("base_spans")).cast("long").alias("n_added"),
    )


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by ``[KIND]``; overlapping spans become one, named by the first."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"])))

    def step(at, s):
        piece = F.array(F.substring(text, at + 1, s["start"] - at), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        end = F.greatest(at, s["end"])
        return F.struct(end.alias("state"), F.when(s["start"] >= at, piece).otherwise(F.array().cast("array<string>")).alias("out"))

    cut = F.substring(text, F.array_max(F.transform(spans, lambda s: s["end"])) + 1, F.length(text))
    done = F.concat(F.array_join(fold(ordered, F.lit(0), step, "array<string>"), ""), cut)
    return F.when(F.size(spans) == 0, text).otherwise(done)


def redact(docs: DataFrame) -> DataFrame:
    """The documents with their columns, personal data in ``text`` replaced; ``n_chars``, if there, follows."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    df = with_spans(docs.select(row, F.coalesce(F.col("text"), F.lit("")).alias("text")))
    df = df.withColumn("_new", F.when(F.col("_row.text").isNotNull(), redacted(F.col("text"), F.col("all_spans"))))
    out = []
    for c in docs.columns:
        if c == "text":
            out.append(F.col("_new").alias("text"))
        elif c == "n_chars":
            kind = docs.schema["n_chars"].dataType
            out.append(F.when(F.size("all_spans") > 0, F.length("_new")).otherwise(F.col("_row.n_chars")).cast(kind).alias("n_chars"))
        else:
            out.append(F.col(f"_row.`{c}`").alias(c))
    return df.select(*out)
