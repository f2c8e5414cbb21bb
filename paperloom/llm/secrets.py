"""Secret scanning by format and by sliding-window entropy. DataFrame functions only.

Base spans are format matches (``assign``, ``access``, ``hex``). The method looks at every maximal run
of token characters of at least 20 characters that mixes letters and digits, takes its character class
(hex, alphanumeric, base64), slides a window of 20 characters over it and keeps the largest Shannon
entropy of a window, from counts that each step changes by one character in and one out. A run is
reported (kind ``entropy``) from the limit of its class on, unless an allow-list pattern fits it.

Defined cases: a null text is an empty one, without spans; repeated rows are scanned each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import count_kind, join_spans, let, read_text, spans_of

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
#: A maximal run of token characters; the look-behind keeps the scan linear.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
WINDOW = 20
#: Least entropy in bits of the best window, by class.
LIMITS = {"hex": 2.8, "alnum": 3.5, "base64": 3.7}
#: Runs that are no secrets: UUIDs, dates and versions, repeated units, long numbers, paths of words.
ALLOW = [
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9/=_+-]+$",
    r"^(.{1,8})\1{2,}.{0,8}$",
    r"^(?:[A-Za-z]+[0-9]{0,4}[/_=+-]+)+[A-Za-z]*[0-9]{0,4}$",
]


def char_class(run: Column) -> Column:
    return (
        F.when(run.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$"), "hex").when(run.rlike(r"^[A-Za-z0-9]+$"), "alnum").otherwise("base64")
    )


def window_entropy(run: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy (bits) of a window over the run, a shorter run being one window.

    The state holds the count of each code 0..127 and ``s``, the sum of c*log2(c) of the counts; a
    step changes the two counts concerned, so H = log2(n) - s/n needs no recount.
    """

    def f(c: Column) -> Column:
        return F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))

    def bump(counts: Column, code: Column, by: int) -> Column:
        at = code + 1
        return F.concat(
            F.slice(counts, F.lit(1), code), F.array(F.element_at(counts, at) + by), F.slice(counts, at + 1, F.lit(128) - at)
        )

    def over(codes: Column) -> Column:
        zero = F.struct(
            F.array_repeat(F.lit(0), 128).alias("c"), F.lit(0.0).alias("s"), F.lit(0).alias("n"), F.lit(0.0).alias("best"), F.lit(0).alias("i")
        )

        def add(acc, code):
            old = F.element_at(acc["c"], code + 1)
            return F.struct(
                bump(acc["c"], code, 1).alias("c"), (acc["s"] - f(old) + f(old + 1)).alias("s"), (acc["n"] + 1).alias("n"),
                acc["best"].alias("best"), acc["i"].alias("i"),
            )

        def drop(acc):
            gone = F.element_at(codes, acc["i"] - window + 1)
            old = F.element_at(acc["c"], gone + 1)
            full = F.struct(
                bump(acc["c"], gone, -1).alias("c"), (acc["s"] - f(old) + f(old - 1)).alias("s"), (acc["n"] - 1).alias("n"),
                acc["best"].alias("best"), acc["i"].alias("i"),
            )
            return F.when(acc["n"] > window, full).otherwise(acc)

        def note(acc):
            h = F.log2(acc["n"].cast("double")) - acc["s"] / acc["n"]
            best = F.when((acc["n"] == window) | (F.size(codes) < window), F.greatest(acc["best"], h)).otherwise(acc["best"])
            return F.struct(acc["c"].alias("c"), acc["s"].alias("s"), acc["n"].alias("n"), best.alias("best"), (acc["i"] + 1).alias("i"))

        return F.aggregate(codes, zero, lambda acc, x: let(let(add(acc, x), drop), note), lambda acc: acc["best"])

    return let(F.transform(F.split(run, ""), lambda c: F.ascii(c)), over)


def is_random(run: Column) -> Column:
    listed = F.lit(False)
    for pattern in ALLOW:
        listed = listed | run.rlike(pattern)
    kind = char_class(run)
    limit = F.when(kind == "hex", LIMITS["hex"]).when(kind == "alnum", LIMITS["alnum"]).otherwise(LIMITS["base64"])
    return F.when(run.rlike("[0-9]") & run.rlike("[A-Za-z]") & ~listed, window_entropy(run) >= limit).otherwise(F.lit(False))


def scan(docs: DataFrame) -> DataFrame:
    df = read_text(docs)
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN_VALUE, 1)) >= 6
    df = df.withColumn("assign", spans_of("text", ASSIGN, "assign", 0, keep=value))
    df = df.withColumn("access", spans_of("text", ACCESS, "access", 1, guard=F.col("text").contains("AKIA")))
    df = df.withColumn("hex", spans_of("text", HEX, "hex", 2))
    df = df.withColumn("entropy", spans_of("text", CANDIDATE, "entropy", 3, keep=is_random))
    base = F.concat("assign", "access", "hex")
    return df.select(
        "doc_id",
        count_kind(F.col("assign"), "assign").alias("n_assign"),
        count_kind(F.col("access"), "access").alias("n_access"),
        count_kind(F.col("hex"), "hex").alias("n_hex"),
        F.sha2(join_spans(base), 256).alias("base_sha256"),
        join_spans(F.concat(base, "entropy")).alias("spans"),
        F.size("entropy").cast("long").alias("n_entropy"),
    )
