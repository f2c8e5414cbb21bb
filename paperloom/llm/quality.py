"""Quality rules and the divergence of a document from its language's reference. DataFrame functions only.

Words are maximal runs of characters other than space and U+0009 to U+000D. Base rules fail a
document with fewer than 50 words or whose repeated 3-word windows cover over half of its words.
The method compares two histograms with language references by Jensen-Shannon distance (base 2,
0 to 1): character classes, and common words. References are the sums over all documents of a
language, so they are a few rows whatever the input. A document is rejected if its nearest
reference is farther than a limit, as the sum of both distances. Short texts have noisy histograms:
the limit is wider the fewer words there are, and the verdict counts only from a minimum length on.

Defined cases: a null text has no words (and fails); a null or unlisted ``lang`` feeds the reference
``other``; repeated rows are judged each; an empty table gives an empty result; extra columns stay
out of the result of ``judge`` and are kept by ``keep``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize

#: The common words that make the bins of the word histogram.
COMMON = {
    "en": "the of and to in is that was for with as on by are",
    "fr": "le la les et des un en du que qui pour est",
    "de": "der die und das den mit ein ist nicht auf zu von",
    "es": "el los las que de y se del por una para con",
}
WORDS = list(dict.fromkeys(w for words in COMMON.values() for w in words.split()))
LANGS = [*COMMON, "other"]
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
MIN_WORDS = 50
#: The limit of the summed distances is LIMIT + SLACK / words; it counts from MIN_HISTOGRAM_WORDS on.
LIMIT, SLACK, MIN_HISTOGRAM_WORDS = 0.37, 8.0, 50


def without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _covered(places: Column) -> Column:
    """Positions in the union of the 3-word windows that start at ascending places."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(
        places,
        start,
        lambda acc, p: F.struct((acc["n"] + p + 3 - F.greatest(p, acc["end"])).alias("n"), (p + 3).alias("end")),
        lambda acc: acc["n"],
    )


def _repeated(grams: Column) -> Column:
    """Words in windows found twice or more. ``grams`` holds a hash for each window, in order."""
    placed = F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i")))

    def few(double):
        hits = F.filter(placed, lambda x: F.array_contains(double, x["g"]))
        return _covered(F.transform(hits, lambda x: x["i"]))

    def many():
        def pick(s):
            def twin(x, i):
                return F.coalesce(x["g"] == F.get(s, i - 1)["g"], F.lit(False)) | F.coalesce(x["g"] == F.get(s, i + 1)["g"], F.lit(False))

            return _covered(F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"])))

        return let(F.sort_array(placed), pick)

    def counted(s):
        double = F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (x == F.get(s, i - 1))))
        return let(double, lambda d: F.when(F.size(d) == 0, F.lit(0)).when(F.size(d) <= 24, few(d)).otherwise(many()))

    return let(F.sort_array(grams), counted)


def measured(docs: DataFrame, repeats: bool = True) -> DataFrame:
    """The input with ``n_words``, ``char_bins`` and ``word_bins``; with ``repeats`` also the base counts."""
    df = docs.withColumn("_t", F.coalesce(F.col("text"), F.lit("")))
    trimmed = F.btrim(F.col("_t"), F.lit(SPACES))
    df = df.withColumn("_w", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+", -1)))
    df = df.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w))).withColumn("n_words", F.size("_h").cast("long"))
    word_chars = F.length(without(F.col("_t"), SPACES))
    df = df.withColumn("word_chars", word_chars.cast("long")).withColumn("n_symbols", (F.length("_t") - F.length(without(F.col("_t"), SYMBOLS))).cast("long"))
    size = F.length("_t")
    upper = size - F.length(F.regexp_replace("_t", "[A-Z]+", ""))
    digit = size - F.length(F.regexp_replace("_t", "[0-9]+", ""))
    point = size - F.length(F.regexp_replace("_t", r"[!\"'(),./:;?@\[\]^_`{}~\\=+-]+", ""))
    foreign = F.octet_length("_t") - size
    df = df.withColumn("_c", F.array(*(c.cast("double") for c in (size - F.col("word_chars"), F.col("n_symbols"), upper, digit, point, foreign))))
    df = df.withColumn(
        "char_bins", F.concat(F.col("_c"), F.array(F.greatest(F.lit(0.0), size - F.aggregate("_c", F.lit(0.0), lambda a, x: a + x))))
    )
    hits = [(F.col("n_words") - F.size(F.array_remove("_h", F.xxhash64(F.lit(w))))).cast("double") for w in WORDS]
    df = df.withColumn("_k", F.array(*hits))
    df = df.withColumn(
        "word_bins", F.concat(F.col("_k"), F.array(F.col("n_words") - F.aggregate("_k", F.lit(0.0), lambda a, x: a + x)))
    )
    if repeats:
        lines = F.filter(F.split("_t", "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
        df = df.withColumn("n_dup_lines", let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"))
        grams = let(
            F.col("_h"),
            lambda h: F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2))),
        )
        df = df.withColumn("n_repeat_words", let(grams, _repeated).cast("long"))
        df = df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return df.drop("_t", "_w", "_h", "_c", "_k")


def _language(lang: Column) -> Column:
    return F.when(lang.isin(*COMMON), lang).otherwise(F.lit("other"))


def references(bins: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """Reference histograms by language: summed in the executors, at most ``len(LANGS)`` rows arrive.

    Each document counts by its shares, so long documents don't outweigh the rest.
    """

    def shares(name: str, n: int) -> list[Column]:
        return [F.sum(F.get(F.col(name), F.lit(i)) / F.col(f"_{name}")).alias(f"{name}_{i}") for i in range(n)]

    # each total once a document, not once a bin
    totals = {f"_{name}": F.greatest(F.aggregate(name, F.lit(0.0), lambda a, x: a + x), F.lit(1.0)) for name in ("char_bins", "word_bins")}
    bins = bins.where(F.col("n_words") >= MIN_HISTOGRAM_WORDS).select("lang", "char_bins", "word_bins").withColumns(totals)
    n_words, n_chars = len(WORDS) + 1, 7
    rows = (
        bins.groupBy(_language(F.col("lang")).alias("language"))
        .agg(*shares("char_bins", n_chars), *shares("word_bins", n_words))
        .collect()
    )
    out = {}
    for r in sorted(rows, key=lambda r: r["language"]):
        both = []
        for name, n in (("char_bins", n_chars), ("word_bins", n_words)):
            v = [r[f"{name}_{i}"] or 0.0 for i in range(n)]
            both.append([round(x / sum(v), 9) for x in v])
        out[r["language"]] = (both[0], both[1])
    return out


def xlog(x: Column) -> Column:
    return F.when(x > 0, x * F.log2(x)).otherwise(F.lit(0.0))


def nearest(bins: Column, references: list[list[float]]) -> Column:
    """Jensen-Shannon distance of a histogram of counts from the nearest of the references' shares.

    With m the mean of p and q the divergence is (sum p log p + sum q log q) / 2 - sum m log m: the first
    sum is the same for all references and the second a constant.
    """
    def of(shares: Column) -> Column:
        own = F.aggregate(shares, F.lit(0.0), lambda a, p: a + xlog(p))

        def divergence(q: list[float], own: Column) -> Column:
            fixed = sum(x * math.log2(x) for x in q if x > 0)
            means = F.zip_with(shares, F.array(*(F.lit(float(x)) for x in q)), lambda p, x: (p + x) / 2)
            return (own + fixed) / 2 - F.aggregate(means, F.lit(0.0), lambda a, m: a + xlog(m))

        return let(own, lambda h: F.array_min(F.array(*(divergence(q, h) for q in references))))

    total = F.greatest(F.aggregate(bins, F.lit(0.0), lambda a, x: a + x), F.lit(1.0))
    return F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), let(let(total, lambda t: F.transform(bins, lambda b: b / t)), of))))


def distances(df: DataFrame, refs: dict) -> DataFrame:
    """Adds the distances to the nearest reference: ``char_distance`` and ``word_distance``."""
    for name, at in (("char", 0), ("word", 1)):
        df = df.withColumn(f"{name}_distance", nearest(F.col(f"{name}_bins"), [ref[at] for ref in refs.values()]) if refs else F.lit(0.0))
    return df


def verdict(limit: float = LIMIT, slack: float = SLACK) -> Column:
    far = F.col("char_distance") + F.col("word_distance") > limit + slack / F.greatest(F.col("n_words"), F.lit(1))
    odd = (F.col("n_words") >= MIN_HISTOGRAM_WORDS) & far
    return ~F.col("base_failed") & ~F.coalesce(odd, F.lit(False))


def judge(docs: DataFrame) -> DataFrame:
    """Counts, distances and the verdict for each document. The texts are read once."""
    bins = materialize(measured(docs.select("doc_id", "text", "lang")).drop("text"), "quality-counts")
    df = distances(bins, references(bins)).withColumn("kept", verdict())
    return df.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance"),
    )


def keep(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns. References first, then one narrow pass: no shuffle.

    The row number keeps the filter above the projections: pushed down, it would repeat them.
    """
    refs = references(measured(docs.select("text", "lang"), repeats=False))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text", "lang")
    judged = distances(measured(rows), refs).select("_row", verdict().alias("_kept"), F.monotonically_increasing_id().alias("_at"))
    return judged.where("_kept and _at >= 0").select("_row.*")
