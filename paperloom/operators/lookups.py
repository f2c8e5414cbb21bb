"""Joins of document work: as-of and range lookups, carried values, recall, selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def carry_forward(rows: DataFrame, keys: list[str], order: list, value: Column, name: str) -> DataFrame:
    """The last value that was set, up to the row."""
    over = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(over))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, since: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the right row that starts last, at or before it: one sort of the
    union, instead of a join on an inequality. Of equal starts the largest value wins."""
    names = [c for c in left.columns if c not in keys and c != at]
    tagged = left.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*names).alias("_row"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("_value"))
    starts = right.select(*keys, F.col(since).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*names)).schema[0].dataType).alias("_row"), F.struct(*values).alias("_value"))
    over = W.partitionBy(*keys).orderBy("_at", "_side", "_value").rowsBetween(W.unboundedPreceding, 0)
    found = tagged.unionByName(starts).withColumn("_found", F.last("_value", ignorenulls=True).over(over)).where("_side = 1")
    return found.select(*keys, F.col("_at").alias(at), *(F.col(f"_row.{c}").alias(c) for c in names), *(F.col(f"_found.{c}").alias(c) for c in values))


def range_lookup(points: DataFrame, pieces: DataFrame, keys: list[str], at: str, start: str, end: str, values: list[str]) -> DataFrame:
    """Points in half-open, disjoint pieces: the piece that starts last, if it reaches the point."""
    found = as_of(points, pieces, keys, at, start, [start, end, *values])
    return found.where(F.col(at) < F.col(end)).drop(start, end)


def range_join(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str, width: int) -> DataFrame:
    """Points with every span [start, end) that holds them, also overlapping ones: spans are listed in each
    bin of ``width`` they touch, so the join has an equality and reads no pair of other bins."""
    binned = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.greatest(F.col(end) - 1, F.col(start))) / width))))
    return points.withColumn("_bin", F.floor(F.col(at) / width)).join(binned, [*keys, "_bin"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_bin")


def word_counts(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Words of letters, digits and underscores, lower-cased, with their counts."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return texts.select(*keys, F.explode(words).alias("word")).groupBy(*keys, "word").agg(F.count("*").alias("n"))


def word_recall(candidate: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: hits (the smaller count of each word), total and recall; null without reference words."""
    found = candidate.withColumnRenamed("n", "found")
    both = reference.join(found, [*keys, "word"], "left")
    out = both.groupBy(*keys).agg(F.sum(F.least("n", F.coalesce("found", F.lit(0)))).alias("hits"), F.sum("n").alias("total"))
    return out.withColumn("recall", F.col("hits") / F.nullif(F.col("total"), F.lit(0)))


def slice_of(rows: DataFrame, keys: list[str], order: list, start: int | None, stop: int | None, step: int = 1) -> DataFrame:
    """Python's slice of each key's rows: ``index`` from 0, negative bounds count from the end."""
    size = F.count("*").over(W.partitionBy(*keys))
    numbered = rows.withColumn("index", (F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1).cast("long")).withColumn("_n", size)

    def bound(value: int) -> Column:
        return F.greatest(F.lit(0), F.col("_n") + value) if value < 0 else F.lit(value)

    low = bound(start) if start is not None else F.lit(0)
    high = bound(stop) if stop is not None else F.col("_n")
    inside = (F.col("index") >= low) & (F.col("index") < high) & ((F.col("index") - low) % step == 0)
    return numbered.where(inside).drop("_n")


def first_of(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Of rows with equal keys the first."""
    return rows.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def first_reference_numbers(references: DataFrame, keys: list[str], target: str, order: str) -> DataFrame:
    """Numbers targets in the order of their first reference; repeats share the number."""
    first = references.groupBy(*keys, target).agg(F.min(order).alias("first"))
    return first.withColumn("number", F.row_number().over(W.partitionBy(*keys).orderBy("first")).cast("long"))


def page_ranges(blocks: DataFrame, keys: list[str], order: list, height: str, budget: int) -> DataFrame:
    """Pages by a budget of lines over the running sum: first and last block of each page."""
    over = W.partitionBy(*keys).orderBy(*order)
    before = F.coalesce(F.sum(height).over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    paged = blocks.withColumn("_b", (F.row_number().over(over) - 1).cast("long")).withColumn("page", F.floor(before / budget).cast("long"))
    spans = paged.groupBy(*keys, "page").agg(F.min("_b").alias("block_start"), (F.max("_b") + 1).alias("block_end"))
    return spans.withColumn("page", (F.row_number().over(W.partitionBy(*keys).orderBy("page")) - 1).cast("long"))
