"""Gaps and islands: runs of neighbours that belong together, and intervals that touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import new_path, same, written


def islands(rows: DataFrame, keys: list[str], order: list, value: Column, name: str = "island") -> DataFrame:
    """Numbers runs of neighbours with an equal value, from 1 on."""
    over = W.partitionBy(*keys).orderBy(*order)
    change = (~value.eqNullSafe(F.lag(value).over(over))) | (F.row_number().over(over) == 1)
    return rows.withColumn("_change", change.cast("long")).withColumn(name, F.sum("_change").over(over.rowsBetween(W.unboundedPreceding, 0))).drop("_change")


def _merged(ranges: DataFrame, keys: list[str], start: str, end: str, gap: int, carry: str | None = None, kept: tuple[str, ...] = ()) -> DataFrame:
    """The last row of each merged range, with it as ``_from``, ``_to`` and ``_n``, and whether it is the key's ``_last``.

    Everything is told in one order of the rows, which is sorted once: no range is gathered into a group of its own.
    ``carry`` is the furthest end before the rows of the key: what goes on from there has the ``_group`` 0.
    """
    over = W.partitionBy(*keys).orderBy(start, end)
    so_far, earlier = over.rowsBetween(W.unboundedPreceding, 0), over.rowsBetween(W.unboundedPreceding, -1)
    reach = F.max(end).over(earlier)
    rows = ranges.select(*keys, start, end, *kept, *filter(None, [carry])).withColumns({"_reach": F.greatest(reach, carry) if carry else reach, "_row": F.row_number().over(over), "_known": F.lag(start).over(over).isNotNull()})
    rows = rows.withColumn("_new", F.coalesce((F.col(start) > F.col("_reach") + gap).cast("long"), F.lit(1)))
    rows = rows.withColumns({"_group": F.sum("_new").over(so_far), "_next": F.lead("_new").over(over)})
    first = F.col("_new") == 1
    begin = F.last(F.when(first, F.col("_row")), ignorenulls=True).over(so_far)
    rows = rows.withColumns({
        # starts ascend, unknown ones first: the range's first known one
        "_from": F.last(F.when(first | ~F.col("_known"), F.col(start)), ignorenulls=True).over(so_far),
        "_to": F.max(F.struct("_group", F.col(end).alias("e"))).over(so_far)["e"],  # groups ascend: of the last one
        "_n": F.col("_row") - (F.coalesce(begin, F.lit(1)) if carry else begin) + F.lit(1).cast("long"),
    })
    return rows.where(F.coalesce("_next", F.lit(1)) == 1).withColumn("_last", F.col("_next").isNull())


def _stitched(pieces: DataFrame, keys: list[str], start: str, end: str, gap: int) -> DataFrame:
    """The merged ranges of keys that stand in several ``_piece`` (of ``tables.split``), as of ``_merged``; each also with
    the end ``_before`` it and the key's furthest ``_reach`` so far.

    A piece is merged by itself, from the furthest end of those before. What touches its edges, three rows a piece at
    most, is stitched over the pieces of a key; all else is whole.
    """
    at = [*keys, "_piece"]
    by_piece = W.partitionBy(*keys).orderBy("_piece")
    tops = pieces.groupBy(*at).agg(F.max(end).alias("_top"))
    tops = tops.withColumns({"_carry": F.max("_top").over(by_piece.rowsBetween(W.unboundedPreceding, -1)), "_ends": F.lead("_piece").over(by_piece).isNull()})
    named = [f"_k{i}" for i in range(len(at))]
    tops = tops.select(*(F.col(k).alias(n) for k, n in zip(at, named, strict=True)), "_carry", "_ends")
    most = pieces.agg(F.max("_piece")).first()[0]
    rows = pieces.join(F.broadcast(tops), same(at, named)).repartitionById(most + 1, F.col("_piece"))
    parts = _merged(rows, at, start, end, gap, "_carry", ("_ends",)).withColumns({"_before": F.lag("_to").over(W.partitionBy(*at).orderBy(start, end)), "_reach": F.greatest("_reach", end)})
    told = ["_from", "_to", "_n", "_before", "_reach"]
    parts = written(parts.select(*at, "_group", *told, "_last", "_ends"), new_path(pieces.sparkSession, "parts"))
    edge, opens = (F.col("_group") <= 1) | F.col("_last"), F.col("_group") != 0
    whole = parts.where(~edge).select(*keys, *told, F.lit(False).alias("_last"))
    over = W.partitionBy(*keys).orderBy("_piece", "_group").rowsBetween(W.unboundedPreceding, 0)
    chains = parts.where(edge).withColumn("_chain", F.sum(opens.cast("long")).over(over)).groupBy(*keys, "_chain")
    chains = chains.agg(
        F.min("_from").alias("_from"), F.max("_to").alias("_to"), F.sum("_n").alias("_n"), F.max(F.when(opens, F.col("_before"))).alias("_inside"),
        F.max("_reach").alias("_reach"), F.bool_or(F.col("_group") == 1).alias("_first"), F.bool_or(F.col("_last") & F.col("_ends")).alias("_last"),
    )
    # before a piece's first own range stands the chain before, before others one of the same piece
    chains = chains.withColumn("_before", F.when(F.col("_first"), F.lag("_to").over(W.partitionBy(*keys).orderBy("_chain"))).otherwise(F.col("_inside")))
    return whole.unionByName(chains.select(*keys, *told, "_last"))


def coalesce_ranges(ranges: DataFrame, keys: list[str], start: str = "start", end: str = "end", gap: int = 0, pieces: DataFrame | None = None) -> DataFrame:
    """Half-open ranges merged where the next starts at most ``gap`` after the furthest end so far. ``pieces``: those of
    large keys, as ``tables.split`` has them."""
    told = [*keys, F.col("_from").alias(start), F.col("_to").alias(end), F.coalesce("_n", F.lit(0)).alias("n_ranges")]
    merged = _merged(ranges, keys, start, end, gap).select(*told)
    return merged if pieces is None else merged.unionByName(_stitched(pieces, keys, start, end, gap).select(*told))


def uncovered_ranges(held: DataFrame, keys: list[str], low: Column, high: Column, start: str = "start", end: str = "end", pieces: DataFrame | None = None) -> DataFrame:
    """What of [low, high) the held ranges leave out, for each key that has a range. ``pieces``: as of ``coalesce_ranges``."""
    over = W.partitionBy(*keys).orderBy(start, end)  # the order in which the rows already are
    merged = _merged(held, keys, start, end, 0).withColumns({"_before": F.lag("_to").over(over), "_reach": F.max("_to").over(over.rowsBetween(W.unboundedPreceding, 0))})
    if pieces is not None:
        told = [*keys, "_from", "_before", "_reach", "_last"]
        merged = merged.select(*told).unionByName(_stitched(pieces, keys, start, end, 0).select(*told))
    before = F.struct(F.coalesce("_before", low).alias("from"), F.col("_from").alias("to"))
    after = F.when(F.col("_last"), F.struct(F.col("_reach").alias("from"), high.alias("to")))
    both = merged.select(*keys, F.explode(F.array(before, after)).alias("_gap")).where("_gap IS NOT NULL")
    return both.select(*keys, F.greatest("_gap.from", low).alias(start), F.least("_gap.to", high).alias(end)).where(F.col(start) < F.col(end))


def start_columns(cells: DataFrame, row_keys: list[str], order: list, span: str) -> DataFrame:
    """Adds ``start_col``: the columns taken by the cells before in the row."""
    before = W.partitionBy(*row_keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return cells.withColumn("start_col", F.coalesce(F.sum(span).over(before), F.lit(0)).cast("long"))


def row_spans(cells: DataFrame, table_keys: list[str], row: str, start_col: str, continues: Column) -> DataFrame:
    """Adds ``row_span`` to cells that start a vertical merge; continuing cells go. A run is broken by a row
    that has no continuing cell at the column."""
    over = W.partitionBy(*table_keys, start_col).orderBy(row)
    opens = ~continues | ~F.coalesce(F.lag(row).over(over) == F.col(row) - 1, F.lit(False))
    grouped = cells.withColumn("_open", opens.cast("long")).withColumn("_run", F.sum("_open").over(over.rowsBetween(W.unboundedPreceding, 0)))
    spans = grouped.withColumn("row_span", F.count("*").over(W.partitionBy(*table_keys, start_col, "_run")))
    return spans.where("_open = 1").drop("_open", "_run")


def group_ahead(rows: DataFrame, keys: list[str], order: list, height: str, keeps: str, limit: int = 64) -> DataFrame:
    """Adds ``group_height``: a row's height with those after it up to the first that doesn't keep with its
    next, at most ``limit`` further rows."""
    before = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    grouped = rows.withColumn("_group", F.coalesce(F.sum((~F.col(keeps)).cast("long")).over(before), F.lit(0)))
    ahead = W.partitionBy(*keys, "_group").orderBy(*order).rowsBetween(0, limit)
    return grouped.withColumn("group_height", F.sum(height).over(ahead)).drop("_group")


def border_groups(rows: DataFrame, keys: list[str], order: list, border: Column) -> DataFrame:
    """Adds whether a row's borders join those of the row above and below: where they are equal."""
    over = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("joins_above", border == F.lag(border).over(over)).withColumn("joins_below", border == F.lead(border).over(over))


def page_numbers(rows: DataFrame, keys: list[str], order: list, ends: Column) -> DataFrame:
    """Adds ``section``, from 0, which ends with a row that ``ends`` it, and ``number``, which starts anew in each."""
    before = F.sum(ends.cast("long")).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    numbered = rows.withColumn("section", F.coalesce(before, F.lit(0)))
    return numbered.withColumn("number", F.row_number().over(W.partitionBy(*keys, "section").orderBy(*order)).cast("long"))
