"""Multilevel list counters by conditional running sums.

Frames are stated as rows everywhere: the default range frame would count ties twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import list_label, number_label

_UP_TO = (W.unboundedPreceding, W.currentRow)


def list_counters(items: DataFrame, list_cols: list[str], order: list, level: str, levels: int = 3, start: Column | None = None) -> DataFrame:
    """Adds ``counter_0``.. : the counters after each item. A level's items count up; a shallower item resets
    all deeper ones. Of levels deeper than the item's own the counter is null; a shallower level that
    has not counted yet shows its start."""
    start = F.lit(1) if start is None else start
    # one order for all counters, which is sorted once: an item's number is the count so far without that at the last reset
    over = W.partitionBy(*list_cols).orderBy(*order).rowsBetween(*_UP_TO)
    ks = range(levels)
    out = items.withColumns({f"_seen_{k}": F.count(F.when(F.col(level) == k, True)).over(over) for k in ks})
    out = out.withColumns({f"_reset_{k}": F.max(F.when(F.col(level) < k, F.col(f"_seen_{k}"))).over(over) for k in ks})
    for k in ks:
        seen = F.col(f"_seen_{k}") - F.coalesce(f"_reset_{k}", F.lit(0))
        out = out.withColumn(f"counter_{k}", F.when(F.col(level) >= k, F.greatest(start + seen - 1, start)).cast("long"))
    return out.drop(*(f"_{c}_{k}" for k in ks for c in ("seen", "reset")))


def list_labels(items: DataFrame, level: str, formats: list[str], templates: list[str], levels: int = 3) -> DataFrame:
    """Adds ``label`` from the counters: each level's template filled with its formatted counters."""
    shown = [number_label(F.lit(formats[k]), F.col(f"counter_{k}")) for k in range(levels)]
    label = None
    for k in range(levels):
        text = list_label(F.lit(templates[k]), shown[: k + 1])
        label = F.when(F.col(level) == k, text) if label is None else label.when(F.col(level) == k, text)
    return items.withColumn("label", label)


def list_ordinals(items: DataFrame, list_cols: list[str], order: list, level: str, levels: int = 3) -> DataFrame:
    """Adds ``ordinal``: the item's own counter, from 1 on."""
    counted = list_counters(items, list_cols, order, level, levels)
    value = F.coalesce(*(F.when(F.col(level) == k, F.col(f"counter_{k}")) for k in range(levels)))
    return counted.withColumn("ordinal", value).drop(*(f"counter_{k}" for k in range(levels)))
