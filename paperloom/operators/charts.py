"""Values of charts: tables, shares, ranges and axes; outcomes by category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def chart_table(cells: DataFrame, category: str, series: str, value: Column, names: list[str], limit: int = 50) -> DataFrame:
    """A chart's values as a table: the first ``limit`` categories in order, a column for each named series."""
    sums = cells.groupBy(category, series).agg(value.alias("_v"))
    first = cells.select(category).distinct().orderBy(category).limit(limit)
    return sums.join(first, category, "left_semi").groupBy(category).pivot(series, names).agg(F.max("_v"))


def percent_stack(rows: DataFrame, keys: list[str], value: str, digits: int = 9) -> DataFrame:
    """Adds ``share``: the value as a share of the absolute values of its stack; 0 where these add up to 0."""
    total = F.sum(F.abs(value)).over(W.partitionBy(*keys))
    return rows.withColumn("share", F.when(total == 0, F.lit(0.0)).otherwise(F.round(F.col(value) / total, digits)))


def axis_step(low: Column, high: Column, parts: int = 5) -> Column:
    """A step of 1, 2, 5 or 10 times a power of ten that cuts the range in about ``parts``."""
    raw = (high - low) / parts
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    return F.when(raw / power <= 1, 1).when(raw / power <= 2, 2).when(raw / power <= 5, 5).otherwise(10) * power


def axes(rows: DataFrame, keys: list[str], value: str, digits: int = 9) -> DataFrame:
    """The range of values of each chart, its step, and the number of the first tick."""
    spans = rows.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    step = axis_step(F.col("low"), F.col("high"))
    return spans.select(*keys, "low", "high", F.round(step, digits).alias("step"), F.floor(F.col("low") / step).cast("long").alias("first"))


def outcome_pivot(rows: DataFrame, keys: list[str], outcome: Column, names: list[str]) -> DataFrame:
    """How many rows of each key had each outcome."""
    return rows.groupBy(*keys).agg(*[F.count_if(outcome == name).alias(name) for name in names])


def tab_stops(rows: DataFrame, keys: list[str], stop: Column, cleared: Column) -> DataFrame:
    """The stops of each paragraph by position: repeated ones merge, cleared ones go; null where none is left."""
    stops = rows.groupBy(*keys).agg(F.array_sort(F.collect_set(F.when(~cleared, stop))).alias("stops"))
    return stops.withColumn("stops", F.when(F.size("stops") > 0, F.col("stops")))
