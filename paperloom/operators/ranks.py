"""Ranks and running sums over all rows, or over few large groups, without a window that holds a group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import new_path, written


def running_before(rows: DataFrame, keys: list[str], order: list[str], amount: Column, name: str = "before") -> DataFrame:
    """Adds the sum of ``amount`` over the rows before, in the order within the keys; ties need a total order.

    The rows are dealt by ranges of keys and order and written once, so that counts and rows see the same
    partitions. A partition's offset is the sum of the partitions before: a row a partition and key.
    """
    spark = rows.sparkSession
    placed = rows.withColumn("_amount", amount).repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    placed = written(placed, new_path(spark, "running"))
    sums = placed.groupBy("_part", *keys).agg(F.sum("_amount").alias("_sum"))
    earlier = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    base = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
    base = base.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(["_part", *keys])], "_base")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(["_part", *keys])])
    inside = W.partitionBy("_part", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    own = placed.withColumn("_own", F.coalesce(F.sum("_amount").over(inside), F.lit(0)))
    return own.join(base, same).withColumn(name, F.col("_base") + F.col("_own")).select(*rows.columns, name)


def evenly_spaced(rows: DataFrame, order: str, size: int) -> DataFrame:
    """``size`` rows at even distances in the order, with their ranks ``i``; all rows where there are fewer."""
    ranked = running_before(rows, [], [order], F.lit(1).cast("long"), "i")
    total = ranked.count()
    return ranked.where(F.col("i").isin(sorted({k * total // size for k in range(size)})))


def order_statistics(rows: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Mean, median (of an even number the middle of two), least, greatest and discrete quantiles for each key.

    Values are counted first, and ranked by ranges: a group may hold any share of all rows.
    """
    known = rows.where(F.col(value).isNotNull())
    counted = known.groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    ranked = running_before(counted, keys, ["_v"], F.col("_n"), "_before")
    total = known.groupBy(*keys).agg(F.count("*").alias("_total"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
    both = ranked.join(F.broadcast(total), keys) if not keys else ranked.join(total, keys)

    def at(place: Column) -> Column:
        """The value at a place from 0."""
        return F.max(F.when((F.col("_before") <= place) & (place < F.col("_before") + F.col("_n")), F.col("_v")))

    middle = (at(F.floor((F.col("_total") - 1) / 2)) + at(F.floor(F.col("_total") / 2))) / 2
    each = [at(F.greatest(F.ceil(F.col("_total") * q) - 1, F.lit(0))).alias(name) for name, q in quantiles.items()]
    return both.groupBy(*keys, "mean", "low", "high").agg(middle.alias("median"), *each)
