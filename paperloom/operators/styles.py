"""Style inheritance: chains of parents, and properties resolved along them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEPTH = 32


def style_chains(styles: DataFrame, keys: list[str], style: str = "style_id", parent: str = "based_on", depth: int = DEPTH) -> DataFrame:
    """(keys, style, ancestor, depth): each style with itself (0) and its parents, up to ``depth`` of them;
    a style met again ends its chain. Parents are found by pointer doubling on the adjacency list:
    six joins, however long the chains are."""
    edges = styles.select(*keys, F.col(style).alias("style"), F.col(parent).alias("up"))
    paths = edges.select(*keys, "style", F.array("style").alias("path"), "up")
    length = 1
    while length < depth:
        right = paths.select(*keys, F.col("style").alias("up"), F.col("path").alias("more"), F.col("up").alias("next"))
        paths = paths.join(right, [*keys, "up"], "left").select(
            *keys, "style", F.when(F.col("more").isNull(), F.col("path")).otherwise(F.concat("path", "more")).alias("path"), F.col("next").alias("up")
        )
        length *= 2
    # a repeated id ends the chain: the path up to its first repetition
    whole = paths.select(*keys, "style", F.posexplode("path").alias("depth", "ancestor"), F.col("path").alias("path"))
    return whole.where((F.col("depth") < depth) & (F.array_position("path", F.col("ancestor")) == F.col("depth") + 1)).drop("path")


def resolve(chains: DataFrame, styles: DataFrame, keys: list[str], plain: list[str], toggles: list[str], style: str = "style_id") -> DataFrame:
    """Along each chain: of plain properties the nearest that is set; of switches the exclusive or of all set."""
    props = styles.select(*keys, F.col(style).alias("ancestor"), *plain, *toggles)
    rows = chains.join(props, [*keys, "ancestor"])
    nearest = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("depth"))).alias(c) for c in plain]
    flipped = [F.when(F.count(c) > 0, F.sum(F.col(c).cast("long")) % 2 == 1).alias(c) for c in toggles]
    return rows.groupBy(*keys, "style").agg(*nearest, *flipped)
