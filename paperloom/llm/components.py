"""Connected components of an edge table.

Every task first replaces its edges by stars of its own components, without a shuffle. If what is left
is at most ``ONE_TASK`` edges, one task finishes. Else alternating large-star and small-star steps do:
each is one grouped minimum (combined before the shuffle) and one equi-join back. Nodes with more edges
than ``HUB`` and than a thousandth of all edges, of which there can be fewer than 4,000, get their minimum
by a broadcast, so their edges stay where they are. Lineage is cut by written tables; a table is removed
once the next one is written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .flat import tidy

ONE_TASK = 1_000_000
_PART = 500_000
HUB = 100_000


def roots(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest node reachable from each of the nodes 0..n-1, by hooking and pointer jumping."""
    parent = np.arange(n)
    while len(u):
        pu, pv = parent[u], parent[v]
        on = pu != pv
        u, v, pu, pv = u[on], v[on], pu[on], pv[on]
        np.minimum.at(parent, np.maximum(pu, pv), np.minimum(pu, pv))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return parent


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v) -> (node, root of the task's edges) for nodes that aren't roots; a bounded part at a time."""

    def solve(tables: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(tables).combine_chunks()
        both = pa.concat_arrays([t.column(0).combine_chunks(), t.column(1).combine_chunks()])
        nodes = pc.unique(both)
        nodes = nodes.take(pc.array_sort_indices(nodes))
        at = pc.index_in(both, nodes).to_numpy().astype(np.int64)
        root = roots(at[: len(t)], at[len(t) :], len(nodes))
        low = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([nodes.take(pa.array(low)), nodes.take(pa.array(root[low]))], ["u", "v"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n > ONE_TASK:
            held = [solve(held)]
            n = len(held[0])
            if n >= _PART:  # mostly stars already
                yield held[0]
                held, n = [], 0
    if n:
        yield solve(held)


def _star(edges: DataFrame, large: bool, n: int, scratch: Scratch) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if large:
        near, emit = both, F.col("v") > F.col("u")
    else:
        near, emit = both.where("v < u"), F.lit(True)
    low = scratch.write(near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "cc-low")
    # the degrees add up to at most 2 * n, so fewer than 2,000 nodes pass, and twice that where n has shrunk
    hubs = low.where(F.col("n") > max(HUB, n // 1000)).select("u", "m")
    rest = near.join(F.broadcast(hubs.select("u")), "u", "left_anti").join(low.select("u", "m"), "u")
    out = near.join(F.broadcast(hubs), "u").unionByName(rest).where(emit).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.unionByName(low.select("u", F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(edges: DataFrame, rounds: int = 60, scratch: Scratch | None = None) -> DataFrame:
    """(u, v) edges of any orderable type -> (node, label): the smallest node that is reachable.

    Null ends and loops are dropped; nodes without an edge are not returned. An empty table gives an
    empty one. Raises if ``rounds`` do not suffice (they grow with the logarithm of the diameter).
    """
    scratch = scratch or Scratch(edges.sparkSession)
    pairs = edges.where("u is not null and v is not null and u <> v").select("u", "v")
    schema = pairs.schema
    held = "cc-edges"
    pairs = scratch.write(pairs.mapInArrow(tidy(_stars), schema).distinct(), held)
    n = pairs.count()
    if 0 < n <= ONE_TASK:
        pairs = scratch.write(pairs.repartition(1).mapInArrow(tidy(_stars_once), schema), "cc-stars")
        scratch.drop(held)
        n = 0
    seen = None
    for k in range(rounds):
        # a forest of stars is stable: every node has one parent and no parent has one
        state = None if n == 0 else pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if n == 0 or state == seen:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
                pairs.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
            )
        seen = state
        middle = scratch.write(_star(pairs, True, state[0], scratch), "cc-large")
        pairs = scratch.write(_star(middle, False, state[0], scratch), f"cc-{k}")
        scratch.drop(held, "cc-large", "cc-low")
        held = f"cc-{k}"
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _stars_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """At most ``ONE_TASK`` edges, all together."""
    held = list(batches)
    if held:
        yield from _stars(iter([pa.Table.from_batches(held).combine_chunks().to_batches()[0]])) if sum(map(len, held)) else []
