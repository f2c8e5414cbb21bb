"""Sharding by fixed virtual slots.

A record's virtual slot is a hash of its id modulo a fixed number of slots. Bytes and rows are
summed per slot, and a versioned map says which shard holds which slot. Rebalancing edits the map;
records never change slots. Everything that reaches the driver is one row per slot.

Defined cases: a null text has no bytes and crc32 0; a null ``doc_id`` hashes like any value; repeated
rows are separate records; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import materialize, new_path, path_exists

SLOTS = 8192
ROW_BYTES = 16


@dataclass(frozen=True)
class SlotMap:
    """A version of the slot-to-shard map: ``owner[slot]`` is a shard."""

    version: int
    shards: int
    owner: tuple[int, ...]
    moved: tuple[int, ...] = field(default=())

    def loads(self, weights: dict[int, int]) -> list[int]:
        out = [0] * self.shards
        for slot, shard in enumerate(self.owner):
            out[shard] += weights.get(slot, 0)
        return out


def first_map(weights: dict[int, int], shards: int, slots: int = SLOTS) -> SlotMap:
    """Slots by falling weight, each to the least loaded shard; ties go to the lower number."""
    heap = [(0, s) for s in range(shards)]
    owner = [0] * slots
    for slot in sorted(range(slots), key=lambda s: (-weights.get(s, 0), s)):
        load, shard = heapq.heappop(heap)
        owner[slot] = shard
        heapq.heappush(heap, (load + weights.get(slot, 0), shard))
    return SlotMap(1, shards, tuple(owner))


def rebalance(current: SlotMap, weights: dict[int, int], shards: int | None = None, tolerance: float = 0.01) -> SlotMap:
    """The next version: as few slots as needed move from the fullest to the emptiest shard.

    With more shards than before only the new ones receive slots until they reach the mean.
    """
    shards = shards or current.shards
    owner = list(current.owner)
    if shards < current.shards:
        raise ValueError("shards are only added here")
    loads = [0] * shards
    held: list[list[int]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(owner):
        loads[shard] += weights.get(slot, 0)
        held[shard].append(slot)
    mean, moved = sum(loads) / shards, []
    grown = shards > current.shards
    targets = range(current.shards, shards) if grown else range(shards)
    while True:
        low = min(targets, key=lambda s: (loads[s], s))
        high = max(range(current.shards if grown else shards), key=lambda s: (loads[s], -s))
        gap = min(mean - loads[low], loads[high] - mean) if grown else (loads[high] - loads[low]) / 2
        if gap <= tolerance * mean:
            break
        fits = [s for s in held[high] if 0 < weights.get(s, 0) <= gap * (1 if not grown else 1.5)]
        if not fits:
            break
        slot = max(fits, key=lambda s: (weights[s], -s))
        held[high].remove(slot)
        held[low].append(slot)
        loads[high] -= weights[slot]
        loads[low] += weights[slot]
        owner[slot] = low
        moved.append(slot)
    return SlotMap(current.version + 1, shards, tuple(owner), tuple(moved))


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.pmod(F.xxhash64(F.col("doc_id")), F.lit(slots)).cast("int").alias("vslot"),
    )


def slot_weights(recs: DataFrame) -> DataFrame:
    return recs.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n_rows"))


def save_map(spark, slot_map: SlotMap, path: str) -> None:
    """Add a version to the stored maps (one row a slot)."""
    map_frame(spark, slot_map).withColumn("version", F.lit(slot_map.version)).withColumn(
        "shards", F.lit(slot_map.shards)
    ).write.mode("append").parquet(path)


def load_map(spark, path: str, version: int | None = None) -> SlotMap:
    stored = spark.read.parquet(path)
    version = version or stored.agg(F.max("version")).first()[0]
    rows = stored.where(F.col("version") == version).orderBy("vslot").collect()
    return SlotMap(version, rows[0]["shards"], tuple(r["shard"] for r in rows))


def map_frame(spark, slot_map: SlotMap, base: dict[int, int] | None = None) -> DataFrame:
    schema = T.StructType([T.StructField("vslot", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("base", T.LongType())])
    rows = [(s, o, (base or {}).get(s, 0)) for s, o in enumerate(slot_map.owner)]
    return spark.createDataFrame(rows, schema)


def current_map(spark, path: str, weights: dict[int, int], shards: int, slots: int = SLOTS) -> SlotMap:
    """The map in force: the last stored version, edited and stored as the next one where shards were added
    or a shard is off the mean by more than a tenth; the first version where none is stored."""
    if not path_exists(spark, path):
        save_map(spark, first_map(weights, shards, slots), path)
        return load_map(spark, path)
    held = load_map(spark, path)
    loads = held.loads(weights)
    if shards != held.shards or max(loads) > 1.1 * sum(loads) / shards:
        save_map(spark, rebalance(held, weights, shards), path)
        held = load_map(spark, path)
    return held


def shard(docs: DataFrame, shards: int = 40, slots: int = SLOTS, maps: str | None = None) -> DataFrame:
    """Each record's shard under a byte-balanced slot map, and its gapless place in the shard.

    ``maps`` is the folder of the stored map's versions; without one, a new folder in the shared one is begun.

    The place is the sum of the rows of the shard's earlier slots plus the rank within the slot, so
    no window spans a whole shard.
    """
    spark = docs.sparkSession
    recs = materialize(records(docs, slots), "shard-records")
    sums = slot_weights(recs).collect()  # at most ``slots`` rows
    weights = {r["vslot"]: r["bytes"] for r in sums}
    counts = {r["vslot"]: r["n_rows"] for r in sums}
    slot_map = current_map(spark, maps or new_path(spark, "slot-maps"), weights, shards, slots)
    base, filled = {}, [0] * shards
    for slot, owner in enumerate(slot_map.owner):
        base[slot] = filled[owner]
        filled[owner] += counts.get(slot, 0)
    placed = recs.join(F.broadcast(map_frame(spark, slot_map, base)), "vslot")  # ``slots`` rows
    rank = F.row_number().over(W.partitionBy("vslot").orderBy("doc_id", "size", "text_crc32"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("base") + rank - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "vslot",
        F.lit(slot_map.version).alias("map_version"),
    )
