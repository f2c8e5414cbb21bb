"""A content-addressed store of token ids.

A rolling hash over the ids cuts each document's stream into chunks, so equal passages give equal
chunks wherever they stand. A chunk is addressed by the BLAKE2b hash of its ids and stored once. A
document is a recipe: the addresses of its chunks and the root of a Merkle tree over them. A manifest
holds, for each part of the recipes (ascending ids), the number of documents and ids and the root over
the document roots. Three Parquet tables under one path: ``chunks``, ``recipes``, ``manifest``.

Readers check every chunk against its address, every document against its root and every part against
the manifest, and raise on a mismatch.

Defined cases: a null text is empty: its stream is the end id alone; rows with an equal ``doc_id``
follow each other, ordered by root; null ids come first; an empty table gives an empty store; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, new_path, read_text
from .flat import U64, flat, kept, mix, parts, tidy
from .tokens import BpeEncoder

END_ID = 2
WINDOW, MEAN, LEAST, MOST = 8, 512, 128, 4096
ADDRESS = 16
_BASE = 0x9E3779B97F4A7C15


def address(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=ADDRESS).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """The root of a binary tree; an odd node moves up unchanged. Leaves and nodes hash differently."""
    level = [hashlib.blake2b(b"\0" + x, digest_size=ADDRESS).digest() for x in leaves] or [address(b"")]
    while len(level) > 1:
        pairs = [hashlib.blake2b(b"\1" + a + b, digest_size=ADDRESS).digest() for a, b in zip(level[::2], level[1::2], strict=False)]
        level = pairs + level[len(level) & ~1 :]
    return level[0]


def boundaries(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ascending ends of chunks over concatenated streams; every stream's end is one.

    The hash at a place covers the last ``WINDOW`` ids of the stream. Chunks have at least ``LEAST`` ids
    (but for a stream's last) and at most ``MOST``.
    """
    n = len(ids)
    if not n:
        return np.zeros(0, np.int64)
    value = mix(ids.astype(np.uint64) + U64(0x1234567))
    h = value.copy()
    factor = U64(1)
    with np.errstate(over="ignore"):
        for k in range(1, min(WINDOW, n)):
            factor = U64((int(factor) * _BASE) & (2**64 - 1))
            h[k:] += value[:-k] * factor
    marks = np.flatnonzero(mix(h) >> U64(55) == 0) + 1  # one in MEAN places
    begin = offsets[np.searchsorted(offsets, marks - 1, side="right") - 1]
    marks = marks[marks - begin >= WINDOW]  # windows that stay in the stream
    out, at, last, k = [], marks.tolist(), 0, 0
    for end in offsets[1:].tolist():
        while k < len(at) and at[k] <= end:
            while at[k] - last > MOST:
                last += MOST
                out.append(last)
            if at[k] - last >= LEAST:
                last = at[k]
                out.append(last)
            k += 1
        while end - last > MOST:
            last += MOST
            out.append(last)
        if end > last:
            out.append(end)
            last = end
    return np.array(out, np.int64)


def _cut(path: str, end_id: int, seen_limit: int = 200_000):
    """Documents -> a recipe row each, and a chunk row for each address that is new to the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = kept(("bpe", path), lambda: BpeEncoder(path))
        seen: set[bytes] = set()
        for batch in batches:
            buf, offs = flat(batch.column(1))
            for a, b in parts(offs):
                ids, sizes = enc.encode(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                ends = np.cumsum(sizes)
                streams = np.insert(ids, ends, end_id)
                offsets = np.concatenate(([0], ends + np.arange(1, len(ends) + 1)))
                wide = "<u2" if len(streams) and streams.max() < 1 << 16 else "<u4"
                data = memoryview(streams.astype(wide).tobytes())
                width = 2 if wide == "<u2" else 4
                cuts = boundaries(streams, offsets)
                of = np.searchsorted(offsets, cuts - 1, side="right") - 1
                first = np.searchsorted(of, np.arange(b - a + 1))
                names, rows, cut = [], [], cuts.tolist()
                last = 0
                for end in cut:
                    # the width is part of the content, so that a chunk's bytes say what they hold
                    chunk = bytes([width]) + data[last * width : end * width]
                    name = address(chunk)
                    names.append(name)
                    if name not in seen:
                        seen.add(name)
                        rows.append((name, chunk))
                    last = end
                if len(seen) > seen_limit:
                    seen.clear()
                recipe = [b"".join(names[i:j]) for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                roots = [merkle(names[i:j]) for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                k, m = b - a, len(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(["recipe"] * k + ["chunk"] * m),
                        pa.concat_arrays([batch.column(0)[a:b], pa.nulls(m, batch.column(0).type)]),
                        pa.array([*roots, *(r[0] for r in rows)], pa.binary()),
                        pa.array([*recipe, *(r[1] for r in rows)], pa.binary()),
                        pa.array([*(sizes + 1).tolist(), *[0] * m], pa.int64()),
                    ],
                    ["kind", "doc_id", "name", "body", "n_tokens"],
                )

    return run


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by kind and name: drops a chunk whose name is that of the row before."""
    last = np.zeros(ADDRESS, np.uint8)
    for batch in batches:
        if not len(batch):
            continue
        buf, _ = flat(batch.column(2))
        names = buf.reshape(-1, ADDRESS)
        same = (names == np.concatenate([last[None], names[:-1]])).all(axis=1)
        keep = ~(same & np.asarray(pc.equal(batch.column(0), "chunk")))
        last = names[-1].copy()
        yield batch.filter(pa.array(keep))


def write(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = END_ID) -> str:
    """Encode and store the documents; returns the store's path."""
    spark = docs.sparkSession
    path = path or new_path(spark, "token-store")
    texts = read_text(docs)
    kind = texts.schema["doc_id"].dataType.simpleString()
    schema = f"kind string, doc_id {kind}, name binary, body binary, n_tokens long"
    rows = texts.mapInArrow(tidy(_cut(tokenizer, end_id)), schema)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a recipe's name is no address: spread it by its document
    dealt = rows.repartition(n, F.when(F.col("kind") == "chunk", F.xxhash64("name")).otherwise(F.xxhash64("doc_id", "name")))
    unique = dealt.sortWithinPartitions("kind", "name").mapInArrow(_first_of_each, schema)
    unique.write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/rows")
    stored = spark.read.schema(schema).parquet(f"{path}/rows")
    recipes = stored.where("kind = 'recipe'").select("doc_id", F.col("name").alias("root"), F.col("body").alias("chunks"), "n_tokens")
    ordered = recipes.repartitionByRange(max(1, n // 2), "doc_id", "root").sortWithinPartitions("doc_id", "root")
    ordered.withColumn("part", F.spark_partition_id()).write.parquet(f"{path}/recipes")
    read_recipes(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_docs")).write.parquet(f"{path}/sums")
    read_recipes(spark, path).select("part", "doc_id", "root").repartition(n, "part").sortWithinPartitions("part", "doc_id", "root").mapInArrow(
        _part_roots, "part int, root binary"
    ).join(spark.read.parquet(f"{path}/sums"), "part").write.parquet(f"{path}/manifest")
    return path


def _part_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part: the chained hash of a part's document roots, in constant memory."""
    now, state = None, None
    for batch in batches:
        for part, root in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if part != now:
                if state is not None:
                    yield pa.RecordBatch.from_pydict({"part": pa.array([now], pa.int32()), "root": pa.array([state.digest()], pa.binary())})
                now, state = part, hashlib.blake2b(digest_size=ADDRESS)
            state.update(root)
    if state is not None:
        yield pa.RecordBatch.from_pydict({"part": pa.array([now], pa.int32()), "root": pa.array([state.digest()], pa.binary())})


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/recipes")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    stored = spark.read.schema("kind string, name binary, body binary").parquet(f"{path}/rows")
    return stored.where("kind = 'chunk'").select("name", F.col("body").alias("chunk"))


# CRC-32 of a concatenation from the parts' CRCs: polynomials over GF(2) modulo the CRC's, as arrays.

_POLY = np.uint32(0xEDB88320)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros_like(a)
    b = b.copy()
    for bit in range(31, -1, -1):
        out ^= np.where(a >> np.uint32(bit) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), _POLY, np.uint32(0))
    return out


def _shifts(n_bytes: np.ndarray) -> np.ndarray:
    """x to the power 8n for each n."""
    out = np.full(len(n_bytes), 0x80000000, np.uint32)
    square = np.full(1, 1 << 23, np.uint32)  # x^8
    n = n_bytes.astype(np.int64).copy()
    while n.any():
        odd = np.flatnonzero(n & 1)
        out[odd] = _times(out[odd], np.repeat(square, len(odd)))
        square = _times(square, square)
        n >>= 1
    return out


def crc_of_parts(crcs: np.ndarray, n_bytes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The CRC of each document from its chunks' CRCs: all chunks shifted by what follows, then xored."""
    ends = np.cumsum(n_bytes)
    last = np.concatenate(([0], ends))[offsets[1:]]
    sizes = np.diff(offsets)
    follow = np.repeat(last, sizes) - ends
    shifted = _times(crcs.astype(np.uint32), _shifts(follow))
    out = np.zeros(len(sizes), np.uint32)
    some = np.flatnonzero(sizes)
    if len(some):
        out[some] = np.bitwise_xor.reduceat(shifted, offsets[:-1][some])
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk, checked against its address: how many ids, and their CRC as 32-bit integers."""
    for batch in batches:
        names, counts, crcs = batch.column(0).to_pylist(), [], []
        for name, chunk in zip(names, batch.column(1).to_pylist(), strict=True):
            if address(chunk) != name:
                raise ValueError(f"chunk {name.hex()} is damaged")
            ids = decode_chunk(chunk)
            counts.append(len(ids))
            crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())], ["name", "n", "crc"])


def decode_chunk(chunk: bytes) -> np.ndarray:
    return np.frombuffer(chunk, "<u2" if chunk[0] == 2 else "<u4", offset=1)


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(root, n_tokens, list of (pos, name, n, crc) in order) -> (root, crc), checked."""
    for batch in batches:
        lists = batch.column(2)
        flat_rows = lists.flatten()
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        names = flat_rows.field("name").to_pylist()
        n = flat_rows.field("n").to_numpy(zero_copy_only=False).astype(np.int64)
        crcs = flat_rows.field("crc").to_numpy(zero_copy_only=False).astype(np.uint32)
        sums = np.concatenate(([0], np.cumsum(n)))
        found = sums[offsets[1:]] - sums[offsets[:-1]]
        if not np.array_equal(found, batch.column(1).to_numpy()):
            raise ValueError("a document's chunks don't hold all of its ids")
        for i, root in enumerate(batch.column(0).to_pylist()):
            if merkle(names[offsets[i] : offsets[i + 1]]) != root:
                raise ValueError("a document's chunks don't give its root")
        crc = crc_of_parts(crcs, 4 * n, offsets).astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crc)], ["root", "ids_crc32"])


def with_starts(spark: SparkSession, path: str) -> DataFrame:
    """The recipes with ``start``: the ids of all documents before. One number a part reaches the driver."""
    sums, starts, total = sorted((r["part"], r["n_tokens"]) for r in spark.read.parquet(f"{path}/sums").collect()), [], 0
    for part, n in sums:
        starts.append((part, total))
        total += n
    bases = spark.createDataFrame(starts, "part int, base long")

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = None, 0
        for batch in batches:
            part, n = batch.column(0).to_numpy(), batch.column(4).to_numpy()
            out = np.empty(len(n), np.int64)
            cut = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)])) if len(part) else np.zeros(1, np.int64)
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if part[a] != now:
                    now, at = part[a], 0
                ends = np.cumsum(n[a:b])
                out[a:b] = at + ends - n[a:b]
                at += int(ends[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "before"])

    recipes = read_recipes(spark, path).select("part", "doc_id", "root", "chunks", "n_tokens")
    placed = recipes.repartition("part").sortWithinPartitions("part", "doc_id", "root")
    kind = recipes.schema["doc_id"].dataType.simpleString()
    placed = placed.mapInArrow(running, f"part int, doc_id {kind}, root binary, chunks binary, n_tokens long, before long")
    return placed.join(F.broadcast(bases), "part").withColumn("start", F.col("base") + F.col("before"))  # a row a part


HOT = 100_000


def _on_hot_key(left: DataFrame, right: DataFrame, key: str, uses: DataFrame, n: int) -> DataFrame:
    """A left join with a right side of unique keys. Keys with more than HOT and a thousandth of the ``n``
    rows of ``uses`` (key, count) are fewer than 1,000: their rows are joined by a broadcast and stay where they are."""
    hot = materialize(uses.where(F.col("count") > max(HOT, n // 1000)).select(key), "token-hot") if n > HOT else None
    if hot is None or hot.isEmpty():
        return left.join(right, key, "left")
    few = F.broadcast(right.join(F.broadcast(hot), key, "left_semi"))
    apart = left.join(F.broadcast(hot), key, "left_semi").join(few, key, "left")
    return apart.unionByName(left.join(F.broadcast(hot), key, "left_anti").join(right, key, "left"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Read the store back: place, number and CRC of every document's ids.

    Equal documents have one root, so their chunks are read and checked once; a root or chunk that a large
    part of all documents use is joined by a broadcast."""
    chunks = read_chunks(spark, path).mapInArrow(_measure, "name binary, n long, crc long")
    recipes = materialize(with_starts(spark, path), "token-recipes")
    roots = materialize(recipes.groupBy("root").agg(F.first("chunks").alias("chunks"), F.first("n_tokens").alias("n_tokens"), F.count("*").alias("count")), "token-roots")
    steps = F.sequence(F.lit(0), (F.length("chunks") / ADDRESS).cast("int") - 1)
    uses = roots.select("root", "n_tokens", F.posexplode(F.transform(steps, lambda i: F.substring(F.col("chunks"), i * ADDRESS + 1, F.lit(ADDRESS)))).alias("pos", "name"))
    sizes = roots.agg(F.sum("count"), F.sum(F.length("chunks") / ADDRESS)).first()
    counts = uses.groupBy("name").count()
    found = _on_hot_key(uses, chunks, "name", counts, int(sizes[1] or 0))
    use = F.struct("pos", "name", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("crc", F.lit(0)).alias("crc"))
    found = found.groupBy("root").agg(F.first("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(use)).alias("uses"))
    crcs = found.select("root", "n_tokens", "uses").mapInArrow(_assemble, "root binary, ids_crc32 long")
    rows = recipes.select("doc_id", "start", "n_tokens", "root")
    out = _on_hot_key(rows, crcs, "root", roots.select("root", "count"), int(sizes[0] or 0))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids): the id streams themselves, from the store alone."""
    recipes = with_starts(spark, path)
    steps = F.sequence(F.lit(0), (F.length("chunks") / ADDRESS).cast("int") - 1)
    uses = recipes.select("doc_id", "start", F.posexplode(F.transform(steps, lambda i: F.substring(F.col("chunks"), i * ADDRESS + 1, F.lit(ADDRESS)))).alias("pos", "name"))
    found = uses.join(read_chunks(spark, path), "name").groupBy("start").agg(
        F.first("doc_id").alias("doc_id"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "chunk"))), lambda x: x["chunk"]).alias("chunks")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.concatenate([decode_chunk(c).astype(np.int64) for c in cs]) for cs in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "start", "ids"])

    kind = recipes.schema["doc_id"].dataType.simpleString()
    return found.select("doc_id", "start", "chunks").mapInArrow(run, f"doc_id {kind}, start long, ids array<long>")


def verify(spark: SparkSession, path: str) -> None:
    """Check the manifest against the recipes; raises on a difference."""
    found = read_recipes(spark, path).select("part", "doc_id", "root").repartition("part").sortWithinPartitions("part", "doc_id", "root")
    roots = found.mapInArrow(_part_roots, "part int, root binary").withColumnRenamed("root", "found")
    bad = spark.read.parquet(f"{path}/manifest").join(roots, "part", "full").where("found is null or root is null or found <> root")
    if not bad.isEmpty():
        raise ValueError("the recipes don't fit the manifest")
