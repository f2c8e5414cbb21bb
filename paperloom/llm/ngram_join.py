"""N-gram Jaccard join: documents whose sets of word shingles overlap by a ratio or more.

Documents with equal sets are one class. Candidates come from prefixes, twice. First each class deals its
lowest shingles in a fixed order (``ext_size``; shingles that counts show to be frequent last) into buckets,
where their exact number of classes is counted. Linked classes share at least ``need`` of these, so a
class with fewer shared ones leaves, and of the others the ``need`` - 1 most common ones are left out.
What is left meets in runs: lists of the classes that hold a shingle, in order of size, cut where the next
is too large for the ratio (size bands). The orders only save work; no pair that reaches the ratio is lost.

Runs are gathered under their smallest class, cut into tiles of bounded rows and shingles, and each class's
text travels once to each of its tiles. There hashed bitmaps bound the overlap from above (bits that
differ are in no overlap), and what passes is intersected exactly, as sorted arrays. Pairs of a known
component are skipped, and a tile gives only links that connect, so what leaves is linear in its rows.
Groups larger than a tile take two rounds: neighbouring parts first; then, between parts, only what lies in
different components. How a group's parts are paired is planned in one task from its classes' names, sizes and
components, some 40 bytes each: at most 2 * RUN classes for each chosen shingle of its smallest class.

``links`` skips nothing: it gives every link between different texts, and ``link_counts`` their number
for each document; both grow with the square of a group of near copies.

Defined cases: a null text or one without words has an empty set and links with nothing; fewer words
than a shingle's are one shingle; repeated rows and equal texts are one class; an empty table gives an
empty result; other columns are ignored by ``join``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, read_text
from .components import connected_components
from .flat import U64, flat, mix, parts, tidy
from .shingles import SIZE, bitmaps, set_id, sets

#: The ratio as a fraction: 3/4.
UP, DOWN = 3, 4
#: A prefix holds this share of a set beyond the least one, so linked classes share that much of it.
EXTRA = 8
SLOT_BITS, RUN, PER_BUCKET = 22, 1 << 17, 200_000
#: Rows and shingles of a part of a group; a group is cut in at most PARTS until a part has MOST rows.
LEAST, PARTS, MOST, SHINGLES = 128, 32, 2048, 2_000_000
#: Classes of the part before that a part sees again, and pairs that are intersected at a time.
AGAIN, STEP, BLOCK = 16, 64, 128
#: Rows of (tile, class, key) that are broadcast at most: 32 bytes each.
SMALL = 300_000
#: Bits of a filter for each key, and at most.
BLOOM_EACH, BLOOM_MOST = 16, 1 << 28
_CROWDED = 1 << 15


def least_overlap(a, b):
    """The smallest overlap with which sets of these sizes reach the ratio: overlap / (a + b - overlap)."""
    return -(-UP * (a + b) // (UP + DOWN))


def prefix_size(n):
    """Linked sets share one of so many first shingles in any order."""
    return n + (-UP * n // DOWN) + 1


def shared_size(n):
    """How many of the first ``ext_size`` shingles a set shares with a linked one of its own size or more."""
    return np.minimum(n // EXTRA, n - prefix_size(n)) + 1


def ext_size(n):
    return prefix_size(n) + shared_size(n) - 1


def need(n):
    """How many it shares with any linked set: the smallest has 3/4 of its size."""
    return shared_size(-(-UP * n // DOWN))


# First pass: classes, and shingles that stand out -------------------------------------------

_SCAN = "kind string, doc_id {id}, key long, n long, class binary, short long, slot int, hits long"


def short_of(c: bytes) -> int:
    """The first 64 bits of a class."""
    return int.from_bytes(c[:8], "little", signed=True)


def _scan(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total, id_type = None, 0, None
        seen: set[bytes] = set()
        names = ["kind", "doc_id", "key", "n", "class", "short", "slot", "hits"]
        for batch in batches:
            id_type = batch.column(0).type
            buf, offs = flat(batch.column(1))
            for a, b in parts(offs):
                found = sets(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], size)
                ids = [set_id(h) if len(h) else None for h in found]
                fresh = []
                for h, c in zip(found, ids, strict=True):
                    if c is not None and c not in seen:
                        seen.add(c)
                        fresh.append(h)
                if len(seen) > 200_000:
                    seen.clear()
                if fresh:
                    counts = np.zeros(1 << SLOT_BITS, np.int32) if counts is None else counts
                    slots = (np.concatenate(fresh) & U64((1 << SLOT_BITS) - 1)).astype(np.int64)
                    at, hits = np.unique(slots, return_counts=True)
                    counts[at] += hits.astype(np.int32)
                    total += len(slots)
                k = b - a
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(["doc"] * k), batch.column(0)[a:b], batch.column(2)[a:b], pa.array([len(h) for h in found], pa.int64()),
                        pa.array(ids, pa.binary()), pa.array([c and short_of(c) for c in ids], pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()),
                    ],
                    names,
                )
        if counts is not None:
            high = np.flatnonzero(counts >= max(6, 6 * total / len(counts)))
            k = len(high)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(["slot"] * k, pa.string()), pa.nulls(k, id_type), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int64()),
                    pa.array(high, pa.int32()), pa.array(counts[high], pa.int64()),
                ],
                names,
            )

    return run


def frequent(scan: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Slots with high counts, summed; at most 2**SLOT_BITS numbers arrive, in practice a few thousand."""
    got = scan.where("kind = 'slot'").groupBy("slot").agg(F.sum("hits").alias("hits")).toArrow()
    return got["slot"].to_numpy().astype(np.int64), got["hits"].to_numpy().astype(np.int64)


# Packed rows, dealt into buckets ------------------------------------------------------------


def _pack(bucket: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    """Rows of a record type, as one value for each bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket, rows = bucket[order], rows[order]
    cut = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)])) if len(bucket) else np.zeros(1, np.int64)
    data, width = rows.tobytes(), rows.dtype.itemsize
    values = [data[width * x : width * y] for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[cut[:-1]].astype(np.int32)), pa.array(values, pa.binary())], ["bucket", "rows"])


def _unpack(table: pa.Table, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(table["rows"].to_pylist()), kind)


def _stage(read: np.dtype, buckets: int, work):
    """A function over all packed rows of a bucket; ``work`` gives (buckets, rows) for the next stage."""

    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_pack(*work(_unpack(table, read), buckets))])

    return run


#: ``q`` is 1000 * log2 of a set's size, _CROWDED added for a shingle that is dealt in tiles; ``short`` are the
#: first 64 bits of a class. Classes that share them are handled together until their texts are at hand.
FIRST = np.dtype([("key", "<u4"), ("q", "<u2"), ("short", "<i8")])
SHARED = np.dtype([("short", "<i8"), ("q", "<u2"), ("token", "<u8"), ("df", "<u2")])
CHOSEN = np.dtype([("token", "<u8"), ("q", "<u2"), ("short", "<i8")])
MEMBER = np.dtype([("anchor", "<i8"), ("q", "<u2"), ("short", "<i8")])
PACKED = "bucket int, rows binary"


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where rows differ from those before them, the first row included."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _first(size: int, buckets: int, table, run_cap: int):
    """Texts -> FIRST rows: each new class's first shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, hits = table.value
        rank = np.zeros(1 << SLOT_BITS, np.uint8)
        rank[slots] = np.frexp(hits.astype(float))[1]
        crowded = {int(s): 1 << (int(h) // run_cap).bit_length() for s, h in zip(slots, hits, strict=True) if h > run_cap}
        seen: set[bytes] = set()
        keys, owners = [], []
        held = 0

        def flush():
            key = np.concatenate(keys)
            rows = np.empty(len(key), FIRST)
            rows["key"] = key >> U64(32)
            sizes = [len(k) for k in keys]
            rows["q"] = np.repeat(np.array([o[1] for o in owners], np.uint16), sizes)
            rows["short"] = np.repeat(np.array([o[0] for o in owners], np.int64), sizes)
            keys.clear(), owners.clear()
            return _pack((key & U64(0xFFFFFFFF)) % U64(buckets), rows)

        for batch in batches:
            buf, offs = flat(batch.column(0))
            for a, b in parts(offs):
                for h in sets(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], size):
                    n = len(h)
                    c = set_id(h)
                    if not n or c in seen:
                        continue
                    seen.add(c)
                    short, q, p = short_of(c), round(1000 * np.log2(n)), int(ext_size(n))
                    slot = (h & U64((1 << SLOT_BITS) - 1)).astype(np.int64)
                    r = rank[slot]
                    if r.any():
                        pick = np.argsort(r, kind="stable")[:p]
                        own, slot = h[pick], slot[pick]
                        many = [i for i, s in enumerate(slot.tolist()) if s in crowded] if crowded else []
                        if many:
                            keys.append(np.concatenate([_tiled_key(int(own[i]), short, crowded[int(slot[i])]) for i in many]))
                            owners.append((short, q | _CROWDED))
                            held += len(keys[-1])
                            own = np.delete(own, many)
                    else:
                        own = h[:p]
                    keys.append(own)
                    owners.append((short, q))
                    held += len(own)
                if len(seen) > 200_000:
                    seen.clear()
                if held > 500_000:
                    yield flush()
                    held = 0
        if held:
            yield flush()

    return run


def _tiled_key(key: int, short: int, cuts: int) -> np.ndarray:
    """A crowded shingle as the keys of the tiles that the class is in: its part with each part."""
    own, other = short % cuts, np.arange(cuts, dtype=np.uint64)
    low, high = np.minimum(other, U64(own)), np.maximum(other, U64(own))
    return mix(U64(key) + low * U64(0x9E3779B97F4A7C15) + high * U64(0xC2B2AE3D27D4EB4F) + U64(1))


def _shared(bucket: int, rows: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """All FIRST rows of a bucket -> SHARED rows, of the shingles that two classes or more hold."""
    rows = rows[np.argsort(rows["key"], kind="stable")]
    # keys of one row are most of them
    new = _changes(rows["key"])
    rows = rows[~(new & np.append(new[1:], True))]
    rows = rows[np.lexsort((rows["q"], rows["short"], rows["key"]))]
    rows = rows[_changes(rows["key"], rows["short"], rows["q"])]  # the same class from several tasks
    begin = np.flatnonzero(_changes(rows["key"]))
    df = np.diff(np.append(begin, len(rows)))
    df = np.repeat(df, df)
    rows, df = rows[df > 1], df[df > 1]
    out = np.empty(len(rows), SHARED)
    out["short"], out["q"], out["df"] = rows["short"], rows["q"], np.minimum(df, 65535)
    out["token"] = rows["key"].astype(np.uint64) << U64(32) | U64(bucket)
    return mix(out["short"].view(np.uint64)) % U64(buckets), out


def _chosen(rows: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """All SHARED rows of classes -> CHOSEN rows: all but the most common shingles, of classes that share enough."""
    plain = rows["q"] & U64(_CROWDED - 1)
    crowd = rows["q"] >= _CROWDED
    order = np.lexsort((rows["token"], rows["df"], crowd, plain, rows["short"]))
    rows, plain, crowd = rows[order], plain[order], crowd[order]
    new = _changes(rows["short"], plain)
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(rows)))
    # the size rounded down: needs less, so keeps more
    n = np.floor(2.0 ** ((plain[begin].astype(float) - 0.51) / 1000)).astype(np.int64)
    keep = count - need(np.maximum(n, 1)) + 1
    uncrowded = np.add.reduceat(~crowd, begin) if len(begin) else begin
    # of crowded shingles all tiles or none
    keep = np.where(keep > uncrowded, count, keep)
    place = np.arange(len(rows)) - np.repeat(begin, count)
    some = place < np.repeat(keep, count)
    out = np.empty(int(some.sum()), CHOSEN)
    out["token"], out["q"], out["short"] = rows["token"][some], plain[some], rows["short"][some]
    return mix(out["token"]) % U64(buckets), out


def _members(rows: np.ndarray) -> np.ndarray:
    """Distinct MEMBER rows in order of anchor, size and class."""
    rows = rows[np.lexsort((rows["short"], rows["q"], rows["anchor"]))]
    return rows[_changes(rows["anchor"], rows["q"], rows["short"])]


def _residues(short: np.ndarray) -> tuple[int, int]:
    """The two residues that classes have by the largest power of two with which there are no more."""
    found = np.zeros(1, np.int64)
    for bits in range(1, 21):
        more = np.unique(short & ((1 << bits) - 1))
        if len(more) > 2:
            break
        found = more
    return int(found[0]), int(found[-1])


def _runs(rows: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """All CHOSEN rows of shingles -> MEMBER rows: the classes of each run under the smallest of them.

    A long run may be a tile of a crowded shingle: its parts become a part of the name, so that tiles that
    hold the same smallest class stay apart."""
    rows = rows[np.lexsort((rows["short"], rows["q"], rows["token"]))]
    q = rows["q"].astype(np.int64)
    new = _changes(rows["token"])
    new[1:] |= q[1:] - q[:-1] > 418  # 1000 * log2(4/3) = 415.04
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(rows)))
    some = np.repeat(count, count) > 1
    rows, count = rows[some], count[count > 1]
    out = np.empty(len(rows), MEMBER)
    if len(rows):
        first = np.cumsum(count) - count
        anchor = np.minimum.reduceat(rows["short"], first)
        for i in np.flatnonzero(count > RUN // 8).tolist():
            anchor[i] = _tile_name(int(anchor[i]), *_residues(rows["short"][first[i] : first[i] + count[i]]))
        out["anchor"] = np.repeat(anchor, count)
    out["q"], out["short"] = rows["q"], rows["short"]
    out = _members(out)
    return mix(out["anchor"].view(np.uint64)) % U64(buckets), out


# Tiles --------------------------------------------------------------------------------------

TILE = "tile long, short long"


def _cut(q: np.ndarray) -> list[tuple[int, int]]:
    """Parts of a group, from its classes' sizes: of bounded rows, and shingles where one alone has not more."""
    most = min(MOST, max(LEAST, -(-len(q) // PARTS)))
    weight = np.cumsum(2.0 ** (q / 1000))
    out, a = [], 0
    while a < len(q):
        b = int(np.searchsorted(weight, (weight[a - 1] if a else 0) + SHINGLES, side="right"))
        b = min(max(b, a + 1), a + most, len(q))
        out.append((a, b))
        a = b
    return out


def _tile_name(anchor: int, i: int, j: int) -> int:
    return int(mix(np.array([anchor], np.int64).view(np.uint64) + U64((i << 32 | j) * 0x9E3779B97F4A7C15 % (1 << 64)))[0].view(np.int64))


def _reach(q_low: int, q_high: int) -> bool:
    """Whether sets of these sizes can be linked; rounding of both counts for 1."""
    return q_high - q_low <= 417


def _first_tiles(every_pair: bool):
    """All MEMBER rows of groups -> (tile, short, anchor, q): a tile for each part of a group, with the last
    classes of the part before. Groups of several parts are marked by ``q``, for the second round. With
    ``every_pair`` there are tiles for all pairs of parts instead, and no second round."""

    def run(table: pa.Table) -> pa.Table:
        rows = _members(_unpack(table, MEMBER))
        begin = np.flatnonzero(_changes(rows["anchor"]))
        end = np.append(begin[1:], len(rows))
        tile, place, again = [], [], np.zeros(len(rows), bool)
        whole = end - begin <= LEAST
        for a, b, all_in_one in zip(begin.tolist(), end.tolist(), whole.tolist(), strict=True):
            q = rows["q"][a:b].astype(np.int64)
            cut = [(0, b - a)] if all_in_one and (2.0 ** (q / 1000)).sum() <= SHINGLES else _cut(q)
            anchor = int(rows["anchor"][a])
            again[a:b] = len(cut) > 1 and not every_pair
            for i, (x, y) in enumerate(cut):
                pairs = [j for j in range(i, len(cut)) if j == i or _reach(q[y - 1], q[cut[j][0]])] if every_pair else [i]
                for j in pairs:
                    own = np.arange(a + x, a + y)
                    if j > i:
                        own = np.concatenate((own, np.arange(a + cut[j][0], a + cut[j][1])))
                    elif i and not every_pair:
                        own = np.concatenate((np.arange(max(a, a + x - AGAIN), a + x), own))
                    place.append(own)
                    tile.append(np.full(len(own), _tile_name(anchor, i, j)))
        place = np.concatenate(place) if place else np.zeros(0, np.int64)
        tile = np.concatenate(tile) if tile else place
        second = np.flatnonzero(again)
        none = pa.nulls(len(place), pa.int64())
        return pa.table(
            {
                "tile": pa.concat_arrays([pa.array(tile, pa.int64()), pa.nulls(len(second), pa.int64())]),
                "short": pa.array(rows["short"][np.concatenate((place, second))]),
                "anchor": pa.concat_arrays([none, pa.array(rows["anchor"][second])]),
                "q": pa.concat_arrays([none, pa.array(rows["q"][second].astype(np.int64))]),
            }
        )

    return run


def _second_tiles(group: pa.Table) -> pa.Table:
    """A group's (anchor, short, q, component) -> (tile, short) for parts that hold different components.

    The classes are ordered by component, the largest first, so most parts have one."""
    anchor, short, q = group["anchor"][0].as_py(), group["short"].to_numpy(), group["q"].to_numpy()
    _, comp, size = np.unique(group["component"].to_numpy(zero_copy_only=False).astype(bytes), return_inverse=True, return_counts=True)
    order = np.lexsort((short, q, comp, -size[comp]))
    short, q, comp = short[order], q[order], comp[order]
    cut = _cut(q)
    low, high = [int(q[x:y].min()) for x, y in cut], [int(q[x:y].max()) for x, y in cut]
    one = [comp[x] if (comp[x:y] == comp[x]).all() else -1 for x, y in cut]
    tile, own = [], []
    for i, (x, y) in enumerate(cut):
        for j in range(i, len(cut)):
            if one[i] >= 0 and one[i] == one[j] or not (_reach(high[i], low[j]) and _reach(high[j], low[i])):
                continue
            members = short[x:y] if i == j else np.concatenate((short[x:y], short[cut[j][0] : cut[j][1]]))
            own.append(members)
            tile.append(np.full(len(members), _tile_name(~anchor, i, j)))
    none = np.zeros(0, np.int64)
    return pa.table({"tile": pa.array(np.concatenate(tile or [none]), pa.int64()), "short": pa.array(np.concatenate(own or [none]), pa.int64())})


# Comparisons --------------------------------------------------------------------------------


def may_link(n_a: np.ndarray, n_b: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """Whether the overlap's upper bound reaches the ratio: differing bits are in no overlap."""
    return (n_a + n_b - differ) // 2 >= least_overlap(n_a, n_b)


def overlap(p: np.ndarray, q: np.ndarray) -> int:
    """How many values two sorted arrays share: a stable sort merges them."""
    both = np.concatenate((p, q))
    both.sort(kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1]))


def compare(found: list[np.ndarray], comp: np.ndarray, every_pair: bool) -> list[tuple[int, int]]:
    """Links between sets, those between different components that connect what earlier ones don't; or all."""
    n = np.array([len(h) for h in found], np.int64)
    order = np.argsort(n, kind="stable")
    n, comp = n[order], comp[order].copy()
    out = []
    for i in range(0, len(n), BLOCK):
        for j in range(i, len(n), BLOCK):
            x, y = slice(i, i + BLOCK), slice(j, j + BLOCK)
            if DOWN * n[x][-1] < UP * n[y][0]:
                break  # sizes ascend: later blocks are larger still
            ok = np.ones((len(n[x]), len(n[y])), bool) if every_pair else comp[x][:, None] != comp[y][None, :]
            if i == j:
                ok = np.triu(ok, 1)
            if not ok.any():
                continue
            width = int(n[y][-1])
            bx, by = bitmaps([found[k] for k in order[x]], width), bitmaps([found[k] for k in order[y]], width)
            differ = np.zeros(ok.shape, np.int64)
            for w in range(bx.shape[1]):
                differ += np.bitwise_count(bx[:, w, None] ^ by[None, :, w])
            p, r = np.nonzero(ok & may_link(n[x][:, None], n[y][None, :], differ))
            first = np.argsort(differ[p, r], kind="stable")  # likely links connect, and so save others
            p, r = p[first] + i, r[first] + j
            while len(p):
                for s, t in zip(p[:STEP].tolist(), r[:STEP].tolist(), strict=True):
                    if every_pair or comp[s] != comp[t]:
                        a, b = found[order[s]], found[order[t]]
                        if overlap(a, b) >= least_overlap(len(a), len(b)):
                            out.append((int(order[s]), int(order[t])))
                            if not every_pair:
                                comp[comp == comp[t]] = comp[s]
                p, r = p[STEP:], r[STEP:]
                if not every_pair:
                    on = comp[p] != comp[r]
                    p, r = p[on], r[on]
    return out


def _tiles(size: int, every_pair: bool):
    """Rows (tile, short, class, component, text) sorted by tile -> links (u, v). One tile is held at a time."""

    def solve(rows: dict[bytes, tuple[np.ndarray, bytes]]) -> list[tuple[bytes, bytes]]:
        if len(rows) < 2:
            return []
        names = sorted(rows)
        _, comp = np.unique(np.array([rows[c][1] for c in names], "S16"), return_inverse=True)
        got = compare([rows[c][0] for c in names], comp, every_pair)
        return [(names[min(p)], names[max(p)]) for p in got]

    def batch_of(links: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.binary()) for k in (0, 1)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, {}
        for batch in batches:
            tile, names, comps = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            buf, offs = flat(batch.column(3))
            out = []
            for a, b in parts(offs):
                found = sets(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], size)
                for k, h in zip(range(a, b), found, strict=True):
                    if tile[k] != now:
                        out += solve(rows)
                        now, rows = tile[k], {}
                    # of rows with one key only that with the class's text counts
                    if set_id(h) == names[k]:
                        rows[names[k]] = (h, comps[k])
            if out:
                yield batch_of(out)
        if got := solve(rows):
            yield batch_of(got)

    return run


# A filter for the texts that a round needs --------------------------------------------------


def _bloom(ids: DataFrame, col: str, n: int) -> np.ndarray:
    """A bit set for ``n`` values of a column, built in the executors word by word; its size is bounded."""
    bits = min(BLOOM_MOST, max(1 << 16, 1 << (BLOOM_EACH * n - 1).bit_length())) if n else 1 << 16
    places = F.explode(F.array(*(F.pmod(F.xxhash64(col, F.lit(s)), F.lit(bits)) for s in (1, 2, 3))))
    got = (
        ids.select(places.alias("p"))
        .groupBy(F.shiftright("p", 6).alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("v"))
        .toArrow()
    )
    out = np.zeros(bits // 64, np.int64)
    out[got["w"].to_numpy().astype(np.int64)] = got["v"].to_numpy()
    return out


def _hashed(col, words: np.ndarray) -> list:
    """The places of a value in a filter."""
    return [F.pmod(F.xxhash64(col, F.lit(s)), F.lit(64 * len(words))) for s in (1, 2, 3)]


def _passes(batch: pa.RecordBatch, words: np.ndarray, first: int) -> pa.Array:
    keep = np.ones(len(batch), bool)
    for k in range(first, first + 3):
        p = batch.column(k).to_numpy()
        keep &= (words[p >> 6] >> (p & 63)) & 1 == 1
    return pa.array(keep)


def _in_bloom(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select([0, 1]).filter(_passes(batch, table.value, 2))

    return run


def _row_key(text):
    """Rows of equal id and text share it; rows without an id are told apart by their texts."""
    return F.xxhash64("doc_id", text)


class _Join:
    def __init__(self, docs: DataFrame, size: int):
        self.spark: SparkSession = docs.sparkSession
        self.size = size
        self.scratch = Scratch(self.spark)
        self.docs = docs = docs.select("doc_id", "text", _row_key("text").alias("key"))
        kind = docs.schema["doc_id"].dataType.simpleString()
        scan = self.scratch.write(docs.mapInArrow(tidy(_scan(size)), _SCAN.format(id=kind)), "join-scan", ["kind"])
        self.members = scan.where("kind = 'doc'").select("doc_id", "key", "n", "class", "short")
        self.slots = frequent(scan)
        # a class's representative: a row with an id where there is one
        row = F.min(F.struct(F.col("doc_id").isNull().alias("alone"), "key")).alias("row")
        by_class = self.members.where("class is not null").groupBy("class").agg(row, F.max("n").alias("n"), F.first("short").alias("short"))
        self.classes = self.scratch.write(by_class.select("class", "short", "row.*", "n"), "join-classes")

    def groups(self) -> tuple[DataFrame, int]:
        """Packed MEMBER rows of all runs."""
        n_rows = self.classes.agg(F.sum(F.floor(F.col("n") * 3 / 8) + 2)).first()[0] or 0
        buckets = int(max(8, -(-n_rows // PER_BUCKET)))
        table = self.spark.sparkContext.broadcast(self.slots)
        rows = self.docs.select("text").mapInArrow(tidy(_first(self.size, buckets, table, RUN)), PACKED)

        def shared(key: tuple, group: pa.Table) -> pa.Table:
            return _stage(FIRST, buckets, lambda found, to: _shared(key[0].as_py(), found, to))(group)

        rows = rows.groupBy("bucket").applyInArrow(shared, PACKED)
        rows = rows.groupBy("bucket").applyInArrow(_stage(SHARED, buckets, _chosen), PACKED)
        return rows.groupBy("bucket").applyInArrow(_stage(CHOSEN, buckets, _runs), PACKED), buckets

    def texts(self, needed: DataFrame, alone: bool) -> DataFrame:
        """(tile, class, component, text) for rows with a key: a broadcast up to SMALL rows; beyond, a filter of
        bounded size keeps most other texts out of the shuffle."""
        docs = self.docs.where(F.col("doc_id").isNull() == F.lit(alone)).select("key", "text")
        needed = needed.where(F.col("alone") == F.lit(alone)).drop("alone")
        n = needed.count()
        if n == 0:
            return None
        if n <= SMALL:
            found = docs.join(F.broadcast(needed), "key")
        else:
            words = _bloom(needed, "key", n)
            tests = [c.alias(f"p{i}") for i, c in enumerate(_hashed("key", words))]
            table = self.spark.sparkContext.broadcast(words)
            found = docs.select("key", "text", *tests).mapInArrow(_in_bloom(table), "key long, text string").join(needed, "key")
        found = found.select("tile", "class", "component", "text")
        # copies without an id share a key: one of them travels on
        return found.distinct() if alone else found

    def links(self, tiles: DataFrame, labels: DataFrame | None, every_pair: bool, name: str) -> DataFrame:
        """The links (u, v) that the tiles' classes have, u < v."""
        component = F.col("class")
        named = tiles.join(self.classes.select("short", "class", "alone", "key"), "short")
        if labels is not None:
            named = named.join(labels, "class", "left")
            component = F.coalesce("label", "class")
        needed = self.scratch.write(named.select("tile", "class", "alone", "key", component.alias("component")), f"{name}-needed")
        texts = [t for t in (self.texts(needed, alone) for alone in (False, True)) if t is not None]
        if not texts:
            return self.scratch.write(self.spark.createDataFrame([], "u binary, v binary"), name)
        rows = texts[0] if len(texts) == 1 else texts[0].unionByName(texts[1])
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartition(n, "tile").sortWithinPartitions("tile")
        out = rows.mapInArrow(tidy(_tiles(self.size, every_pair)), "u binary, v binary")
        out = self.scratch.write(out.distinct() if every_pair else out, name)
        self.scratch.drop(f"{name}-needed")
        return out

    def components(self) -> DataFrame | None:
        """(class, label) for classes with links, or None."""
        rows, _ = self.groups()
        tiles = self.scratch.write(rows.groupBy("bucket").applyInArrow(_first_tiles(False), "tile long, short long, anchor long, q long"), "join-tiles")
        links = self.links(tiles.where("tile is not null").select("tile", "short"), None, False, "join-first")
        labels = self.label(links)
        large = tiles.where("anchor is not null").select("anchor", "short", "q")
        if large.isEmpty():
            return labels
        # groups of several parts, if they still hold several components
        named = large.join(self.classes.select("short", "class"), "short")
        if labels is not None:
            named = named.join(labels, "class", "left").withColumn("component", F.coalesce("label", "class"))
        else:
            named = named.withColumn("component", F.col("class"))
        named = self.scratch.write(named.select("anchor", "short", "q", "component"), "join-large")
        mixed = named.groupBy("anchor").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("anchor")
        second = named.join(mixed, "anchor").groupBy("anchor").applyInArrow(_second_tiles, TILE)
        more = self.links(self.scratch.write(second.distinct(), "join-second-tiles"), labels, False, "join-second")
        return self.label(links.unionByName(more)) if not more.isEmpty() else labels

    def label(self, links: DataFrame) -> DataFrame | None:
        if links.isEmpty():
            return None
        found = connected_components(links, scratch=self.scratch)
        return self.scratch.write(found.select(F.col("node").alias("class"), "label"), "join-labels")

    def all_links(self) -> DataFrame:
        """Every linked pair of classes (u, v); no pair is skipped."""
        rows, _ = self.groups()
        tiles = rows.groupBy("bucket").applyInArrow(_first_tiles(True), "tile long, short long, anchor long, q long")
        return self.links(self.scratch.write(tiles.select("tile", "short"), "join-tiles"), None, True, "join-links")


def join(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest linked id) and n_copies for every row."""
    return _labelled(docs, size).drop("key")


def _labelled(docs: DataFrame, size: int) -> DataFrame:
    """The rows of ``join`` with their row keys, written; what they were made from is removed."""
    job = _Join(read_text(docs), size)
    labels = job.components()
    named = job.members.where("class is not null")
    by_class = named.groupBy("class").agg(F.min("doc_id").alias("low"), F.count("*").alias("n_copies"))
    if labels is not None:
        by_class = by_class.join(labels, "class", "left").withColumn("component", F.coalesce("label", "class")).drop("label")
        low = by_class.groupBy("component").agg(F.min("low").alias("component_id"))
        of_class = by_class.join(low, "component").select("class", "component_id", "n_copies")
    else:
        of_class = by_class.withColumnRenamed("low", "component_id")
    columns = ["doc_id", "key", F.col("n").alias("n_shingles")]
    linked = named.join(of_class, "class").select(*columns, F.coalesce("component_id", "doc_id").alias("component_id"), "n_copies")
    empty = job.members.where("class is null").select(*columns, F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("n_copies"))
    out = job.scratch.write(linked.unionByName(empty), "join-result")
    job.scratch.drop_all_but("join-result")
    return out


def links(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(class_a, class_b, doc_a, doc_b) for every two linked classes, each pair once.

    A class is named by the hash of its set and by its smallest id, which is null where no row has one.
    """
    job = _Join(read_text(docs), size)
    found = job.all_links()
    low = job.members.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("doc"))
    left, right = (low.select(F.col("class").alias(k), F.col("doc").alias(d)) for k, d in (("u", "doc_a"), ("v", "doc_b")))
    return found.join(left, "u").join(right, "v").select(F.col("u").alias("class_a"), F.col("v").alias("class_b"), "doc_a", "doc_b")


def link_counts(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, class and n_links for every row: to how many other classes its class is linked."""
    job = _Join(read_text(docs), size)
    per_class = job.all_links().select(F.explode(F.array("u", "v")).alias("class")).groupBy("class").agg(F.count("*").alias("n_links"))
    return job.members.join(per_class, "class", "left").select("doc_id", "class", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _split(table):
    """(three places, key, row) -> (key, row, whether the filter has the key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(3), batch.column(4), _passes(batch, table.value, 0)], ["key", "row", "hit"])

    return run


def one_of_each(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """The documents, with all their columns, without those linked to one of a smaller id.

    Documents without words, and rows with a null id, stay; of rows with equal id and text one stays.
    Where an id repeats with different texts, each row is judged by its own text: one that is linked
    to a smaller id goes, the others stay, also those linked only to rows of their own id. Columns may
    have any names.
    A filter of bounded size over the rows that go lets most documents pass without a shuffle; only those
    that it names are joined with the exact list.
    """
    spark = docs.sparkSession
    gone = _labelled(docs, size).where("doc_id <> component_id").select("doc_id", "key").distinct()
    words = _bloom(gone, "key", gone.count())
    counts = docs.where("doc_id is not null").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("d")).first()
    if counts["n"] != counts["d"]:
        docs = docs.where("doc_id is not null").dropDuplicates(["doc_id", "text"]).unionByName(docs.where("doc_id is null"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(_row_key(F.coalesce("text", F.lit(""))).alias("key"), row.alias("row"))
    tests = [c.alias(f"p{i}") for i, c in enumerate(_hashed("key", words))]
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("row", docs.schema), T.StructField("hit", T.BooleanType())])
    tested = keyed.select(*tests, "key", "row").mapInArrow(tidy(_split(spark.sparkContext.broadcast(words))), schema)
    doc_id = F.col("row").getField("doc_id")
    # the test is cheap, the texts are not: two narrow passes instead of one shuffle of all
    passed = tested.where(~F.col("hit") | doc_id.isNull())
    checked = tested.where(F.col("hit") & doc_id.isNotNull()).withColumn("doc_id", doc_id).join(gone, ["doc_id", "key"], "left_anti")
    columns = [F.col("row").getField(c).alias(c) for c in docs.columns]
    return passed.select(*columns).unionByName(checked.select(*columns))
