"""Arrays over the bytes of a whole Arrow batch: cut it into pieces, name the pieces, look them up.

A piece's name has 128 bits. Up to 15 bytes it is the piece itself with its length, so short pieces never
share a name; a longer one is named by XXH3-128. Work is done on parts of bounded size (``parts``).
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

SHORT = 15
U64 = np.uint64
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
#: The first n bytes of a little-endian word.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


# What a worker keeps ------------------------------------------------------------------------

_kept: dict[tuple, object] = {}
try:
    _trim: Callable | None = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def kept(key: tuple, make: Callable[[], object]):
    """What ``make`` gives, kept by the Python process until it asks for something else: a reused worker
    holds the tables of one operator at a time."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def release() -> None:
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def tidy(run: Callable) -> Callable:
    """A function over batches whose free memory goes back to the system, now and then and at its end."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for i, batch in enumerate(run(batches), 1):
                yield batch
                if i % 16 == 0:
                    release()
        finally:
            release()

    return tidied


# Names of pieces ----------------------------------------------------------------------------


def mix(h: np.ndarray) -> np.ndarray:
    """A finalizer: every input bit reaches every output bit."""
    h = (h ^ (h >> U64(30))) * _M1
    h = (h ^ (h >> U64(27))) * _M2
    return h ^ (h >> U64(31))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its offsets, without a copy; nulls are empty."""
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    else:
        kind = np.int64
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def names(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The names of byte ranges, as two words each."""
    size = ends - starts
    padded = np.zeros(len(buf) + 16, np.uint8)
    padded[: len(buf)] = buf
    lanes = np.ndarray((len(buf) + 9,), "<u8", padded, strides=(1,))
    low = lanes[starts] & _FIRST[np.minimum(size, 8)]
    high = lanes[starts + 8] & _FIRST[np.clip(size - 8, 0, 7)]
    high |= size.astype(np.uint64) << U64(56)
    for i in np.flatnonzero(size > SHORT).tolist():
        h = xxhash.xxh3_128_intdigest(buf[starts[i] : ends[i]].data)
        low[i], high[i] = h & 0xFFFFFFFFFFFFFFFF, h >> 64 | 0xFF << 56
    return low, high


def hashes(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """64 bits of each name."""
    return mix(mix(low + U64(0x9E3779B97F4A7C15)) ^ (high * U64(0xC2B2AE3D27D4EB4F)))


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words before each text) of maximal runs of ``inside`` bytes that stay in one text."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    within = inside[buf]
    first = within.copy()
    first[1:] &= ~within[:-1]
    cuts = offsets[(offsets > 0) & (offsets < len(buf))]
    first[cuts] = within[cuts]
    last = within.copy()
    last[:-1] &= ~within[1:]
    last[cuts - 1] = within[cuts - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def distinct(low: np.ndarray, high: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct name, which of those each row is); ``h`` are the names' hashes."""
    _, first, back = np.unique(h, return_index=True, return_inverse=True)
    if np.array_equal(low[first][back], low) and np.array_equal(high[first][back], high):
        return first, back
    order = np.lexsort((low, high))  # two names share a hash
    new = np.concatenate(([True], (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])))
    back = np.empty(len(low), np.int64)
    back[order] = np.cumsum(new) - 1
    return order[new], back


class Memo:
    """Piece name -> a list of ids, in arrays; emptied when it is full."""

    def __init__(self, bits: int = 21):
        self.bits = bits
        self.clear()

    def clear(self) -> None:
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.count = self.used = 0
        self.low = np.empty(1 << 12, np.uint64)
        self.high = np.empty(1 << 12, np.uint64)
        self.start = np.empty(1 << 12, np.int64)
        self.size = np.empty(1 << 12, np.int32)
        self.ids = np.empty(1 << 14, np.uint32)

    def _find(self, low: np.ndarray, high: np.ndarray, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int32)
        todo, mask = np.arange(len(h)), (1 << self.bits) - 1
        slot = (h >> U64(64 - self.bits)).astype(np.int64)
        while len(todo):
            value = self.slots[slot]
            some = value >= 0
            hit = some & (self.low[value] == low[todo]) & (self.high[value] == high[todo])
            out[todo[hit]] = value[hit]
            on = np.flatnonzero(some & ~hit)
            todo, slot = todo[on], (slot[on] + 1) & mask
        return out

    def _insert(self, h: np.ndarray, values: np.ndarray) -> None:
        slot, mask = (h >> U64(64 - self.bits)).astype(np.int64), (1 << self.bits) - 1
        while len(h):
            free = self.slots[slot] < 0
            _, pick = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            pick = pick[free[pick]]
            self.slots[slot[pick]] = values[pick]
            rest = np.ones(len(h), bool)
            rest[pick] = False
            h, values, slot = h[rest], values[rest], (slot[rest] + 1) & mask

    def _room(self, name: str, need: int) -> None:
        old = getattr(self, name)
        if need > len(old):
            new = np.empty(max(need, 2 * len(old)), old.dtype)
            new[: len(old)] = old
            setattr(self, name, new)

    def places(self, low: np.ndarray, high: np.ndarray, encode) -> np.ndarray:
        """The pieces' places, valid until the next call. ``encode(which)`` gives the ids of the pieces with
        these numbers one after the other, and how many each has."""
        h = hashes(low, high)
        out = self._find(low, high, h)
        missing = np.flatnonzero(out < 0)
        if len(missing):
            first, back = distinct(low[missing], high[missing], h[missing])
            which = missing[first]
            n = len(which)
            if self.count + n > 1 << (self.bits - 1):
                if self.count == 0:
                    while n > 1 << (self.bits - 1):
                        self.bits += 1
                self.clear()
                return self.places(low, high, encode)
            ids, sizes = encode(which)
            k = self.count
            for name in ("low", "high", "start", "size"):
                self._room(name, k + n)
            self._room("ids", self.used + len(ids))
            self.low[k : k + n], self.high[k : k + n] = low[which], high[which]
            self.start[k : k + n] = self.used + np.cumsum(sizes) - sizes
            self.size[k : k + n] = sizes
            self.ids[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
            self.count += n
            fresh = np.arange(k, k + n, dtype=np.int32)
            self._insert(h[which], fresh)
            out[missing] = fresh[back]
        return out

    def gather(self, places: np.ndarray) -> np.ndarray:
        sizes = self.size[places]
        ends = np.cumsum(sizes, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(self.start[places] - ends + sizes, sizes) + np.arange(total)]


def gather_ranges(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, tail: int | None = None) -> np.ndarray:
    """The bytes of the ranges one after the other, each followed by the byte ``tail`` if there is one."""
    sizes = ends - starts + (tail is not None)
    stop = np.cumsum(sizes)
    total = int(stop[-1]) if len(stop) else 0
    at = np.repeat(starts - stop + sizes, sizes) + np.arange(total)
    if tail is None:
        return buf[at]
    at[stop - 1] = 0
    out = buf[at]
    out[stop - 1] = tail
    return out


def parts(offsets: np.ndarray, size: int = 1 << 20):
    """(first, last) of runs of texts that hold about so many bytes."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="left"))
        last = min(max(last, first + 1), n)
        yield first, last
        first = last
