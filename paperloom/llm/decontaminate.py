"""Benchmark decontamination: n-gram seeds find passages, Smith-Waterman alignment scores them.

Words are runs of letters and digits, lower-cased (ASCII and Latin-1). A seed is a 3-word window of a
test item. Every place where a seed occurs in a document, however common it is, gives a window of the
document's words as long as the item and a margin; the window is aligned with the item (match 2,
mismatch -1, gap -1). A document leaks an item if the best alignment reaches a share of the item's own
score. Windows that hold too few of the item's words to reach it are not aligned: no alignment matches
more words than are there, so this loses nothing.

Test items are a stated query set: they are read in blocks of bounded size, each against all documents.

Defined cases: null texts are empty; items with fewer words than a seed match nothing; repeated
documents and repeated items are each reported; an empty table gives an empty result; other columns
are ignored by ``leaks`` and kept by ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_text
from .flat import U64, flat, parts, tidy
from .shingles import LOWER, windows, word_hashes

SEED, SHARE, MATCH = 3, 0.5, 2
BLOCK_WORDS = 1_000_000
#: Words of windows that are bounded at a time, and one window.
WINDOW_WORDS = 2_000_000
_FILTER_BITS = 20
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def plain(buf: np.ndarray) -> np.ndarray:
    """The bytes in lower case, ASCII and the two-byte letters from U+00C0 to U+00DE."""
    out = LOWER[buf]
    if len(buf) > 1:
        high = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
        out[1:][high] += 0x20
    return out


def text_words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes(plain(buf), offsets, None, _INSIDE)


class Items:
    """A block of test items: their words, and an index of their seeds."""

    def __init__(self, ids: list, texts: list[str]):
        self.ids = ids
        buf, offsets = flat(pa.array([t or "" for t in texts], pa.string()))
        words, before = text_words(buf, offsets)
        self.words = [words[a:b] for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True)]
        rows = [(h, i, k) for i, w in enumerate(self.words) for k, h in enumerate(windows(w, SEED).tolist())]
        self.hash = np.array([r[0] for r in rows], np.uint64)
        self.item = np.array([r[1] for r in rows], np.int64)
        self.place = np.array([r[2] for r in rows], np.int64)
        order = np.argsort(self.hash, kind="stable")
        self.hash, self.item, self.place = self.hash[order], self.item[order], self.place[order]
        self.seeds = np.unique(self.hash)
        self.table = np.zeros(1 << _FILTER_BITS, bool)
        self.table[(self.seeds & U64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True
        # how often each word of the block is in an item, by item * (number of words) + word
        self.known, own = np.unique(words, return_inverse=True)
        self.held, self.times = np.unique(np.repeat(np.arange(len(ids)), np.diff(before)) * len(self.known) + own, return_counts=True)

    def hits(self, grams: np.ndarray) -> np.ndarray:
        """Places of windows that are seeds."""
        at = np.flatnonzero(self.table[(grams & U64((1 << _FILTER_BITS) - 1)).astype(np.int64)])
        if not len(at) or not len(self.seeds):
            return at[:0]
        k = np.minimum(np.searchsorted(self.seeds, grams[at]), len(self.seeds) - 1)
        return at[self.seeds[k] == grams[at]]


def most_matches(words: np.ndarray, begin: np.ndarray, end: np.ndarray, item: np.ndarray, items: Items) -> np.ndarray:
    """For windows of a part's words, how many of the item's words are in the window: no alignment matches more."""
    out = np.zeros(len(begin), np.int64)
    at = np.minimum(np.searchsorted(items.known, words), len(items.known) - 1)
    at[items.known[at] != words] = -1
    chunk = np.cumsum(end - begin) // WINDOW_WORDS
    cut = [0, *(np.flatnonzero(chunk[1:] != chunk[:-1]) + 1).tolist(), len(begin)]
    for x, y in zip(cut[:-1], cut[1:], strict=True):
        low, n = begin[x:y], (end - begin)[x:y]
        window = np.repeat(np.arange(len(n)), n)
        word = at[low[window] + np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n)]
        window, word = window[word >= 0], word[word >= 0]
        once = np.unique(window * len(items.known) + word)
        window, word = once // len(items.known), once % len(items.known)
        key = item[x:y][window] * len(items.known) + word
        k = np.minimum(np.searchsorted(items.held, key), len(items.held) - 1)
        times = np.where(items.held[k] == key, items.times[k], 0)
        out[x:y] = np.bincount(window, times, minlength=len(n)).astype(np.int64)
    return out


def align(texts: list[np.ndarray], items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman scores of text i with item i, and where in the text the best alignment ends.

    All pairs advance by one word of the text at a time. A gap along the item is a running maximum,
    because a gap costs the same for each word.
    """
    score, end = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    order = np.argsort([len(t) for t in texts], kind="stable")
    for first in range(0, len(order), 256):
        own = order[first : first + 256]
        high, wide = max(len(texts[i]) for i in own), max(len(items[i]) for i in own)
        t, q = np.zeros((len(own), high), np.uint64), np.zeros((len(own), wide), np.uint64)
        tl, ql = np.array([len(texts[i]) for i in own]), np.array([len(items[i]) for i in own])
        for r, i in enumerate(own):
            t[r, : tl[r]], q[r, : ql[r]] = texts[i], items[i]
        inside = np.arange(wide)[None] < ql[:, None]
        ramp = np.arange(1, wide + 1, dtype=np.int32)
        row = np.zeros((len(own), wide + 1), np.int32)
        best, at = np.zeros(len(own), np.int32), np.zeros(len(own), np.int64)
        for k in range(high):
            hit = (t[:, k, None] == q) & inside & (k < tl)[:, None]
            new = np.maximum(row[:, :-1] + np.where(hit, MATCH, -1).astype(np.int32), row[:, 1:] - 1)
            np.maximum(new, 0, out=new)
            new = np.maximum.accumulate(new + ramp, axis=1) - ramp
            row[:, 1:] = new
            top = np.where(inside & (k < tl)[:, None], new, 0).max(axis=1)
            better = top > best
            best[better], at[better] = top[better], k
        score[own], end[own] = best, at
    return score, end


def found_in(words: np.ndarray, before: np.ndarray, items: Items, share: float) -> list[tuple[int, int, float, int, int]]:
    """(text, item, score share, seeds, end word) of the leaks in a part of documents."""
    grams = windows(words, SEED)
    at = items.hits(grams)
    if not len(at):
        return []
    doc = np.searchsorted(before, at, side="right") - 1
    ok = at + SEED <= before[doc + 1]
    at, doc = at[ok], doc[ok]
    low, high = np.searchsorted(items.hash, grams[at], "left"), np.searchsorted(items.hash, grams[at], "right")
    n = high - low
    rep = np.repeat(np.arange(len(at)), n)
    entry = low[rep] + np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)
    item, doc, shift = items.item[entry], doc[rep], at[rep] - items.place[entry]
    order = np.lexsort((shift, item, doc))
    item, doc, shift = item[order], doc[order], shift[order]
    size = np.array([len(w) for w in items.words], np.int64)[item]
    margin = 8 + size // 4
    # hits of one item whose windows overlap become one window
    new = np.ones(len(shift), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (shift[1:] - shift[:-1] > margin[1:])
    begin = np.flatnonzero(new)
    stop = np.append(begin[1:], len(new)) - 1
    d, i = doc[begin], item[begin]
    a = np.maximum(before[d], shift[begin] - margin[begin])
    b = np.minimum(before[d + 1], shift[stop] + size[begin] + margin[begin])
    ok = most_matches(words, a, b, i, items) / size[begin] >= share
    pairs = list(zip(*(x[ok].tolist() for x in (d, i, a, b, stop - begin + 1)), strict=True))
    score, end = align([words[a:b] for _, _, a, b, _ in pairs], [items.words[i] for _, i, *_ in pairs])
    out: dict[tuple[int, int], tuple] = {}
    for (d, i, a, _, seeds), s, e in zip(pairs, score.tolist(), end.tolist(), strict=True):
        part = s / (MATCH * len(items.words[i]))
        if part >= share and (d, i) not in out or (d, i) in out and part > out[d, i][2]:
            out[d, i] = (d, i, part, seeds, a + e - int(before[d]))
    return list(out.values())


def _find(table, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = table.value
        for batch in batches:
            buf, offs = flat(batch.column(1))
            for a, b in parts(offs):
                words, before = text_words(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                rows = found_in(words, before, items, share)
                if rows:
                    ids = batch.column(0)[a:b].take(pa.array([r[0] for r in rows]))
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array([items.ids[r[1]] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], kind) for k, kind in ((2, pa.float64()), (3, pa.int64()), (4, pa.int64())))],
                        ["doc_id", "item_id", "score", "n_seeds", "end_word"],
                    )

    return run


def blocks(benchmark: DataFrame, limit: int = BLOCK_WORDS) -> Iterator[Items]:
    """The items in blocks of about ``limit`` words, streamed to the driver one block at a time."""
    ids, texts, held = [], [], 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator():
        ids.append(row["item_id"])
        texts.append(row["text"])
        held += len(row["text"] or "") // 4 + 1
        if held >= limit:
            yield Items(ids, texts)
            ids, texts, held = [], [], 0
    if ids:
        yield Items(ids, texts)


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, score, n_seeds, end_word) for each document that holds an item."""
    spark = docs.sparkSession
    texts = read_text(docs)
    kind = texts.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, score double, n_seeds long, end_word long"
    out = []
    for items in blocks(benchmark):
        out.append(texts.mapInArrow(tidy(_find(spark.sparkContext.broadcast(items), share)), schema))
    if not out:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, out)


def _drop(table, share: float):
    """(text, row) -> the rows whose text holds no item of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = table.value
        for batch in batches:
            buf, offs = flat(batch.column(0))
            keep = np.ones(len(batch), bool)
            for a, b in parts(offs):
                words, before = text_words(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                for r in found_in(words, before, items, share):
                    keep[a + r[0]] = False
            yield batch.filter(pa.array(keep))

    return run


def clean(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """The documents that hold no item, with all their columns, whatever their names; nothing is shuffled."""
    spark = docs.sparkSession
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), row.alias("row"))
    for items in blocks(benchmark):
        rows = rows.mapInArrow(tidy(_drop(spark.sparkContext.broadcast(items), share)), rows.schema)
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
