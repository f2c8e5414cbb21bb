"""Byte-level BPE with the tokenizers library, by pieces that are proven to encode alone.

The pre-tokenizer's pattern never crosses a space that is followed by a non-space, a line feed between
two non-spaces, or the place between a letter or digit and a full stop or comma, so a text's ids are the ids of its pieces one after the other. Pieces repeat;
a worker keeps the ids of those it has seen, up to a fixed number. Tokenizer files with another
pre-tokenizer or a normalizer are encoded as whole texts.
"""

from __future__ import annotations

import json
import os

import numpy as np

from .flat import SPACE, Memo, gather_ranges, names

#: First bytes of white space beyond ASCII (U+0085, U+00A0, U+1680, U+2000.., U+3000), and controls
#: that some libraries take for white space: next to them no cut is made.
_DOUBTFUL = SPACE.copy()
_DOUBTFUL[[*range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3]] = True
_STOP = np.zeros(256, bool)
_STOP[[0x2C, 0x2E]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_PLAIN = ~_DOUBTFUL
_PLAIN[0x80:] = False


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def cuts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ascending starts of pieces, each text's start included."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64)
    at = np.zeros(n, bool)
    nxt = np.flatnonzero(buf[:-1] == 0x20)
    at[nxt[~_DOUBTFUL[buf[nxt + 1]]]] = True
    feed = np.flatnonzero(buf[1:-1] == 0x0A) + 1
    at[feed[_PLAIN[buf[feed - 1]] & ~_DOUBTFUL[buf[feed + 1]]]] = True
    stop = np.flatnonzero(_STOP[buf[1:]]) + 1
    stop = stop[_ALNUM[buf[stop - 1]]]
    # a text's last byte has no follower in the text
    edge = offsets[(offsets > 0) & (offsets <= n)] - 1
    at[edge] = False
    at[stop] = True
    at[offsets[:-1][offsets[:-1] < n]] = True
    return np.flatnonzero(at)


class BpeEncoder:
    def __init__(self, path: str, bits: int = 21):
        self.tok = load(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        alone = all(not t["lstrip"] and not t["rstrip"] and not any(c.isspace() or c in ".," for c in t["content"]) for t in spec["added_tokens"])
        self.by_pieces = (
            pre.get("type") == "ByteLevel" and not pre["add_prefix_space"] and pre.get("use_regex", True) and not spec["normalizer"] and alone
        )
        feed = self.tok.encode("\n", add_special_tokens=False).ids
        self.feed = feed[0] if len(feed) == 1 else None
        self.memo = Memo(bits)

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter((i for ids in lists for i in ids), np.uint32, int(sizes.sum())), sizes

    def _joined(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces without white space but for a leading space, many a call: the ids between line feeds."""
        ids, sizes = [], []
        texts = []
        for i in range(0, len(starts), 1000):
            texts.append(gather_ranges(buf, starts[i : i + 1000], ends[i : i + 1000], 0x0A).tobytes().decode("utf-8", "replace"))
        for i, e in enumerate(self.tok.encode_batch_fast(texts, add_special_tokens=False)):
            got = np.array(e.ids, np.uint32)
            seam = np.flatnonzero(got == self.feed)
            n = min(1000, len(starts) - 1000 * i)
            if len(seam) != n:  # a line feed met its neighbours in one id
                got, own = self._each(texts[i].split("\n")[:-1])
            else:
                own = np.diff(seam, prepend=-1) - 1
                got = got[got != self.feed]
            ids.append(got)
            sizes.append(own)
        return np.concatenate(ids), np.concatenate(sizes)

    def _encode(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces' ids one after the other, and how many each has."""
        doubt = np.concatenate(([0], np.cumsum(_DOUBTFUL[buf])))
        head = buf[starts]
        plain = (doubt[ends] - doubt[starts + 1] == 0) & (ends > starts + 1) & (self.feed is not None)
        fed = plain & (head == 0x0A)
        clean = plain & ~fed & ((head == 0x20) | ~_DOUBTFUL[head])
        sizes = np.zeros(len(starts), np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for which, skip in ((np.flatnonzero(clean), 0), (np.flatnonzero(fed), 1)):
            if len(which):
                found.append((which, *self._joined(buf, starts[which] + skip, ends[which])))
        rest = np.flatnonzero(~clean & ~fed)
        if len(rest):
            texts = [buf[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)]
            found.append((rest, *self._each(texts)))
        for which, _, own in found:
            sizes[which] = own
        sizes[fed] += 1
        stop = np.cumsum(sizes)
        out = np.full(int(stop[-1]) if len(stop) else 0, self.feed or 0, np.uint32)
        for which, ids, own in found:
            # behind the line feed of those that start with one
            at = (stop - sizes)[which] + fed[which]
            last = np.cumsum(own)
            out[np.repeat(at - last + own, own) + np.arange(len(ids))] = ids
        return out, sizes

    def _places(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces' places, and how many pieces begin before each text (and after all)."""
        starts = cuts(buf, offsets) if self.by_pieces else np.unique(offsets[:-1][np.diff(offsets) > 0])
        ends = np.append(starts[1:], len(buf)) if len(starts) else starts
        places = self.memo.places(*names(buf, starts, ends), lambda which: self._encode(buf, starts[which], ends[which]))
        return places, np.searchsorted(starts, offsets)

    def counts(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        places, before = self._places(buf, offsets)
        sums = np.concatenate(([0], np.cumsum(self.memo.size[places])))
        return np.diff(sums[before])

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the number of ids of each text."""
        places, before = self._places(buf, offsets)
        sums = np.concatenate(([0], np.cumsum(self.memo.size[places])))
        return self.memo.gather(places), np.diff(sums[before])
