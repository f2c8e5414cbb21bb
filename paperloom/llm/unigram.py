"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The best segmentation maximises the sum of the pieces' scores. A character that no piece covers alone
costs the least score less 10 and becomes its UTF-8 byte pieces (byte fallback). White space is marked
by U+2581; a text starts with one mark. Of equally good paths the one whose last piece starts first
wins. A model whose own type is BPE is read as a unigram model: its scores are taken as log scores.

No piece holds a mark after another character, nor a line feed, so a text is cut before marks and
around line feeds and the parts are encoded alone; a worker keeps the ids of parts it has seen.

Defined cases: a null text is empty, without ids; repeated rows are encoded each; an empty table gives
an empty result; a literal U+2581 in a text is decoded as a space (as the format has it).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_text
from .flat import U64, Memo, flat, kept, names, parts, tidy

MARK = "▁"
#: Texts that go together, and the characters of a text that goes alone.
TOGETHER, LONG = 8192, 48
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class DoubleArray:
    """A trie in two arrays: the child of state s by code c is base[s] + c if check there is s."""

    def __init__(self, keys: dict[str, int]):
        counts: dict[str, int] = {}
        for key in keys:
            for c in key:
                counts[c] = counts.get(c, 0) + 1
        self.code = {c: i + 1 for i, c in enumerate(sorted(counts, key=lambda c: (-counts[c], c)))}
        root: dict = {}
        for key, value in keys.items():
            node = root
            for c in key:
                node = node.setdefault(self.code[c], {})
            node[0] = value
        size = 1 << 17
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0] = 0
        queue, free = [(0, root)], 1
        for state, node in queue:
            codes = sorted(c for c in node if c)
            value[state] = node.get(0, -1)
            if not codes:
                continue
            while check[free] != -1:
                free += 1
            at = max(free - codes[0], 0)
            while True:
                top = at + codes[-1] + 1
                if top >= len(check):
                    more = max(top - len(check) + 1, len(check))
                    base += [0] * more
                    check += [-1] * more
                    value += [-1] * more
                if all(check[at + c] == -1 for c in codes):
                    break
                at += 1
            base[state] = at
            for c in codes:
                check[at + c] = state
            queue += [(at + c, node[c]) for c in codes]
        # room for any code after any base, so that a step needs no bounds check
        room = max(base) + len(self.code) + 2 - len(check)
        self.base, self.check, self.value = base + [0] * max(room, 0), check + [-1] * max(room, 0), value + [-1] * max(room, 0)


class Unigram:
    def __init__(self, path: str, bits: int = 21):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rules = model.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that keep the text as it is are supported")
        self.prefix = rules.add_dummy_prefix
        kinds = [p.type for p in model.pieces]
        scores = [p.score for p in model.pieces]
        self.unknown = kinds.index(UNKNOWN)
        self.byte_ids = [-1] * 256
        self.bytes_of: list[bytes] = []
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type == CONTROL:
                self.bytes_of.append(b"")
            elif p.type == UNKNOWN:
                self.bytes_of.append(model.trainer_spec.unk_surface.encode())
            else:
                self.bytes_of.append(p.piece.replace(MARK, " ").encode())
        normal = [s for s, k in zip(scores, kinds, strict=True) if k == NORMAL]
        self.unknown_score, best = min(normal) - 10.0, max(normal)
        self.fallback = all(i >= 0 for i in self.byte_ids)
        keys = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (NORMAL, USER)}
        self.score = [len(p.piece) * best - 0.1 if p.type == USER else p.score for p in model.pieces]
        self.trie = DoubleArray(keys)
        self.arrays = (np.array(self.trie.base, np.int64), np.array(self.trie.check, np.int64), np.array(self.trie.value, np.int64), np.array(self.score))
        self.code_of = np.zeros(0x110000, np.int32)
        for c, number in self.trie.code.items():
            self.code_of[ord(c)] = number
        self.cut_marks = not any(MARK in k.lstrip(MARK) for k in keys)
        self.cut_feeds = not any("\n" in k for k in keys)
        self.is_byte = np.array([k == BYTE for k in kinds])
        sizes = np.array([len(b) for b in self.bytes_of], np.int64)
        self.out_size, self.out_start = sizes, np.cumsum(sizes) - sizes
        self.out_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.memo = Memo(bits)

    def viterbi(self, s: str) -> list[int]:
        """The ids of a text that holds marks for spaces."""
        base, check, value, score = self.trie.base, self.trie.check, self.trie.value, self.score
        code = self.trie.code
        codes = [code.get(c, 0) for c in s]
        n = len(s)
        best = [0.0] + [-np.inf] * n
        came, what = [0] * (n + 1), [-1] * (n + 1)
        for i in range(n):
            here, state, j, single = best[i], 0, i, False
            while j < n:
                c = codes[j]
                if not c:
                    break
                to = base[state] + c
                if check[to] != state:
                    break
                state = to
                j += 1
                v = value[state]
                if v >= 0:
                    total = here + score[v]
                    if total > best[j]:
                        best[j], came[j], what[j] = total, i, v
                    if j == i + 1:
                        single = True
            if not single:
                total = here + self.unknown_score
                if total > best[i + 1]:
                    best[i + 1], came[i + 1], what[i + 1] = total, i, -1
        out: list[int] = []
        at = n
        while at:
            v = what[at]
            if v >= 0:
                out.append(v)
            elif self.fallback:
                out += [self.byte_ids[b] for b in reversed(s[came[at] : at].encode("utf-8", "replace"))]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
            at = came[at]
        return out[::-1]

    def viterbi_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many texts one after the other, and how many each has: ``viterbi`` on all at once, a place
        of each at a time. Texts of about equal length go together; long ones, and those whose best path has a
        character without a piece, go alone."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        alone = np.flatnonzero(lengths > LONG).tolist()
        order = np.argsort(lengths, kind="stable")[: len(texts) - len(alone)]
        for k in range(0, len(order), TOGETHER):
            which = order[k : k + TOGETHER]
            ids, sizes, odd = self._paths([texts[i] for i in which.tolist()], lengths[which])
            found.append((which, ids, sizes))
            alone += which[odd].tolist()
        for i in alone:
            ids = np.array(self.viterbi(texts[i]), np.uint32)
            found.append((np.array([i]), ids, np.array([len(ids)])))
        sizes = np.zeros(len(texts), np.int64)
        for which, _, own in found:
            sizes[which] = own  # those that go alone come last
        out = np.empty(int(sizes.sum()), np.uint32)
        start = np.cumsum(sizes) - sizes
        for which, ids, own in found:
            keep = own == sizes[which] if len(which) > 1 else np.ones(1, bool)
            last = np.cumsum(own)
            at = np.repeat(start[which] - last + own, own) + np.arange(len(ids))
            some = np.repeat(keep, own)
            out[at[some]] = ids[some]
        return out, sizes

    def _paths(self, texts: list[str], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, how many each text has, the texts whose path has a character without a piece: no ids)."""
        base, check, value, score = self.arrays
        n, wide = len(texts), int(lengths.max(initial=0))
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        codes = np.zeros((n, wide), np.int32)
        codes[np.arange(wide)[None] < lengths[:, None]] = self.code_of[points]
        best = np.full((n, wide + 1), -np.inf)
        best[:, 0] = 0.0
        came, what = np.zeros((n, wide + 1), np.int32), np.full((n, wide + 1), -1, np.int32)
        for i in range(wide):
            row = np.flatnonzero(lengths > i)
            here = best[row, i]
            single = np.zeros(n, bool)
            live, state, start = row, np.zeros(len(row), np.int64), here
            for j in range(i, wide):
                c = codes[live, j]
                to = base[state] + c
                on = (c > 0) & (check[to] == state)
                live, state, start = live[on], to[on], start[on]
                if not len(live):
                    break
                v = value[state]
                total = start + score[v]
                better = (v >= 0) & (total > best[live, j + 1])
                hit = live[better]
                best[hit, j + 1], came[hit, j + 1], what[hit, j + 1] = total[better], i, v[better]
                if j == i:
                    single[live[v >= 0]] = True
            total = here + self.unknown_score
            better = ~single[row] & (total > best[row, i + 1])
            hit = row[better]
            best[hit, i + 1], came[hit, i + 1], what[hit, i + 1] = total[better], i, -1
        row, at = np.arange(n), lengths.copy()
        rows, ids, step, odd = [], [], [], np.zeros(n, bool)
        while len(row := row[at[row] > 0]):
            v = what[row, at[row]]
            odd[row[v < 0]] = True
            rows.append(row)
            ids.append(v)
            step.append(np.full(len(row), -len(step)))
            at[row] = came[row, at[row]]
        if not rows:
            return np.zeros(0, np.uint32), np.zeros(n, np.int64), odd
        row, v, k = np.concatenate(rows), np.concatenate(ids), np.concatenate(step)
        keep = ~odd[row]
        row, v, k = row[keep], v[keep], k[keep]
        return v[np.lexsort((k, row))].astype(np.uint32), np.bincount(row, minlength=n), odd

    def _encode_parts(self, pieces: list[tuple[bytes, bool]]) -> tuple[np.ndarray, np.ndarray]:
        texts = [data.decode("utf-8", "replace").replace(" ", MARK) for data, _ in pieces]
        return self.viterbi_many([MARK + t if first else t for t, (_, first) in zip(texts, pieces, strict=True)])

    def cuts(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        at = np.zeros(len(buf), bool)
        if len(buf) and self.cut_marks:
            at[1:] = (buf[1:] == 0x20) & (buf[:-1] != 0x20) & (buf[:-1] != 0x81)  # 0x81 may end a literal mark
        if len(buf) and self.cut_feeds:
            feed = buf == 0x0A
            at |= feed
            at[1:] |= feed[:-1]
        at[offsets[:-1][offsets[:-1] < len(buf)]] = True
        return np.flatnonzero(at)

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the number of ids of each."""
        starts = self.cuts(buf, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        ends = np.append(starts[1:], len(buf))
        first = np.zeros(len(starts), bool)
        if self.prefix:
            first[np.searchsorted(starts, offsets[:-1][np.diff(offsets) > 0])] = True
        low, high = names(buf, starts, ends)
        high ^= first.astype(np.uint64) << U64(62)  # a length is at most SHORT, or 255
        pieces = lambda which: [(buf[starts[i] : ends[i]].tobytes(), bool(first[i])) for i in which.tolist()]
        places = self.memo.places(low, high, lambda which: self._encode_parts(pieces(which)))
        sums = np.concatenate(([0], np.cumsum(self.memo.size[places])))
        return self.memo.gather(places), np.diff(sums[np.searchsorted(starts, offsets)])

    def decode_flat(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts' bytes one after the other and their offsets; a text's first marker goes."""
        counts = self.out_size[ids]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        data = self.out_bytes[np.repeat(self.out_start[ids] - ends + counts, counts) + np.arange(total)]
        offsets = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(sizes)))]
        if self.prefix:
            some = np.flatnonzero(np.diff(offsets) > 0)
            head = offsets[:-1][some]
            led = data[head] == 0x20
            data = np.delete(data, head[led])
            shift = np.zeros(len(offsets), np.int64)
            shift[some[led] + 1] = 1
            offsets = offsets - np.cumsum(shift)
        return data, offsets

    def decode(self, ids: list[int]) -> str:
        data, _ = self.decode_flat(np.array(ids, np.int64), np.array([len(ids)]))
        return data.tobytes().decode("utf-8", "replace")


def unigram(path: str) -> Unigram:
    return kept(("unigram", path), lambda: Unigram(path))


def same_texts(buf: np.ndarray, offsets: np.ndarray, data: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Which decoded texts equal the originals, a literal mark counting as a space."""
    out = np.diff(offsets) == np.diff(found)
    if np.array_equal(offsets, found):
        wrong = np.concatenate(([0], np.cumsum(buf != data)))
        out = wrong[offsets[1:]] == wrong[offsets[:-1]]
        doubt = np.flatnonzero(~out)
    else:
        doubt = np.arange(len(out))
    for i in doubt.tolist():
        want = buf[offsets[i] : offsets[i + 1]].tobytes().replace(MARK.encode(), b" ")
        out[i] = want == data[found[i] : found[i + 1]].tobytes()
    return out


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """Per document: number of ids and of byte pieces, the ids' CRC-32, and whether decoding gives the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = unigram(path)
        for batch in batches:
            buf, offs = flat(batch.column(1))
            for a, b in parts(offs):
                text, offsets = buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
                ids, sizes = model.encode(text, offsets)
                same = same_texts(text, offsets, *model.decode_flat(ids, sizes))
                ends = np.concatenate(([0], np.cumsum(sizes)))
                in_bytes = np.concatenate(([0], np.cumsum(model.is_byte[ids])))
                data = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(data[4 * x : 4 * y]) for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array(sizes), pa.array(np.diff(in_bytes[ends])), pa.array(crcs, pa.int64()), pa.array(same)],
                    ["doc_id", "n_tokens", "n_byte_tokens", "ids_crc32", "round_trip"],
                )

    df = read_text(docs)
    kind = df.schema["doc_id"].dataType.simpleString()
    return df.mapInArrow(tidy(run), f"doc_id {kind}, n_tokens long, n_byte_tokens long, ids_crc32 long, round_trip boolean")


def to_ids(docs: DataFrame, path: str) -> DataFrame:
    """The documents without their text, with ``n_tokens`` and ``token_ids``; these two replace columns of
    the documents with such names, all others stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = unigram(path)
        for batch in batches:
            buf, offs = flat(batch.column(0))
            for a, b in parts(offs):
                ids, sizes = model.encode(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(1)[a:b], pa.array(sizes), lists], ["row", "n_tokens", "token_ids"])

    others = [c for c in docs.columns if c not in ("text", "n_tokens", "token_ids")]
    row = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(0).alias("none"))
    df = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"), row.alias("row"))
    ids = [T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.ArrayType(T.IntegerType()))]
    out = df.mapInArrow(tidy(run), T.StructType([T.StructField("row", df.schema["row"].dataType), *ids]))
    return out.select(*[F.col("row").getField(c).alias(c) for c in others], "n_tokens", "token_ids")
