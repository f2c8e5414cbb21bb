"""Token counts, with huge documents encoded in overlapping chunks that are spliced where they agree.

A document of up to ``HUGE`` bytes is one chunk. A longer one is cut into chunks that overlap; each
is encoded with offsets. A position where a pre-token starts in both the left and the right encoding,
away from the chunks' edges by more than the longest special token, is a stable boundary: up to it the
left encoding is that of the whole text, and from it on so is the right one, as the pre-tokenizer looks
ahead only. Counts are taken between stable boundaries. Where an overlap has none (one huge word), the
overlap is doubled, and once it reaches back to the last boundary, the left chunk grows.

Defined cases: a null text is empty and has no tokens; repeated rows are counted each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_text
from .flat import flat, kept, parts, tidy
from .tokens import BpeEncoder

HUGE, CHUNK, OVERLAP, LIMIT = 32_768, 16_384, 256, 1024


class ChunkCounter(BpeEncoder):
    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        super().__init__(path)
        from tokenizers import Tokenizer, processors

        self.offset_tok = Tokenizer.from_file(path)
        self.offset_tok.post_processor = processors.ByteLevel(trim_offsets=False)
        special = self.offset_tok.get_added_tokens_decoder().values()
        self.margin = max([16, *(len(t.content) + 1 for t in special)])
        self.chunk, self.overlap, self.widened = chunk, overlap, 0

    def starts(self, text: str, at: int, to: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Where pre-tokens of ``text[at:to]`` start, the tokens before each, and all its tokens."""
        enc = self.offset_tok.encode(text[at:to], add_special_tokens=False)
        words = np.array(enc.word_ids, dtype=np.int64)
        if not len(words):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        first = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1])))
        offsets = np.array(enc.offsets, dtype=np.int64)[:, 0]
        return at + offsets[first], first, len(words)

    def spliced(self, text: str) -> int:
        n, total, done = len(text), 0, 0
        at, to = 0, min(len(text), self.chunk)
        left = self.starts(text, at, to)
        before = 0  # tokens of the left encoding before ``done``
        while to < n:
            overlap = self.overlap
            while True:
                at2 = max(done, to - overlap)
                to2 = min(n, max(at2 + self.chunk, to + self.chunk - self.overlap))
                right = self.starts(text, at2, to2)
                low = at2 + self.margin if at2 > done else done + 1
                both, i, j = np.intersect1d(left[0], right[0], assume_unique=True, return_indices=True)
                ok = np.flatnonzero((both >= low) & (both <= to - self.margin) & (both > done))
                if len(ok):
                    k = ok[len(ok) // 2]
                    total += int(left[1][i[k]]) - before
                    done, before, left, to = int(both[k]), int(right[1][j[k]]), right, to2
                    break
                self.widened += 1
                if at2 > done:
                    overlap *= 2
                    continue
                # nothing but one pre-token since the last boundary: the left chunk grows
                to = min(n, to + max(self.chunk, to - done))
                left, before = self.starts(text, done, to), 0
                if to == n:
                    break
        return total + left[2] - before

    def document_counts(self, buf: np.ndarray, offsets: np.ndarray, huge: int = HUGE) -> np.ndarray:
        sizes = np.diff(offsets)
        out = np.zeros(len(sizes), np.int64)
        long = np.flatnonzero(sizes > huge)
        first = 0
        for i in [*long.tolist(), len(sizes)]:
            if i > first:
                out[first:i] = self.counts(buf[offsets[first] : offsets[i]], offsets[first : i + 1] - offsets[first])
            if i < len(sizes):
                out[i] = self.spliced(buf[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
            first = i + 1
        return out


def counter(path: str) -> ChunkCounter:
    return kept(("counter", path), lambda: ChunkCounter(path))


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, huge: int = HUGE) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = counter(path)
        for batch in batches:
            buf, offsets = flat(batch.column(1))
            n = np.zeros(len(batch), np.int64)
            for a, b in parts(offsets):
                n[a:b] = enc.document_counts(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], huge)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n)], ["doc_id", "n_bytes", "n_tokens"])

    df = read_text(docs).withColumn("n_bytes", F.octet_length("text").cast("long"))
    kind = df.schema["doc_id"].dataType.simpleString()
    return df.mapInArrow(tidy(run), f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
