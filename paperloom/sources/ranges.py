"""Remote documents by byte ranges: only the parts that a task needs are read.

``Fetcher`` reads ranges of a source, merges those that lie close together and keeps what it has read.
``remote_archive`` fetches a ZIP's directory and the wanted entries. ``DocumentParts`` is a Spark data
source with a row a part; a filter on part names is pushed down, so media are never fetched for text.
"""

from __future__ import annotations

import re
import urllib.request
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith

from .containers import Archive, Entry, NotAContainer, _directory, open_zip

GAP, TAIL, AT_ONCE = 16 * 1024, 64 * 1024, 8


class Memory:
    """Bytes at hand."""

    def __init__(self, data: bytes):
        self.data = data

    def size(self) -> int:
        return len(self.data)

    def read(self, start: int, end: int) -> bytes:
        return self.data[start:end]


class File:
    """A file of the local or a mounted file system."""

    def __init__(self, path: str):
        self.path = path.removeprefix("file://")

    def size(self) -> int:
        with open(self.path, "rb") as f:
            return f.seek(0, 2)

    def read(self, start: int, end: int) -> bytes:
        with open(self.path, "rb") as f:
            f.seek(start)
            return f.read(end - start)


class Http:
    """``HEAD`` for the length, then range requests; one full download where ranges are ignored."""

    def __init__(self, url: str, timeout: float = 30.0):
        self.url, self.timeout, self.whole = url, timeout, None

    def size(self) -> int:
        request = urllib.request.Request(self.url, method="HEAD")
        with urllib.request.urlopen(request, timeout=self.timeout) as r:
            length = r.headers.get("Content-Length")
        if length is None:
            return len(self._all())
        return int(length)

    def _all(self) -> bytes:
        if self.whole is None:
            with urllib.request.urlopen(self.url, timeout=self.timeout) as r:
                self.whole = r.read()
        return self.whole

    def read(self, start: int, end: int) -> bytes:
        if self.whole is not None or end <= start:
            return (self.whole or b"")[start:end]
        request = urllib.request.Request(self.url, headers={"Range": f"bytes={start}-{end - 1}"})
        with urllib.request.urlopen(request, timeout=self.timeout) as r:
            data = r.read()
            if r.status == 206:
                return data
        self.whole = data
        return data[start:end]


def backend(path: str):
    return Http(path) if re.match("https?://", path) else File(path)


def merge(ranges: list[tuple[int, int]], gap: int = 0) -> list[tuple[int, int]]:
    """Disjoint ranges in order; two that lie at most ``gap`` apart become one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(r for r in ranges if r[0] < r[1]):
        if out and start <= out[-1][1] + gap:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def missing(held: list[tuple[int, int]], start: int, end: int) -> list[tuple[int, int]]:
    """What of a range the held, disjoint ranges leave out."""
    out = []
    for a, b in held:
        if b <= start or a >= end:
            continue
        if a > start:
            out.append((start, a))
        start = max(start, b)
    return [*out, (start, end)] if start < end else out


class Fetcher:
    def __init__(self, source, gap: int = GAP):
        self.source, self.gap = source, gap
        self.length = source.size()
        self.held: dict[tuple[int, int], bytes] = {}
        self.requests = self.bytes_fetched = 0

    def fetch(self, ranges: list[tuple[int, int]]) -> None:
        """Read what isn't held yet; close gaps are read too, several requests at once."""
        known = merge(list(self.held))
        wanted = [m for a, b in ranges for m in missing(known, max(0, a), min(b, self.length))]
        # a gap is closed only where nothing in it is held
        parts: list[tuple[int, int]] = []
        for a, b in merge(wanted):
            if parts and a - parts[-1][1] <= self.gap and missing(known, parts[-1][1], a) == [(parts[-1][1], a)]:
                parts[-1] = (parts[-1][0], b)
            else:
                parts.append((a, b))
        with ThreadPoolExecutor(AT_ONCE) as pool:
            for part, data in zip(parts, pool.map(lambda p: self.source.read(*p), parts), strict=True):
                self.held[part] = data
                self.requests += 1
                self.bytes_fetched += len(data)

    def get(self, start: int, end: int) -> bytes:
        end = min(end, self.length)
        self.fetch([(start, end)])
        out, at = [], start
        while at < end:
            a, data = next((a, d) for (a, b), d in self.held.items() if a <= at < b)
            piece = data[at - a : end - a]
            if not piece:
                raise EOFError(f"the source ended before {end}")
            out.append(piece)
            at += len(piece)
        return b"".join(out)


class RemoteArchive:
    """A ZIP read by ranges: its directory first, then the entries that are asked for."""

    def __init__(self, fetcher: Fetcher):
        self.fetcher = fetcher
        tail = max(0, fetcher.length - TAIL)
        data = fetcher.get(tail, fetcher.length)
        end = data.rfind(b"PK\x05\x06")
        if end < 0:
            self.archive = open_zip(fetcher.get(0, fetcher.length))
            return
        start = int.from_bytes(data[end + 16 : end + 20], "little")
        if start < tail and start < fetcher.length:
            data = fetcher.get(start, fetcher.length)
            tail = start
        entries = _directory(data, tail)
        self.archive = Archive(b"", entries) if entries else open_zip(fetcher.get(0, fetcher.length))

    def names(self) -> list[str]:
        return self.archive.names()

    def _span(self, e: Entry) -> tuple[int, int]:
        # the local header repeats the name; its extra field may be longer than the directory's
        return e.offset, e.offset + 30 + len(e.name.encode()) + 256 + e.stored

    def read_many(self, names: list[str]) -> dict[str, tuple[bytes, bool]]:
        entries = [e for n in names if (e := self.archive.find(n))]
        if self.archive.data:
            return {e.name: self.archive.read(e.name) for e in entries}
        self.fetcher.fetch([self._span(e) for e in entries])
        out = {}
        for e in entries:
            a, b = self._span(e)
            body = self.fetcher.get(a, min(b, self.fetcher.length))
            own = Entry(e.name, e.method, e.crc, e.stored, e.size, 0, e.sizes_known)
            out[e.name] = Archive(body, [own]).read(e.name)
        return out


def needed_for_text(name: str) -> bool:
    """Text needs XML and relationship parts alone."""
    return name.lower().endswith((".xml", ".rels"))


class _Document(InputPartition):
    def __init__(self, path: str):
        self.path = path


class PartsReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths, self.names, self.suffixes = paths, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Conditions on the part's name are taken; others go back to Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("name",):
                self.names = {f.value} if self.names is None else self.names & {f.value}
            elif isinstance(f, In) and f.attribute == ("name",):
                self.names = set(f.value) if self.names is None else self.names & set(f.value)
            elif isinstance(f, StringEndsWith) and f.attribute == ("name",):
                self.suffixes = [*(self.suffixes or []), f.value]
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [_Document(p) for p in self.paths]

    def wanted(self, name: str) -> bool:
        return (self.names is None or name in self.names) and all(name.endswith(s) for s in self.suffixes or [])

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        fetcher = Fetcher(backend(partition.path))
        try:
            box = RemoteArchive(fetcher)
        except NotAContainer:
            return
        parts = box.read_many([n for n in box.names() if self.wanted(n)])
        for name, (content, whole) in parts.items():
            yield partition.path, name, len(content), whole, content, fetcher.requests, fetcher.bytes_fetched


class DocumentParts(DataSource):
    """``spark.read.format("document_parts").option("paths", "a.docx,b.docx").load()``"""

    @classmethod
    def name(cls) -> str:
        return "document_parts"

    def schema(self) -> str:
        return "path string, name string, size long, whole boolean, content binary, requests int, bytes_fetched long"

    def reader(self, schema) -> DataSourceReader:
        paths = self.options.get("paths") or self.options.get("path") or ""
        return PartsReader([p for p in paths.split(",") if p])
