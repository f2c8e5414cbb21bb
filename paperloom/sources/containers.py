"""ZIP archives and compound files, read leniently: damage costs the damaged part, not the file."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field


class NotAContainer(ValueError):
    """The bytes hold no archive that could be read."""


@dataclass(frozen=True)
class Limits:
    """Bounds on what a part may unpack to."""

    entry: int = 1 << 30
    ratio: int = 1000
    ratio_floor: int = 16 << 20


@dataclass
class Entry:
    name: str
    method: int
    crc: int
    stored: int
    size: int
    offset: int
    sizes_known: bool = True


@dataclass
class Archive:
    data: bytes
    entries: list[Entry]
    recovered: bool = False
    limits: Limits = field(default_factory=Limits)

    def names(self) -> list[str]:
        return [e.name for e in self.entries]

    def find(self, name: str) -> Entry | None:
        """By exact name, else without regard to case, a leading slash or the kind of slash."""
        plain = lambda n: n.replace("\\", "/").lstrip("/").lower()
        for e in self.entries:
            if e.name == name:
                return e
        wanted = plain(name)
        return next((e for e in self.entries if plain(e.name) == wanted), None)

    def read(self, name: str) -> tuple[bytes, bool] | None:
        """(content, whether it is whole); a damaged stream gives what could be unpacked."""
        e = self.find(name)
        if e is None:
            return None
        head = self.data[e.offset : e.offset + 30]
        if len(head) < 30 or head[:4] != b"PK\x03\x04":
            return b"", False
        n, m = struct.unpack("<HH", head[26:30])
        at = e.offset + 30 + n + m
        body = self.data[at : at + e.stored] if e.sizes_known else self.data[at:]
        if e.method == 0:
            out, whole = body, len(body) == e.stored or not e.sizes_known
        elif e.method == 8:
            out, whole = self._inflate(body)
        else:
            return b"", False
        right = zlib.crc32(out) == e.crc or (not e.sizes_known and e.crc == 0)
        return out, whole and right

    def _inflate(self, body: bytes) -> tuple[bytes, bool]:
        engine, out, size = zlib.decompressobj(-15), [], 0
        try:
            rest = body
            while rest and not engine.eof:
                piece = engine.decompress(rest, 1 << 20)
                size += len(piece)
                out.append(piece)
                if size > self.limits.entry or size > self.limits.ratio_floor and size > self.limits.ratio * max(1, len(body)):
                    return b"".join(out), False
                rest = engine.unconsumed_tail
            out.append(engine.flush())
        except zlib.error:
            return b"".join(out), False
        return b"".join(out), engine.eof


def _name(raw: bytes, flags: int) -> str:
    return raw.decode("utf-8", "replace") if flags & 0x800 else raw.decode("cp437")


def _wide(extra: bytes, values: list[int]) -> list[int]:
    """Sizes and the offset from the 64-bit extra field, for those that are saturated."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            body, k = extra[at + 4 : at + 4 + n], 0
            out = []
            for v in values:
                if v == 0xFFFFFFFF and k + 8 <= len(body):
                    out.append(struct.unpack_from("<Q", body, k)[0])
                    k += 8
                else:
                    out.append(v)
            return out
        at += 4 + n
    return values


def _directory(data: bytes, base: int = 0) -> list[Entry]:
    """The entries listed at the end of ``data``, which is the file from offset ``base`` on."""
    end = data.rfind(b"PK\x05\x06", max(0, len(data) - 65_557))
    if end < 0 or end + 22 > len(data):
        return []
    count, _, start = struct.unpack_from("<HII", data, end + 10)
    if start == 0xFFFFFFFF or count == 0xFFFF:
        locator = end - 20
        if locator >= 0 and data[locator : locator + 4] == b"PK\x06\x07":
            wide = struct.unpack_from("<Q", data, locator + 8)[0] - base
            if wide >= 0 and data[wide : wide + 4] == b"PK\x06\x06" and wide + 56 <= len(data):
                count, _, start = struct.unpack_from("<QQQ", data, wide + 32)
    out, at = [], start - base
    while at >= 0 and len(out) < count and data[at : at + 4] == b"PK\x01\x02" and at + 46 <= len(data):
        flags, method = struct.unpack_from("<HH", data, at + 8)
        crc, stored, size, n, m, k = struct.unpack_from("<IIIHHH", data, at + 16)
        offset = struct.unpack_from("<I", data, at + 42)[0]
        raw, extra = data[at + 46 : at + 46 + n], data[at + 46 + n : at + 46 + n + m]
        size, stored, offset = _wide(extra, [size, stored, offset])
        out.append(Entry(_name(raw, flags), method, crc, stored, size, offset))
        at += 46 + n + m + k
    return out


def _scan(data: bytes) -> list[Entry]:
    """Local headers in order; the first of a name counts."""
    out: dict[str, Entry] = {}
    at = data.find(b"PK\x03\x04")
    while at >= 0:
        if at + 30 > len(data):
            break
        flags, method = struct.unpack_from("<HH", data, at + 6)
        crc, stored, size, n, m = struct.unpack_from("<IIIHH", data, at + 14)
        if method in (0, 8) and n:
            name = _name(data[at + 30 : at + 30 + n], flags)
            size, stored = _wide(data[at + 30 + n : at + 30 + n + m], [size, stored])
            known = not (flags & 8 and stored == 0)
            out.setdefault(name, Entry(name, method, crc, stored, size, at, known))
            skip = 30 + n + m + (stored if known else 0)
        else:
            skip = 4
        at = data.find(b"PK\x03\x04", at + skip)
    return list(out.values())


def open_zip(data: bytes, limits: Limits | None = None) -> Archive:
    """Through the central directory; without a usable one from local headers."""
    entries = _directory(data)
    recovered = not entries
    if recovered:
        entries = _scan(data)
    if not entries:
        raise NotAContainer("no ZIP entries")
    return Archive(data, entries, recovered, limits or Limits())


# Compound files -----------------------------------------------------------------------------

SIGNATURE = bytes.fromhex("D0CF11E0A1B11AE1")
FREE, END = 0xFFFFFFFF, 0xFFFFFFFE


@dataclass
class Stream:
    name: str
    path: str
    start: int
    size: int


@dataclass
class CompoundFile:
    data: bytes
    sector: int
    mini: int
    cutoff: int
    fat: list[int]
    minifat: list[int]
    streams: list[Stream]
    root: bytes
    damaged: bool = False

    def names(self) -> list[str]:
        return [s.path for s in self.streams]

    def find(self, path: str) -> Stream | None:
        return next((s for s in self.streams if s.path.lower() == path.lower()), None)

    def read(self, path: str) -> bytes | None:
        s = self.find(path)
        if s is None:
            return None
        if s.size < self.cutoff:
            chain = _walk(self.minifat, s.start)
            return b"".join(self.root[k * self.mini : (k + 1) * self.mini] for k in chain)[: s.size]
        return _chain(self.data, self.fat, s.start, self.sector)[: s.size]


def _walk(table: list[int], start: int) -> list[int]:
    """A chain of sectors, cut at a loop or a number outside the table."""
    out, seen, at = [], set(), start
    while at < len(table) and at not in seen:
        seen.add(at)
        out.append(at)
        at = table[at]
    return out


def _chain(data: bytes, fat: list[int], start: int, sector: int) -> bytes:
    return b"".join(data[(k + 1) * sector : (k + 2) * sector] for k in _walk(fat, start))


def open_compound(data: bytes) -> CompoundFile:
    if data[:8] != SIGNATURE or len(data) < 512:
        raise NotAContainer("no compound file")
    shift, mini_shift = struct.unpack_from("<HH", data, 30)
    if not 7 <= shift <= 16 or mini_shift > shift:
        raise NotAContainer("bad sector size")
    sector, mini = 1 << shift, 1 << mini_shift
    first_dir, _, cutoff, first_mini, _, first_difat, _ = struct.unpack_from("<IIIIIII", data, 48)
    difat = list(struct.unpack_from("<109I", data, 76))
    seen = set()
    while first_difat < FREE - 5 and first_difat not in seen:
        seen.add(first_difat)
        block = data[(first_difat + 1) * sector : (first_difat + 2) * sector]
        if len(block) < sector:
            break
        values = struct.unpack(f"<{sector // 4}I", block)
        difat += values[:-1]
        first_difat = values[-1]
    fat: list[int] = []
    for k in difat:
        if k < FREE - 5:
            block = data[(k + 1) * sector : (k + 2) * sector]
            fat += struct.unpack(f"<{len(block) // 4}I", block[: len(block) // 4 * 4])
    directory = _chain(data, fat, first_dir, sector)
    nodes = []
    for at in range(0, len(directory) - 127, 128):
        raw = directory[at : at + 128]
        n = struct.unpack_from("<H", raw, 64)[0]
        left, right, child = struct.unpack_from("<III", raw, 68)
        start, size = struct.unpack_from("<IQ", raw, 116)
        if shift == 9:
            size &= 0xFFFFFFFF
        nodes.append((raw[: max(0, min(n, 64) - 2)].decode("utf-16-le", "replace"), raw[66], left, right, child, start, size))
    if not nodes:
        raise NotAContainer("no directory")
    blob = _chain(data, fat, first_mini, sector)
    minifat = list(struct.unpack(f"<{len(blob) // 4}I", blob[: len(blob) // 4 * 4]))
    root = _chain(data, fat, nodes[0][5], sector)
    streams: list[Stream] = []
    done: set[int] = set()
    todo = [(nodes[0][4], "")]
    while todo:
        k, prefix = todo.pop()
        if k >= len(nodes) or k in done:
            continue
        done.add(k)
        name, kind, left, right, child, start, size = nodes[k]
        todo += [(left, prefix), (right, prefix)]
        if kind == 2:
            streams.append(Stream(name, prefix + name, start, size))
        elif kind == 1:
            todo.append((child, f"{prefix}{name}/"))
    return CompoundFile(data, sector, mini, cutoff, fat, minifat, sorted(streams, key=lambda s: s.path), root)


def detect(data: bytes) -> str:
    """docx, doc, encrypted_docx, rtf or unknown."""
    if data[:4] in (b"PK\x03\x04", b"PK\x05\x06", b"PK\x07\x08"):
        return "docx"
    if data[:5] == b"{\\rtf":
        return "rtf"
    if data[:8] == SIGNATURE:
        try:
            names = {n.lower() for n in open_compound(data).names()}
        except NotAContainer:
            return "unknown"
        return "doc" if "worddocument" in names else "encrypted_docx" if "encryptedpackage" in names else "unknown"
    return "doc" if data[:2] in (b"\xdb\xa5", b"\xec\xa5") else "unknown"
