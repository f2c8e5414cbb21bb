"""Property sets of compound files: titles, authors, dates and counts."""

from __future__ import annotations

import struct
from datetime import UTC, datetime, timedelta

from .containers import CompoundFile

#: Names of the properties of the two summary streams.
SUMMARY = {2: "title", 3: "subject", 4: "creator", 5: "keywords", 6: "description", 8: "lastModifiedBy", 9: "revision", 12: "created", 13: "modified", 14: "pages", 15: "words", 16: "characters", 18: "application"}
DOCUMENT = {2: "category", 14: "manager", 15: "company"}


def iso_time(ticks: int) -> str | None:
    """100 ns ticks since 1601; 0 is none."""
    if not 0 < ticks < 1 << 62:
        return None
    try:
        return (datetime(1601, 1, 1, tzinfo=UTC) + timedelta(microseconds=ticks // 10)).strftime("%Y-%m-%dT%H:%M:%SZ")
    except OverflowError:
        return None


def _value(data: bytes, at: int, page: str):
    kind = struct.unpack_from("<I", data, at)[0] & 0xFFFF
    if kind == 2:
        return struct.unpack_from("<h", data, at + 4)[0]
    if kind in (3, 22):
        return struct.unpack_from("<i", data, at + 4)[0]
    if kind == 19:
        return struct.unpack_from("<I", data, at + 4)[0]
    if kind == 11:
        return struct.unpack_from("<h", data, at + 4)[0] != 0
    if kind == 64:
        return iso_time(struct.unpack_from("<Q", data, at + 4)[0])
    if kind in (30, 31):
        n = struct.unpack_from("<I", data, at + 4)[0]
        raw = data[at + 8 : at + 8 + n * (2 if kind == 31 else 1)]
        return raw.decode("utf-16-le" if kind == 31 else page, "replace").split("\0")[0]
    return None


def read_properties(data: bytes) -> dict[int, object]:
    """Number -> value of the first section; damaged entries are left out."""
    out: dict[int, object] = {}
    if len(data) < 48:
        return out
    start = struct.unpack_from("<I", data, 44)[0]
    page = "cp1252"
    try:
        count = min(10_000, struct.unpack_from("<I", data, start + 4)[0])
        places = [struct.unpack_from("<II", data, start + 8 + 8 * i) for i in range(count)]
    except struct.error:
        return out
    for key, at in sorted(places, key=lambda p: p[0] != 1):
        try:
            value = _value(data, start + at, page)
        except (struct.error, LookupError):
            continue
        if key == 1 and isinstance(value, int):
            number = value & 0xFFFF
            page = "utf-8" if number == 65001 else "utf-16-le" if number == 1200 else f"cp{number}"
            try:
                "".encode(page)
            except LookupError:
                page = "cp1252"
        elif value is not None:
            out[key] = value
    return out


def metadata(box: CompoundFile) -> dict[str, str]:
    out: dict[str, str] = {}
    for stream, names in (("\5SummaryInformation", SUMMARY), ("\5DocumentSummaryInformation", DOCUMENT)):
        data = box.read(stream)
        for key, value in (read_properties(data) if data else {}).items():
            if key in names and str(value).strip():
                out.setdefault(names[key], str(value).strip())
    return out
