"""Formatting of Word 97-2003 binary files: runs and paragraphs from their pages, styles, fonts, lists, table rows."""

from __future__ import annotations

import struct
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

from ..functions.office import NUMBER_FORMATS
from ..model import Document, Level, RunFormat, Style

PAGE = 512
#: Places in the file information block.
STYLES, CHAR_PAGES, PARA_PAGES, FONTS, LISTS, OVERRIDES = 0xA2, 0xFA, 0x102, 0x112, 0x2E2, 0x2EA
#: Sizes of operands by the top three bits of a property's code; 0 is a length in front.
OPERANDS = (1, 1, 2, 4, 2, 2, 0, 3)
#: Property codes.
BOLD, ITALIC, STRIKE, VANISH, UNDERLINE, VERTICAL, FONT, SIZE, CHAR_STYLE, SYMBOL = 0x0835, 0x0836, 0x0837, 0x083C, 0x2A3E, 0x2A48, 0x4A4F, 0x4A43, 0x4A30, 0x6A09
DELETED = 0x0800
IN_TABLE, ROW_END, DEPTH, INNER_CELL, INNER_ROW_END = 0x2416, 0x2417, 0x6649, 0x244B, 0x244C
LIST_LEVEL, LIST, OUTLINE, PAGE_BEFORE, PARA_STYLE = 0x260A, 0x460B, 0x2640, 0x2407, 0x4600
TABLE_CELLS, TABLE_HEADER, TABS = 0xD608, 0x3404, 0xC615
TOGGLES = {BOLD: "bold", ITALIC: "italic", STRIKE: "strike", VANISH: "vanish"}


def place(stream: bytes, at: int) -> tuple[int, int]:
    """An offset and a size of the file information block; nothing where the block is shorter."""
    return struct.unpack_from("<II", stream, at) if at + 8 <= len(stream) else (0, 0)


def properties(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(code, operand) of a list of properties; a cut one ends it."""
    at = 0
    while at + 2 <= len(data):
        code = struct.unpack_from("<H", data, at)[0]
        at += 2
        size = OPERANDS[code >> 13]
        if code == TABLE_CELLS:
            if at + 2 > len(data):
                return
            size = struct.unpack_from("<H", data, at)[0] + 1
        elif not size:
            if at >= len(data):
                return
            size = data[at] + 1
            if code == TABS and data[at] == 255 and at + 1 < len(data):
                removed = data[at + 1]
                added = data[at + 2 + 4 * removed] if at + 2 + 4 * removed < len(data) else 0
                size = 3 + 4 * removed + 3 * added
        if at + size > len(data):
            return
        yield code, data[at : at + size]
        at += size


@dataclass
class ParaFormat:
    style: int = 0
    in_table: bool = False
    depth: int | None = None
    row_end: bool = False
    inner_cell: bool = False
    inner_row_end: bool = False
    list_id: int | None = None
    level: int = 0
    outline: int | None = None
    page_before: bool = False
    header: bool = False
    edges: list[int] = field(default_factory=list)
    cells: list[int] = field(default_factory=list)

    @property
    def tables(self) -> int:
        """How many tables the paragraph is in."""
        return self.depth if self.depth is not None else int(self.in_table)


def paragraph_format(base: ParaFormat, data: bytes) -> ParaFormat:
    p = replace(base)
    for code, value in properties(data):
        match code:
            case c if c == IN_TABLE:
                p.in_table = bool(value[0])
            case c if c == DEPTH:
                p.depth = struct.unpack("<I", value)[0]
            case c if c == ROW_END:
                p.row_end = bool(value[0])
            case c if c == INNER_CELL:
                p.inner_cell = bool(value[0])
            case c if c == INNER_ROW_END:
                p.inner_row_end = bool(value[0])
            case c if c == LIST:
                p.list_id = struct.unpack("<H", value)[0]
            case c if c == LIST_LEVEL:
                p.level = min(8, value[0])
            case c if c == OUTLINE:
                p.outline = value[0]
            case c if c == PAGE_BEFORE:
                p.page_before = bool(value[0])
            case c if c == TABLE_HEADER:
                p.header = bool(value[0])
            case c if c == TABLE_CELLS and len(value) > 2:
                n = value[2]
                if 3 + 2 * (n + 1) <= len(value):
                    p.edges = list(struct.unpack_from(f"<{n + 1}h", value, 3))
                    rest = value[3 + 2 * (n + 1) :]
                    p.cells = [struct.unpack_from("<H", rest, 20 * i)[0] if 20 * i + 2 <= len(rest) else 0 for i in range(n)]
    return p


def run_format(base: RunFormat, data: bytes, fonts: list[str], style: RunFormat | None = None) -> tuple[RunFormat, dict]:
    """The format that the properties make of ``base``, and what is no format: symbol, deleted."""
    f, more = replace(base), {}
    for code, value in properties(data):
        if code in TOGGLES:
            name = TOGGLES[code]
            if value[0] in (0, 1):
                setattr(f, name, bool(value[0]))
            elif value[0] == 0x81:
                setattr(f, name, not (getattr(style, name) if style else False))
            elif value[0] == 0x80:
                setattr(f, name, getattr(style, name) if style else None)
        elif code == UNDERLINE:
            f.underline = value[0] != 0
        elif code == VERTICAL:
            f.vertical = {1: "superscript", 2: "subscript"}.get(value[0], "baseline")
        elif code == SIZE:
            f.size = struct.unpack("<H", value)[0]
        elif code == CHAR_STYLE:
            f.style = style_id(struct.unpack("<H", value)[0])
        elif code == FONT:
            at = struct.unpack("<H", value)[0]
            f.font = fonts[at] if at < len(fonts) else f.font
        elif code == SYMBOL:
            at, char = struct.unpack("<HH", value)
            more["symbol"] = (fonts[at] if at < len(fonts) else None, char)
        elif code == DELETED:
            more["deleted"] = bool(value[0])
    return f, more


def style_id(number: int) -> str:
    return f"s{number}"


def _pages(stream: bytes, table: bytes, at: int) -> list[int]:
    start, size = place(stream, at)
    n = max(0, (size - 4) // 8)
    if not n or start + size > len(table):
        return []
    return [p & 0x3FFFFF for p in struct.unpack_from(f"<{n}I", table, start + 4 * (n + 1))]


def char_runs(stream: bytes, table: bytes) -> list[tuple[int, int, bytes]]:
    """(from, to, properties) by place in the stream, ascending."""
    out = []
    for number in _pages(stream, table, CHAR_PAGES):
        page = stream[number * PAGE : (number + 1) * PAGE]
        if len(page) < PAGE or 5 * page[-1] + 4 >= PAGE:
            continue
        n = page[-1]
        ends = struct.unpack_from(f"<{n + 1}I", page, 0)
        for i in range(n):
            at = 2 * page[4 * (n + 1) + i]
            data = page[at + 1 : at + 1 + page[at]] if at else b""
            out.append((ends[i], ends[i + 1], data))
    return sorted(out)


def para_runs(stream: bytes, table: bytes) -> list[tuple[int, int, int, bytes]]:
    """(from, to, style, properties) by place in the stream, ascending."""
    out = []
    for number in _pages(stream, table, PARA_PAGES):
        page = stream[number * PAGE : (number + 1) * PAGE]
        if len(page) < PAGE or 17 * page[-1] + 4 >= PAGE:
            continue
        n = page[-1]
        ends = struct.unpack_from(f"<{n + 1}I", page, 0)
        for i in range(n):
            at, style, data = 2 * page[4 * (n + 1) + 13 * i], 0, b""
            if at:
                size, begin = (2 * page[at] - 1, at + 1) if page[at] else (2 * page[at + 1], at + 2)
                body = page[begin : begin + size]
                if len(body) >= 2:
                    style, data = struct.unpack_from("<H", body)[0], body[2:]
            out.append((ends[i], ends[i + 1], style, data))
    return sorted(out)


def font_names(stream: bytes, table: bytes) -> list[str]:
    start, size = place(stream, FONTS)
    data = table[start : start + size]
    out, at = [], 4
    while at < len(data) and len(out) < 4096:
        end = at + 1 + data[at]
        # the name stands behind 39 bytes of properties, and ends with a zero
        out.append(data[at + 40 : end].decode("utf-16-le", "ignore").split("\0")[0])
        at = end
    return out


def read_styles(stream: bytes, table: bytes, fonts: list[str], doc: Document) -> dict[int, ParaFormat]:
    """The styles of the model, and each one's own paragraph properties."""
    start, size = place(stream, STYLES)
    data, own = table[start : start + size], {}
    if len(data) < 6:
        return own
    head, count, base_size = struct.unpack_from("<HHH", data)
    at = 2 + head
    for number in range(count):
        if at + 2 > len(data):
            break
        length = struct.unpack_from("<H", data, at)[0]
        std, at = data[at + 2 : at + 2 + length], at + 2 + length + (length & 1)
        if len(std) < base_size + 2 or base_size < 10:
            continue
        _, kind, counts = struct.unpack_from("<HHH", std)
        parent, parts, kind = kind >> 4, counts & 15, kind & 15
        chars = struct.unpack_from("<H", std, base_size)[0]
        place_ = base_size + 2 + 2 * chars
        name = std[base_size + 2 : place_].decode("utf-16-le", "ignore").split(",")[0]
        place_ += 2
        style = Style(style_id(number), name, {1: "paragraph", 2: "character", 3: "table", 4: "numbering"}.get(kind, "paragraph"), style_id(parent) if parent != 0xFFF else None, number == 0)
        for part in range(parts):
            place_ += place_ & 1
            if place_ + 2 > len(std):
                break
            n = struct.unpack_from("<H", std, place_)[0]
            body, place_ = std[place_ + 2 : place_ + 2 + n], place_ + 2 + n
            if kind == 1 and part == 0:
                own[number] = paragraph_format(ParaFormat(number), body[2:])
            elif kind == 1 and part == 1 or kind == 2 and part == 0:
                style.format = run_format(RunFormat(), body, fonts)[0]
        if number in own:
            style.outline = own[number].outline
            style.num_id, style.level = own[number].list_id, own[number].level
        doc.styles[style.id] = style
    return own


def _level(data: bytes, at: int, fonts: list[str]) -> tuple[Level | None, int]:
    if at + 28 > len(data):
        return None, len(data)
    start, code, info = struct.unpack_from("<iBB", data, at)
    chars, paras = data[at + 24], data[at + 25]
    at += 28 + paras
    font = run_format(RunFormat(), data[at : at + chars], fonts)[0].font
    at += chars
    if at + 2 > len(data):
        return None, len(data)
    n = struct.unpack_from("<H", data, at)[0]
    text = data[at + 2 : at + 2 + 2 * n].decode("utf-16-le", "ignore")
    text = "".join(f"%{ord(c) + 1}" if ord(c) < 9 else c for c in text)
    return Level(start, NUMBER_FORMATS.get(code, "decimal"), text, bool(info & 4), font), at + 2 + 2 * n


def read_lists(stream: bytes, table: bytes, fonts: list[str], doc: Document) -> None:
    start, size = place(stream, LISTS)
    if size < 2 or start + size > len(table):
        return
    count = struct.unpack_from("<H", table, start)[0]
    at, ids = start + size, {}
    for i in range(min(count, (size - 2) // 28)):
        row = table[start + 2 + 28 * i : start + 30 + 28 * i]
        ids[struct.unpack_from("<i", row)[0]] = i
        doc.abstracts[i] = {}
        for level in range(1 if row[26] & 1 else 9):
            found, at = _level(table, at, fonts)
            if found is not None:
                doc.abstracts[i][level] = found
    start, size = place(stream, OVERRIDES)
    if size < 4 or start + size > len(table):
        return
    n = min(struct.unpack_from("<I", table, start)[0], (size - 4) // 16)
    rows = [struct.unpack_from("<iIIB", table, start + 4 + 16 * i) for i in range(n)]
    at = start + 4 + 16 * n
    for number, (list_id, _, _, changes) in enumerate(rows, 1):
        starts, levels = {}, {}
        at += 4
        for _ in range(changes):
            if at + 8 > len(table):
                break
            first, bits = struct.unpack_from("<iI", table, at)
            at += 8
            if bits & 0x20:
                found, at = _level(table, at, fonts)
                if found is not None:
                    levels[bits & 15] = found
            elif bits & 0x10:
                starts[bits & 15] = first
        if list_id in ids:
            doc.instances[number] = (ids[list_id], starts, levels)


class Formats:
    """Formats by place in the stream."""

    def __init__(self, stream: bytes, table: bytes, doc: Document):
        self.doc, self.fonts = doc, font_names(stream, table)
        self.own = read_styles(stream, table, self.fonts, doc)
        read_lists(stream, table, self.fonts, doc)
        self.chars, self.paras = char_runs(stream, table), para_runs(stream, table)
        self.char_starts, self.para_starts = [c[0] for c in self.chars], [p[0] for p in self.paras]

    def paragraph(self, fc: int) -> ParaFormat:
        """The format of the paragraph whose mark stands at a place: the last run that starts at or before it."""
        i = bisect_right(self.para_starts, fc) - 1
        if i < 0 or fc >= self.paras[i][1]:
            return ParaFormat()
        _, _, style, data = self.paras[i]
        return paragraph_format(ParaFormat(style), data)

    def runs(self, start: int, end: int) -> Iterator[tuple[int, int, bytes]]:
        """The runs of [start, end), gaps as runs without properties."""
        at, i = start, max(0, bisect_right(self.char_starts, start) - 1)
        while at < end and i < len(self.chars):
            a, b, data = self.chars[i]
            if b <= at:
                i += 1
                continue
            if a >= end:
                break
            if a > at:
                yield at, a, b""
                at = a
            yield at, min(b, end), data
            at = min(b, end)
            i += 1
        if at < end:
            yield at, end, b""

    def style_run(self, style: str) -> RunFormat:
        """What a paragraph's style says of its runs, with its parents."""
        out, seen = RunFormat(), set()
        while style in self.doc.styles and style not in seen:
            seen.add(style)
            own = self.doc.styles[style]
            for name in ("bold", "italic", "strike", "vanish"):
                if getattr(out, name) is None:
                    setattr(out, name, getattr(own.format, name))
            style = own.based_on
        return out
