"""Word 97-2003 binary files: text by the piece table, with formats, styles, lists, tables, notes and comments.

Pictures, drawings and sections are not read; what is left out is named in a diagnostic.
"""

from __future__ import annotations

import re
import struct

from ..model import Cell, Document, Note, Paragraph, Piece, Row, RunFormat, Table
from ..outputs.walk import symbol_char
from .containers import SIGNATURE, CompoundFile, NotAContainer, open_compound
from .crypt import PLAIN_HEAD, in_blocks, unlock_binary
from .doc_format import Formats, ParaFormat, place, run_format, style_id
from .docx import Encrypted
from .properties import metadata

#: Places in the file information block.
COUNTS, CLX, FOOTNOTES, COMMENTS, ENDNOTES, AUTHORS = 0x4C, 0x1A2, 0xAA, 0xBA, 0x20A, 0x1BA
#: Flags of the block, and the place of the size of the encryption's head.
ENCRYPTED, OBFUSCATED, KEY_SIZE = 0x100, 0x8000, 0x0E
#: Bits of a table cell's flags.
MERGED, DOWN, TOP = 0x2, 0x20, 0x40
KINDS = {"\t": "tab", "\x0b": "line", "\x0c": "page", "\x0e": "column"}


class Pieces:
    """The text's pieces: [cp_start, cp_end) -> place in the stream, 8 or 16 bits a character."""

    def __init__(self, stream: bytes, table: bytes, at: int, size: int):
        clx, k = table[at : at + size], 0
        while k < len(clx) and clx[k] == 1:
            k += 3 + struct.unpack_from("<H", clx, k + 1)[0]
        if k >= len(clx) or clx[k] != 2:
            raise NotAContainer("no piece table")
        n = struct.unpack_from("<I", clx, k + 1)[0]
        body = clx[k + 5 : k + 5 + n]
        count = (len(body) - 4) // 12
        cps = struct.unpack_from(f"<{count + 1}I", body, 0)
        self.rows = []
        for i in range(count):
            fc = struct.unpack_from("<I", body, 4 * (count + 1) + 8 * i + 2)[0]
            narrow = bool(fc & 0x40000000)
            fc &= 0x3FFFFFFF
            self.rows.append((cps[i], cps[i + 1], fc // 2 if narrow else fc, narrow))
        self.stream = stream

    def text(self) -> str:
        """A character for each position; missing ones are NUL, so positions stay right."""
        out = []
        for start, end, fc, narrow in self.rows:
            n = max(0, end - start)
            raw = self.stream[fc : fc + n * (1 if narrow else 2)]
            part = raw.decode("cp1252", "replace") if narrow else "".join(chr(u) for (u,) in struct.iter_unpack("<H", raw[: len(raw) // 2 * 2]))
            out.append(part.ljust(n, "\0")[:n])
        return "".join(out)


    def parts(self, start: int, end: int):
        """(first position, last, place in the stream, bytes a character) of the pieces of [start, end)."""
        for a, b, fc, narrow in self.rows:
            low, high = max(a, start), min(b, end)
            if low < high:
                width = 1 if narrow else 2
                yield low, high, fc + (low - a) * width, width

    def place(self, cp: int) -> int:
        return next((fc for _, _, fc, _ in self.parts(cp, cp + 1)), -1)


def hyperlink(code: str) -> tuple[str | None, str | None] | None:
    """Target and anchor of a field's code, or None for another field."""
    m = re.match(r"\s*HYPERLINK\b(.*)", code, re.S)
    if not m:
        return None
    target = anchor = None
    for switch, quoted, bare in re.findall(r'(\\[a-z])?\s*(?:"([^"]*)"|([^\s"\\]+))', m[1]):
        if switch == "\\l":
            anchor = quoted or bare
        elif not switch and target is None:
            target = quoted or bare
    return target, anchor


class Reader:
    def __init__(self, doc: Document, text: str, pieces: Pieces, formats: Formats):
        self.doc, self.text, self.pieces, self.formats = doc, text, pieces, formats
        #: Notes and comments by the position of their mark.
        self.marks: dict[int, tuple[str, int]] = {}
        self.links = 0

    def spans(self, start: int, end: int):
        """(text, properties) of the runs of [start, end), with the first position of each."""
        for low, high, fc, width in self.pieces.parts(start, end):
            for a, b, data in self.formats.runs(fc, fc + (high - low) * width):
                first, last = low + (a - fc) // width, low + (b - fc) // width
                if first < last:
                    yield first, self.text[first:last], data

    def inline(self, start: int, end: int, style: str) -> list[Piece]:
        out: list[Piece] = []
        fields: list[dict] = []
        base = self.formats.style_run(style)
        run, run_format_, run_link = "", RunFormat(), (None, 0)

        def flush():
            nonlocal run
            if run:
                whole = run.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
                out.append(Piece("text", whole, run_format_, *run_link))
            run = ""

        for at, text, data in self.spans(start, end):
            fmt, more = run_format(RunFormat(), data, self.formats.fonts, base)
            if more.get("deleted"):
                continue
            if fmt != run_format_:
                flush()
                run_format_ = fmt
            for k, c in enumerate(text, at):
                link = next((f["link"] for f in reversed(fields) if f["link"]), (None, 0))
                if link != run_link:
                    flush()
                    run_link = link
                if c == "\x13":
                    fields.append({"code": "", "open": True, "link": None})
                elif c == "\x14" and fields:
                    fields[-1]["open"] = False
                    found = hyperlink(fields[-1]["code"])
                    if found is not None:
                        self.links += 1
                        fields[-1]["link"] = (found, self.links)
                elif c == "\x15":
                    if fields:
                        fields.pop()
                elif any(f["open"] for f in fields):
                    fields[-1]["code"] += c
                elif c in KINDS or k in self.marks:
                    flush()
                    kind, ref = self.marks.get(k, (KINDS.get(c), None))
                    out.append(Piece(kind, "", fmt, *link, ref))
                elif c == "\x28" and "symbol" in more:
                    run += symbol_char(more["symbol"][1], more["symbol"][0])
                elif c == "\x1e":
                    run += "-"
                elif c >= " " and c != "\x7f" or c == "\n":
                    run += c
        flush()
        return out

    def paragraph(self, start: int, end: int, f: ParaFormat) -> Paragraph:
        style = style_id(f.style) if style_id(f.style) in self.doc.styles else None
        return Paragraph(style, f.list_id, f.level, f.outline if f.outline is not None and f.outline < 9 else None, f.page_before, self.inline(start, end, style or ""))

    def story(self, start: int, end: int) -> list:
        """Paragraphs end at a carriage return or a cell mark; a paragraph's depth says in how many tables it is."""
        blocks: list = []
        open_: list[dict] = []

        def close() -> None:
            top = open_.pop()
            if top["row"] or top["cell"]:
                add_row(top, ParaFormat())
            if top["rows"]:
                into = open_[-1]["cell"] if open_ else blocks
                into.append(table_of(top["rows"]))

        def add_row(top: dict, f: ParaFormat) -> None:
            if top["cell"]:
                top["row"].append(Cell(top["cell"]))
            top["rows"].append((top["row"], f))
            top["row"], top["cell"] = [], []

        at, styled = start, bool(self.formats.paras)
        while at < end:
            ends = [k for k in (self.text.find("\r", at, end), self.text.find("\x07", at, end)) if k >= 0]
            stop = min(ends, default=end)
            f = self.formats.paragraph(self.pieces.place(stop)) if styled else ParaFormat()
            is_cell = self.text[stop : stop + 1] == "\x07"
            depth = f.tables if styled else self.guess(at, stop, end, open_)
            while len(open_) > depth:
                close()
            while len(open_) < depth:
                open_.append({"rows": [], "row": [], "cell": []})
            if not depth:
                blocks.append(self.paragraph(at, stop, f))
            elif (f.row_end or f.inner_row_end) if styled else is_cell and at == stop and not open_[-1]["cell"] and open_[-1]["row"]:
                add_row(open_[-1], f)
            else:
                open_[-1]["cell"].append(self.paragraph(at, stop, f))
                if is_cell or f.inner_cell:
                    open_[-1]["row"].append(Cell(open_[-1]["cell"]))
                    open_[-1]["cell"] = []
            at = stop + 1
        while open_:
            close()
        return blocks

    def guess(self, at: int, stop: int, end: int, open_: list) -> int:
        """In files without paragraph formats: a cell mark is in a table, and what follows cells of an open row."""
        if self.text[stop : stop + 1] == "\x07":
            return 1
        return int(bool(open_ and open_[-1]["row"]) and "\x07" in self.text[stop:end])

    def notes(self, kind: str, refs: list[int], bounds: list[int], start: int, size: int, into: dict, authors: list[str | None] | None = None) -> None:
        for n, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False), 1):
            if n > len(refs) or a > size:
                break
            last = start + min(b, size)
            while last > start + a and self.text[last - 1] == "\r":
                last -= 1
            into[n] = Note(n, kind, self.story(start + a, last), authors[n - 1] if authors else None)


def table_of(rows: list[tuple[list[Cell], ParaFormat]]) -> Table:
    """Cells span the columns between their edges; cells merged into the one before go."""
    grid = sorted({e for _, f in rows for e in f.edges})
    out = Table(grid=[b - a for a, b in zip(grid, grid[1:], strict=False)])
    for cells, f in rows:
        kept: list[Cell] = []
        for i, cell in enumerate(cells):
            flags = f.cells[i] if i < len(f.cells) else 0
            wide = grid.index(f.edges[i + 1]) - grid.index(f.edges[i]) if i + 1 < len(f.edges) else 1
            if flags & MERGED and kept:
                kept[-1].span += wide
                continue
            cell.span = max(1, wide)
            cell.merge = "restart" if flags & TOP else "continue" if flags & DOWN else None
            kept.append(cell)
        out.rows.append(Row(kept, f.header))
    return out


def _positions(table: bytes, at: int, size: int, width: int) -> list[int]:
    n = max(0, (size - 4) // (4 + width))
    return list(struct.unpack_from(f"<{n + 1}I", table, at)) if n and at + 4 * (n + 1) <= len(table) else []


def read_doc(data: bytes, password: str | None = None) -> Document:
    doc = Document("doc")
    if data[:8] != SIGNATURE:
        raise NotAContainer("only files in a compound container are read")
    box: CompoundFile = open_compound(data)
    stream = box.read("WordDocument")
    if stream is None or len(stream) < CLX + 8:
        raise NotAContainer("no document stream")
    flags = struct.unpack_from("<H", stream, 10)[0]
    table = box.read("1Table" if flags & 0x200 else "0Table")
    if table is None:
        raise NotAContainer("no table stream")
    if flags & ENCRYPTED:
        if password is None:
            raise Encrypted("the document is encrypted")
        if flags & OBFUSCATED:
            raise Encrypted("unsupported encryption")
        key, head = unlock_binary(table, password), struct.unpack_from("<I", stream, KEY_SIZE)[0]
        table, stream = in_blocks(table, key, min(head, len(table))), in_blocks(stream, key, PLAIN_HEAD)
    pieces = Pieces(stream, table, *struct.unpack_from("<II", stream, CLX))
    text = pieces.text()
    counts = [max(0, n) for n in struct.unpack_from("<6i", stream, COUNTS)]
    main, footnotes, headers, macros, comments, endnotes = counts
    main = min(main, len(text))
    reader = Reader(doc, text, pieces, Formats(stream, table, doc))
    begin = {"footnote": (main, footnotes), "comment": (main + footnotes + headers + macros, comments), "endnote": (main + footnotes + headers + macros + comments, endnotes)}
    found = {}
    for kind, at, width in (("footnote", FOOTNOTES, 2), ("comment", COMMENTS, 30), ("endnote", ENDNOTES, 2)):
        refs = _positions(table, *place(stream, at), width)[:-1]
        found[kind] = (refs, _positions(table, *place(stream, at + 8), 0))
        reader.marks |= {cp: (kind, n) for n, cp in enumerate(refs, 1)}
    doc.sections = [reader.story(0, main)]
    for kind, into in (("footnote", doc.footnotes), ("endnote", doc.endnotes), ("comment", doc.comments)):
        authors = _authors(stream, table, len(found[kind][0])) if kind == "comment" else None
        reader.notes(kind, *found[kind], *begin[kind], into, authors)
    doc.metadata = metadata(box)
    doc.note("approximated", "document", "pictures, drawings and sections of binary files are not read")
    return doc


def _authors(stream: bytes, table: bytes, count: int) -> list[str | None]:
    """The author of each comment, by the number that its reference holds."""
    start, size = place(stream, AUTHORS)
    names, at = [], start
    while at + 2 <= min(start + size, len(table)):
        n = struct.unpack_from("<H", table, at)[0]
        names.append(table[at + 2 : at + 2 + 2 * n].decode("utf-16-le", "ignore"))
        at += 2 + 2 * n
    start, _ = place(stream, COMMENTS)
    out = []
    for i in range(count):
        at = start + 4 * (count + 1) + 30 * i + 20
        number = struct.unpack_from("<H", table, at)[0] if at + 2 <= len(table) else -1
        out.append(names[number] if 0 <= number < len(names) else None)
    return out
