"""Pagination with fixed metrics: greedy line breaking, page breaks, keep-with-next headings, widows and
orphans, repeated header rows, footnotes at the foot of the page.

Widths come from a table of character classes, not from fonts, so page counts are near those of a word
processor but not equal. Blocks stay whole in the slices: a block belongs to the page it starts on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Document, Paragraph, Table
from ..outputs.text import TextWriter
from ..outputs.walk import Resolver

MAX_PAGES = 100_000
#: Widths in thousandths of the font size, by class.
NARROW, WIDE = set("iljtfrI.,;:'!|()[] "), set("mwMW@%—")


@dataclass(frozen=True)
class PageSetup:
    """Points; A4 with margins of one inch."""

    width: float = 595.3
    height: float = 841.9
    margin: float = 72.0
    size: float = 11.0
    leading: float = 1.22

    @property
    def line(self) -> float:
        return self.size * self.leading

    @property
    def columns(self) -> float:
        return self.width - 2 * self.margin

    @property
    def room(self) -> float:
        return self.height - 2 * self.margin


@dataclass
class Page:
    number: int
    block_start: int
    block_end: int
    lines: list[str] = field(default_factory=list)
    notes: list[int] = field(default_factory=list)


def char_width(c: str, size: float) -> float:
    if c in NARROW:
        return 0.28 * size
    if c in WIDE or ord(c) >= 0x2E80:
        return (1.0 if ord(c) >= 0x2E80 else 0.85) * size
    return (0.65 if c.isupper() else 0.52) * size


def break_lines(text: str, width: float, size: float) -> list[str]:
    """Greedy lines: words go on while they fit; a word wider than the line is cut; line feeds break."""
    out: list[str] = []
    for part in text.split("\n"):
        line, used = "", 0.0
        for word in re.findall(r"\S+\s*|\s+", part):
            ink = sum(char_width(c, size) for c in word.rstrip())
            if line and used + ink > width:
                out.append(line.rstrip())
                line, used = "", 0.0
            while ink > width:
                cut, taken = 0, 0.0
                while cut < len(word) and (cut == 0 or taken + char_width(word[cut], size) <= width):
                    taken += char_width(word[cut], size)
                    cut += 1
                out.append(word[:cut])
                word = word[cut:]
                ink = sum(char_width(c, size) for c in word.rstrip())
            line += word
            used += sum(char_width(c, size) for c in word)
        out.append(line.rstrip())
    return out


@dataclass
class _Slab:
    """Lines of a block that stay in order: what may split, what is kept, notes referred to."""

    block: int
    lines: list[str]
    height: float
    keep_next: bool = False
    split: bool = True
    break_before: bool = False
    break_after: bool = False
    repeat: list[str] = field(default_factory=list)
    notes: list[int] = field(default_factory=list)


def _slabs(doc: Document, setup: PageSetup) -> Iterator[_Slab]:
    writer, resolver, number = TextWriter(doc), Resolver(doc), 0
    for index, section in enumerate(doc.sections):
        for at, block in enumerate(section):
            fresh = index > 0 and at == 0
            if isinstance(block, Table):
                head: list[str] = []
                for i, row in enumerate(block.rows):
                    cells = [break_lines(writer.cell(c.blocks), setup.columns * c.span / max(1, sum(x.span for x in row.cells)), setup.size) for c in row.cells]
                    tall = max(map(len, cells), default=1)
                    lines = ["\t".join(c[k] if k < len(c) else "" for c in cells) for k in range(tall)]
                    if row.header and i == len(head):
                        head += lines
                    yield _Slab(number, lines, setup.line, split=False, break_before=fresh and i == 0, repeat=[] if row.header else list(head))
            else:
                _, heading, _ = resolver.paragraph(block)
                size = setup.size * (1.6 - 0.1 * min(heading, 5)) if heading is not None else setup.size
                # a page break inside a paragraph splits it
                for k, part in enumerate(_at_page_breaks(writer, block)):
                    yield _Slab(
                        number, break_lines(part, setup.columns, size), size * setup.leading, keep_next=heading is not None,
                        break_before=k > 0 or fresh or block.page_break_before,
                        notes=[p.ref for p in block.pieces if p.kind == "footnote"] if k == 0 else [],
                    )
            number += 1


def _at_page_breaks(writer: TextWriter, block: Paragraph) -> list[str]:
    if not any(p.kind == "page" for p in block.pieces):
        return [writer.line(block)]
    parts, now = [], []
    for p in block.pieces:
        if p.kind == "page":
            parts.append(now)
            now = []
        else:
            now.append(p)
    parts.append(now)
    first, *rest = parts
    out = [writer.line(Paragraph(block.style, block.num_id, block.level, block.outline, pieces=first))]
    out += ["".join({"text": p.text, "tab": "\t", "line": "\n"}.get(p.kind, "") for p in part) for part in rest]
    return out if out[-1] or len(out) == 1 else [*out[:-1], ""]


def paginate(doc: Document, setup: PageSetup | None = None) -> list[Page]:
    """The document's pages; at least one. Ranges of blocks are contiguous and cover all blocks."""
    setup = setup or PageSetup()
    pages = [Page(1, 0, 0)]
    room = setup.room
    note_heights = {ref: setup.line * sum(len(break_lines(writer_line, setup.columns, setup.size)) for writer_line in TextWriter(doc).story(n.blocks)) for ref, n in doc.footnotes.items()}
    slabs = list(_slabs(doc, setup))
    used = 0.0

    def turn() -> None:
        nonlocal used
        if len(pages) >= MAX_PAGES:
            return
        pages.append(Page(len(pages) + 1, 0, 0))
        used = 0.0

    last_block = -1
    for k, s in enumerate(slabs):
        if s.break_before and (pages[-1].lines or last_block >= 0):
            turn()
        need = s.height * len(s.lines)
        foot = sum(note_heights.get(n, 0.0) for n in s.notes) + (12.0 if s.notes and not pages[-1].notes else 0.0)
        # a heading stays with the first two lines that follow
        ahead, j = 0.0, k
        while slabs[j].keep_next and j + 1 < len(slabs) and j - k < 64:
            j += 1
            ahead += slabs[j].height * min(2, len(slabs[j].lines))
        if pages[-1].lines and used + need + foot + ahead > room:
            fit = int((room - used - foot) // s.height) if s.split and not s.keep_next else 0
            # no widow and no orphan: at least two lines on either side
            fit = min(fit, len(s.lines) - 2)
            if fit >= 2:
                start_page = pages[-1]
                _place(start_page, s, s.lines[:fit])
                turn()
                last_block = s.block
                s = _Slab(s.block, s.lines[fit:], s.height, notes=s.notes)
            else:
                turn()
                if s.repeat:
                    pages[-1].lines += s.repeat
                    used += s.height * len(s.repeat)
        while len(s.lines) * s.height > room - used and s.split and len(pages) < MAX_PAGES:
            fit = max(1, int((room - used) // s.height))
            if fit >= len(s.lines):
                break
            _place(pages[-1], s, s.lines[:fit])
            turn()
            s = _Slab(s.block, s.lines[fit:], s.height, notes=s.notes)
        _place(pages[-1], s, s.lines)
        used += s.height * len(s.lines) + foot
        pages[-1].notes += s.notes
        last_block = s.block
    _ranges(pages, slabs)
    if len(pages) >= MAX_PAGES:
        doc.note("dropped", "layout", f"more than {MAX_PAGES} pages")
    return pages


def _place(page: Page, slab: _Slab, lines: list[str]) -> None:
    if not page.lines and not page.block_end:
        page.block_start = slab.block
    page.block_end = slab.block + 1
    page.lines += lines


def _ranges(pages: list[Page], slabs: list[_Slab]) -> None:
    """A block counts to the page it starts on, so the ranges are contiguous and cover all."""
    total = slabs[-1].block + 1 if slabs else 0
    reached = 0
    for i, page in enumerate(pages):
        end = max(reached, min(page.block_end, total)) if i < len(pages) - 1 else total
        page.block_start, page.block_end = reached, end
        reached = end


def select_pages(pages: list[Page], index) -> list[Page]:
    """A page by number from 0, negative from the end, or a slice."""
    if isinstance(index, slice):
        return pages[index]
    if not -len(pages) <= index < len(pages):
        raise IndexError(f"page {index} of {len(pages)}")
    return [pages[index]]


def pages_of(files: DataFrame, key: str = "path", content: str = "content", setup: PageSetup | None = None) -> DataFrame:
    """(key, page, block_start, block_end, n_lines, text) for each page of each file that can be read."""
    from ..plans.documents import read_document

    own = files.select(F.col(key).alias("key"), F.col(content).alias("content"))
    kind = own.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                try:
                    pages = paginate(read_document(batch.column(1)[at].as_py() or b""), setup)
                except (ValueError, RecursionError, IndexError, KeyError):
                    continue
                names = ["key", "page", "block_start", "block_end", "n_lines", "text"]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column(0)[at].as_py()] * len(pages), batch.schema.field(0).type),
                        *(pa.array([v(p) for p in pages], pa.int32()) for v in (lambda p: p.number, lambda p: p.block_start, lambda p: p.block_end, lambda p: len(p.lines))),
                        pa.array(["\n".join(p.lines) for p in pages], pa.string()),
                    ],
                    names,
                )

    return own.mapInArrow(run, f"key {kind}, page int, block_start int, block_end int, n_lines int, text string").withColumnRenamed("key", key)
