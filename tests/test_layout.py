"""Pagination: invariants, and the pages of files as rows."""

import random
import re

import pytest

from paperloom.layout import PageSetup, pages_of, paginate, select_pages
from paperloom.layout.pages import break_lines, char_width
from paperloom.model import Cell, Document, Note, Paragraph, Piece, Row, Style, Table
from paperloom.sinks.docx import write_docx

SMALL = PageSetup(width=300, height=400, margin=50)


def para(text, **kw):
    return Paragraph(pieces=[Piece("text", text)], **kw)


def words(n, seed=0):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 12))) for _ in range(n))


def document(*blocks):
    doc = Document(sections=[list(blocks)])
    doc.styles = {"H": Style("H", "heading 1", outline=0)}
    return doc


def check(doc, setup=SMALL):
    pages = paginate(doc, setup)
    total = sum(map(len, doc.sections))
    assert pages[0].block_start == 0 and pages[-1].block_end == total
    assert all(a.block_end == b.block_start for a, b in zip(pages, pages[1:], strict=False))
    assert [p.number for p in pages] == list(range(1, len(pages) + 1))
    return pages


def test_lines_fit_and_hold_all_words():
    text = words(400) + " " + "x" * 300
    lines = break_lines(text, 180, 11)
    assert "".join(lines).replace(" ", "") == text.replace(" ", "")
    assert all(sum(char_width(c, 11) for c in line) <= 180.001 for line in lines)
    assert break_lines("", 100, 11) == [""] and break_lines("a\n\nb", 100, 11) == ["a", "", "b"]


@pytest.mark.parametrize("seed", range(6))
def test_every_word_once(seed):
    rng = random.Random(seed)
    doc = document(*(para(words(rng.randint(1, 300), seed * 100 + i), style="H" if rng.random() < 0.2 else None) for i in range(30)))
    pages = check(doc)
    source = re.findall(r"\S+", " ".join(p.pieces[0].text for p in doc.sections[0]))
    assert "".join("".join(p.lines) for p in pages).replace(" ", "") == "".join(source)
    assert all(len(p.lines) <= SMALL.room / SMALL.line + 1 for p in pages)


def test_breaks_headings_and_sections():
    pages = check(document(para("one"), para("two", page_break_before=True), Paragraph(pieces=[Piece("text", "three"), Piece("page"), Piece("text", "four")])))
    assert [p.lines for p in pages] == [["one"], ["two", "three"], ["four"]]
    lines = int(SMALL.room // SMALL.line)
    pages = check(document(*(para(f"line{i}") for i in range(lines - 1)), para("Title", style="H"), para("body")))
    assert pages[1].lines[0] == "Title"
    doc = document(para("a"))
    doc.sections.append([para("b")])
    assert [p.lines for p in check(doc)] == [["a"], ["b"]]
    assert len(check(document())) == 1


def test_tables_repeat_their_header_and_notes_take_room():
    rows = [Row([Cell([para("head")])], header=True)] + [Row([Cell([para(f"row {i}")])]) for i in range(60)]
    pages = check(document(Table(rows)))
    assert len(pages) > 2 and all(p.lines[0] == "head" for p in pages)
    doc = document(Paragraph(pieces=[Piece("text", "x"), Piece("footnote", ref=1)]), *(para(f"p{i}") for i in range(20)))
    doc.footnotes = {1: Note(1, "footnote", [para(words(120))])}
    assert len(check(doc)) > len(check(document(*(para(f"p{i}") for i in range(21)))))


def test_selection():
    pages = check(document(*(para("x", page_break_before=True) for _ in range(6))))
    assert [p.number for p in select_pages(pages, slice(2, 5))] == [3, 4, 5]
    assert select_pages(pages, -1)[0].number == 6
    with pytest.raises(IndexError):
        select_pages(pages, 6)


def test_pages_as_rows(spark):
    data = write_docx(document(para("one"), para("two", page_break_before=True)))
    df = spark.createDataFrame([(1, data), (2, b"no"), (3, None)], "doc_id long, content binary")
    rows = sorted((r["doc_id"], r["page"], r["block_start"], r["block_end"], r["text"]) for r in pages_of(df, "doc_id").collect())
    assert rows == [(1, 1, 0, 1, "one"), (1, 2, 1, 2, "two")]
