"""Formats, lists, tables, notes and comments of Word 97 files."""

import random

import pytest

from paperloom.outputs import to_html, to_markdown, to_text
from paperloom.sources.doc import hyperlink, read_doc
from paperloom.sources.doc_format import properties
from tests.doc_builder import cells, level, sprm, units, word_file

BOLD, ITALIC, STRIKE, VANISH, FONT = 0x0835, 0x0836, 0x0837, 0x083C, 0x4A4F
IN, END, ITAP, INNER, INNER_END = sprm(0x2416, 1), sprm(0x2417, 1), lambda n: sprm(0x6649, n), sprm(0x244B, 1), sprm(0x244C, 1)
STYLES = [
    ("Normal", 1, None, b"", b""), ("heading 1", 1, 0, sprm(0x2640, 0), sprm(BOLD, 1)), ("heading 2", 1, 0, b"", sprm(BOLD, 1)),
    ("Listed", 1, 0, sprm(0x460B, 1) + sprm(0x260A, 0), b""), ("Strong", 2, None, b"", sprm(BOLD, 1)), ("Code", 1, 0, b"", b""),
]


def written(*paragraphs, **more):
    """(style, paragraph properties, [(text, run properties)], mark) -> the document read back."""
    text, chars, paras = "", [], []
    for style, props, runs, mark in paragraphs:
        body = "".join(units(t) for t, _ in runs)
        text += body + mark
        paras.append((len(body) + 1, style, props))
        chars += [(len(units(t)), data) for t, data in runs if t] + [(1, b"")]
    return read_doc(word_file(text, chars=chars, paras=paras, **more))


def test_styles_and_runs():
    doc = written(
        (1, b"", [("Top", b"")], "\r"),
        (0, b"", [("plain ", b""), ("fat", sprm(BOLD, 1)), (" ", b""), ("lean", sprm(ITALIC, 1)), (" gone", sprm(VANISH, 1)), (" out", sprm(0x0800, 1)), (" é🙂", sprm(STRIKE, 1))], "\r"),
        (2, b"", [("Under", sprm(BOLD, 0x80)), ("neath", sprm(BOLD, 0x81))], "\r"),
        (0, b"", [("by ", b""), ("style", sprm(0x4A30, 4))], "\r"),
        (0, sprm(0x2640, 2), [("By outline", b"")], "\r"),
        (5, b"", [("x = *y", b"")], "\r"),
        (0, b"", [("a", sprm(FONT, 1)), ("\x28", sprm(0x6A09, b"\x00\x00\xb7\xf0"))], "\r"),
        styles=STYLES, fonts=["Symbol", "Consolas"],
    )
    assert to_markdown(doc) == "# Top\n\nplain **fat** *lean* ~~é🙂~~\n\n## Underneath\n\nby **style**\n\n### By outline\n\n```\nx = *y\n```\n\n`a`•\n"
    assert doc.styles["s1"].based_on == "s0" and doc.styles["s4"].kind == "character" and doc.styles["s0"].default


def test_lists():
    numbers = [level(3, 0, "\0."), level(1, 4, "\1)"), *[level(1, 0, f"{chr(k)}.") for k in range(2, 9)]]
    item = lambda lfo, at, text: (0, sprm(0x460B, lfo) + sprm(0x260A, at), [(text, b"")], "\r")
    bullet = [level(1, 23, "", chars=sprm(FONT, 0))]
    first = (7).to_bytes(4, "little") + (0x10).to_bytes(4, "little")
    doc = written(
        item(1, 0, "three"), item(1, 1, "a"), item(1, 1, "b"), item(1, 0, "four"), (3, b"", [("five", b"")], "\r"), item(2, 0, "dot"), item(3, 0, "seven"), (0, sprm(0x460B, 0), [("none", b"")], "\r"),
        styles=STYLES, fonts=["Symbol"], lists=[(11, numbers), (22, bullet), (33, [level(1, 1, "\0)")])], overrides=[(11, []), (22, []), (33, [first])],
    )
    assert to_text(doc) == "3. three\na) a\nb) b\n4. four\n5. five\n• dot\nVII) seven\nnone\n"


def test_tables_by_property():
    cell = lambda text, props=b"": (0, IN + props, [(text, b"")], "\x07")
    row = lambda edges, flags, props=b"": (0, IN + END + cells(edges, flags) + props, [], "\x07")
    doc = written(
        (0, b"", [("before", b"")], "\r"),
        cell("year"), cell("wide"), row([0, 10, 30], [0x60, 0], sprm(0x3404, 1)),
        cell(""), (0, IN, [("two", b"")], "\r"), cell("lines"), cell("last"), row([0, 10, 20, 30], [0x20, 0, 0]),
        cell("p"), cell("q"), cell("r"), row([0, 10, 20, 30], [0x1, 0x2, 0]),
        (0, b"", [("after", b"")], "\r"),
        cell("alone"), row([0, 9], [0]),
        styles=STYLES,
    )
    table = doc.sections[0][1]
    assert [[(c.span, c.merge) for c in r.cells] for r in table.rows] == [[(1, "restart"), (2, None)], [(1, "continue"), (1, None), (1, None)], [(2, None), (1, None)]]
    assert table.rows[0].header and table.grid == [10, 10, 10]
    assert to_text(doc) == "before\nyear\twide\n\ttwo lines\tlast\np\tr\nafter\nalone\n"
    assert '<th rowspan="2">year</th>' in to_html(doc)


def test_nested_tables():
    deep = lambda text, props=b"", mark="\r": (0, IN + ITAP(2) + props, [(text, b"")], mark)
    doc = written(
        (0, IN, [("outer", b"")], "\x07"),
        deep("in 1", INNER), deep("in 2", INNER), deep("", INNER_END + cells([0, 5, 9], [0, 0])), (0, IN, [("tail", b"")], "\x07"),
        (0, IN + END + cells([0, 10, 20], [0, 0]), [], "\x07"),
        styles=STYLES,
    )
    outer = doc.sections[0][0]
    assert len(doc.sections[0]) == 1 and len(outer.rows) == 1 and len(outer.rows[0].cells) == 2
    inner = outer.rows[0].cells[1].blocks[0]
    assert [["".join(p.text for b in c.blocks for p in b.pieces) for c in r.cells] for r in inner.rows] == [["in 1", "in 2"]]


def test_notes_and_comments():
    doc = read_doc(word_file("a\x02 b\x02 c\x05 d\x02 e\x05\r", "\x02first\r\x02second\r", endnotes="\x02end\r", comments="\x05why\r\x05no\r", authors=["Ann", "Bo"]))
    assert to_text(doc) == "a[1] b[2] c d[i] e\n\n[1] first\n[2] second\n[i] end\n"
    assert [(c.author, c.blocks[0].pieces[0].text) for c in doc.comments.values()] == [("Ann", "why"), ("Bo", "no")]
    assert "**Ann:** why" in to_markdown(doc, comments=True)


def test_links():
    doc = written((0, b"", [("see \x13 HYPERLINK \"http://a.b/c\" \\l \"top\" \x14the ", b""), ("page", sprm(BOLD, 1)), ("\x15 or \x13 PAGE \x144\x15.", b"")], "\r"))
    assert to_markdown(doc) == "see [the **page**](http://a.b/c#top) or 4.\n"
    assert hyperlink(' HYPERLINK \\l "x" ') == (None, "x") and hyperlink(" PAGEREF x") is None and hyperlink(" HYPERLINK http://q ") == ("http://q", None)


def test_cut_properties():
    data = sprm(BOLD, 1) + sprm(0xC615, bytes([2, 0, 0])) + sprm(ITALIC, 1)
    assert [c for c, _ in properties(data)] == [BOLD, 0xC615, ITALIC]
    for k in range(len(data)):
        assert len(list(properties(data[:k]))) <= 3


@pytest.mark.parametrize("seed", range(4))
def test_damaged_files(seed):
    """Damage gives a document, or one of the errors that a file's row can hold."""
    rng = random.Random(seed)
    text, props = "one\rtwo\x07three\x07\x07four\x02\r", sprm(0x460B, 1)
    good = word_file(text, "\x02n\r", chars=[(len(text), sprm(BOLD, 1))], paras=[(4, 1, b""), (4, 0, IN), (6, 0, IN), (1, 0, IN + END + cells([0, 4, 8], [0, 0])), (6, 3, props)], styles=STYLES, fonts=["Symbol"], lists=[(5, [level(1, 0, "\0.")])], overrides=[(5, [])])
    assert to_markdown(read_doc(good)).startswith("# **one**") or "one" in to_text(read_doc(good))
    from paperloom.plans import documents

    for _ in range(150):
        data = bytearray(good)
        for _ in range(rng.randint(1, 25)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        row = documents.parse_one(bytes(data), ("text", "markdown", "html"))
        assert (row["error"] is None) == (row["text"] is not None)
