"""Containers, readers, writers and the document plans."""

import base64
import io
import random
import zipfile
import zlib

import pytest

from paperloom.model import Cell, Document, Level, Media, Note, Paragraph, Piece, Row, RunFormat, Style, Table
from paperloom.outputs import blocks_view, to_html, to_markdown, to_text
from paperloom.outputs.walk import MONOSPACE, SYMBOL, WINGDINGS, symbol_char, symbol_text
from paperloom.plans import documents
from paperloom.sinks.docx import write_docx
from paperloom.sources import containers, xmltree
from paperloom.sources.doc import read_doc
from paperloom.sources.docx import BULLETS, Encrypted, read_docx
from paperloom.sources.markdown import read_markdown, to_docx
from tests.doc_builder import compound, word_file


def run(text, **fmt):
    return Piece("text", text, RunFormat(**fmt))


def para(*pieces, **kw):
    return Paragraph(pieces=list(pieces), **kw)


def item(num, level, text):
    return para(run(text), num_id=num, level=level)


def document(*blocks):
    doc = Document(sections=[list(blocks)])
    doc.styles = {s.id: s for s in [Style("Normal", "Normal", default=True), Style("Code", "Code"), Style("SourceCode", "Source Code"), Style("Hidden", "Hidden", "character", format=RunFormat(vanish=True))]}
    for n in (1, 2, 3):
        doc.styles[f"Heading{n}"] = Style(f"Heading{n}", f"heading {n}", based_on="Normal", format=RunFormat(bold=True))
    doc.abstracts = {0: {0: Level(), 1: Level(format="lower_letter", text="%2)"), 2: Level(format="lower_roman", text="(%3)")}, 1: {0: Level(format="bullet", text="•"), 1: Level(format="bullet", text="o")}}
    doc.instances = {1: (0, {}, {}), 2: (1, {}, {})}
    return doc


def both(doc):
    """The document, and the same one written and read."""
    return [doc, read_docx(write_docx(doc))]


def test_every_heading_level_and_style_of_text():
    """A heading a level, with bold from its style left out; each switch of a run has its marks, and neighbours join."""
    levels = document(*[para(run(f"Part {n}"), style=f"Heading{n}") for n in (1, 2, 3)], para(run("Level by outline"), outline=4))
    for d in both(levels):
        assert to_markdown(d) == "# Part 1\n\n## Part 2\n\n### Part 3\n\n##### Level by outline\n"
    marks = {"bold": "**", "italic": "*", "strike": "~~"}
    for switch, mark in marks.items():
        for d in both(document(para(run("left "), run("mid", **{switch: True}), run("dle", **{switch: True}), run(" right")))):
            assert to_markdown(d) == f"left {mark}middle{mark} right\n"
    for d in both(document(para(run("x"), Piece("line"), run("y"), Piece("tab"), run("z"), style="Heading2"))):
        assert to_markdown(d) == "## x y z\n"


@pytest.mark.parametrize(("target", "anchor", "shown"), [
    ("https://site.test/a", None, "https://site.test/a"), (None, "chapter-9", "#chapter-9"),
    ("https://site.test/a", "q", "https://site.test/a#q"), ("https://site.test/a b", None, "<https://site.test/a b>"),
    ("https://site.test/f(x)", None, "<https://site.test/f(x)>"),
])
def test_a_link_around_formatted_text(target, anchor, shown):
    link = (target, anchor)
    doc = document(para(run("see "), Piece("text", "the ", RunFormat(), link, 7), Piece("text", "page", RunFormat(italic=True), link, 7), run(" now")))
    assert to_markdown(doc) == f"see [the *page*]({shown}) now\n"
    if " " not in (target or ""):
        assert to_markdown(read_docx(write_docx(doc))) == f"see [the *page*]({shown}) now\n"


def counted(kinds):
    """Ordinals and indents by the rules of nested lists, from (list, level) alone."""
    counts, stack, out = {}, [], []
    for num, level in kinds:
        own = counts.setdefault(num, {})
        own[level] = own.get(level, 0) + 1
        for deeper in [k for k in own if k > level]:
            del own[deeper]
        while stack and stack[-1][0] >= level:
            stack.pop()
        marker = "-" if num == 2 else f"{own[level]}."
        out.append(" " * sum(w for _, w in stack) + marker)
        stack.append((level, len(marker) + 1))
    return out


def test_random_nested_lists():
    rng = random.Random(31)
    for _ in range(60):
        kinds = [(rng.choice([1, 1, 1, 2]), rng.choice([0, 0, 1, 1, 2])) for _ in range(rng.randint(1, 25))]
        kinds = [(num, level if num == 1 else min(level, 1)) for num, level in kinds]
        doc = document(*[item(num, level, f"entry{i}") for i, (num, level) in enumerate(kinds)])
        want = "".join(f"{head} entry{i}\n" for i, head in enumerate(counted(kinds)))
        for d in both(doc):
            assert to_markdown(d) == want
            assert [line.rsplit(" ", 1)[1] for line in to_text(d).splitlines()] == [f"entry{i}" for i in range(len(kinds))]


def test_labels_and_html_of_lists():
    doc = document(item(1, 0, "apples"), item(1, 0, "pears"), item(1, 1, "green"), item(1, 1, "red"), para(run("pause")), item(1, 0, "plums"), item(2, 1, "stone"))
    for d in both(doc):
        assert to_text(d) == "1. apples\n2. pears\na) green\nb) red\npause\n3. plums\no stone\n"
    page = to_html(doc)
    assert page.count("<li>") == 6 and page.count("</li>") == 6 and '<ol type="a">' in page and '<ol start="3">' in page and "<ul>" in page
    assert page.index("pause") < page.index('<ol start="3">')


def test_a_grid_with_merged_cells():
    """Columns of a row that spans, and rows of a cell that goes on."""
    rows = [
        Row([Cell([para(run("year"))]), Cell([para(run("sold|left"))]), Cell([para(run("sum", italic=True))])], header=True),
        Row([Cell([para(run("2001"))], merge="restart"), Cell([para(run("both"))], span=2)]),
        Row([Cell(merge="continue"), Cell([para(run("7"))]), Cell([para(run("8")), item(2, 0, "note")])]),
        Row([Cell(merge="continue"), Cell(), Cell([para()])]),
    ]
    for d in both(document(Table(rows))):
        assert to_markdown(d).splitlines() == ["| year | sold\\|left | *sum* |", "| --- | --- | --- |", "| 2001 | both |  |", "|  | 7 | 8<br>• note |", "|  |  |  |"]
        assert to_text(d).splitlines()[:2] == ["year\tsold|left\tsum", "2001\tboth"]
        page = to_html(d)
        assert page.count("<th>") == 3 and '<td rowspan="3">2001</td><td colspan="2">both</td>' in page and page.count("<tr>") == 4 == page.count("</tr>")


def test_notes_count_by_first_use():
    order = [4, 11, 4, 8]
    doc = document(para(*[x for i in order for x in (run(f"s{i}"), Piece("footnote", ref=i))], run("t"), Piece("endnote", ref=1)))
    doc.footnotes = {i: Note(i, "footnote", [para(run(f"about {i}")), para(run("more"))]) for i in (8, 4, 11)}
    doc.endnotes = {1: Note(1, "endnote", [para(run("last"))])}
    for d in both(doc):
        text = to_text(d)
        assert text.startswith("s4[1]s11[2]s4[1]s8[3]t[i]\n")
        assert [line for line in text.splitlines() if "about" in line] == ["[1] about 4 more", "[2] about 11 more", "[3] about 8 more"]
        mark = to_markdown(d)
        assert mark.startswith("s4[^1]s11[^2]s4[^1]s8[^3]t[^i]\n") and "[^2]: about 11\n\n    more" in mark and mark.endswith("[^i]: last\n")
        assert to_html(d).count('<li id="fn-') == 4


@pytest.mark.parametrize(("text", "escaped"), [
    ("*stars*", "\\*stars\\*"), ("a_b c_", "a_b c\\_"), ("+ plus", "\\+ plus"), ("> quoted", "\\> quoted"), ("12) item", "12\\) item"),
    ("[x]", "\\[x\\]"), ("tick ` here", "tick \\` here"), ("## two", "\\## two"), ("back\\slash", "back\\\\slash"), ("<tag>", "\\<tag>"),
])
def test_text_that_looks_like_marks(text, escaped):
    for d in both(document(para(run(text)))):
        assert to_markdown(d) == escaped + "\n"
        assert to_text(d) == text + "\n"


@pytest.mark.parametrize("style", ["Code", "Source Code", "HTML Preformatted", "Preformatted", "Plain Text", "Code Block", "Macro Text"])
def test_code_by_style(style):
    doc = document(para(run("let a = *b"), style="S"), para(run("  print(a)   "), style="S"), para(run("after")))
    doc.styles["S"] = Style("S", style)
    assert to_markdown(doc) == "```\nlet a = *b\n  print(a)\n```\n\nafter\n"
    doc.styles["S"] = Style("S", "Verbatim")
    assert not to_markdown(doc).startswith("```")


@pytest.mark.parametrize(("font", "mono"), [(f, True) for f in MONOSPACE] + [("Fira Code Retina", True), ("Code 39 Barcode", False), ("Terminal", False), ("Arial", False)])
def test_code_by_font(font, mono):
    for d in both(document(para(run("if (a < b)", font=font.title())), para(run("use "), run("x*y", font=font)))):
        assert to_markdown(d) == ("```\nif (a < b)\n```\n\nuse `x*y`\n" if mono else "if (a \\< b)\n\nuse x\\*y\n")
    if mono:
        assert to_html(document(para(run("a < b", font=font)), para(run("c & d", font=font)))) == "<pre><code>a &lt; b\nc &amp; d</code></pre>\n"


def test_breaks_and_formulas():
    doc = document(para(run("upper"), Piece("line"), run("middle"), Piece("column"), run("lower")), para(run("first"), Piece("page")), para(run("next")))
    for d in both(doc):
        assert to_markdown(d) == "upper\\\nmiddle\\\nlower\n\nfirst\n\nnext\n"
        assert to_markdown(d, page_breaks=True).endswith("first\n\n---\n\nnext\n")
    assert to_markdown(document(para(Piece("math", "a+b", ref=1, latex="a+b"), Piece("math", "c", ref=0, latex="c")))) == "$$a+b$$ $c$\n"


def test_hidden_runs():
    for d in both(document(para(run("kept "), run("not", vanish=True), run("nor", style="Hidden"), run("this"), run(" too", vanish=False)))):
        assert to_text(d) == "kept this too\n"


def test_symbol_fonts():
    """Every code of the two fonts, plain and in the private-use area."""
    assert len(SYMBOL) == 190 and len(WINGDINGS) == 24
    for font, table in (("Symbol", SYMBOL), ("Wingdings", WINGDINGS), ("wingdings 3", WINGDINGS), ("Webdings", WINGDINGS)):
        for code, c in table.items():
            assert symbol_text(chr(code) + chr(0xF000 + code), font) == c + c
            assert symbol_char(0xF000 + code, font) == c
    assert symbol_text("\uf001é", "Wingdings") == "•é" and symbol_text("\uf0a7a", "Arial") == "\uf0a7a"
    doc = document(para(run("p\"s", font="Symbol"), run(" "), run("\uf0fe\uf001", font="Wingdings")))
    for d in both(doc):
        assert to_text(d) == "π∀σ ☑•\n"


@pytest.mark.parametrize(("text", "font", "label"), [("\uf0b7", "Symbol", "•"), ("\uf0d8", "Wingdings", "➢"), ("\uf0d8", None, "•"), ("-", "Symbol", "−"), ("x", "Wingdings", "•"), ("–", None, "–"), ("o", "Courier New", "o")])
def test_bullets_in_the_font_of_their_level(text, font, label):
    doc = document(item(2, 0, "point"))
    doc.abstracts[1][0] = Level(format="bullet", text=text, font=font)
    assert to_text(doc) == f"{label} point\n" and to_markdown(doc) == "- point\n"


def test_bullets_as_files_have_them():
    body = '<w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr></w:pPr><w:r><w:t>x</w:t></w:r></w:p>'
    for code, c in BULLETS.items():
        numbering = f'<w:numbering xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:numFmt w:val="bullet"/><w:lvlText w:val="{code}"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num></w:numbering>'
        doc = read_docx(package(body, **{"word/numbering.xml": numbering, "word/_rels/document.xml.rels": '<Relationships><Relationship Id="n" Type="x/numbering" Target="numbering.xml"/></Relationships>'}))
        assert to_text(doc) == f"{c} x\n"


def test_pictures():
    pixel = bytes.fromhex("89504E470D0A1A0A00")
    doc = document(para(run("left "), Piece("image", "two * boats", ref=0), run(" right")), para(Piece("image", "", ref=0)))
    doc.media = [Media("word/media/boats.png", pixel, "image/png")]
    for d in both(doc):
        name = d.media[0].name.rpartition("/")[2]
        assert to_markdown(d, image_prefix="pics/") == f"left ![two \\* boats](pics/{name}) right\n\n![](pics/{name})\n"
        assert f"(data:image/png;base64,{base64.b64encode(pixel).decode()})" in to_markdown(d, images="embed")
        assert to_markdown(d, images="omit") == "left  right\n"


def test_the_title():
    doc = document(para(), para(run(" \t")))
    doc.metadata["title"] = "Boats & *nets*"
    for d in both(doc):
        assert to_markdown(d) == "" and to_markdown(d, title=True) == "# Boats & \\*nets\\*\n"
        assert "<title>Boats &amp; *nets*</title>" in to_html(d, standalone=True)


def test_block_view():
    rng = random.Random(32)
    for _ in range(20):
        blocks, want, n = [], [], 0
        for _ in range(rng.randint(0, 12)):
            kind = rng.choice(["heading", "paragraph", "list_item", "table", "nothing"])
            word = "".join(rng.choice("abcxyz") for _ in range(5))
            if kind == "heading":
                level = rng.randint(1, 3)
                blocks.append(para(run(word), style=f"Heading{level}"))
                want.append((kind, level, None, word))
            elif kind == "list_item":
                n += 1
                blocks.append(item(1, 0, word))
                want.append((kind, None, f"{n}.", word))
            elif kind == "table":
                blocks.append(Table([Row([Cell([para(run(word))]), Cell([para(run("second"))])])]))
                want.append((kind, None, None, f"{word}\tsecond"))
            else:
                blocks.append(para(*[run(word)] * (kind == "paragraph")))
                want += [(kind, None, None, word)] * (kind == "paragraph")
        for d in both(document(*blocks)):
            assert [(b["kind"], b["heading_level"], b["list_label"], b["text"]) for b in blocks_view(d)] == want


def package(body, **parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("_rels/.rels", '<Relationships><Relationship Id="r" Type="x/officeDocument" Target="/word/document.xml"/></Relationships>')
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"><w:body>{body}</w:body></w:document>')
        for name, xml in parts.items():
            z.writestr(name, xml)
    return out.getvalue()


def test_reading_fields_revisions_and_choices():
    field = '<w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText> HYPERLINK "http://a.b" </w:instrText></w:r><w:r><w:fldChar w:fldCharType="separate"/></w:r><w:r><w:t>go</w:t></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r>'
    body = (
        f'<w:p>{field}<w:del><w:r><w:delText>old</w:delText></w:r></w:del><w:ins><w:r><w:t> new</w:t></w:r></w:ins></w:p>'
        '<w:p><mc:AlternateContent><mc:Choice Requires="zz"><w:r><w:t>no</w:t></w:r></mc:Choice><mc:Fallback><w:r><w:t>yes</w:t></w:r></mc:Fallback></mc:AlternateContent></w:p>'
        '<w:sdt><w:sdtContent><w:p><w:r><w:t>in</w:t><w:noBreakHyphen/><w:tab/><w:sym w:font="Wingdings" w:char="F0FC"/></w:r></w:p></w:sdtContent></w:sdt><w:altChunk/>'
        "<w:p><w:pPr><w:sectPr/></w:pPr></w:p><w:p><w:r><w:t>unclosed &amp; &bad; &#65;"
    )
    doc = read_docx(package(body))
    assert to_markdown(doc) == "[go](http://a.b) new\n\nyes\n\nin- ✓\n\nunclosed & &bad; A\n"
    assert len(doc.sections) == 2 and ("dropped", "body", "altChunk") in doc.diagnostics


def test_xml_is_lenient():
    root = xmltree.parse(b"\xff\xfe" + '<a x="1&#10;2"><b>t<c></b></zz><![CDATA[<raw>]]><!-- c --></a>'.encode("utf-16-le"))
    assert root.tag == "a" and root.get("x") == "1\n2" and root.find("b").text == "t" and root.text == "<raw>"
    assert xmltree.parse("").tag == "" and xmltree.parse("<" * 50).tag == ""
    assert xmltree.decode(b'<?xml version="1.0" encoding="windows-1252"?>\x93') .endswith("“")


def test_archives():
    data = write_docx(document(para(run("text"))))
    box = containers.open_zip(data)
    assert box.read("WORD\\Document.xml") == box.read("/word/document.xml") and box.read("nothing") is None
    cut = data[: data.rfind(b"PK\x05\x06") - 40].replace(b"PK\x01\x02", b"xxxx")
    assert containers.open_zip(cut).recovered and to_text(read_docx(cut)) == "text\n"
    bomb = io.BytesIO()
    with zipfile.ZipFile(bomb, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("big", b"0" * (20 << 20))
    limits = containers.Limits(ratio=100, ratio_floor=1 << 20)
    assert not containers.open_zip(bomb.getvalue(), limits).read("big")[1]
    with pytest.raises(containers.NotAContainer):
        containers.open_zip(b"PK")


def test_binary_documents():
    data = word_file("One\x13 HYPERLINK x \x14link\x15 é🙂\rtwo\ttabs\x0bline\ra\x07b\x07\x07c\x07d\x07\x07end\x02\r", "\x02 note\r")
    assert containers.detect(data) == "doc"
    assert to_text(read_doc(data)) == "Onelink é🙂\ntwo\ttabs\nline\na\tb\nc\td\nend[1]\n\n[1] note\n"


def test_detection():
    assert containers.detect(b"PK\x03\x04") == "docx" and containers.detect(b"{\\rtf1") == "rtf" and containers.detect(b"") == "unknown"
    locked = compound({"EncryptedPackage": b"x"})
    assert containers.detect(locked) == "encrypted_docx"
    with pytest.raises(Encrypted):
        read_docx(locked)


MARKDOWN = "# T\n\nBody **b** *i* `c` ~~s~~ [l](http://x.y) a\\*b\n\n1. one\n   1. sub\n2. two\n\n- x\n  - y\n\n| a | b\\|c |\n| --- | --- |\n| 1 | 2 |\n\n```\ncode *x*\n```\n\nend[^1]\n\n[^1]: why\n"


def test_markdown_round_trip():
    for text in (to_markdown(read_markdown(MARKDOWN)), to_markdown(read_docx(to_docx(MARKDOWN, "Title")))):
        assert text == MARKDOWN.replace("2. two\n\n- x", "2. two\n- x")
    assert read_docx(to_docx("x", "Title")).metadata["title"] == "Title"
    assert to_docx(MARKDOWN) == to_docx(MARKDOWN)


def test_damaged_files_never_crash():
    rng = random.Random(20)
    seed = to_docx(MARKDOWN)
    for _ in range(150):
        data = bytearray(seed)
        for _ in range(rng.randint(1, 30)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        data = bytes(data[: rng.randint(1, len(data))]) if rng.random() < 0.4 else bytes(data)
        row = documents.parse_one(data, ("text", "markdown", "html"))
        assert (row["error"] is None) == (row["text"] is not None)


def test_files_as_rows(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.docx").write_bytes(to_docx(MARKDOWN))
    (tmp_path / "sub" / "b.doc").write_bytes(word_file("text\r"))
    (tmp_path / "c.docx").write_bytes(b"broken")
    docs = documents.read_documents(spark, str(tmp_path)).cache()
    rows = {r["path"].rpartition("/")[2]: r for r in docs.collect()}
    assert rows["a.docx"]["markdown"].startswith("# T") and rows["b.doc"]["text"] == "text\n" and rows["c.docx"]["error"]
    view = documents.block_view(docs).where("kind = 'heading'").collect()
    assert [r["text"] for r in view] == ["T"]
    counts = {r["path"].rpartition("/")[2]: r for r in documents.info(docs).collect()}
    assert counts["a.docx"]["n_list_item"] == 5 and counts["a.docx"]["n_table"] == 1
    assert documents.media(docs).count() == 0 and documents.diagnostics(docs).count() == 1
    lenient = {r["path"].rpartition("/")[2]: r["text"] for r in documents.extract_texts(spark, str(tmp_path), strict=False).collect()}
    assert lenient["c.docx"] is None and lenient["b.doc"] == "text\n"
    with pytest.raises(Exception, match="NotAContainer"):
        documents.extract_texts(spark, str(tmp_path)).collect()


def test_crc_is_the_zip_one(spark):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(b"123456789",)], "d binary").select(F.crc32("d")).first()[0] == zlib.crc32(b"123456789") == 0xCBF43926
