"""Sections, settings, themes and defaults of packages; lists of files; the command line."""

import json

import pytest

from paperloom import api
from paperloom.__main__ import chosen, main
from paperloom.model import SectionFormat, Settings
from paperloom.outputs import to_markdown, to_text
from paperloom.plans import documents
from paperloom.sources import sections
from paperloom.sources.docx import read_docx
from paperloom.sources.markdown import to_docx
from tests.test_documents import package

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'


def relations(**targets):
    rows = "".join(f'<Relationship Id="{i}" Type="x/{kind}" Target="{target}"/>' for i, (kind, target) in targets.items())
    return f"<Relationships>{rows}</Relationships>"


def paragraph(text, props=""):
    return f"<w:p><w:pPr>{props}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"


def story(tag, text):
    return f"<w:{tag} {W}>{paragraph(text)}</w:{tag}>"


@pytest.fixture
def book():
    r = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    first = f'<w:sectPr {r}><w:headerReference w:type="default" r:id="h1"/><w:headerReference w:type="first" r:id="h2"/><w:footerReference r:id="f1"/><w:pgSz w:w="16840" w:h="11900" w:orient="landscape"/><w:pgMar w:top="700" w:left="-5"/><w:cols w:num="2" w:sep="1"><w:col w:w="4000"/><w:col w:w="3000"/></w:cols><w:titlePg/><w:pgNumType w:start="5" w:fmt="lowerRoman"/><w:pgBorders w:display="notFirstPage"/></w:sectPr>'
    second = f'<w:sectPr {r}><w:headerReference w:type="even" r:id="h1"/><w:type w:val="oddPage"/><w:titlePg w:val="0"/></w:sectPr>'
    return package(
        paragraph("one") + paragraph("two", first) + paragraph("three") + second,
        **{
            "word/_rels/document.xml.rels": relations(h1=("header", "h1.xml"), h2=("header", "h2.xml"), h3=("header", "h3.xml"), f1=("footer", "f1.xml"), s=("settings", "settings.xml"), t=("theme", "theme.xml"), st=("styles", "styles.xml")),
            "word/h1.xml": story("hdr", "usual head"), "word/h2.xml": story("hdr", "title head"), "word/h3.xml": story("hdr", "nowhere"), "word/f1.xml": story("ftr", "foot"),
            "word/settings.xml": f'<w:settings {W}><w:defaultTabStop w:val="360"/><w:evenAndOddHeaders/><w:compat><w:compatSetting w:name="other" w:val="3"/><w:compatSetting w:name="compatibilityMode" w:val="15"/></w:compat></w:settings>',
            "word/theme.xml": f'<a:theme {A}><a:themeElements><a:clrScheme><a:dk2><a:srgbClr val="1f497d"/></a:dk2><a:lt1><a:sysClr val="window" lastClr="FEFEFE"/></a:lt1></a:clrScheme><a:fontScheme><a:majorFont><a:latin typeface="Cambria"/><a:ea typeface=""/></a:majorFont><a:minorFont><a:latin typeface="Courier New"/><a:cs typeface="Arial"/></a:minorFont></a:fontScheme></a:themeElements></a:theme>',
            "word/styles.xml": f'<w:styles {W}><w:docDefaults><w:rPrDefault><w:rPr><w:rFonts w:asciiTheme="minorHAnsi" w:ascii="Times"/></w:rPr></w:rPrDefault></w:docDefaults></w:styles>',
        },
    )


def test_section_properties(book):
    doc = read_docx(book)
    one, two = doc.section_formats
    assert (one.width, one.height, one.landscape, one.start) == (16840, 11900, True, "nextPage")
    assert (one.margins.top, one.margins.left, one.margins.right) == (700, -5, 1440)
    assert (one.columns.count, one.columns.separator, one.columns.widths, one.columns.space) == (2, True, [4000, 3000], 720)
    assert (one.title_page, one.page_number_start, one.page_number_format, one.borders) == (True, 5, "lowerRoman", "notFirstPage")
    assert (two.width, two.start, two.title_page, two.borders, two.headers) == (12240, "oddPage", False, None, {"even": "h1"})
    assert sections.distinct_ids(one.headers) == ["h2", "h1"]
    assert sections.carried(doc.section_formats)[1] == ({"default": "h1", "first": "h2", "even": "h1"}, {"default": "f1"})
    assert to_text(doc, headers_footers=True).splitlines() == ["title head", "usual head", "one", "two", "three", "foot"]


@pytest.mark.parametrize(("title", "even", "first_page", "page", "shown"), [
    (True, True, True, 1, "F"), (True, True, False, 2, "E"), (True, True, False, 3, "D"), (False, True, True, 2, "E"), (False, False, True, 2, "D"), (True, False, False, 2, "D"),
])
def test_choice_of_headers(title, even, first_page, page, shown):
    refs = {"first": "F", "default": "D", "even": "E"}
    assert sections.header_of(refs, SectionFormat(title_page=title), Settings(even_and_odd=even), first_page, page) == shown


def test_settings_theme_and_defaults(book):
    doc = read_docx(book)
    assert (doc.settings.tab_stop, doc.settings.even_and_odd, doc.settings.compatibility) == (360, True, 15)
    colour = lambda slot: sections.theme_colour(doc.theme, slot)
    assert [colour(s) for s in ("tx2", "dk2", "bg1", "tx1", "accent1")] == ["1F497D", "1F497D", "FEFEFE", "000000", None]
    face = lambda slot: sections.theme_font(doc.theme, slot)
    assert [face(s) for s in ("majorHAnsi", "minorAscii", "minorBidi", "majorEastAsia")] == ["Cambria", "Courier New", "Arial", None]
    # the default font is the theme's, which is monospace
    assert to_markdown(doc) == "```\none\ntwo\nthree\n```\n"
    assert api.Document(data=book).fonts == ["Courier New"]
    plain = read_docx(package(paragraph("x")))
    assert (plain.settings.tab_stop, plain.settings.compatibility, plain.section_formats[0].height) == (720, 12, 15840)


def test_lists_numbered_by_a_style_over_pages():
    body = "".join(paragraph(f"entry {i}", '<w:pStyle w:val="L"/>') for i in range(90))
    numbering = f'<w:numbering {W}><w:abstractNum w:abstractNumId="3"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/><w:lvlText w:val="%1."/></w:lvl></w:abstractNum><w:num w:numId="4"><w:abstractNumId w:val="3"/></w:num></w:numbering>'
    styles = f'<w:styles {W}><w:style w:styleId="L" w:type="paragraph"><w:name w:val="L"/><w:pPr><w:numPr><w:numId w:val="4"/></w:numPr></w:pPr></w:style></w:styles>'
    doc = api.Document(data=package(body, **{"word/numbering.xml": numbering, "word/styles.xml": styles, "word/_rels/document.xml.rels": relations(n=("numbering", "numbering.xml"), s=("styles", "styles.xml"))}))
    pages = doc.pages()
    assert len(pages) > 1
    assert "".join(pages.to("text")) == doc.extract_text()
    assert [line.split(" ")[0] for page in pages.to("markdown") for line in page.splitlines()] == [f"{i}." for i in range(1, 91)]


def test_an_unusable_choice_falls_through():
    body = '<w:p><mc:AlternateContent><mc:Choice Requires="w14"/><mc:Choice Requires="wps"><w:r><w:t>second</w:t></w:r></mc:Choice><mc:Fallback><w:r><w:t>last</w:t></w:r></mc:Fallback></mc:AlternateContent></w:p>'
    assert to_text(read_docx(package(body))) == "second\n"


def test_lists_of_files(spark, tmp_path, book):
    (tmp_path / "sub").mkdir()
    for name, text in (("b.docx", "bee"), ("a.docx", "ay"), ("sub/b.docx", "bee")):
        (tmp_path / name).write_bytes(to_docx(text))
    (tmp_path / "book.docx").write_bytes(book)
    (tmp_path / "bad.docx").write_bytes(b"broken")
    wanted = [str(tmp_path / n) for n in ("b.docx", "bad.docx", "a.docx", "b.docx")]
    got = documents.extract_texts(spark, wanted, strict=False).collect()
    assert [(r["ord"], r["text"]) for r in got] == [(0, "bee\n"), (1, None), (2, "ay\n"), (3, "bee\n")]
    with pytest.raises(Exception, match="bad.docx"):
        documents.extract_texts(spark, wanted).collect()
    assert documents.extract_texts(spark, []).collect() == []
    names = [r["name"] for r in documents.listing(spark, str(tmp_path)).collect()]
    assert names == ["a.docx", "b.docx", "bad.docx", "book.docx"]
    rows = documents.sections(documents.read_documents(spark, str(tmp_path / "book.docx"), outputs=())).orderBy("section").collect()
    assert [(r["columns"], r["header_default"], r["header_even"], r["footer_default"], r["width"]) for r in rows] == [(2, "h1", None, "f1", 16840), (1, "h1", "h1", "f1", 12240)]
    said = spark.createDataFrame([("p", "word/a.png", "x"), ("p", "body", "y")], "path string, location string, message string")
    left = spark.createDataFrame([("p", "word/a.png")], "path string, location string")
    assert [r["message"] for r in documents.unneeded_gone(said, left).collect()] == ["y"]


def test_command_line(tmp_path, capsys, book):
    file = tmp_path / "a.docx"
    file.write_bytes(to_docx("# Top\n\n1. one\n2. two\n", "Title"))
    out = lambda *argv: (main([*argv]), capsys.readouterr().out)
    assert out("text", str(file)) == (0, "Top\n1. one\n2. two\n")
    assert out("md", str(file), "--pages", "1,7") == (0, "# Top\n\n1. one\n2. two\n")
    assert out("html", str(file))[1].startswith("<h1>") and json.loads(out("json", str(file), "--blocks")[1])[0]["heading_level"] == 1
    facts = json.loads(out("info", str(file))[1])
    assert (facts["heading"], facts["list_item"], facts["pages"], facts["metadata"]["title"]) == (1, 2, 1, "Title")
    assert "word/document.xml" in out("parts", str(file))[1] and out("xml", str(file), "word/document.xml")[1].startswith("<w:document")
    assert out("hex", str(file))[1].startswith("00000000  50 4b 03 04") and out("hex", str(file), "word/document.xml")[1].startswith("00000000  3c")
    assert out("convert", str(file), str(tmp_path / "b.md"))[0] == 0 and (tmp_path / "b.md").read_text().startswith("# Top")
    assert out("text", str(file), "-o", str(tmp_path / "c.txt")) == (0, "") and (tmp_path / "c.txt").read_text() == "Top\n1. one\n2. two\n"
    (tmp_path / "book.docx").write_bytes(book)
    assert out("fonts", str(tmp_path / "book.docx"))[1] == "Courier New\n"
    assert out("images", str(file), "-o", str(tmp_path / "pics"))[0] == 0 and (tmp_path / "pics").is_dir()
    assert main(["text", str(tmp_path / "none.docx")]) == 1 and "none.docx" in capsys.readouterr().err
    assert main(["xml", str(file), "nothing.xml"]) == 1
    assert chosen("2-4,1", 3) == [1, 2, 0]


def test_embedded_fonts():
    from paperloom.sources.fonts import font_table, unhide

    guid, font = "{1DBA2C3D-0001-4A5B-8C9D-0123456789AB}", bytes(range(200))
    hidden = unhide(font, guid)
    # the last pair of digits meets the first byte
    assert hidden[0] == 0xAB and hidden[15] == 15 ^ 0x1D and hidden[16] == 16 ^ 0xAB and hidden[32:] == font[32:]
    assert unhide(hidden, guid) == font and unhide(font, "none") == font and unhide(b"ab", guid) == bytes([0x61 ^ 0xAB, 0x62 ^ 0x89])
    table = f'<w:fonts {W}><w:font w:name="Own"><w:embedRegular r:id="a" w:fontKey="{guid}"/><w:embedBold r:id="gone" w:fontKey="{guid}"/></w:font><w:font w:name="Other"/></w:fonts>'
    data = package(paragraph("x"), **{"word/_rels/document.xml.rels": relations(f=("fontTable", "fontTable.xml")), "word/fontTable.xml": table, "word/_rels/fontTable.xml.rels": relations(a=("font", "fonts/a.odttf")), "word/fonts/a.odttf": hidden})
    names, carried = font_table(data)
    assert names == ["Own", "Other"] and [(f.name, f.face, f.data) for f in carried] == [("Own", "regular", font)]
    assert font_table(package(paragraph("x"))) == ([], [])
