"""The single-document API."""

import json

import pytest

from paperloom import api
from paperloom.sources.markdown import to_docx

TEXT = "# Title\n\n" + "\n".join(f"{i}. item {i}" for i in range(1, 121)) + "\n\nend `code`\n"


@pytest.fixture(scope="module")
def doc():
    return api.Document(data=to_docx(TEXT, "Report"))


def test_formats(doc, tmp_path):
    assert doc.format == "docx" and doc.metadata["title"] == "Report" and doc.fonts == ["Courier New"]
    assert doc.to("markdown") == TEXT and doc.extract_text().splitlines()[1] == "1. item 1"
    assert doc.to({"format": "html", "standalone": True}).startswith("<!DOCTYPE html>")
    assert json.loads(doc.to_json())["sections"][0][0]["style"] == "Heading1"
    assert doc.blocks()[0]["heading_level"] == 1 and doc.images() == []
    doc.save_docx(tmp_path / "a.docx")
    assert api.Document(tmp_path / "a.docx").to("markdown") == TEXT
    for bad in ({"format": "pdf"}, {"format": "text", "dpi": 3}, {"format": "html", "images": "no"}):
        with pytest.raises(ValueError, match="unknown|images"):
            doc.to(bad)
    with pytest.raises(ValueError, match="path or data"):
        api.Document()


def test_pages_go_on_counting(doc):
    pages = doc.pages()
    assert len(pages) == doc.page_count() > 2
    assert "".join(pages.to("text")) == doc.extract_text()
    second = doc.page(1).to("markdown").splitlines()[0]
    assert second == doc.pages()[1:2].to("markdown")[0].splitlines()[0] and not second.startswith("1. ")
    assert [p.number for p in pages[-2:]] == [len(pages) - 1, len(pages)]
    assert json.loads(pages[0].to("json"))[0]["text"] == "Title"
    with pytest.raises(IndexError):
        pages[99]


def test_convert(tmp_path):
    (tmp_path / "a.md").write_text(TEXT, "utf-8")
    for name in ("b.docx", "c.html", "d.txt", "e.json"):
        api.convert(tmp_path / "a.md", tmp_path / name)
    api.convert(tmp_path / "b.docx", tmp_path / "f.md")
    assert (tmp_path / "f.md").read_text("utf-8") == TEXT and (tmp_path / "c.html").read_text("utf-8").startswith("<h1>")
    with pytest.raises(ValueError, match="extension"):
        api.convert(tmp_path / "a.md", tmp_path / "g.pdf")


def test_looking_into_files():
    assert api.hexdump(b"ABC\x00\xff" * 4) == "00000000  41 42 43 00 ff 41 42 43 00 ff 41 42 43 00 ff 41  ABC..ABC..ABC..A\n00000010  42 43 00 ff                                      BC.."
    assert api.pretty_xml('<a x="1"><b>t</b><c/></a>') == '<a x="1">\n  <b>t</b>\n  <c/>\n</a>'
    assert api.detect(b"{\\rtf1") == "rtf"
