"""Charts, diagrams, groups and text boxes as text."""

import pytest

from paperloom.outputs import to_markdown, to_text
from paperloom.sources.charts import Chart, Series, chart_blocks, shown
from paperloom.sources.docx import read_docx
from tests.test_documents import package
from tests.test_sections import relations

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:c="http://schemas.openxmlformats.org/drawingml/2006/chart" xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing" xmlns:pic="http://schemas.openxmlformats.org/drawingml/2006/picture" xmlns:dgm="http://schemas.openxmlformats.org/drawingml/2006/diagram" xmlns:dsp="http://schemas.microsoft.com/office/drawing/2008/diagram" xmlns:wps="http://schemas.microsoft.com/office/word/2010/wordprocessingShape"'


def inline(content, alt=""):
    return f'<w:p><w:r><w:t>before</w:t></w:r><w:r><w:drawing {NS}><wp:inline><wp:docPr descr="{alt}"/>{content}</wp:inline></w:drawing></w:r><w:r><w:t> after</w:t></w:r></w:p><w:p><w:r><w:t>next</w:t></w:r></w:p>'


def points(*values):
    return "".join(f'<c:pt idx="{i}"><c:v>{v}</c:v></c:pt>' for i, v in enumerate(values) if v is not None)


def chart_part(series, title="Sales"):
    return f'<c:chartSpace {NS}><c:chart><c:title><c:tx><c:rich><a:p><a:r><a:t>{title}</a:t></a:r></a:p></c:rich></c:tx></c:title><c:plotArea><c:barChart>{series}</c:barChart></c:plotArea></c:chart></c:chartSpace>'


def test_a_chart_is_a_table():
    series = f'<c:ser><c:tx><c:strRef><c:strCache>{points("North")}</c:strCache></c:strRef></c:tx><c:cat><c:strRef><c:strCache>{points("Q1", "Q2", "Q3")}</c:strCache></c:strRef></c:cat><c:val><c:numRef><c:numCache>{points("1.50", None, "1e3")}</c:numCache></c:numRef></c:val></c:ser><c:ser><c:val><c:numRef><c:numCache>{points("-0", "x", 2)}</c:numCache></c:numRef></c:val></c:ser>'
    doc = read_docx(package(inline('<c:chart r:id="k"/>'), **{"word/_rels/document.xml.rels": relations(k=("chart", "charts/c.xml")), "word/charts/c.xml": chart_part(series)}))
    assert to_text(doc).splitlines() == ["before after", "Sales", "\tNorth\tSeries 2", "Q1\t1.5\t0", "Q2\t\t", "Q3\t1000\t2", "next"]
    assert "|  | North | Series 2 |\n| --- | --- | --- |" in to_markdown(doc)


def test_scattered_points_and_limits():
    part = f'<c:ser><c:xVal><c:numRef><c:numCache>{points(0.25, 4)}</c:numCache></c:numRef></c:xVal><c:yVal><c:numRef><c:numCache>{points(9, 8)}</c:numCache></c:numRef></c:yVal></c:ser>'
    doc = read_docx(package(inline('<c:chart r:id="k"/><c:chart r:id="gone"/>'), **{"word/_rels/document.xml.rels": relations(k=("chart", "c.xml")), "word/c.xml": chart_part(part, "")}))
    assert to_text(doc).splitlines()[1:4] == ["x\tSeries 1", "0.25\t9", "4\t8"] and ("dropped", "drawing", "chart gone is missing") in doc.diagnostics
    many = Chart("T", [Series(f"s{i}", {k: str(k) for k in range(60)}, {}, {k: k / 3 for k in range(60)}) for i in range(14)])
    blocks, cut = chart_blocks(many)
    assert cut and len(blocks[1].rows) == 51 and len(blocks[1].rows[0].cells) == 13
    assert chart_blocks(Chart()) == ([], False)


@pytest.mark.parametrize(("value", "text"), [(None, ""), (1.0, "1"), (1 / 3, "0.3333333333"), (-1e-12, "0"), (1e15, "1000000000000000"), (float("nan"), "")])
def test_numbers(value, text):
    assert shown(value) == text


def test_diagrams():
    data = f'<dgm:dataModel {NS}><dgm:ptLst><dgm:pt><dgm:t><a:p><a:r><a:t>from data</a:t></a:r></a:p></dgm:t></dgm:pt></dgm:ptLst></dgm:dataModel>'
    saved = f'<dsp:drawing {NS}><dsp:sp><dsp:txBody><a:p><a:r><a:t>step </a:t></a:r><a:r><a:t>one</a:t></a:r></a:p><a:p/></dsp:txBody></dsp:sp><dsp:sp><dsp:txBody><a:p><a:r><a:t>step two</a:t></a:r></a:p></dsp:txBody></dsp:sp></dsp:drawing>'
    body = inline('<dgm:relIds r:dm="d"/>')
    both = read_docx(package(body, **{"word/_rels/document.xml.rels": relations(d=("diagramData", "d.xml"), s=("diagramDrawing", "s.xml")), "word/d.xml": data, "word/s.xml": saved}))
    assert to_text(both).splitlines() == ["before after", "step one", "step two", "next"]
    alone = read_docx(package(body, **{"word/_rels/document.xml.rels": relations(d=("diagramData", "d.xml")), "word/d.xml": data}))
    assert to_text(alone).splitlines() == ["before after", "from data", "next"]


def test_groups_and_text_boxes():
    pic = lambda rel, alt: f'<pic:pic><pic:nvPicPr><pic:cNvPr descr="{alt}"/></pic:nvPicPr><pic:blipFill><a:blip r:embed="{rel}"/></pic:blipFill></pic:pic>'
    box = "<wps:txbx><w:txbxContent><w:p><w:r><w:t>boxed</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:txbxContent></wps:txbx>"
    files = {"word/_rels/document.xml.rels": relations(p=("image", "media/p.png"), q=("image", "media/q.png")), "word/media/p.png": "\x89PNG", "word/media/q.png": "\x89PNG"}
    doc = read_docx(package(inline(pic("p", "first") + pic("q", "second") + box, "all"), **files))
    assert to_markdown(doc, image_prefix="") == "before![first](p.png)![second](q.png) after\n\nboxed\n\n| cell |\n| --- |\n\nnext\n"
    assert to_markdown(read_docx(package(inline(pic("p", "own"), "whole"), **files))).startswith("before![whole](p.png) after")
