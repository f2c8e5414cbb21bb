"""Formulas as linear text and LaTeX."""

import pytest

from paperloom.outputs import to_html, to_markdown, to_text
from paperloom.outputs.math import read_math, to_latex, to_linear
from paperloom.sources.docx import read_docx
from paperloom.sources.xmltree import parse
from tests.test_documents import package

M = 'xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"'
r = lambda t: f"<m:r><m:t>{t}</m:t></m:r>"
e = lambda tag, t: f"<m:{tag}>{t if '<' in t else r(t)}</m:{tag}>"
CASES = [
    (r("a+b"), "a+b", "a+b"),
    (f"<m:f>{e('num', 'a+1')}{e('den', 'b')}</m:f>", "(a+1)/b", "\\frac{a+1}{b}"),
    (f"<m:sSup>{e('e', 'x')}{e('sup', '2')}</m:sSup>", "x^2", "x^{2}"),
    (f"<m:sSubSup>{e('e', 'x')}{e('sub', 'i')}{e('sup', 'n+1')}</m:sSubSup>", "x_i^(n+1)", "x_{i}^{n+1}"),
    (f"<m:rad><m:radPr><m:degHide m:val='1'/></m:radPr><m:deg/>{e('e', 'α')}</m:rad>", "√α", "\\sqrt{\\alpha}"),
    (f"<m:rad>{e('deg', '3')}{e('e', 'x')}</m:rad>", "√(3&x)", "\\sqrt[3]{x}"),
    (f"<m:nary><m:naryPr><m:chr m:val='∑'/></m:naryPr>{e('sub', 'i=0')}{e('sup', 'n')}{e('e', 'i')}</m:nary>", "∑_(i=0)^n▒i", "\\sum_{i=0}^{n}{i}"),
    (f"<m:d><m:dPr><m:begChr m:val='['/><m:endChr m:val=']'/></m:dPr>{e('e', 'a')}{e('e', 'b')}</m:d>", "[a|b]", "\\left[a|b\\right]"),
    (f"<m:m><m:mr>{e('e', '1')}{e('e', '2')}</m:mr><m:mr>{e('e', '3')}{e('e', '4')}</m:mr></m:m>", "■(1&2@3&4)", "\\begin{matrix}1 & 2 \\\\ 3 & 4\\end{matrix}"),
    (f"<m:func>{e('fName', 'sin')}{e('e', 'x')}</m:func>", "sin⁡x", "\\sin x"),
    (f"<m:limLow>{e('e', 'lim')}{e('lim', 'x→0')}</m:limLow>", "lim┬(x→0)", "\\lim_{x\\to 0}"),
    (f"<m:acc>{e('e', 'v')}</m:acc>", "v̂", "\\hat{v}"),
    (f"<m:bar><m:barPr><m:pos m:val='top'/></m:barPr>{e('e', 'z')}</m:bar>", "¯z", "\\overline{z}"),
]


@pytest.mark.parametrize(("xml", "linear", "latex"), CASES)
def test_formulas(xml, linear, latex):
    m = read_math(parse(f"<m:oMath {M}>{xml}</m:oMath>"))
    assert to_linear(m) == linear and to_latex(m).strip() == latex


def test_deep_formulas_end():
    deep = "<m:sSup><m:e>" * 3000 + r("x")
    assert len(to_linear(read_math(parse(f"<m:oMath {M}>{deep}")))) < 1000


def test_formulas_in_documents():
    doc = read_docx(package(f"<w:p><w:r><w:t>so </w:t></w:r><m:oMath {M}>{CASES[1][0]}</m:oMath></w:p>"))
    assert to_text(doc) == "so (a+1)/b\n" and to_markdown(doc) == "so $\\frac{a+1}{b}$\n"
    assert to_html(doc) == '<p>so <span class="math">(a+1)/b</span></p>\n'
