"""Charts and diagrams of packages, as the text that they show."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..model import Cell, Paragraph, Piece, Row, Table
from .xmltree import Node

#: Rows and series of a chart's table, and points that are read.
ROWS, SERIES, POINTS = 50, 12, 4096


@dataclass
class Series:
    name: str | None = None
    categories: dict[int, str] = field(default_factory=dict)
    x: dict[int, float] = field(default_factory=dict)
    values: dict[int, float] = field(default_factory=dict)


@dataclass
class Chart:
    title: str = ""
    series: list[Series] = field(default_factory=list)


def _local(node: Node) -> str:
    return node.tag.rpartition(":")[2]


def _children(node: Node, name: str) -> list[Node]:
    return [c for c in node.children if _local(c) == name]


def _text(node: Node) -> str:
    """Paragraphs of rich text, one a line, or a cached value."""
    lines = ["".join(t.text for t in p.walk() if _local(t) == "t") for p in node.walk() if p.tag == "a:p"]
    return "\n".join(lines) if lines else "".join(v.text for v in node.walk() if _local(v) == "v")


def _points(node: Node) -> dict[int, str]:
    """Cached points by number; of several levels of categories the first."""
    levels = [n for n in node.walk() if _local(n) == "lvl"]
    out: dict[int, str] = {}
    for p in (levels[0] if levels else node).walk():
        if _local(p) == "pt" and (p.get("idx") or "").isdigit() and int(p.get("idx")) < POINTS:
            out.setdefault(int(p.get("idx")), "".join(v.text for v in _children(p, "v")))
    return out


def _numbers(points: dict[int, str]) -> dict[int, float]:
    out = {}
    for i, text in points.items():
        try:
            out[i] = float(text)
        except ValueError:
            continue
    return out


def read_chart(root: Node) -> Chart:
    out = Chart()
    chart = next((n for n in root.walk() if _local(n) == "chart"), root)
    for c in chart.children:
        if _local(c) == "title":
            out.title = _text(c)
        elif _local(c) == "plotArea":
            for plot in c.children:
                for ser in _children(plot, "ser"):
                    s = Series()
                    for part in ser.children:
                        match _local(part):
                            case "tx":
                                s.name = _text(part) or None
                            case "cat":
                                s.categories = _points(part)
                            case "xVal":
                                s.x = _numbers(_points(part))
                            case "val" | "yVal":
                                s.values = _numbers(_points(part))
                    out.series.append(s)
    return out


def shown(value: float | None) -> str:
    """Ten decimals at most, without zeros at the end."""
    if value is None or value != value or value in (float("inf"), float("-inf")):
        return ""
    text = f"{value:.10f}".rstrip("0").rstrip(".")
    return "0" if text == "-0" else text


def _cell(text: str) -> Cell:
    return Cell([Paragraph(pieces=[Piece("text", text)] if text else [])])


def chart_blocks(chart: Chart) -> tuple[list, bool]:
    """The title and a table of the values, a row a category or x value and a column a series; and whether rows
    or series beyond the limits were left out."""
    out: list = []
    if chart.title.strip():
        out.append(Paragraph(pieces=[Piece("text", chart.title)]))
    if not chart.series:
        return out, False
    first, kept = chart.series[0], chart.series[:SERIES]
    n = max(max([*s.values, *s.categories, *s.x, -1]) + 1 for s in chart.series)
    head = ["x" if first.x else "", *(s.name or f"Series {i}" for i, s in enumerate(kept, 1))]
    rows = [Row([_cell(t) for t in head])]
    for k in range(min(n, ROWS)):
        label = shown(first.x.get(k)) if first.x else first.categories.get(k, "")
        rows.append(Row([_cell(label), *(_cell(shown(s.values.get(k))) for s in kept)]))
    return [*out, Table(rows, [1440] * len(head))], n > ROWS or len(chart.series) > SERIES


def diagram_blocks(root: Node) -> list:
    """A paragraph for each line of the shapes, or of the points of the data."""
    out = []
    for body in (n for n in root.walk() if n.tag in ("dsp:txBody", "dgm:t") or _local(n) == "txBody"):
        for line in _text(body).split("\n"):
            if line.strip():
                out.append(Paragraph(pieces=[Piece("text", line)]))
    return out
