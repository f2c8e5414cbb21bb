"""The document model that readers make and writers take. Plain Python; formatting stays unresolved."""

from __future__ import annotations

from dataclasses import dataclass, field

TOGGLES = ("bold", "italic", "strike", "vanish")


@dataclass
class RunFormat:
    """Direct formatting; None is unset and inherits."""

    style: str | None = None
    bold: bool | None = None
    italic: bool | None = None
    underline: bool | None = None
    strike: bool | None = None
    vanish: bool | None = None
    vertical: str | None = None
    font: str | None = None
    size: int | None = None


@dataclass
class Piece:
    """One step of a paragraph in reading order: text, tab, line, page, column, footnote, endnote, comment, image, math."""

    kind: str
    text: str = ""
    format: RunFormat = field(default_factory=RunFormat)
    link: tuple[str | None, str | None] | None = None
    link_id: int = 0
    ref: int | None = None
    latex: str = ""


@dataclass
class Paragraph:
    style: str | None = None
    num_id: int | None = None
    level: int = 0
    outline: int | None = None
    page_break_before: bool = False
    pieces: list[Piece] = field(default_factory=list)


@dataclass
class Cell:
    blocks: list = field(default_factory=list)
    span: int = 1
    merge: str | None = None


@dataclass
class Row:
    cells: list[Cell] = field(default_factory=list)
    header: bool = False


@dataclass
class Table:
    rows: list[Row] = field(default_factory=list)
    grid: list[int] = field(default_factory=list)


@dataclass
class Style:
    id: str
    name: str | None = None
    kind: str = "paragraph"
    based_on: str | None = None
    default: bool = False
    outline: int | None = None
    num_id: int | None = None
    level: int = 0
    format: RunFormat = field(default_factory=RunFormat)


@dataclass
class Level:
    start: int = 1
    format: str = "decimal"
    text: str = "%1."
    legal: bool = False
    font: str | None = None


@dataclass
class Note:
    id: int
    kind: str
    blocks: list = field(default_factory=list)
    author: str | None = None


@dataclass
class Media:
    name: str
    data: bytes
    content_type: str


@dataclass
class Margins:
    top: int = 1440
    right: int = 1440
    bottom: int = 1440
    left: int = 1440
    header: int = 720
    footer: int = 720
    gutter: int = 0


@dataclass
class Columns:
    count: int = 1
    space: int = 720
    separator: bool = False
    widths: list[int] = field(default_factory=list)


@dataclass
class SectionFormat:
    """Lengths in twips; header and footer ids by kind: first, default, even."""

    width: int = 12240
    height: int = 15840
    landscape: bool = False
    margins: Margins = field(default_factory=Margins)
    columns: Columns = field(default_factory=Columns)
    start: str = "nextPage"
    title_page: bool = False
    page_number_start: int | None = None
    page_number_format: str | None = None
    borders: str | None = None
    headers: dict[str, str] = field(default_factory=dict)
    footers: dict[str, str] = field(default_factory=dict)


@dataclass
class Settings:
    tab_stop: int = 720
    even_and_odd: bool = False
    compatibility: int = 12


@dataclass
class Theme:
    colours: dict[str, str] = field(default_factory=dict)
    fonts: dict[str, str] = field(default_factory=dict)


@dataclass
class Document:
    format: str = "docx"
    sections: list[list] = field(default_factory=lambda: [[]])
    styles: dict[str, Style] = field(default_factory=dict)
    abstracts: dict[int, dict[int, Level]] = field(default_factory=dict)
    instances: dict[int, tuple[int, dict[int, int], dict[int, Level]]] = field(default_factory=dict)
    footnotes: dict[int, Note] = field(default_factory=dict)
    endnotes: dict[int, Note] = field(default_factory=dict)
    comments: dict[int, Note] = field(default_factory=dict)
    section_formats: list[SectionFormat] = field(default_factory=list)
    settings: Settings = field(default_factory=Settings)
    theme: Theme = field(default_factory=Theme)
    default_run: RunFormat = field(default_factory=RunFormat)
    list_state: tuple[dict, dict] | None = None
    header_parts: dict[str, list] = field(default_factory=dict)
    headers: list[list] = field(default_factory=list)
    footers: list[list] = field(default_factory=list)
    media: list[Media] = field(default_factory=list)
    metadata: dict[str, str] = field(default_factory=dict)
    diagnostics: list[tuple[str, str, str]] = field(default_factory=list)

    def note(self, severity: str, where: str, what: str) -> None:
        self.diagnostics.append((severity, where, what))
