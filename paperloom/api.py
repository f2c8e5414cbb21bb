"""One document at a time, on the driver: open, look at, convert and save.

The same functions run over many files as DataFrames in ``paperloom.plans.documents``.
"""

from __future__ import annotations

import json
from copy import deepcopy
from dataclasses import asdict
from pathlib import Path

from .layout import PageSetup, paginate
from .model import Document as Model
from .model import Table
from .outputs import blocks_view, to_html, to_markdown, to_text
from .outputs.view import aligned_view
from .outputs.walk import Lists, Resolver
from .plans.documents import read_document
from .sinks.docx import write_docx
from .sources.containers import detect
from .sources.markdown import read_markdown

#: Options of each format, with their defaults.
FORMATS = {
    "text": {"list_labels": True, "headers_footers": False, "notes": True, "comments": False},
    "markdown": {"title": False, "page_breaks": False, "images": "reference", "image_prefix": "", "headers_footers": False, "notes": True, "comments": False},
    "html": {"standalone": False, "images": "embed", "image_prefix": "", "headers_footers": False, "notes": True},
    "json": {"pretty": False},
}


def checked(spec: str | dict, **options) -> tuple[str, dict]:
    """A format and its options; unknown ones are refused."""
    if isinstance(spec, dict):
        options = {k: v for k, v in spec.items() if k != "format"} | options
        spec = spec.get("format", "")
    if spec not in FORMATS:
        raise ValueError(f"unknown format {spec!r}; known: {', '.join(FORMATS)}")
    unknown = set(options) - set(FORMATS[spec])
    if unknown:
        raise ValueError(f"unknown options for {spec}: {', '.join(sorted(unknown))}")
    if options.get("images", "omit") not in ("reference", "embed", "omit"):
        raise ValueError("images is reference, embed or omit")
    return spec, FORMATS[spec] | options


def write(doc: Model, spec: str, options: dict) -> str:
    if spec == "text":
        return to_text(doc, **options)
    if spec == "markdown":
        return to_markdown(doc, **options)
    if spec == "html":
        return to_html(doc, **options)
    return json.dumps(as_json(doc), ensure_ascii=False, indent=2 if options["pretty"] else None, separators=None if options["pretty"] else (",", ":"))


def as_json(doc: Model) -> dict:
    """The whole model as plain values; the bytes of media are left out."""
    out = asdict(doc)
    out["media"] = [{"name": m.name, "content_type": m.content_type, "size": len(m.data)} for m in doc.media]
    return out


class Page:
    def __init__(self, pages: Pages, index: int):
        self._pages, self.index, self.number = pages, index, index + 1

    def to(self, spec: str | dict, **options) -> str:
        return self._pages[self.index : self.index + 1].to(spec, **options)[0]


class Pages:
    """Pages by index, slice and iteration."""

    def __init__(self, doc: Model, setup: PageSetup | None, chosen: list[int] | None = None):
        self._doc, self._setup = doc, setup
        self._layout = paginate(doc, setup)
        self._chosen = list(range(len(self._layout))) if chosen is None else chosen

    def __len__(self) -> int:
        return len(self._chosen)

    def __iter__(self):
        return (Page(self, i) for i in self._chosen)

    def __getitem__(self, key):
        if isinstance(key, slice):
            out = Pages.__new__(Pages)
            out._doc, out._setup, out._layout, out._chosen = self._doc, self._setup, self._layout, self._chosen[key]
            return out
        if not -len(self) <= key < len(self):
            raise IndexError(f"page {key} of {len(self)}")
        return Page(self, self._chosen[key])

    def to(self, spec: str | dict, **options) -> list[str]:
        """One string a page: the blocks that start on it. List numbers go on from page to page."""
        spec, options = checked(spec, **options)
        blocks = [b for section in self._doc.sections for b in section]
        if spec == "json":
            views = aligned_view(self._doc)
            rows = [[r for r in views[self._layout[i].block_start : self._layout[i].block_end] if r] for i in self._chosen]
            return [json.dumps(r, ensure_ascii=False, indent=2 if options["pretty"] else None) if r else "" for r in rows]
        states = _list_states(self._doc, blocks, {self._layout[i].block_start for i in self._chosen})
        out = []
        for page in (self._layout[i] for i in self._chosen):
            own = blocks[page.block_start : page.block_end]
            out.append(write(Model(**{**self._doc.__dict__, "sections": [own], "list_state": states[page.block_start]}), spec, options))
        return out


def _list_states(doc: Model, blocks: list, starts: set[int]) -> dict[int, tuple[dict, dict]]:
    """The lists' counters before each of the blocks with these numbers: one pass, as the writers count."""
    lists, resolver, out = Lists(doc), Resolver(doc), {}

    def count(block) -> None:
        if isinstance(block, Table):
            for row in block.rows:
                for cell in row.cells:
                    for b in cell.blocks:
                        count(b)
        elif ref := resolver.paragraph(block)[0]:
            lists.next(*ref)

    for i, block in enumerate([*blocks, None]):
        if i in starts:
            out[i] = deepcopy((lists.counters, lists.ordinals))
        if block is not None:
            count(block)
    return out


class Document:
    def __init__(self, path: str | Path | None = None, *, data: bytes | None = None, password: str | None = None):
        if (path is None) == (data is None):
            raise ValueError("give a path or data")
        self.model = read_document(Path(path).read_bytes() if data is None else data, password)

    @property
    def format(self) -> str:
        return self.model.format

    @property
    def metadata(self) -> dict[str, str]:
        return dict(self.model.metadata)

    @property
    def diagnostics(self) -> list[tuple[str, str, str]]:
        return list(self.model.diagnostics)

    @property
    def styles(self) -> list[dict]:
        return [{"style_id": s.id, "name": s.name, "kind": s.kind, "based_on": s.based_on, "is_default": s.default} for s in self.model.styles.values()]

    @property
    def fonts(self) -> list[str]:
        """Every font that is asked for, sorted."""
        resolver = Resolver(self.model)
        named = {s.format.font for s in self.model.styles.values()} | {self.model.default_run.font}
        todo = [b for section in self.model.sections for b in section]
        while todo:
            b = todo.pop()
            if hasattr(b, "rows"):
                todo += [x for r in b.rows for c in r.cells for x in c.blocks]
            else:
                named |= {p.format.font for p in b.pieces}
        return sorted({f for f in map(resolver.face, named) if f})

    def to(self, spec: str | dict, **options) -> str:
        return write(self.model, *checked(spec, **options))

    def extract_text(self, **options) -> str:
        return self.to("text", **options)

    def extract_markdown(self, **options) -> str:
        return self.to("markdown", **options)

    def extract_html(self, **options) -> str:
        return self.to("html", **options)

    def to_json(self, pretty: bool = False) -> str:
        return self.to("json", pretty=pretty)

    def blocks(self) -> list[dict]:
        return blocks_view(self.model)

    def images(self) -> list[tuple[str, str, bytes]]:
        return [(m.name.rpartition("/")[2], m.content_type, m.data) for m in self.model.media]

    def pages(self, setup: PageSetup | None = None) -> Pages:
        return Pages(self.model, setup)

    def page(self, index: int) -> Page:
        return self.pages()[index]

    def page_count(self) -> int:
        return len(self.pages())

    def to_docx(self) -> bytes:
        return write_docx(self.model)

    def save_docx(self, path: str | Path) -> None:
        Path(path).write_bytes(self.to_docx())


def convert(source: str | Path, target: str | Path, password: str | None = None) -> None:
    """By the target's extension: docx, md, html, txt or json. Markdown sources are read too."""
    source, target = Path(source), Path(target)
    doc = read_markdown(source.read_text("utf-8")) if source.suffix == ".md" else read_document(source.read_bytes(), password)
    kinds = {".md": "markdown", ".html": "html", ".txt": "text", ".json": "json"}
    if target.suffix == ".docx":
        target.write_bytes(write_docx(doc))
    elif target.suffix in kinds:
        target.write_text(write(doc, *checked(kinds[target.suffix])), "utf-8")
    else:
        raise ValueError(f"unknown extension {target.suffix!r}")


def hexdump(data: bytes, width: int = 16, start: int = 0) -> str:
    """Offset, bytes and their ASCII characters, a line for each ``width`` bytes."""
    lines = []
    for at in range(0, len(data), width):
        part = data[at : at + width]
        shown = "".join(chr(b) if 32 <= b < 127 else "." for b in part)
        lines.append(f"{start + at:08x}  {part.hex(' '):<{3 * width - 1}}  {shown}")
    return "\n".join(lines)


def pretty_xml(data: bytes | str, indent: str = "  ") -> str:
    """An element a line; elements that hold text alone stay on theirs."""
    from .outputs.html import escape
    from .sources.xmltree import parse

    out: list[str] = []
    todo: list = [(parse(data), 0)]
    while todo:
        node, depth = todo.pop()
        if isinstance(node, str):
            out.append(indent * depth + node)
            continue
        head = node.tag + "".join(f' {k}="{escape(v)}"' for k, v in node.attributes.items())
        text = node.text.strip()
        if not node.children:
            out.append(indent * depth + (f"<{head}>{escape(text)}</{node.tag}>" if text else f"<{head}/>"))
            continue
        out.append(f"{indent * depth}<{head}>{escape(text)}")
        todo += [(f"</{node.tag}>", depth), *((c, depth + 1) for c in reversed(node.children))]
    return "\n".join(out)


__all__ = ["FORMATS", "Document", "Page", "Pages", "convert", "detect", "hexdump", "pretty_xml"]
