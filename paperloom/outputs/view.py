"""The flat block view for retrieval, and its JSON."""

from __future__ import annotations

import json

from ..model import Document, Paragraph
from .text import TextWriter
from .walk import Resolver


def aligned_view(doc: Document, resolver: Resolver | None = None) -> list[dict | None]:
    """kind, section, style, heading_level, list_level, list_label and text of each block; None without text."""
    w = TextWriter(doc, list_labels=False, resolver=resolver)
    out = []
    for number, section in enumerate(doc.sections):
        for b in section:
            row = {"kind": "table", "section": number, "style": None, "heading_level": None, "list_level": None, "list_label": None}
            if isinstance(b, Paragraph):
                ref, heading, _ = w.resolver.paragraph(b)
                item = w.lists.next(*ref) if ref else None
                plain = [(p, f) for p, f in w.resolver.pieces(b) if p.kind not in ("page", "column")]
                text = "".join(p.text if p.kind in ("text", "math") else "\t" if p.kind == "tab" else "\n" if p.kind == "line" else "" for p, _ in plain)
                row |= {"style": b.style, "kind": "list_item" if item else "heading" if heading is not None else "paragraph"}
                if item:
                    row |= {"list_level": item.level, "list_label": item.label}
                elif heading is not None:
                    row["heading_level"] = heading + 1
            else:
                own = TextWriter(doc, list_labels=False, resolver=w.resolver)
                text = "\n".join("\t".join(" ".join(own.cell(c.blocks).split()) for c in r.cells) for r in b.rows)
            out.append(row | {"text": text.strip()} if text.strip() else None)
    return out


def blocks_view(doc: Document, resolver: Resolver | None = None) -> list[dict]:
    """The rows of the blocks that have text."""
    return [row for row in aligned_view(doc, resolver) if row]


def blocks_json(doc: Document, pretty: bool = False) -> str:
    return json.dumps(blocks_view(doc), ensure_ascii=False, indent=2 if pretty else None, separators=None if pretty else (",", ":"))
