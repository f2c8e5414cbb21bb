"""Plain text: a line a paragraph, tab-separated table rows, notes at the end."""

from __future__ import annotations

from ..model import Document, Paragraph, Table
from .walk import Lists, Notes, Resolver, note_label


class TextWriter:
    def __init__(self, doc: Document, list_labels: bool = True, notes: bool = True, comments: bool = False, resolver: Resolver | None = None):
        self.doc, self.resolver, self.lists, self.notes = doc, resolver or Resolver(doc), Lists(doc), Notes()
        self.labels, self.with_notes, self.with_comments = list_labels, notes, comments
        self.comment_order: list[int] = []

    def line(self, p: Paragraph) -> str:
        ref, _, _ = self.resolver.paragraph(p)
        item = self.lists.next(*ref) if ref else None
        out = []
        for piece, _ in self.resolver.pieces(p):
            if piece.kind == "text":
                out.append(piece.text)
                continue
            match piece.kind:
                case "math":
                    out.append(piece.text)
                case "tab":
                    out.append("\t")
                case "line" | "page" | "column":
                    out.append("\n")
                case "footnote" | "endnote" if self.with_notes:
                    out.append(f"[{note_label(piece.kind, self.notes.number(piece.kind, piece.ref))}]")
                case "comment" if self.with_comments and piece.ref not in self.comment_order:
                    self.comment_order.append(piece.ref)
        text = "".join(out)
        return f"{item.label} {text}" if item and self.labels and item.label else text

    def cell(self, blocks: list) -> str:
        if len(blocks) == 1 and isinstance(blocks[0], Paragraph):
            return self.line(blocks[0]).replace("\n", " ").replace("\t", " ")
        texts = [self.line(b) if isinstance(b, Paragraph) else self.table(b).replace("\n", " ") for b in blocks]
        return " ".join(t.replace("\n", " ").replace("\t", " ") for t in texts if t)

    def table(self, t: Table) -> str:
        return "\n".join("\t".join(self.cell(c.blocks) for c in r.cells) for r in t.rows)

    def story(self, blocks: list) -> list[str]:
        return [self.line(b) if isinstance(b, Paragraph) else self.table(b) for b in blocks]


def to_text(doc: Document, list_labels: bool = True, headers_footers: bool = False, notes: bool = True, comments: bool = False, resolver: Resolver | None = None) -> str:
    w = TextWriter(doc, list_labels, notes, comments, resolver)
    lines = []
    if headers_footers:
        for blocks in doc.headers:
            lines += w.story(blocks)
    for section in doc.sections:
        lines += w.story(section)
    if headers_footers:
        for blocks in doc.footers:
            lines += w.story(blocks)
    out = "".join(f"{line}\n" for line in lines)
    done, first = 0, True
    while done < len(w.notes.order):
        kind, ref, n = w.notes.order[done]
        done += 1
        note = (doc.footnotes if kind == "footnote" else doc.endnotes).get(ref)
        if note is not None:
            out += ("\n" if first and done == 1 else "") + f"[{note_label(kind, n)}] " + " ".join(x.strip() for x in w.story(note.blocks) if x.strip()) + "\n"
        first = False
    for n, ref in enumerate(w.comment_order, 1):
        c = doc.comments.get(ref)
        if c is not None:
            out += f"[c{n}] " + (f"{c.author}: " if c.author else "") + " ".join(x.strip() for x in w.story(c.blocks)) + "\n"
    return out
