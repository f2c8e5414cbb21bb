"""Semantic HTML."""

from __future__ import annotations

import base64

from ..model import Document, Paragraph, Piece, Table
from .walk import PLAIN, Format, Lists, Notes, Resolver, all_monospace, href, note_label

#: The list types of HTML.
TYPES = {"lower_letter": "a", "upper_letter": "A", "lower_roman": "i", "upper_roman": "I"}
TAGS = (("bold", "strong"), ("italic", "em"), ("underline", "u"), ("strike", "s"), ("superscript", "sup"), ("subscript", "sub"), ("mono", "code"))


def escape(text: str) -> str:
    if not ("&" in text or "<" in text or ">" in text or '"' in text):
        return text
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def tagged(text: str, fmt: Format, heading: bool) -> str:
    """White space at the ends stays outside the tags."""
    core = text.strip()
    if not core or fmt is PLAIN:
        return escape(text)
    names = [tag for name, tag in TAGS if getattr(fmt, name) and not (heading and name == "bold")]
    lead, trail = text[: len(text) - len(text.lstrip())], text[len(text.rstrip()) :]
    return escape(lead) + "".join(f"<{t}>" for t in names) + escape(core) + "".join(f"</{t}>" for t in reversed(names)) + escape(trail)


class HtmlWriter:
    def __init__(self, doc: Document, images: str = "embed", prefix: str = "", notes: bool = True, resolver: Resolver | None = None):
        self.doc, self.resolver, self.lists, self.notes = doc, resolver or Resolver(doc), Lists(doc), Notes()
        self.images, self.prefix, self.with_notes = images, prefix, notes

    def image(self, piece: Piece) -> str:
        media = self.doc.media[piece.ref]
        if self.images == "omit":
            return ""
        src = f"data:{media.content_type};base64,{base64.b64encode(media.data).decode()}" if self.images == "embed" else self.prefix + media.name.rpartition("/")[2]
        return f'<img src="{escape(src)}" alt="{escape(piece.text)}">'

    def inline(self, pieces: list[tuple[Piece, Format]], heading: bool = False) -> str:
        if len(pieces) == 1 and pieces[0][0].kind == "text" and not pieces[0][0].link:
            return tagged(pieces[0][0].text, pieces[0][1], heading)
        out, group, fmt, link = [], "", PLAIN, (None, 0)

        def flush():
            nonlocal group
            out.append(tagged(group, fmt, heading))
            group = ""

        for piece, own in pieces:
            target = (piece.link if piece.link and any(piece.link) else None, piece.link_id)
            if target != link:
                flush()
                if link[0]:
                    out.append("</a>")
                if target[0]:
                    out.append(f'<a href="{escape(href(target[0]))}">')
                link = target
            if piece.kind in ("text", "tab"):
                text = "\t" if piece.kind == "tab" else piece.text
                if own != fmt and text.strip():
                    flush()
                    fmt = own
                group += text
                continue
            flush()
            match piece.kind:
                case "line":
                    out.append("<br>")
                case "footnote" | "endnote" if self.with_notes:
                    label = note_label(piece.kind, self.notes.number(piece.kind, piece.ref))
                    out.append(f'<sup><a href="#fn-{label}" id="fnref-{label}">{label}</a></sup>')
                case "math":
                    out.append(f'<span class="math">{escape(piece.text)}</span>')
                case "image":
                    out.append(self.image(piece))
        flush()
        if link[0]:
            out.append("</a>")
        return "".join(out)

    def blocks(self, blocks: list) -> str:
        """Blocks one after the other; lists stay open while items follow."""
        out: list[str] = []
        stack: list[tuple[int, str, str]] = []  # level, tag, number format
        code: list[str] = []

        def end_code():
            if code:
                out.append("<pre><code>" + "\n".join(code) + "</code></pre>\n")
                code.clear()

        def end_lists(level: int = -1):
            while stack and stack[-1][0] > level:
                out.append(f"</li>\n</{stack.pop()[1]}>\n")

        for b in blocks:
            if isinstance(b, Table):
                end_code(), end_lists()
                out.append(self.table(b))
                continue
            ref, heading, is_code = self.resolver.paragraph(b)
            pieces = self.resolver.pieces(b)
            if is_code or all_monospace(pieces):
                end_lists()
                code.append(escape("".join(x.text if x.kind == "text" else "\t" if x.kind == "tab" else "\n" if x.kind == "line" else "" for x, _ in pieces)))
                continue
            item = self.lists.next(*ref) if ref else None
            text = self.inline(pieces, heading is not None and item is None).strip()
            if not text:
                continue
            end_code()
            if item is None:
                end_lists()
                tag = f"h{min(heading + 1, 6)}" if heading is not None else "p"
                out.append(f"<{tag}>{text}</{tag}>\n")
                continue
            tag = "ul" if item.bullet else "ol"
            end_lists(item.level)
            if stack and stack[-1][0] == item.level:
                if stack[-1][1:] != (tag, item.format):
                    end_lists(item.level - 1)
                else:
                    out.append("</li>\n")
            if not stack or stack[-1][0] < item.level:
                kind = f' type="{TYPES[item.format]}"' if item.format in TYPES else ""
                start = f' start="{item.ordinal}"' if tag == "ol" and item.ordinal != 1 else ""
                out.append(f"<{tag}{kind}{start}>\n")
                stack.append((item.level, tag, item.format))
            out.append(f"<li>{text}")
        end_code()
        end_lists()
        return "".join(out)

    def table(self, t: Table) -> str:
        starts, out = [], []
        for r in t.rows:
            at, row = 0, []
            for c in r.cells:
                row.append((at, c))
                at += c.span
            starts.append(row)
        for i, (r, row) in enumerate(zip(t.rows, starts, strict=True)):
            cells = []
            for at, c in row:
                if c.merge == "continue":
                    continue
                span = 1
                if c.merge == "restart":
                    for later in starts[i + 1 :]:
                        if not any(a == at and x.merge == "continue" for a, x in later):
                            break
                        span += 1
                tag = "th" if r.header else "td"
                attributes = (f' colspan="{c.span}"' if c.span > 1 else "") + (f' rowspan="{span}"' if span > 1 else "")
                cells.append(f"<{tag}{attributes}>{self.cell(c.blocks)}</{tag}>")
            out.append("<tr>" + "".join(cells) + "</tr>\n")
        return "<table>\n" + "".join(out) + "</table>\n"

    def cell(self, blocks: list) -> str:
        full = [b for b in blocks if isinstance(b, Table) or b.pieces]
        if len(full) == 1 and isinstance(full[0], Paragraph):
            ref, heading, _ = self.resolver.paragraph(full[0])
            if ref is None and heading is None:
                return self.inline(self.resolver.pieces(full[0])).strip()
        return self.blocks(full)


def to_html(doc: Document, standalone: bool = False, images: str = "embed", image_prefix: str = "", headers_footers: bool = False, notes: bool = True, resolver: Resolver | None = None) -> str:
    w = HtmlWriter(doc, images, image_prefix, notes, resolver)
    stories = [*(doc.headers if headers_footers else []), [b for s in doc.sections for b in s], *(doc.footers if headers_footers else [])]
    body = "".join(w.blocks(s) for s in stories)
    rows, done = [], 0
    while done < len(w.notes.order):
        kind, ref, n = w.notes.order[done]
        done += 1
        note = (doc.footnotes if kind == "footnote" else doc.endnotes).get(ref)
        if note is not None:
            label = note_label(kind, n)
            rows.append(f'<li id="fn-{label}">\n{w.blocks(note.blocks)}<a href="#fnref-{label}">↩</a></li>\n')
    if rows:
        body += '<section class="footnotes">\n<ol>\n' + "".join(rows) + "</ol>\n</section>\n"
    if not standalone:
        return body
    title = escape(doc.metadata.get("title", ""))
    return f'<!DOCTYPE html>\n<html>\n<head>\n<meta charset="utf-8">\n<title>{title}</title>\n</head>\n<body>\n{body}</body>\n</html>\n'
