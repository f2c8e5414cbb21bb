"""GitHub-flavoured Markdown."""

from __future__ import annotations

import base64
import re

from ..model import Document, Paragraph, Piece, Table
from .walk import PLAIN, Format, Lists, Notes, Resolver, all_monospace, href, note_label


_SPECIAL = re.compile(r"[\\`*\[\]<~]")
_UNDERSCORE = re.compile(r"(?<![^\W_])_|_(?![^\W_])")
_NUMBERED = re.compile(r"([0-9]{1,9})([.)])(?=[ \t]|\Z)")


def escape(text: str, table: bool = False) -> str:
    if _SPECIAL.search(text):
        text = _SPECIAL.sub(r"\\\g<0>", text)
    if "_" in text:
        text = _UNDERSCORE.sub(r"\\_", text)
    return text.replace("|", "\\|") if table else text


def escape_line(line: str) -> str:
    if line[:1] in ("#", ">", "-", "+", "=") and line:
        return "\\" + line
    m = _NUMBERED.match(line)
    return f"{m[1]}\\{line[m.end(1) :]}" if m else line


def code_span(text: str) -> str:
    fence = "`" * (max(map(len, re.findall("`+", text)), default=0) + 1)
    pad = " " if text[:1] == "`" or text[-1:] == "`" else ""
    return f"{fence}{pad}{text}{pad}{fence}"


def link_target(url: str) -> str:
    if not url or re.search("[ ()]", url):
        return "<" + url.replace("<", "%3C").replace(">", "%3E") + ">"
    return url


def styled(text: str, fmt: Format, heading: bool, table: bool) -> str:
    """A group of equal format; white space at its ends stays outside the marks."""
    core = text.strip()
    if not core:
        return text
    if fmt is PLAIN and core == text:
        return escape(text, table)
    lead, trail = text[: len(text) - len(text.lstrip())], text[len(text.rstrip()) :]
    if fmt.mono:
        return lead + code_span(core) + trail
    marks = "*" * (2 * (fmt.bold and not heading) + fmt.italic)
    strike = "~~" if fmt.strike else ""
    body = f"{strike}{marks}{escape(core, table)}{marks}{strike}"
    if fmt.subscript:
        body = f"<sub>{body}</sub>"
    if fmt.superscript:
        body = f"<sup>{body}</sup>"
    return lead + body + trail


def _plain(fmt: Format, heading: bool) -> Format:
    return Format(fmt.bold and not heading, fmt.italic, False, fmt.strike, fmt.superscript, fmt.subscript, fmt.mono)


class MarkdownWriter:
    def __init__(self, doc: Document, images: str, prefix: str, notes: bool, comments: bool, page_breaks: bool, resolver: Resolver | None = None):
        self.doc, self.resolver, self.lists, self.notes = doc, resolver or Resolver(doc), Lists(doc), Notes()
        self.images, self.prefix, self.with_notes, self.with_comments, self.page_breaks = images, prefix, notes, comments, page_breaks
        self.out: list[str] = []
        self.last = ""
        self.stack: list[tuple[int, int]] = []
        self.comment_order: list[int] = []

    def begin(self, kind: str) -> None:
        """Blank lines between blocks; items of a list and lines of code follow closely."""
        if self.last == "code" and kind != "code":
            self.out.append("\n```")
        if self.last:
            close = kind == self.last and kind in ("item", "code")
            self.out.append("\n" if close else "\n\n")
        if kind != "item":
            self.stack.clear()
        if kind == "code" and self.last != "code":
            self.out.append("```\n")
        self.last = kind

    def image(self, piece: Piece, table: bool) -> str:
        media = self.doc.media[piece.ref]
        if self.images == "omit":
            return ""
        url = f"data:{media.content_type};base64,{base64.b64encode(media.data).decode()}" if self.images == "embed" else self.prefix + media.name.rpartition("/")[2]
        return f"![{escape(piece.text, table)}]({link_target(url)})"

    def inline(self, pieces: list[tuple[Piece, Format]], heading: bool = False, table: bool = False) -> tuple[str, bool]:
        """(text, whether a page break stands in it)."""
        if len(pieces) == 1 and pieces[0][0].kind == "text" and not pieces[0][0].link:
            piece, raw = pieces[0]
            text = styled(piece.text, raw if raw is PLAIN else _plain(raw, heading), heading, table)
            return text[:-2] if text.endswith("\\\n") else text, False
        out: list[str] = []
        group, fmt, link, link_id, link_start, broke = "", Format(), None, 0, 0, False

        def flush():
            nonlocal group
            out.append(styled(group, fmt, heading, table))
            group = ""

        def close():
            nonlocal link
            if link is None:
                return
            text = "".join(out[link_start:])
            del out[link_start:]
            if text.strip():
                url = href(link)
                out.append(f"[{text}]({link_target(url)})" if url else text)
            link = None

        for piece, raw in pieces:
            own = piece.link if piece.link and any(piece.link) else None
            if own != link or piece.link_id != link_id:
                flush()
                close()
                link, link_id, link_start = own, piece.link_id, len(out)
            if piece.kind in ("text", "tab"):
                text = " " if piece.kind == "tab" else piece.text
                new = _plain(raw, heading)
                if new != fmt and text.strip():
                    if group.strip():
                        flush()
                    fmt = new if not group or group.strip() == "" else fmt
                    if group and not group.strip():
                        out.append(group)
                        group = ""
                    fmt = new
                group += text
                continue
            flush()
            match piece.kind:
                case "line" | "column":
                    out.append("<br>" if table else " " if heading else "\\\n")
                case "page":
                    broke = True
                case "footnote" | "endnote" if self.with_notes:
                    out.append(f"[^{note_label(piece.kind, self.notes.number(piece.kind, piece.ref))}]")
                case "comment" if self.with_comments:
                    if piece.ref not in self.comment_order:
                        self.comment_order.append(piece.ref)
                    out.append(f"[^c{self.comment_order.index(piece.ref) + 1}]")
                case "math":
                    fence = "$$" if piece.ref and not table else "$"
                    if "".join(out[-2:]).endswith("$"):
                        out.append(" ")
                    out.append(f"{fence}{piece.latex}{fence}")
                case "image":
                    out.append(self.image(piece, table))
        flush()
        close()
        text = "".join(out)
        return text[:-2] if text.endswith("\\\n") else text, broke

    def lines(self, text: str, indent: str) -> str:
        if "\n" not in text:
            return escape_line(text)
        first, *rest = text.split("\n")
        return "".join([escape_line(first), *(f"\n{indent}{escape_line(x.lstrip())}" for x in rest)])

    def paragraph(self, p: Paragraph) -> None:
        ref, heading, code = self.resolver.paragraph(p)
        if self.page_breaks and p.page_break_before and self.last:
            self.rule()
        pieces = self.resolver.pieces(p)
        if code or all_monospace(pieces):
            self.begin("code")
            text = "".join({"text": x.text, "math": x.text, "tab": "\t", "line": "\n"}.get(x.kind, "") for x, _ in pieces)
            self.out.append(text.rstrip().lstrip("\n"))
            return
        item = self.lists.next(*ref) if ref else None
        heading = heading if item is None else None
        text, broke = self.inline(pieces, heading is not None)
        text = text.strip()
        if text:
            if item:
                self.begin("item")
                while self.stack and self.stack[-1][0] >= item.level:
                    self.stack.pop()
                indent = sum(w for _, w in self.stack)
                label = item.label.strip()
                marker = "-" if item.bullet else label if re.fullmatch(r"[0-9]{1,9}[.)]", label) else f"{item.ordinal}."
                self.out.append(" " * indent + marker + " " + self.lines(text, " " * (indent + len(marker) + 1)))
                self.stack.append((item.level, len(marker) + 1))
            else:
                self.begin("block")
                self.out.append(f"{'#' * min(heading + 1, 6)} {text}" if heading is not None else self.lines(text, ""))
        if broke and self.page_breaks:
            self.rule()

    def rule(self) -> None:
        self.begin("block")
        self.out.append("---")

    def cell(self, blocks: list) -> str:
        parts = []
        for b in blocks:
            if isinstance(b, Table):
                parts += [self.cell(c.blocks) for r in b.rows for c in r.cells]
                continue
            ref, _, _ = self.resolver.paragraph(b)
            item = self.lists.next(*ref) if ref else None
            text = self.inline(self.resolver.pieces(b), table=True)[0].strip()
            if text:
                parts.append(f"{item.label} {text}" if item and item.label else text)
        if len(parts) == 1:
            return parts[0].replace("\n", " ")
        return "<br>".join(p for p in parts if p).replace("\n", " ")

    def table(self, t: Table) -> None:
        width = max(max((len(r.cells) for r in t.rows), default=0), len(t.grid), 1) if t.rows else 0
        if not width:
            return
        self.begin("block")
        rows = []
        for i, r in enumerate(t.rows):
            cells = ["" if c.merge == "continue" else self.cell(c.blocks) for c in r.cells]
            rows.append("| " + " | ".join(cells + [""] * (width - len(cells))) + " |")
            if i == 0:
                rows.append("|" + " --- |" * width)
        self.out.append("\n".join(rows))

    def note_body(self, blocks: list) -> str:
        parts = []
        for b in blocks:
            text = self.inline(self.resolver.pieces(b))[0] if isinstance(b, Paragraph) else " ".join(self.cell(c.blocks) for r in b.rows for c in r.cells)
            if text.strip():
                parts.append(text.strip().replace("\n", "\n    "))
        return "\n\n    ".join(parts)

    def blocks(self, blocks: list) -> None:
        for b in blocks:
            self.paragraph(b) if isinstance(b, Paragraph) else self.table(b)


def to_markdown(doc: Document, title: bool = False, page_breaks: bool = False, images: str = "reference", image_prefix: str = "", headers_footers: bool = False, notes: bool = True, comments: bool = False, resolver: Resolver | None = None) -> str:
    w = MarkdownWriter(doc, images, image_prefix, notes, comments, page_breaks, resolver)
    if title and doc.metadata.get("title"):
        w.begin("block")
        w.out.append("# " + escape(doc.metadata["title"]))
    for blocks in [*(doc.headers if headers_footers else []), *doc.sections, *(doc.footers if headers_footers else [])]:
        w.blocks(blocks)
    done = 0
    while done < len(w.notes.order):
        kind, ref, n = w.notes.order[done]
        done += 1
        note = (doc.footnotes if kind == "footnote" else doc.endnotes).get(ref)
        if note is not None:
            body = w.note_body(note.blocks)
            w.begin("note")
            w.out.append(f"[^{note_label(kind, n)}]: {body}")
    for n, ref in enumerate(w.comment_order, 1):
        c = doc.comments.get(ref)
        if c is not None:
            body = w.note_body(c.blocks)
            w.begin("note")
            w.out.append(f"[^c{n}]: " + (f"**{escape(c.author)}:** " if c.author else "") + body)
    if w.last == "code":
        w.out.append("\n```")
    return "".join(w.out) + "\n" if w.out else ""


