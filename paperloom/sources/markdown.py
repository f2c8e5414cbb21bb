"""Markdown -> the document model: headings, paragraphs, nested lists, quotes, fences, rules, pipe tables,
emphasis, code, links, images' alternative texts, hard breaks and footnotes."""

from __future__ import annotations

import re

from ..model import Cell, Document, Level, Note, Paragraph, Piece, Row, RunFormat, Style, Table

_ITEM = re.compile(r"^( *)(?:([-*+])|([0-9]{1,9})([.)]))(?: +(.*)|)$")
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
_RULE = re.compile(r"^ {0,3}(?:(?:- *){3,}|(?:\* *){3,}|(?:_ *){3,})$")
_NOTE = re.compile(r"^\[\^([^\]]+)\]:\s?(.*)$")
_INLINE = re.compile(
    r"(?=[\\`!\[*_~< ])(?:\\([!-/:-@\[-`{-~])|(`+)(.+?)(?<!`)\2(?!`)|!\[([^\]]*)\]\(([^)]*)\)|\[\^([^\]]+)\]|\[((?:\\.|[^\]\\])*)\]\((<[^>]*>|[^()\s]*)(?:\s+\"[^\"]*\")?\)"
    r"|(\*\*\*|___)(?=\S)(.+?)(?<=\S)\9|(\*\*|__)(?=\S)(.+?)(?<=\S)\11|(\*|_)(?=\S)(.+?)(?<=\S)\13|~~(?=\S)(.+?)(?<=\S)~~|( {2,}|\\)\n|<(https?:[^>\s]+)>)",
    re.S,
)


_BAR = re.compile(r"(?<!\\)\|")
#: What any match of ``_INLINE`` begins with.
_MARK = re.compile(r"[\\`!\[*_~<]| {2,}\n")


def new_document() -> Document:
    doc = Document("markdown")
    doc.styles["Normal"] = Style("Normal", "Normal", default=True)
    for n in range(1, 7):
        doc.styles[f"Heading{n}"] = Style(f"Heading{n}", f"heading {n}", based_on="Normal", outline=n - 1)
    doc.styles["Quote"] = Style("Quote", "Quote", based_on="Normal")
    doc.styles["SourceCode"] = Style("SourceCode", "Source Code", based_on="Normal", format=RunFormat(font="Courier New"))
    doc.abstracts = {0: {k: Level(1, "bullet", "•" if k % 2 == 0 else "o") for k in range(9)}}
    doc.instances = {1: (0, {}, {})}
    return doc


class MarkdownReader:
    def __init__(self, markdown: str):
        self.doc = new_document()
        self.links = 0
        self.notes: dict[str, int] = {}
        self.lines = markdown.replace("\r\n", "\n").replace("\r", "\n").split("\n")

    def inline(self, text: str, fmt: RunFormat | None = None, link=None, link_id: int = 0) -> list[Piece]:
        fmt, out, at = fmt or RunFormat(), [], 0

        if not _MARK.search(text):
            parts = text.split("\n") if "\n" in text else [text]
            for i, part in enumerate(parts):
                if i:
                    out.append(Piece("text", " ", fmt, link, link_id))
                if part:
                    out.append(Piece("text", part, fmt, link, link_id))
            return out

        def add(value: str, own: RunFormat) -> None:
            for i, part in enumerate(value.split("\n")):
                if i:
                    out.append(Piece("text", " ", own, link, link_id))
                if part:
                    out.append(Piece("text", part, own, link, link_id))

        def with_(**changes) -> RunFormat:
            return RunFormat(**{**fmt.__dict__, **changes})

        for m in _INLINE.finditer(text):
            if m[13] == "_" and (m.start() and text[m.start() - 1].isalnum() or m.end() < len(text) and text[m.end()].isalnum()):
                continue
            add(text[at : m.start()], fmt)
            at = m.end()
            if m[1]:
                add(m[1], fmt)
            elif m[2]:
                code = m[3]
                out.append(Piece("text", code[1:-1] if code[:1] == code[-1:] == " " and code.strip() else code, with_(font="Courier New"), link, link_id))
            elif m[4] is not None:
                add(m[4], fmt)
            elif m[6]:
                out.append(Piece("footnote", "", fmt, link, link_id, self.notes.setdefault(m[6], len(self.notes) + 1)))
            elif m[7] is not None:
                self.links += 1
                url = m[8].strip("<>")
                target, _, anchor = url.partition("#")
                out += self.inline(m[7], fmt, (target or None, anchor or None), self.links)
            elif m[9]:
                out += self.inline(m[10], with_(bold=True, italic=True), link, link_id)
            elif m[11]:
                out += self.inline(m[12], with_(bold=True), link, link_id)
            elif m[13]:
                out += self.inline(m[14], with_(italic=True), link, link_id)
            elif m[15]:
                out += self.inline(m[15], with_(strike=True), link, link_id)
            elif m[16]:
                out.append(Piece("line", "", fmt, link, link_id))
            elif m[17]:
                self.links += 1
                out.append(Piece("text", m[17], fmt, (m[17], None), self.links))
        add(text[at:], fmt)
        return out

    def ordered(self, start: int, level: int) -> int:
        """A numbering instance of its own for each ordered list."""
        key = len(self.doc.abstracts)
        self.doc.abstracts[key] = {k: Level(start if k == level else 1, "decimal", f"%{k + 1}.") for k in range(9)}
        self.doc.instances[len(self.doc.instances) + 1] = (key, {}, {})
        return len(self.doc.instances)

    def read(self) -> Document:
        blocks, i, lines = self.doc.sections[0], 0, self.lines
        stack: list[tuple[int, int]] = []  # content column, numbering instance
        while i < len(lines):
            line = lines[i]
            if not line.strip():
                i += 1
                continue
            if m := _FENCE.match(line):
                i += 1
                while i < len(lines) and not re.match(rf"^ {{0,3}}{m[1][0]}{{{len(m[1])},}}\s*$", lines[i]):
                    blocks.append(Paragraph("SourceCode", pieces=[Piece("text", lines[i])] if lines[i] else []))
                    i += 1
                i += 1
                continue
            if m := _NOTE.match(line):
                body = [m[2]]
                i += 1
                while i < len(lines) and lines[i].startswith("    "):
                    body.append(lines[i][4:])
                    i += 1
                ref = self.notes.setdefault(m[1], len(self.notes) + 1)
                self.doc.footnotes[ref] = Note(ref, "footnote", [Paragraph(pieces=self.inline("\n".join(body).strip()))])
                continue
            if m := re.match(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$", line):
                blocks.append(Paragraph(f"Heading{len(m[1])}", pieces=self.inline(m[2] or "")))
                stack.clear()
                i += 1
                continue
            if _RULE.match(line):
                stack.clear()
                i += 1
                continue
            if "|" in line and i + 1 < len(lines) and re.match(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$", lines[i + 1]):
                rows = [line]
                i += 2
                while i < len(lines) and "|" in lines[i] and lines[i].strip():
                    rows.append(lines[i])
                    i += 1
                blocks.append(self.table(rows))
                stack.clear()
                continue
            if m := _ITEM.match(line):
                indent = len(m[1])
                while stack and indent < stack[-1][0]:
                    last = stack.pop()
                    if stack and indent >= stack[-1][0] or not stack:
                        self.closed = last
                level = min(8, len(stack))
                width = indent + len(m[2] or f"{m[3]}{m[4]}") + 1
                sibling = getattr(self, "closed", None)
                num = self.instance(m, level, sibling)
                self.closed = None
                stack.append((width, num))
                text, i = self.collect(m[5] or "", i + 1, lines)
                blocks.append(Paragraph(num_id=num, level=level, pieces=self.inline(text)))
                self.previous = (level, num, bool(m[2]))
                continue
            quote = line.lstrip().startswith(">")
            text, i = self.collect(re.sub(r"^\s*> ?", "", line) if quote else line.strip(" "), i + 1, lines, quote)
            if i < len(lines) and not quote and re.match(r"^ {0,3}(=+|-+)\s*$", lines[i]):
                blocks.append(Paragraph("Heading1" if "=" in lines[i] else "Heading2", pieces=self.inline(text)))
                i += 1
            else:
                blocks.append(Paragraph("Quote" if quote else None, pieces=self.inline(text)))
            stack.clear()
            self.previous = None
        return self.doc

    previous: tuple[int, int, bool] | None = None
    closed: tuple[int, int] | None = None

    def instance(self, m: re.Match, level: int, sibling) -> int:
        if m[2]:
            return 1
        held = getattr(self, "open_lists", {})
        self.open_lists = {k: v for k, v in held.items() if k <= level}
        if self.previous is not None and level in self.open_lists:
            return self.open_lists[level]
        self.open_lists[level] = self.ordered(int(m[3]), level)
        return self.open_lists[level]

    def collect(self, first: str, i: int, lines: list[str], quote: bool = False) -> tuple[str, int]:
        """A paragraph's further lines: up to a blank line or the start of another block."""
        out = [first]
        while i < len(lines):
            line = lines[i]
            if not line.strip() or _ITEM.match(line) or _FENCE.match(line) or re.match(r"^ {0,3}(#{1,6}(\s|$)|[=-]+\s*$)", line) or _RULE.match(line) or not quote and line.lstrip().startswith(">"):
                break
            out.append(re.sub(r"^\s*>? ?", "", line) if quote else line.lstrip())
            i += 1
        return "\n".join(out), i

    def table(self, rows: list[str]) -> Table:
        out = Table()
        for k, row in enumerate(rows):
            row = row.strip().removeprefix("|")
            cells = _BAR.split(row) if "\\" in row else row.split("|")
            if len(cells) > 1 and not cells[-1].strip():
                cells.pop()
            out.rows.append(Row([Cell([Paragraph(pieces=self.inline(c.strip().replace("\\|", "|").replace("<br>", "\\\n")))]) for c in cells], header=k == 0))
        return out


def read_markdown(markdown: str) -> Document:
    return MarkdownReader(markdown).read()


def to_docx(markdown: str, title: str | None = None) -> bytes:
    from ..sinks.docx import write_docx

    doc = read_markdown(markdown)
    if title:
        doc.metadata["title"] = title
    return write_docx(doc)
