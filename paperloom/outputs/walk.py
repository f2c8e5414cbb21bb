"""What all writers share: resolved paragraphs and runs, list counters, note numbers."""

from __future__ import annotations

import re
from copy import deepcopy
from dataclasses import dataclass, replace

from ..functions.labels import HUNDREDS, ONES, TENS
from ..model import Document, Level, Paragraph, Piece, RunFormat, Style

# Style names of code, without spaces and in lower case.
CODE_STYLES = ("code", "sourcecode", "htmlpreformatted", "preformatted", "plaintext", "codeblock", "macrotext")
# Parts of the names of monospace fonts, in lower case.
MONOSPACE = (
    "courier", "consolas", "mono", "menlo", "monaco", "lucida console", "lucida sans typewriter", "source code", "fira code",
    "inconsolata", "andale", "fixedsys",
)
DEPTH = 32
# The Symbol font's characters from 0x20 to 0x7E, and from 0xA0 to 0xFE.
SYMBOL_LOW = (
    "\xa0!∀#∃%&∋()∗+,−./0123456789:;<=>?"
    "≅ΑΒΧΔΕΦΓΗΙϑΚΛΜΝΟΠΘΡΣΤΥςΩΞΨΖ[∴]⊥_"
    "‾αβχδεφγηιϕκλμνοπθρστυϖωξψζ{|}∼"
)
SYMBOL_HIGH = (
    "€ϒ′≤⁄∞ƒ♣♦♥♠↔←↑→↓°±″≥×∝∂•÷≠≡≈…⏐⎯↵"
    "ℵℑℜ℘⊗⊕∅∩∪⊃⊇⊄⊂⊆∈∉∠∇®©™∏√⋅¬∧∨⇔⇐⇑⇒⇓"
    "◊〈®©™∑⎛⎜⎝⎡⎢⎣⎧⎨⎩⎪\uf8ff〉∫⌠⎮⌡⎞⎟⎠⎤⎥⎦⎫⎬⎭"
)
# Pictures of Wingdings by their codes.
WINGDINGS = {
    0x28: "☎", 0x2A: "✉", 0x46: "☞", 0x4A: "☺", 0x4C: "☹", 0x6C: "●", 0x6E: "■", 0x6F: "□", 0x71: "❑", 0x72: "❒", 0x75: "◆", 0x76: "❖",
    0x77: "⬥", 0x9E: "·", 0x9F: "•", 0xA1: "○", 0xA7: "▪", 0xA8: "◻", 0xD8: "➢", 0xE8: "➔", 0xFB: "✗", 0xFC: "✓", 0xFD: "☒", 0xFE: "☑",
}
SYMBOL = dict(zip([*range(0x20, 0x7F), *range(0xA0, 0xFF)], SYMBOL_LOW + SYMBOL_HIGH, strict=True))


def symbol_table(font: str | None) -> dict[int, str] | None:
    """The characters of a font with codes of its own, or None."""
    name = (font or "").strip().lower()
    if name == "symbol":
        return SYMBOL
    return WINGDINGS if name.startswith("wingdings") or name == "webdings" else None


def _mapped(table: dict[int, str], c: str) -> str | None:
    code = ord(c)
    return table.get(code - 0xF000 if 0xF000 <= code <= 0xF0FF else code)


def symbol_text(text: str, font: str | None) -> str:
    """Text of a symbol font as Unicode; unknown private-use codes are bullets, other characters stay."""
    table = symbol_table(font)
    if table is None:
        return text
    return "".join(_mapped(table, c) or ("•" if "\uf000" <= c <= "\uf0ff" else c) for c in text)


def symbol_char(code: int, font: str | None) -> str:
    """A single character of a font, a bullet where the font's code is not known."""
    table = symbol_table(font)
    return chr(code) if table is None else _mapped(table, chr(code)) or "•"


def bullet_label(text: str, font: str | None) -> str:
    """A bullet in its level's font: what the font does not know, and private-use characters, are bullets."""
    table = symbol_table(font)
    if table is not None:
        return "".join(_mapped(table, c) or "•" for c in text)
    return "".join("•" if "\ue000" <= c <= "\uf8ff" else c for c in text)


@dataclass(frozen=True)
class Format:
    bold: bool = False
    italic: bool = False
    underline: bool = False
    strike: bool = False
    superscript: bool = False
    subscript: bool = False
    mono: bool = False


PLAIN = Format()


@dataclass(frozen=True)
class Item:
    level: int
    label: str
    ordinal: int
    bullet: bool
    format: str


def roman(n: int) -> str:
    return "M" * (n // 1000) + HUNDREDS[n // 100 % 10] + TENS[n // 10 % 10] + ONES[n % 10] if n else "0"


def number_label(fmt: str, n: int) -> str:
    if fmt == "decimal":
        return str(n)
    letter = chr(65 + (n - 1) % 26) * ((n - 1) // 26 + 1) if n > 0 else ""
    suffix = "th" if 11 <= n % 100 <= 13 else {1: "st", 2: "nd", 3: "rd"}.get(n % 10, "th")
    return {
        "decimal_zero": f"{n:02}", "upper_roman": roman(n), "lower_roman": roman(n).lower(), "upper_letter": letter,
        "lower_letter": letter.lower(), "ordinal": f"{n}{suffix}", "bullet": "", "none": "",
    }.get(fmt, str(n))


class Lists:
    """Counters of each abstract list. A level that has counted goes on; deeper ones start anew."""

    def __init__(self, doc: Document):
        self.doc = doc
        self.known: dict[tuple[int, int], tuple] = {}
        self.counters, self.ordinals = deepcopy(doc.list_state) if doc.list_state else ({}, {})

    def level(self, num_id: int, level: int) -> tuple[int, Level, int] | None:
        found = self.doc.instances.get(num_id)
        if found is None:
            return None
        abstract, starts, levels = found
        own = levels.get(level) or self.doc.abstracts.get(abstract, {}).get(level)
        if own is None:
            return None
        return abstract, own, starts.get(level, own.start)

    def next(self, num_id: int, level: int) -> Item | None:
        found = self.known.get((num_id, level))
        if found is None:
            found = self.known[num_id, level] = self.level(num_id, level) or ()
        if not found or found[1].format == "none":
            return None
        abstract, own, start = found
        values = self.counters.setdefault(abstract, [None] * 9)
        values[level] = start if values[level] is None else values[level] + 1
        values[level + 1 :] = [None] * (8 - level)
        counts = self.ordinals.setdefault(abstract, [None] * 9)
        counts[level] = max(own.start, 1) if counts[level] is None else counts[level] + 1
        counts[level + 1 :] = [None] * (8 - level)

        def fill(m: re.Match) -> str:
            k = int(m[1]) - 1
            other = self.level(num_id, k)
            n = values[k] if values[k] is not None else other[2] if other else 1
            return number_label("decimal" if own.legal else other[1].format if other else "decimal", n)

        if own.format == "bullet":
            label = bullet_label(own.text, own.font)
        elif own.format == "decimal" and own.text == f"%{level + 1}.":
            label = f"{values[level]}."
        else:
            label = re.sub("%([1-9])", fill, own.text)
        return Item(level, label, counts[level], own.format == "bullet", own.format)


class Resolver:
    def __init__(self, doc: Document):
        self.doc = doc
        self.default = next((s.id for s in doc.styles.values() if s.default and s.kind == "paragraph"), None)
        self.base: dict = {}
        self.by_style: dict[str | None, tuple[tuple[int, int] | None, int | None, bool]] = {}
        self.runs: dict[tuple, tuple[Format, bool]] = {}
        self.seen: dict[int, tuple[Paragraph, list[tuple[Piece, Format]]]] = {}

    def chain(self, style: str | None) -> list[Style]:
        """The style and its parents; a repeated id or the 32nd ends it."""
        out, seen = [], set()
        while style in self.doc.styles and style not in seen and len(out) < DEPTH:
            seen.add(style)
            out.append(self.doc.styles[style])
            style = out[-1].based_on
        return out

    def paragraph(self, p: Paragraph) -> tuple[tuple[int, int] | None, int | None, bool]:
        """(list reference, heading level from 0, code)."""
        if p.style not in self.by_style:
            self.by_style[p.style] = self.of_style(p.style)
        ref, heading, code = self.by_style[p.style]
        if p.num_id is not None:
            ref = (p.num_id, p.level)
        if ref is not None and ref[0] == 0:
            ref = None
        if p.outline is not None:
            heading = p.outline if p.outline < 9 else None
        return ref, heading, code

    def of_style(self, style: str | None) -> tuple[tuple[int, int] | None, int | None, bool]:
        """What a style with its parents gives to a paragraph."""
        chain = self.chain(style if style is not None else self.default)
        ref = next(((s.num_id, s.level) for s in chain if s.num_id is not None), None)
        heading = next((s.outline for s in chain if s.outline is not None), None)
        if heading is not None and heading >= 9:
            heading = None
        elif heading is None:
            for s in chain:
                m = re.fullmatch(r"(title)|heading ([1-9])", (s.name or s.id).lower())
                if m:
                    heading = 0 if m[1] else int(m[2]) - 1
                    break
        code = any("".join((s.name or s.id).split()).lower() in CODE_STYLES for s in chain)
        return ref, heading, code

    def run(self, paragraph_style: str | None, direct: RunFormat) -> tuple[Format, bool]:
        """(format, hidden). Switches set in several styles flip each other; direct ones win."""
        d = direct
        whole = (paragraph_style, d.style, d.bold, d.italic, d.underline, d.strike, d.vanish, d.vertical, d.font)
        found = self.runs.get(whole)
        if found is None:
            found = self.runs[whole] = self.resolved(paragraph_style, direct)
        return found

    def resolved(self, paragraph_style: str | None, direct: RunFormat) -> tuple[Format, bool]:
        key = (paragraph_style, direct.style)
        if key not in self.base:
            layers = []
            for chain in (self.chain(paragraph_style if paragraph_style is not None else self.default), self.chain(direct.style)):
                layers.append({a: next((getattr(s.format, a) for s in chain if getattr(s.format, a) is not None), None) for a in ("bold", "italic", "underline", "strike", "vanish", "vertical", "font")})
            para, char = layers
            merged = {a: char[a] if char[a] is not None else para[a] for a in para}
            # the document's defaults are beneath all styles
            merged = {a: v if v is not None else getattr(self.doc.default_run, a) for a, v in merged.items()}
            for a in ("bold", "italic", "strike", "vanish"):
                if para[a] is not None and char[a] is not None:
                    merged[a] = para[a] != char[a]
            self.base[key] = merged
        base = self.base[key]
        pick = lambda a: getattr(direct, a) if getattr(direct, a) is not None else base[a]
        font = self.face(pick("font")).lower()
        fmt = Format(
            bool(pick("bold")), bool(pick("italic")), bool(pick("underline")), bool(pick("strike")),
            pick("vertical") == "superscript", pick("vertical") == "subscript", any(m in font for m in MONOSPACE),
        )
        return PLAIN if fmt == PLAIN else fmt, bool(pick("vanish"))

    def face(self, font: str | None) -> str:
        """A font's name; a reference into the theme (``@slot``) is looked up there."""
        if font and font.startswith("@"):
            slot = font[1:6] + font[6:7].upper() + font[7:]
            return self.doc.theme.fonts.get(slot, "")
        return font or ""

    def pieces(self, p: Paragraph) -> list[tuple[Piece, Format]]:
        """The paragraph's visible pieces with their resolved formats; worked out once for all outputs."""
        held = self.seen.get(id(p))
        if held is None:
            held = self.seen[id(p)] = (p, self.resolved_pieces(p))
        return held[1]

    def resolved_pieces(self, p: Paragraph) -> list[tuple[Piece, Format]]:
        if len(p.pieces) == 1 and p.pieces[0].kind == "text":
            piece = p.pieces[0]
            fmt, hidden = self.run(p.style, piece.format)
            if fmt is PLAIN and not hidden and not (piece.format.font or self.base[p.style, piece.format.style]["font"]):
                return [(piece, fmt)]
        out = []
        for piece in p.pieces:
            fmt, hidden = self.run(p.style, piece.format)
            if hidden:
                continue
            if piece.kind == "text":
                font = piece.format.font or self.base[p.style, piece.format.style]["font"]
                if font and symbol_table(self.face(font)) is not None:
                    piece = replace(piece, text=symbol_text(piece.text, self.face(font)))
            out.append((piece, fmt))
        return out


class Notes:
    """Numbers by first reference; footnotes and endnotes count apart."""

    def __init__(self):
        self.numbers: dict[tuple[str, int], int] = {}
        self.order: list[tuple[str, int, int]] = []

    def number(self, kind: str, ref: int) -> int:
        if (kind, ref) not in self.numbers:
            n = 1 + sum(k == kind for k, _ in self.numbers)
            self.numbers[kind, ref] = n
            self.order.append((kind, ref, n))
        return self.numbers[kind, ref]


def note_label(kind: str, n: int) -> str:
    return roman(n).lower() if kind == "endnote" else str(n)


def all_monospace(pieces: list[tuple[Piece, Format]]) -> bool:
    seen = False
    for piece, fmt in pieces:
        if fmt is PLAIN and piece.kind == "text" and not piece.text.isspace():
            return False
        if piece.kind in ("image", "math", "footnote", "endnote", "comment") or piece.link:
            return False
        if piece.kind == "text" and piece.text.strip():
            if not fmt.mono:
                return False
            seen = True
    return seen


def href(link: tuple[str | None, str | None]) -> str:
    target, anchor = link
    return (target or "") + (f"#{anchor}" if anchor else "")


def columns(rows) -> int:
    return max((sum(c.span for c in r.cells) for r in rows), default=1)
