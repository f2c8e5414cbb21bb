"""Section properties, settings and theme of word-processing packages."""

from __future__ import annotations

from ..model import Columns, Margins, SectionFormat, Settings, Theme
from .xmltree import Node

#: Theme slots that stand for others, and the colours of two slots that a theme leaves out.
ALIASES = {"tx1": "dk1", "bg1": "lt1", "tx2": "dk2", "bg2": "lt2"}
DEFAULTS = {"dk1": "000000", "lt1": "FFFFFF"}
SCRIPTS = {"latin": "", "ea": "EastAsia", "cs": "Bidi"}


def whole(node: Node, name: str) -> int | None:
    try:
        return int(float(node.get(name) or ""))
    except ValueError:
        return None


def is_on(node: Node | None, name: str = "w:val") -> bool:
    return node is not None and (node.get(name) or "true").lower() not in ("0", "false", "off")


def read_section(node: Node | None) -> SectionFormat:
    """``w:sectPr``; what it doesn't say has the defaults of a letter page."""
    out = SectionFormat()
    for c in node.children if node is not None else []:
        match c.tag:
            case "w:pgSz":
                width, height = whole(c, "w:w"), whole(c, "w:h")
                out.width, out.height = width if width and width > 0 else out.width, height if height and height > 0 else out.height
                out.landscape = c.get("w:orient") == "landscape"
            case "w:pgMar":
                given = {side: whole(c, f"w:{side}") for side in vars(out.margins)}
                out.margins = Margins(**{side: n for side, n in given.items() if n is not None})
            case "w:cols":
                count, space = whole(c, "w:num"), whole(c, "w:space")
                widths = [w for col in c.all("w:col") if (w := whole(col, "w:w"))]
                out.columns = Columns(max(1, min(64, count or 1)), 720 if space is None else space, c.get("w:sep") is not None and is_on(c, "w:sep"), widths)
            case "w:type":
                kind = c.get("w:val")
                out.start = kind if kind in ("continuous", "evenPage", "oddPage", "nextColumn") else "nextPage"
            case "w:titlePg":
                out.title_page = is_on(c)
            case "w:pgNumType":
                out.page_number_start, out.page_number_format = whole(c, "w:start"), c.get("w:fmt")
            case "w:pgBorders":
                display = c.get("w:display")
                out.borders = display if display in ("firstPage", "notFirstPage") else "allPages"
            case "w:headerReference" | "w:footerReference":
                refs = out.headers if c.tag == "w:headerReference" else out.footers
                slot = c.get("w:type")
                if c.get("r:id"):
                    refs[slot if slot in ("first", "even") else "default"] = c.get("r:id")
    return out


def carried(sections: list[SectionFormat]) -> list[tuple[dict[str, str], dict[str, str]]]:
    """Each section's header and footer ids by kind; a kind that a section leaves out is that of the one before."""
    out, headers, footers = [], {}, {}
    for s in sections:
        headers, footers = headers | s.headers, footers | s.footers
        out.append((headers, footers))
    return out


def distinct_ids(refs: dict[str, str]) -> list[str]:
    """First page, default, even; each id once."""
    return list(dict.fromkeys(refs[k] for k in ("first", "default", "even") if k in refs))


def header_of(refs: dict[str, str], section: SectionFormat, settings: Settings, first_page: bool, page: int) -> str | None:
    """The id that a page shows: its first-page one where the section has a title page, the even one where
    the document tells even pages apart."""
    if first_page and section.title_page:
        return refs.get("first")
    if settings.even_and_odd and page % 2 == 0:
        return refs.get("even")
    return refs.get("default")


def read_settings(root: Node | None) -> Settings:
    out = Settings()
    for c in root.children if root is not None else []:
        match c.tag:
            case "w:defaultTabStop":
                stop = whole(c, "w:val")
                out.tab_stop = stop if stop and stop > 0 else 720
            case "w:evenAndOddHeaders":
                out.even_and_odd = is_on(c)
            case "w:compat":
                for s in c.all("w:compatSetting"):
                    if s.get("w:name") == "compatibilityMode":
                        out.compatibility = whole(s, "w:val") or out.compatibility
    return out


def read_theme(root: Node | None) -> Theme:
    """Colours by slot (a system colour's last value), fonts by reference."""
    out = Theme()
    for n in root.walk() if root is not None else []:
        if n.tag == "a:clrScheme":
            for slot in n.children:
                for c in slot.children:
                    colour = c.get("val") if c.tag == "a:srgbClr" else c.get("lastClr") if c.tag == "a:sysClr" else None
                    if colour and len(colour) == 6:
                        out.colours.setdefault(slot.tag.rpartition(":")[2], colour.upper())
        elif n.tag in ("a:majorFont", "a:minorFont"):
            kind = n.tag[2:7]
            for face in n.children:
                script = SCRIPTS.get(face.tag.rpartition(":")[2])
                if script is not None and face.get("typeface"):
                    for name in (["HAnsi", "Ascii"] if not script else [script]):
                        out.fonts[kind + name] = face.get("typeface")
    return out


def theme_colour(theme: Theme, slot: str) -> str | None:
    slot = ALIASES.get(slot, slot)
    return theme.colours.get(slot) or DEFAULTS.get(slot)


def theme_font(theme: Theme, reference: str) -> str | None:
    """The face of a reference such as ``minorHAnsi``."""
    return theme.fonts.get(reference[:5] + reference[5:6].upper() + reference[6:])
