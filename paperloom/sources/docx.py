"""WordprocessingML packages -> the document model."""

from __future__ import annotations

import functools
import posixpath
import re
from urllib.parse import unquote

from ..model import Cell, Document, Level, Media, Note, Paragraph, Piece, Row, RunFormat, Style, Table
from ..outputs.math import read_math, to_latex, to_linear
from ..outputs.walk import symbol_char
from .charts import chart_blocks, diagram_blocks, read_chart
from .containers import SIGNATURE, Archive, NotAContainer, open_zip
from .sections import distinct_ids, read_section, read_settings, read_theme
from .xmltree import Node, parse

#: Numbering formats by their names in files.
FORMATS = {
    "decimal": "decimal", "decimalZero": "decimal_zero", "upperRoman": "upper_roman", "lowerRoman": "lower_roman",
    "upperLetter": "upper_letter", "lowerLetter": "lower_letter", "ordinal": "ordinal", "bullet": "bullet", "none": "none",
}
#: Private-use bullets of symbol fonts.
BULLETS = {"\uf0b7": "•", "\uf0a1": "•", "\uf0a7": "▪", "\uf06e": "▪", "\uf0fc": "✓", "\uf0d8": "➢", "\uf076": "❖", "\uf0a8": "□", "\uf0e0": "➢"}
UNDERSTOOD = {"w", "a", "wp", "pic", "wps", "wpg", "w14", "w15", "v", "m", "r"}
IMAGES = {b"\x89PNG": "image/png", b"\xff\xd8\xff": "image/jpeg", b"GIF8": "image/gif", b"BM": "image/bmp", b"II*\0": "image/tiff", b"MM\0*": "image/tiff"}


class Encrypted(ValueError):
    """The file needs a password."""


def flag(node: Node | None) -> bool | None:
    if node is None:
        return None
    return node.get("w:val") not in ("0", "false", "off", "False", "FALSE")


def number(text: str | None, default: int | None = None) -> int | None:
    try:
        return int(float(text)) if text is not None else default
    except ValueError:
        return default


def value(node: Node | None, name: str = "w:val") -> str | None:
    return node.get(name) if node is not None else None


#: Parts of at most so many bytes are often the same in many files, as styles and relations are: their trees are kept.
SMALL = 16 << 10
_kept = functools.lru_cache(maxsize=64)(parse)


class Package:
    def __init__(self, archive: Archive, doc: Document):
        self.archive, self.doc = archive, doc
        self.found: dict[str, dict[str, tuple[str, str, bool]]] = {}

    def part(self, name: str) -> Node | None:
        got = self.archive.read(name)
        if got is None:
            return None
        if not got[1]:
            self.doc.note("approximated", name, "damaged part")
        shared = len(got[0]) <= SMALL and not name.endswith("/document.xml")
        return _kept(got[0]) if shared else parse(got[0])

    def relations(self, part: str) -> dict[str, tuple[str, str, bool]]:
        """id -> (kind, target, external); internal targets are resolved against the part's folder."""
        if part not in self.found:
            self.found[part] = self.read_relations(part)
        return self.found[part]

    def read_relations(self, part: str) -> dict[str, tuple[str, str, bool]]:
        folder, _, name = part.rpartition("/")
        root = self.part(f"{folder}/_rels/{name}.rels" if folder else f"_rels/{name}.rels")
        out = {}
        for r in root.children if root is not None else []:
            kind, target = (r.get("Type") or "").rpartition("/")[2], r.get("Target") or ""
            external = r.get("TargetMode") == "External"
            out[r.get("Id") or ""] = (kind, target if external else resolve(folder, target), external)
        return out

    def main(self) -> str:
        for kind, target, _ in self.relations("").values():
            if kind == "officeDocument" and self.archive.find(target):
                return target
        types = self.part("[Content_Types].xml")
        for t in types.children if types is not None else []:
            if (t.get("ContentType") or "").endswith("document.main+xml") and t.get("PartName"):
                return t.get("PartName").lstrip("/")
        return "word/document.xml"


def resolve(folder: str, target: str) -> str:
    target = unquote(target)
    path = target.lstrip("/") if target.startswith("/") else posixpath.join(folder, target)
    return posixpath.normpath(path).lstrip("/") if path else ""


def run_format(node: Node | None) -> RunFormat:
    f = RunFormat()
    if node is None:
        return f
    for p in node.children:
        match p.tag:
            case "w:rStyle":
                f.style = value(p)
            case "w:b":
                f.bold = flag(p)
            case "w:i":
                f.italic = flag(p)
            case "w:u":
                f.underline = value(p) not in (None, "none")
            case "w:strike" | "w:dstrike":
                f.strike = flag(p) or f.strike or False
            case "w:vanish":
                f.vanish = flag(p)
            case "w:vertAlign":
                f.vertical = value(p)
            case "w:rFonts":
                slot = p.get("w:asciiTheme") or p.get("w:hAnsiTheme")
                f.font = (f"@{slot}" if slot else None) or p.get("w:ascii") or p.get("w:hAnsi") or f.font
            case "w:sz":
                f.size = number(value(p))
    return f


def numbering_of(node: Node | None) -> tuple[int | None, int]:
    n = node.find("w:numPr") if node is not None else None
    if n is None:
        return None, 0
    return number(value(n.find("w:numId"))), max(0, min(8, number(value(n.find("w:ilvl")), 0) or 0))


class Story:
    """One part's content: body, header, note."""

    def __init__(self, package: Package, part: str):
        self.package, self.doc, self.relations = package, package.doc, package.relations(part)
        self.fields: list[dict] = []
        self.links = 0
        self.formats: list = []
        self.after: list = []

    def blocks(self, node: Node, sections: list[list] | None = None) -> list:
        out: list = []
        for child in node.children:
            self.block(child, out, sections)
        if sections is not None:
            sections[-1] = sections[-1] + out
        return out

    def block(self, node: Node, out: list, sections: list[list] | None) -> None:
        match node.tag:
            case "w:p":
                p = self.paragraph(node)
                out.append(p)
                out += self.after
                self.after = []
                if sections is not None and node.find("w:pPr", "w:sectPr") is not None:
                    self.formats.append(read_section(node.find("w:pPr", "w:sectPr")))
                    sections[-1] = sections[-1] + out
                    out.clear()
                    sections.append([])
            case "w:tbl":
                out.append(self.table(node))
            case "w:sdt":
                content = node.find("w:sdtContent")
                for c in content.children if content is not None else []:
                    self.block(c, out, sections)
            case "w:customXml" | "w:ins" | "w:moveTo" | "w:smartTag":
                for c in node.children:
                    self.block(c, out, sections)
            case "mc:AlternateContent":
                for c in self.choice(node):
                    self.block(c, out, sections)
            case "w:altChunk":
                self.doc.note("dropped", "body", "altChunk")

    def choice(self, node: Node) -> list[Node]:
        """The first branch whose needs are all understood, if it holds something; else the fallback."""
        for c in node.all("mc:Choice"):
            if c.children and all(p in UNDERSTOOD for p in (c.get("Requires") or "").split()):
                return c.children
        fallback = node.find("mc:Fallback")
        return fallback.children if fallback is not None else []

    def table(self, node: Node) -> Table:
        grid = node.find("w:tblGrid")
        t = Table(grid=[number(c.get("w:w"), 0) or 0 for c in grid.all("w:gridCol")] if grid is not None else [])
        for r in self.wrapped(node, "w:tr"):
            row = Row(header=flag(r.find("w:trPr", "w:tblHeader")) or False)
            for c in self.wrapped(r, "w:tc"):
                props = c.find("w:tcPr")
                if props is None:
                    row.cells.append(Cell(self.blocks(c)))
                    continue
                merge = props.find("w:vMerge")
                span = number(value(props.find("w:gridSpan")), 1) or 1
                cell = Cell(span=max(1, span), merge=None if merge is None else "restart" if value(merge) == "restart" else "continue")
                cell.blocks = self.blocks(c)
                row.cells.append(cell)
            t.rows.append(row)
        return t

    def wrapped(self, node: Node, tag: str) -> list[Node]:
        out = []
        for c in node.children:
            if c.tag == tag:
                out.append(c)
            elif c.tag in ("w:sdt", "w:sdtContent", "w:customXml", "w:ins"):
                out += self.wrapped(c, tag)
        return out

    def paragraph(self, node: Node) -> Paragraph:
        p, props = Paragraph(), node.find("w:pPr")
        if props is not None:
            p.style = value(props.find("w:pStyle"))
            p.num_id, p.level = numbering_of(props)
            p.outline = number(value(props.find("w:outlineLvl")))
            p.page_break_before = flag(props.find("w:pageBreakBefore")) or False
        for c in node.children:
            if c.tag == "w:r":
                self.run(c, p.pieces, None, 0)
            elif c is not props:
                self.inline(c, p.pieces, None, 0)
        return p

    def inline(self, node: Node, out: list[Piece], link, link_id: int) -> None:
        match node.tag:
            case "w:r":
                self.run(node, out, link, link_id)
            case "w:hyperlink":
                self.links += 1
                target = self.relations.get(node.get("r:id") or "", (None, None, False))[1]
                own = (target, node.get("w:anchor"))
                for c in node.children:
                    self.inline(c, out, own, self.links)
            case "w:fldSimple":
                own, own_id = self.field_link(node.get("w:instr") or "", link, link_id)
                for c in node.children:
                    self.inline(c, out, own, own_id)
            case "w:ins" | "w:moveTo" | "w:smartTag" | "w:customXml" | "w:dir" | "w:bdo":
                for c in node.children:
                    self.inline(c, out, link, link_id)
            case "w:sdt":
                content = node.find("w:sdtContent")
                for c in content.children if content is not None else []:
                    self.inline(c, out, link, link_id)
            case "mc:AlternateContent":
                for c in self.choice(node):
                    self.inline(c, out, link, link_id)
            case "m:oMath" | "m:oMathPara":
                formula = read_math(node)
                text = to_linear(formula)
                if text:
                    out.append(Piece("math", text, RunFormat(), link, link_id, int(node.tag == "m:oMathPara"), to_latex(formula).strip()))

    def field_link(self, instruction: str, link, link_id: int):
        m = re.match(r"\s*HYPERLINK\b(.*)", instruction, re.S)
        if not m:
            return link, link_id
        args = re.findall(r'\\([a-z])\s*(?:"([^"]*)")?|"([^"]*)"|(\S+)', m[1])
        target = anchor = None
        for switch, quoted, plain, bare in args:
            if switch == "l":
                anchor = quoted or None
            elif not switch and target is None:
                target = plain or bare or None
        self.links += 1
        return (target, anchor), self.links

    def run(self, node: Node, out: list[Piece], link, link_id: int) -> None:
        fmt = run_format(node.find("w:rPr"))
        for c in node.children:
            if c.tag == "w:t" and not self.fields:
                if c.text:
                    out.append(Piece("text", c.text, fmt, link, link_id))
                continue
            if c.tag == "w:rPr":
                continue
            if c.tag == "w:fldChar":
                kind = c.get("w:fldCharType")
                if kind == "begin":
                    self.fields.append({"code": "", "in_code": True, "link": (link, link_id)})
                elif kind == "separate" and self.fields:
                    self.fields[-1]["in_code"] = False
                    self.fields[-1]["link"] = self.field_link(self.fields[-1]["code"], link, link_id)
                elif kind == "end" and self.fields:
                    self.fields.pop()
                continue
            if self.fields and self.fields[-1]["in_code"]:
                if c.tag == "w:instrText":
                    self.fields[-1]["code"] += c.text
                continue
            own, own_id = self.fields[-1]["link"] if self.fields else (link, link_id)

            def add(kind: str, text: str = "", ref: int | None = None) -> None:
                out.append(Piece(kind, text, fmt, own, own_id, ref))

            match c.tag:
                case "w:t":
                    if c.text:
                        add("text", c.text)
                case "w:tab" | "w:ptab":
                    add("tab")
                case "w:br":
                    add({"page": "page", "column": "column"}.get(c.get("w:type") or "", "line"))
                case "w:cr":
                    add("line")
                case "w:noBreakHyphen":
                    add("text", "-")
                case "w:sym":
                    code = number_of_hex(c.get("w:char"))
                    if code:
                        add("text", symbol_char(code, c.get("w:font")))
                case "w:footnoteReference":
                    add("footnote", ref=number(c.get("w:id"), -1))
                case "w:endnoteReference":
                    add("endnote", ref=number(c.get("w:id"), -1))
                case "w:commentReference":
                    add("comment", ref=number(c.get("w:id"), -1))
                case "w:drawing" | "w:pict" | "w:object":
                    self.drawing(c, add)
                case "mc:AlternateContent":
                    for d in self.choice(c):
                        if d.tag in ("w:drawing", "w:pict"):
                            self.drawing(d, add)

    def drawing(self, node: Node, add) -> None:
        """Pictures stay in the line, those of groups one after the other; text boxes, charts and diagrams follow the
        paragraph as blocks."""
        alt, todo, pictures, seen = "", [node], [], False
        after: list = []
        while todo:
            n = todo.pop()
            match n.tag:
                case "wp:docPr":
                    if n.get("hidden") in ("1", "true"):
                        self.doc.note("dropped", "drawing", "hidden drawing")
                        return
                    alt = n.get("descr") or n.get("title") or ""
                case "pic:cNvPr":
                    pictures.append([n.get("descr") or n.get("title") or "", None])
                case "a:blip" | "v:imagedata":
                    rel = n.get("r:embed") or n.get("r:link") or n.get("r:id")
                    if rel:
                        if not pictures or pictures[-1][1]:
                            pictures.append(["", None])
                        pictures[-1][1] = rel
                case "w:txbxContent":
                    after += self.blocks(n)
                    seen = True
                    continue
                case "mc:AlternateContent":
                    todo += reversed(self.choice(n))
                    continue
                case "c:chart" if n.get("r:id"):
                    after += self.chart(n.get("r:id"))
                case "dgm:relIds":
                    after += self.diagram(n.get("r:dm") or "")
            todo += reversed(n.children)
        shown = [(own, rel) for own, rel in pictures if rel]
        for own, rel in shown:
            target = self.relations.get(rel, (None, "", False))[1]
            at = next((i for i, m in enumerate(self.doc.media) if m.name == target), None)
            if at is None:
                self.doc.note("dropped", "drawing", f"image {target or rel} is missing")
            else:
                add("image", (alt if len(shown) == 1 else own) or own or alt, at)
        if seen or after:
            self.after += after

    def part_of(self, rel: str, kind: str) -> Node | None:
        _, target, external = self.relations.get(rel, (None, "", True))
        part = None if external else self.package.part(target)
        if part is None:
            self.doc.note("dropped", "drawing", f"{kind} {target or rel} is missing")
        return part

    def chart(self, rel: str) -> list:
        part = self.part_of(rel, "chart")
        blocks, cut = chart_blocks(read_chart(part)) if part is not None else ([], False)
        if cut:
            self.doc.note("approximated", "chart", "the table leaves out rows or series")
        return blocks

    def diagram(self, rel: str) -> list:
        """The text of the drawing that was saved with the diagram, else of its data."""
        saved = next((target for kind, target, external in self.relations.values() if kind == "diagramDrawing" and not external), None)
        part = self.package.part(saved) if saved else None
        return diagram_blocks(part) if part is not None else diagram_blocks(self.part_of(rel, "diagram") or Node("", {}))


def number_of_hex(text: str | None) -> int | None:
    try:
        return int(text or "", 16)
    except ValueError:
        return None


def plain_text(block) -> str:
    if isinstance(block, Table):
        return "\n".join("\t".join(" ".join(plain_text(b) for b in c.blocks) for c in r.cells) for r in block.rows)
    return "".join({"text": p.text, "tab": "\t", "line": "\n"}.get(p.kind, "") for p in block.pieces)


def read_headers(package: Package, relations: dict, doc: Document) -> None:
    """The header and footer parts that sections name, each once, in the order of the sections; all that there
    are where no section names one."""
    for kind, into in (("header", doc.headers), ("footer", doc.footers)):
        named = [i for s in doc.section_formats for i in distinct_ids(getattr(s, f"{kind}s"))]
        for i in dict.fromkeys(named or [i for i, r in relations.items() if r[0] == kind and not r[2]]):
            found, target, external = relations.get(i, (None, "", False))
            part = package.part(target) if found == kind and not external else None
            if part is None:
                doc.note("dropped", "section", f"{kind} {i} is missing")
                continue
            doc.header_parts[i] = Story(package, target).blocks(part)
            into.append(doc.header_parts[i])


def read_styles(root: Node | None, doc: Document) -> None:
    defaults = root.find("w:docDefaults", "w:rPrDefault", "w:rPr") if root is not None else None
    doc.default_run = run_format(defaults)
    for s in root.all("w:style") if root is not None else []:
        style = Style(s.get("w:styleId") or "", value(s.find("w:name")), s.get("w:type") or "paragraph", value(s.find("w:basedOn")), s.get("w:default") in ("1", "true"))
        props = s.find("w:pPr")
        if props is not None:
            style.outline = number(value(props.find("w:outlineLvl")))
            style.num_id, style.level = numbering_of(props)
        style.format = run_format(s.find("w:rPr"))
        doc.styles.setdefault(style.id, style)


def read_level(node: Node) -> Level:
    held: dict[str, Node] = {}
    for c in node.children:
        held.setdefault(c.tag, c)
    fmt = FORMATS.get(value(held.get("w:numFmt")) or "decimal", "decimal")
    own = number(node.get("w:ilvl"), 0) or 0
    text = value(held.get("w:lvlText"))
    if text is None:
        text = "" if fmt == "bullet" else f"%{own + 1}."
    if not text.isascii():
        text = "".join(BULLETS.get(c, c) for c in text)
    font = run_format(held["w:rPr"]).font if "w:rPr" in held else None
    return Level(number(value(held.get("w:start")), 1) or 0, fmt, text, flag(held.get("w:isLgl")) or False, font)


def read_numbering(root: Node | None, doc: Document) -> None:
    linked: dict[int, str] = {}
    for a in root.all("w:abstractNum") if root is not None else []:
        key = number(a.get("w:abstractNumId"), -1)
        doc.abstracts.setdefault(key, {number(v.get("w:ilvl"), 0) or 0: read_level(v) for v in a.all("w:lvl")})
        if value(a.find("w:numStyleLink")):
            linked[key] = value(a.find("w:numStyleLink"))
    for n in root.all("w:num") if root is not None else []:
        starts, levels = {}, {}
        for o in n.all("w:lvlOverride"):
            k = number(o.get("w:ilvl"), 0) or 0
            if o.find("w:startOverride") is not None:
                starts[k] = number(value(o.find("w:startOverride")), 1) or 0
            if o.find("w:lvl") is not None:
                levels[k] = read_level(o.find("w:lvl"))
        doc.instances.setdefault(number(n.get("w:numId"), -1), (number(value(n.find("w:abstractNumId")), -1), starts, levels))
    for key, style in linked.items():
        own = doc.styles.get(style)
        if not doc.abstracts.get(key) and own is not None and own.num_id in doc.instances:
            doc.abstracts[key] = doc.abstracts.get(doc.instances[own.num_id][0], {})


def read_docx(data: bytes) -> Document:
    if data[:8] == SIGNATURE:
        raise Encrypted("the package is encrypted")
    doc = Document("docx")
    archive = open_zip(data)
    if archive.recovered:
        doc.note("approximated", "archive", "no central directory")
    package = Package(archive, doc)
    main = package.main()
    root = package.part(main)
    if root is None:
        raise NotAContainer("no main part")
    relations = package.relations(main)
    by_kind: dict[str, list[str]] = {}
    for kind, target, external in relations.values():
        if not external:
            by_kind.setdefault(kind, []).append(target)
    for name in sorted({n for k in relations.values() if k[0] == "image" and not k[2] for n in [k[1]]} | {n for n in archive.names() if "/media/" in n}):
        got = archive.read(name)
        if got is not None:
            kind = next((k for magic, k in IMAGES.items() if got[0].startswith(magic)), "application/octet-stream")
            doc.media.append(Media(name, got[0], kind))
    first = lambda kind: package.part(by_kind[kind][0]) if by_kind.get(kind) else None
    doc.settings, doc.theme = read_settings(first("settings")), read_theme(first("theme"))
    read_styles(first("styles"), doc)
    read_numbering(first("numbering"), doc)
    for kind, tag, into in (("footnotes", "w:footnote", doc.footnotes), ("endnotes", "w:endnote", doc.endnotes), ("comments", "w:comment", doc.comments)):
        for target in by_kind.get(kind, [])[:1]:
            story, part = Story(package, target), package.part(target)
            for n in part.all(tag) if part is not None else []:
                if n.get("w:type") in ("separator", "continuationSeparator", "continuationNotice"):
                    continue
                note = Note(number(n.get("w:id"), -1), kind[:-1], story.blocks(n), n.get("w:author"))
                into.setdefault(note.id, note)
    body = root.find("w:body") or root
    sections: list[list] = [[]]
    story = Story(package, main)
    story.blocks(body, sections)
    last = next((c for c in reversed(body.children) if c.tag == "w:sectPr"), None)
    doc.section_formats = [*story.formats, read_section(last)]
    if len(sections) > 1 and not sections[-1]:
        sections.pop()
        doc.section_formats = doc.section_formats[: len(sections)]
    doc.sections = sections
    read_headers(package, relations, doc)
    for part in (p for k, p, _ in package.relations("").values() if k in ("core-properties", "extended-properties")):
        props = package.part(part)
        for c in props.children if props is not None else []:
            if c.text.strip():
                doc.metadata[c.tag.rpartition(":")[2]] = c.text.strip()
    return doc
