"""The document model as a WordprocessingML package, with the same bytes for the same model."""

from __future__ import annotations

import functools
import io
import re
import struct
import zipfile
import zlib
from xml.sax.saxutils import escape as _escape

from ..model import Document, Level, Paragraph, Piece, RunFormat, Style, Table

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
DECLARATION = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
STAMP = (1980, 1, 1, 0, 0, 0)
#: Numbering formats by their names in files, and extensions of pictures.
FORMATS = {
    "decimal": "decimal", "decimal_zero": "decimalZero", "upper_roman": "upperRoman", "lower_roman": "lowerRoman",
    "upper_letter": "upperLetter", "lower_letter": "lowerLetter", "ordinal": "ordinal", "bullet": "bullet", "none": "none",
}
EXTENSIONS = {"image/png": "png", "image/jpeg": "jpeg", "image/gif": "gif", "image/bmp": "bmp", "image/tiff": "tiff"}
_FORBIDDEN = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff\ufffe\uffff]")
_UNSAFE = re.compile("[\x00-\x08\x0b-\x1f&<>\"\ud800-\udfff\ufffe\uffff]")
_PLAIN = RunFormat()


def text(value: str) -> str:
    """Without what XML forbids. A carriage return is written as a reference: parsers would fold it."""
    if not _UNSAFE.search(value):
        return value
    return _escape(_FORBIDDEN.sub("", value), {'"': "&quot;", "\r": "&#13;"})


class _Writer:
    def __init__(self, doc: Document):
        self.doc, self.relations = doc, []

    def relation(self, kind: str, target: str, external: bool = False) -> str:
        row = (kind, target, external)
        if row not in self.relations:
            self.relations.append(row)
        return f"rId{self.relations.index(row) + 1}"

    def run_properties(self, f: RunFormat) -> str:
        if f == _PLAIN:
            return ""
        out = f'<w:rStyle w:val="{text(f.style)}"/>' if f.style else ""
        if f.font and f.font.startswith("@"):
            out += f'<w:rFonts w:asciiTheme="{text(f.font[1:])}" w:hAnsiTheme="{text(f.font[1:])}"/>'
        elif f.font:
            out += f'<w:rFonts w:ascii="{text(f.font)}" w:hAnsi="{text(f.font)}"/>'
        for tag, on in (("b", f.bold), ("i", f.italic), ("strike", f.strike), ("vanish", f.vanish)):
            if on is not None:
                out += f"<w:{tag}/>" if on else f'<w:{tag} w:val="0"/>'
        if f.underline is not None:
            out += f'<w:u w:val="{"single" if f.underline else "none"}"/>'
        if f.size:
            out += f'<w:sz w:val="{f.size}"/>'
        if f.vertical:
            out += f'<w:vertAlign w:val="{f.vertical}"/>'
        return f"<w:rPr>{out}</w:rPr>" if out else ""

    def content(self, p: Piece) -> str:
        match p.kind:
            case "text" if p.text and "\t" not in p.text and "\n" not in p.text:
                return f'<w:t xml:space="preserve">{text(p.text)}</w:t>'
            case "text":
                # a tab or line feed inside a text is its own element
                return "".join(
                    "<w:tab/>" if x == "\t" else "<w:br/>" if x == "\n" else f'<w:t xml:space="preserve">{text(x)}</w:t>'
                    for x in re.split("([\t\n])", p.text) if x
                )
            case "tab":
                return "<w:tab/>"
            case "line":
                return "<w:br/>"
            case "page" | "column":
                return f'<w:br w:type="{p.kind}"/>'
            case "footnote" | "endnote":
                return f'<w:{p.kind}Reference w:id="{p.ref}"/>'
            case "comment":
                return f'<w:commentReference w:id="{p.ref}"/>'
            case "image":
                rel = self.relation("image", f"media/{_media_name(self.doc, p.ref)}")
                return (
                    f'<w:drawing><wp:inline><wp:extent cx="952500" cy="476250"/><wp:docPr id="{p.ref + 1}" name="image{p.ref + 1}" descr="{text(p.text)}"/>'
                    f'<a:graphic><a:graphicData><pic:pic><pic:blipFill><a:blip r:embed="{rel}"/></pic:blipFill></pic:pic></a:graphicData></a:graphic></wp:inline></w:drawing>'
                )
        return ""

    def paragraph(self, p: Paragraph) -> str:
        props = f'<w:pStyle w:val="{text(p.style)}"/>' if p.style else ""
        if p.page_break_before:
            props += "<w:pageBreakBefore/>"
        if p.num_id is not None:
            props += f'<w:numPr><w:ilvl w:val="{p.level}"/><w:numId w:val="{p.num_id}"/></w:numPr>'
        if p.outline is not None:
            props += f'<w:outlineLvl w:val="{p.outline}"/>'
        out, open_link = [f"<w:pPr>{props}</w:pPr>" if props else ""], None
        for piece in p.pieces:
            link = (piece.link, piece.link_id) if piece.link and any(piece.link) else None
            if link != open_link:
                if open_link:
                    out.append("</w:hyperlink>")
                if link:
                    target, anchor = link[0]
                    rel = f' r:id="{self.relation("hyperlink", target, True)}"' if target else ""
                    out.append(f"<w:hyperlink{rel}" + (f' w:anchor="{text(anchor)}"' if anchor else "") + ">")
                open_link = link
            out.append(f"<w:r>{self.run_properties(piece.format)}{self.content(piece)}</w:r>")
        return "<w:p>" + "".join(out) + ("</w:hyperlink>" if open_link else "") + "</w:p>"

    def table(self, t: Table) -> str:
        width = max((sum(c.span for c in r.cells) for r in t.rows), default=1)
        grid = t.grid or [9000 // max(1, width)] * width
        rows = []
        for r in t.rows:
            cells = []
            for c in r.cells:
                props = f'<w:gridSpan w:val="{c.span}"/>' if c.span > 1 else ""
                if c.merge:
                    props += f'<w:vMerge w:val="{c.merge}"/>'
                body = self.blocks(c.blocks)
                # a cell ends with a paragraph
                if not c.blocks or isinstance(c.blocks[-1], Table):
                    body += "<w:p/>"
                cells.append(f"<w:tc>{f'<w:tcPr>{props}</w:tcPr>' if props else ''}{body}</w:tc>")
            rows.append("<w:tr>" + ("<w:trPr><w:tblHeader/></w:trPr>" if r.header else "") + "".join(cells) + "</w:tr>")
        return "<w:tbl><w:tblGrid>" + "".join(f'<w:gridCol w:w="{g}"/>' for g in grid) + "</w:tblGrid>" + "".join(rows) + "</w:tbl>"

    def blocks(self, blocks: list) -> str:
        return "".join(self.paragraph(b) if isinstance(b, Paragraph) else self.table(b) for b in blocks)

    def body(self) -> str:
        last = len(self.doc.sections) - 1
        out = []
        for i, section in enumerate(self.doc.sections):
            out.append(self.blocks(section))
            out.append("<w:sectPr/>" if i == last else "")
            if i < last:
                # the section's last paragraph closes it
                text_so_far = out[-2]
                cut = text_so_far.rfind("<w:p>")
                if cut >= 0 and text_so_far.endswith("</w:p>"):
                    body = text_so_far[cut + 5 :]
                    body = body.replace("<w:pPr>", "<w:pPr><w:sectPr/>", 1) if body.startswith("<w:pPr>") else "<w:pPr><w:sectPr/></w:pPr>" + body
                    out[-2] = text_so_far[:cut] + "<w:p>" + body
                else:
                    out.append("<w:p><w:pPr><w:sectPr/></w:pPr></w:p>")
        return "".join(out)


def _media_name(doc: Document, at: int) -> str:
    return f"image{at + 1}.{EXTENSIONS.get(doc.media[at].content_type, 'bin')}"


def _root(tag: str, body: str) -> str:
    spaces = (
        f'xmlns:w="{W}" xmlns:r="{R}" xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing" '
        'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:pic="http://schemas.openxmlformats.org/drawingml/2006/picture"'
    )
    return f"{DECLARATION}<w:{tag} {spaces}>{body}</w:{tag}>"


def _relations(rows) -> str:
    body = "".join(
        f'<Relationship Id="rId{i}" Type="{R}/{kind}" Target="{text(target)}"{" TargetMode=" + chr(34) + "External" + chr(34) if external else ""}/>'
        for i, (kind, target, external) in enumerate(rows, 1)
    )
    return f'{DECLARATION}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{body}</Relationships>'


def _style(s: Style, w: _Writer) -> str:
    out = f'<w:name w:val="{text(s.name or s.id)}"/>' + (f'<w:basedOn w:val="{text(s.based_on)}"/>' if s.based_on else "")
    props = f'<w:outlineLvl w:val="{s.outline}"/>' if s.outline is not None else ""
    if s.num_id is not None:
        props = f'<w:numPr><w:ilvl w:val="{s.level}"/><w:numId w:val="{s.num_id}"/></w:numPr>' + props
    out += (f"<w:pPr>{props}</w:pPr>" if props else "") + w.run_properties(s.format)
    return f'<w:style w:type="{s.kind}"{" w:default=" + chr(34) + "1" + chr(34) if s.default else ""} w:styleId="{text(s.id)}">{out}</w:style>'


def _level(k: int, v: Level) -> str:
    return (
        f'<w:lvl w:ilvl="{k}"><w:start w:val="{v.start}"/><w:numFmt w:val="{FORMATS.get(v.format, "decimal")}"/>'
        + ("<w:isLgl/>" if v.legal else "") + f'<w:lvlText w:val="{text(v.text)}"/></w:lvl>'
    )


def write_docx(doc: Document) -> bytes:
    w = _Writer(doc)
    for kind in ("styles", "numbering"):
        w.relation(kind, f"{kind}.xml")
    parts: dict[str, str | bytes] = {}
    body = w.body()
    notes = {}
    for kind, rows in (("footnotes", doc.footnotes), ("endnotes", doc.endnotes), ("comments", doc.comments)):
        if rows:
            w.relation(kind, f"{kind}.xml")
            tag = kind[:-1]
            notes[kind] = _root(kind, "".join(
                f'<w:{tag} w:id="{n.id}"' + (f' w:author="{text(n.author)}"' if n.author else "") + f">{w.blocks(n.blocks)}</w:{tag}>" for n in rows.values()
            ))
    stories = {}
    for kind, rows in (("header", doc.headers), ("footer", doc.footers)):
        for i, blocks in enumerate(rows, 1):
            w.relation(kind, f"{kind}{i}.xml")
            stories[f"{kind}{i}"] = _root("hdr" if kind == "header" else "ftr", w.blocks(blocks))
    kinds = {"xml": "application/xml", "rels": "application/vnd.openxmlformats-package.relationships+xml"}
    for m in doc.media:
        kinds[EXTENSIONS.get(m.content_type, "bin")] = m.content_type
    main = "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"
    parts["[Content_Types].xml"] = (
        f'{DECLARATION}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
        + "".join(f'<Default Extension="{k}" ContentType="{v}"/>' for k, v in sorted(kinds.items())) + f'<Override PartName="/word/document.xml" ContentType="{main}"/></Types>'
    )
    rows = [("officeDocument", "word/document.xml", False)]
    if doc.metadata:
        rows.append(("core-properties", "docProps/core.xml", False))
        props = "".join(f"<dc:{k}>{text(v)}</dc:{k}>" for k, v in sorted(doc.metadata.items()) if re.fullmatch("[A-Za-z]+", k))
        parts["docProps/core.xml"] = (
            f'{DECLARATION}<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/">{props}</cp:coreProperties>'
        )
    parts["_rels/.rels"] = _relations(rows)
    parts["word/document.xml"] = _root("document", f"<w:body>{body}</w:body>")
    parts["word/styles.xml"] = _root("styles", "".join(_style(s, w) for s in doc.styles.values()))
    parts["word/numbering.xml"] = _root(
        "numbering",
        "".join(f'<w:abstractNum w:abstractNumId="{k}">' + "".join(_level(i, v) for i, v in sorted(levels.items())) + "</w:abstractNum>" for k, levels in doc.abstracts.items())
        + "".join(
            f'<w:num w:numId="{k}"><w:abstractNumId w:val="{a}"/>'
            + "".join(f'<w:lvlOverride w:ilvl="{i}"><w:startOverride w:val="{n}"/></w:lvlOverride>' for i, n in sorted(starts.items())) + "</w:num>"
            for k, (a, starts, _) in doc.instances.items()
        ),
    )
    for kind, xml in {**notes, **stories}.items():
        parts[f"word/{kind}.xml"] = xml
    for i, m in enumerate(doc.media):
        parts[f"word/media/{_media_name(doc, i)}"] = m.data
    parts["word/_rels/document.xml.rels"] = _relations(w.relations)
    return _zipped({name: data.encode() if isinstance(data, str) else data for name, data in parts.items()})


#: Parts of at most so many bytes are often the same in many files, as styles and relations are: they are packed once.
SMALL = 16 << 10


def _deflated(data: bytes) -> tuple[int, bytes]:
    engine = zlib.compressobj(zlib.Z_DEFAULT_COMPRESSION, zlib.DEFLATED, -15)
    return zlib.crc32(data), engine.compress(data) + engine.flush()


_kept = functools.lru_cache(maxsize=64)(_deflated)


def _zipped(parts: dict[str, bytes]) -> bytes:
    """The package, as ``zipfile`` writes it; that one itself writes what needs more than plain headers."""
    if len(parts) > 0xFFF or sum(map(len, parts.values())) > 1 << 30 or not all(n.isascii() for n in parts):
        return _zipped_by_library(parts)
    files, directory, at = [], [], 0
    for name, data in parts.items():
        crc, packed = _kept(data) if len(data) <= SMALL and name != "word/document.xml" else _deflated(data)
        raw = name.encode()
        # version 2.0, no flags, deflated, the first of January 1980
        common = struct.pack("<HHHHHIIIHH", 20, 0, 8, 0, 33, crc, len(packed), len(data), len(raw), 0)
        files += [b"PK\x03\x04", common, raw, packed]
        directory += [b"PK\x01\x02", struct.pack("<BB", 20, 3), common, struct.pack("<HHHII", 0, 0, 0, 0o600 << 16, at), raw]
        at += 30 + len(raw) + len(packed)
    listed = b"".join(directory)
    return b"".join([*files, listed, b"PK\x05\x06", struct.pack("<HHHHIIH", 0, 0, len(parts), len(parts), len(listed), at, 0)])


def _zipped_by_library(parts: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(zipfile.ZipInfo(name, STAMP), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()
