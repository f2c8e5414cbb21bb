"""Fonts that a package carries."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..model import Document
from .containers import open_zip
from .docx import Package

#: How many bytes are hidden, and the faces of a font by their element.
HIDDEN = 32
FACES = {"w:embedRegular": "regular", "w:embedBold": "bold", "w:embedItalic": "italic", "w:embedBoldItalic": "bold_italic"}


@dataclass
class EmbeddedFont:
    name: str
    face: str
    data: bytes


def unhide(data: bytes, guid: str) -> bytes:
    """A font's bytes; the first ones are combined with the digits of its key, the last pair first."""
    digits = re.sub("[^0-9A-Fa-f]", "", guid)
    if len(digits) != 32:
        return data
    key = bytes.fromhex(digits)[::-1]
    return bytes(b ^ key[i % 16] for i, b in enumerate(data[:HIDDEN])) + data[HIDDEN:]


def font_table(data: bytes) -> tuple[list[str], list[EmbeddedFont]]:
    """The fonts that a document declares, and those that it carries, in order; fonts whose part is missing go."""
    package = Package(open_zip(data), Document("docx"))
    tables = [target for kind, target, external in package.relations(package.main()).values() if kind == "fontTable" and not external]
    root = package.part(tables[0]) if tables else None
    names, carried = [], []
    for font in root.all("w:font") if root is not None else []:
        names.append(font.get("w:name") or "")
        for c in font.children:
            target = package.relations(tables[0]).get(c.get("r:id") or "", (None, "", True))
            got = package.archive.read(target[1]) if c.tag in FACES and not target[2] else None
            if got is not None:
                carried.append(EmbeddedFont(names[-1], FACES[c.tag], unhide(got[0], c.get("w:fontKey") or "")))
    return names, carried
