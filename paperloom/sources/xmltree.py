"""A lenient XML reader: always gives a tree, whatever is wrong with the text."""

from __future__ import annotations

import re
from xml.parsers import expat

# Namespaces by the end of their address, strict and transitional alike, and short prefixes.
NAMESPACES = {
    "wordprocessingml/main": "w",
    "officeDocument/relationships": "r",
    "officeDocument/2006/relationships": "r",
    "package/2006/relationships": "rel",
    "package/2006/content-types": "ct",
    "drawingml/wordprocessingDrawing": "wp",
    "drawingml/2006/wordprocessingDrawing": "wp",
    "drawingml/main": "a",
    "drawingml/2006/main": "a",
    "drawingml/2006/picture": "pic",
    "drawingml/2006/chart": "c",
    "drawingml/2006/diagram": "dgm",
    "drawing/2008/diagram": "dsp",
    "wordprocessingml/2006/main": "w",
    "markup-compatibility/2006": "mc",
    "word/2010/wordprocessingShape": "wps",
    "package/2006/metadata/core-properties": "cp",
    "purl.org/dc/elements/1.1/": "dc",
    "purl.org/dc/terms/": "dcterms",
    "schemas-microsoft-com:vml": "v",
    "officeDocument/2006/math": "m",
    "officeDocument/math": "m",
}
ENTITIES = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}
DEPTH = 4096
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<\?.*?(?:\?>|\Z)|<![^>]*>?|<(/?)([^\s<>/=\"']+)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+)|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", re.S)
_REFERENCE = re.compile(r"&(?:#([0-9]+)|#[xX]([0-9A-Fa-f]+)|([A-Za-z]+));")


class Node:
    __slots__ = ("attributes", "children", "tag", "text")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children, self.text = tag, attributes, [], ""

    def get(self, name: str, default=None):
        return self.attributes.get(name, default)

    def find(self, *tags: str) -> Node | None:
        """The first child of each tag in turn."""
        node = self
        for tag in tags:
            for c in node.children:
                if c.tag == tag:
                    node = c
                    break
            else:
                return None
        return node

    def all(self, tag: str) -> list[Node]:
        return [c for c in self.children if c.tag == tag]

    def walk(self):
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.children))


def decode(data: bytes) -> str:
    """By byte order mark, else by the declaration, else UTF-8 with replacements."""
    if data[:3] == b"\xef\xbb\xbf":
        return data[3:].decode("utf-8", "replace")
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", "replace")
    if data[:2] == b"<\0":
        return data.decode("utf-16-le", "replace")
    if data[:2] == b"\0<":
        return data.decode("utf-16-be", "replace")
    named = re.match(rb"<\?xml[^>]*encoding=[\"']([A-Za-z0-9._-]+)", data[:200])
    name = named[1].decode().lower() if named else "utf-8"
    return data.decode("cp1252" if name in ("windows-1252", "iso-8859-1") else "utf-8", "replace")


def unescape(text: str, attribute: bool = False) -> str:
    def one(m: re.Match) -> str:
        if m[3]:
            return ENTITIES.get(m[3], m[0])
        code = int(m[1]) if m[1] else int(m[2], 16)
        return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]

    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if attribute:
        text = re.sub(r"[\t\n]", " ", text)
    return _REFERENCE.sub(one, text) if "&" in text else text


def _prefix(address: str) -> str | None:
    for end, short in NAMESPACES.items():
        if address.endswith(end):
            return short
    return None


def parse(data: bytes | str) -> Node:
    """The root element; without one an empty node. Unclosed elements end with their parent, stray ends
    are skipped."""
    text = decode(data) if isinstance(data, bytes) else data
    root = _well_formed(text)
    return _lenient(text) if root is None else root


class _TooDeep(Exception):
    pass


def _well_formed(text: str) -> Node | None:
    """The root by expat, the same as by the lenient way; None for texts that are not well-formed, and for those with
    comments, types or character data sections."""
    if "<!" in text:
        return None
    top = Node("", {})
    stack, scopes = [top], []
    spaces, tags, keys = {}, {}, {}

    def declared(attributes: dict[str, str]) -> None:
        nonlocal spaces, tags, keys
        scopes.append((len(stack), spaces, tags, keys))
        spaces, tags, keys = dict(spaces), {}, {}
        for k, v in attributes.items():
            if k == "xmlns":
                spaces[""] = _prefix(v) or v
            elif k.startswith("xmlns:"):
                spaces[k[6:]] = _prefix(v) or k[6:]

    def start(name: str, attributes: dict[str, str]) -> None:
        if attributes:
            try:
                attributes = {keys[k]: v for k, v in attributes.items()}
            except KeyError:  # declarations are never among the keys
                if any(k.startswith("xmlns") for k in attributes):
                    declared(attributes)
                for k in attributes:
                    if not k.startswith("xmlns"):
                        keys[k] = _tag(k, spaces, False)
                attributes = {keys[k]: v for k, v in attributes.items() if k in keys}
        tag = tags.get(name)
        if tag is None:
            tag = tags[name] = _tag(name, spaces, True)
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if len(stack) >= DEPTH:
            raise _TooDeep
        stack.append(node)

    def end(name: str) -> None:
        nonlocal spaces, tags, keys
        stack.pop()
        if scopes and scopes[-1][0] == len(stack):
            _, spaces, tags, keys = scopes.pop()

    def chars(data: str) -> None:
        stack[-1].text += data

    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, chars
    try:
        parser.Parse(text, True)
    except (expat.ExpatError, UnicodeError, _TooDeep):
        return None
    return top.children[0]


def _lenient(text: str) -> Node:
    top = Node("", {})
    stack: list[tuple[Node, str, dict[str, str]]] = [(top, "", {})]
    for m in _TOKEN.finditer(text):
        cdata, close, name, rest, chars = m.groups()
        if chars is not None or cdata is not None:
            node = stack[-1][0]
            body = cdata if cdata is not None else unescape(chars)
            node.text += body
        elif name and close:
            if any(raw == name for _, raw, _ in stack):
                while stack[-1][1] != name:
                    stack.pop()
                stack.pop()
        elif name:
            empty = rest.rstrip().endswith("/")
            pairs = [(k, unescape(a or b, True)) for k, a, b in _ATTRIBUTE.findall(rest)]
            spaces = stack[-1][2]
            if any(k.startswith("xmlns") for k, _ in pairs):
                spaces = dict(spaces)
                for k, v in pairs:
                    if k == "xmlns":
                        spaces[""] = _prefix(v) or v
                    elif k.startswith("xmlns:"):
                        spaces[k[6:]] = _prefix(v) or k[6:]
            node = Node(_tag(name, spaces, True), {_tag(k, spaces, False): v for k, v in pairs if not k.startswith("xmlns")})
            stack[-1][0].children.append(node)
            if not empty and len(stack) < DEPTH:
                stack.append((node, name, spaces))
    return top.children[0] if top.children else top


def _tag(name: str, spaces: dict[str, str], element: bool) -> str:
    prefix, _, local = name.rpartition(":")
    if prefix:
        return f"{spaces.get(prefix, prefix)}:{local}"
    return f"{spaces['']}:{local}" if element and spaces.get("") else local
