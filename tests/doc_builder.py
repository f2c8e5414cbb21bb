"""Small Word 97 files for tests: one piece of text, formats in single pages, styles, lists, notes."""

import struct

from paperloom.sources import containers


def compound(streams):
    """A small compound file: one FAT sector, a directory, streams in whole sectors."""
    sector, names = 512, ["Root Entry", *streams]
    body, fat, starts = b"", [], {}
    for name, data in streams.items():
        starts[name] = len(fat)
        n = max(1, -(-max(len(data), 4096) // sector))
        body += data.ljust(n * sector, b"\0")
        fat += [*range(len(fat) + 1, len(fat) + n), 0xFFFFFFFE]
    first_dir = len(fat)
    rows = b""
    for i, name in enumerate(names):
        raw = name.encode("utf-16-le") + b"\0\0"
        right = i + 1 if 0 < i < len(names) - 1 else 0xFFFFFFFF
        child = 1 if i == 0 else 0xFFFFFFFF
        data = streams.get(name, b"")
        rows += raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw), 5 if i == 0 else 2, 1, 0xFFFFFFFF, right, child) + bytes(36) + struct.pack("<IQ", starts.get(name, 0xFFFFFFFE), max(len(data), 4096) if i else 0)
    n = -(-len(rows) // sector)
    body += rows.ljust(n * sector, b"\0")
    fat += [*range(first_dir + 1, first_dir + n), 0xFFFFFFFE, 0xFFFFFFFD]
    at = len(fat) - 1
    table = struct.pack(f"<{len(fat)}I", *fat).ljust(sector, b"\xff")
    head = containers.SIGNATURE + bytes(16) + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<IIIIIIIII", 0, 1, first_dir, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    return head + struct.pack("<I", at) + b"\xff" * (4 * 108) + body + table


def units(text):
    """A character for each 16-bit unit, as positions count."""
    return "".join(chr(u) for (u,) in struct.iter_unpack("<H", text.encode("utf-16-le", "surrogatepass")))


def sprm(code, value):
    size = (1, 1, 2, 4, 2, 2, 0, 3)[code >> 13]
    return struct.pack("<H", code) + (value if isinstance(value, bytes) else value.to_bytes(size, "little"))


def cells(edges, flags):
    body = bytes([len(flags)]) + struct.pack(f"<{len(edges)}h", *edges) + b"".join(struct.pack("<H", f) + bytes(18) for f in flags)
    return sprm(0xD608, struct.pack("<H", len(body) + 1) + body)


def char_page(runs, fc):
    """(length, properties) of consecutive runs of two-byte characters from a place on."""
    page, ends, top, offsets = bytearray(512), [fc], 510, []
    for n, data in runs:
        ends.append(ends[-1] + 2 * n)
        at = 0
        if data:
            top = (top - len(data) - 1) & ~1
            page[top : top + len(data) + 1] = bytes([len(data)]) + data
            at = top // 2
        offsets.append(at)
    struct.pack_into(f"<{len(ends)}I", page, 0, *ends)
    page[4 * len(ends) : 4 * len(ends) + len(offsets)] = bytes(offsets)
    page[511] = len(runs)
    return bytes(page), ends


def para_page(runs, fc):
    """(length, style, properties) of consecutive paragraphs."""
    page, ends, top = bytearray(512), [fc], 510
    at = 4 * (len(runs) + 1)
    for i, (n, style, data) in enumerate(runs):
        ends.append(ends[-1] + 2 * n)
        body = struct.pack("<H", style) + data
        if len(body) % 2:
            body = bytes([(len(body) + 1) // 2]) + body
        else:
            body = bytes([0, len(body) // 2]) + body
        top = (top - len(body)) & ~1
        page[top : top + len(body)] = body
        page[at + 13 * i] = top // 2
    struct.pack_into(f"<{len(ends)}I", page, 0, *ends)
    page[511] = len(runs)
    assert at + 13 * len(runs) < top
    return bytes(page), ends


def style_sheet(styles):
    """(name, kind, parent or None, paragraph properties, character properties)."""
    out = struct.pack("<H", 18) + struct.pack("<HH", len(styles), 10) + bytes(14)
    for number, (name, kind, parent, para, char) in enumerate(styles):
        parts = 2 if kind == 1 else 1
        std = struct.pack("<HHHHH", number, kind | (0xFFF if parent is None else parent) << 4, parts, 0, 0)
        std += struct.pack("<H", len(name)) + name.encode("utf-16-le") + b"\0\0"
        for data in [struct.pack("<H", number) + para, char] if kind == 1 else [char]:
            std += b"\0" * (len(std) & 1) + struct.pack("<H", len(data)) + data
        out += struct.pack("<H", len(std)) + std + b"\0" * (len(std) & 1)
    return out


def level(start, code, text, legal=False, chars=b""):
    return struct.pack("<iBB", start, code, 4 * legal) + bytes(9) + bytes(1) + bytes(8) + bytes([len(chars), 0, 0, 0]) + chars + struct.pack("<H", len(text)) + text.encode("utf-16-le")


def font_table(names):
    out = struct.pack("<HH", len(names), 0)
    for name in names:
        body = bytes(39) + name.encode("utf-16-le") + b"\0\0"
        out += bytes([len(body)]) + body
    return out


def word_file(text, notes="", chars=None, paras=None, styles=None, fonts=(), lists=(), overrides=(), endnotes="", comments="", authors=()):
    """The main text, then footnotes, comments and endnotes, each a text with ``\\x02`` or ``\\x05`` where a note begins."""
    text, notes, comments, endnotes = map(units, (text, notes, comments, endnotes))
    whole = text + notes + comments + endnotes
    raw, begin = whole.encode("utf-16-le", "surrogatepass"), 2048
    stream = bytearray(begin)
    struct.pack_into("<HH", stream, 0, 0xA5EC, 0xC1)
    struct.pack_into("<H", stream, 10, 0x200)
    struct.pack_into("<6i", stream, 0x4C, len(text), len(notes), 0, 0, len(comments), len(endnotes))
    table = b""

    def add(at, data):
        nonlocal table
        struct.pack_into("<II", stream, at, len(table), len(data))
        table += data

    add(0x1A2, struct.pack("<BI", 2, 4 * 2 + 8) + struct.pack("<II", 0, len(whole)) + struct.pack("<HIH", 0, begin, 0))
    marks = [i for i, c in enumerate(text) if c == "\x02"]
    n_foot = notes.count("\x02")
    for at, cps, body, width in ((0xAA, marks[:n_foot], notes, 2), (0x20A, marks[n_foot:], endnotes, 2), (0xBA, [i for i, c in enumerate(text) if c == "\x05"], comments, 30)):
        if cps:
            extra = b"".join(bytes(20) + struct.pack("<H", i) + bytes(8) for i in range(len(cps))) if width == 30 else b"\1\0" * len(cps)
            add(at, struct.pack(f"<{len(cps) + 1}I", *cps, len(text)) + extra)
            mark = "\x05" if width == 30 else "\x02"
            add(at + 8, struct.pack(f"<{len(cps) + 1}I", *[i for i, c in enumerate(body) if c == mark][: len(cps)], len(body)))
    if authors:
        add(0x1BA, b"".join(struct.pack("<H", len(a)) + a.encode("utf-16-le") for a in authors))
    if styles:
        add(0xA2, style_sheet(styles))
    if fonts:
        add(0x112, font_table(fonts))
    if lists:
        head = struct.pack("<H", len(lists)) + b"".join(struct.pack("<ii", list_id, 0) + bytes(18) + bytes([len(levels) == 1, 0]) for list_id, levels in lists)
        add(0x2E2, head)
        table += b"".join(b"".join(levels) for _, levels in lists)
        add(0x2EA, struct.pack("<I", len(overrides)) + b"".join(struct.pack("<iIIBBBB", i, 0, 0, len(changes), 0, 0, 0) for i, changes in overrides) + b"".join(struct.pack("<I", 0xFFFFFFFF) + b"".join(changes) for _, changes in overrides))
    body = bytes(stream[:begin])
    pages, number = raw.ljust(-(-len(raw) // 512) * 512, b"\0"), (begin + len(raw) + 511) // 512
    for at, runs, build in ((0xFA, chars, char_page), (0x102, paras, para_page)):
        if runs:
            made, place, held, size = [], begin, [], 0
            for run in [*runs, None]:
                cost = 0 if run is None else 24 + len(run[-1])
                if held and (run is None or size + cost > 480):
                    page, ends = build(held, place)
                    made.append((place, page))
                    place, held, size = ends[-1], [], 0
                if run is not None:
                    held, size = [*held, run], size + cost
            add(at, struct.pack(f"<{len(made) + 1}I", *[a for a, _ in made], place) + struct.pack(f"<{len(made)}I", *range(number, number + len(made))))
            pages, number = pages + b"".join(p for _, p in made), number + len(made)
    body = bytes(stream[:begin])
    return compound({"WordDocument": body + pages, "1Table": table})
