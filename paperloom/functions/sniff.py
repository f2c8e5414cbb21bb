"""What bytes are, from their first few."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Leading bytes of image formats.
IMAGES = [
    ("89504E470D0A1A0A", "image/png"),
    ("FFD8FF", "image/jpeg"),
    ("474946383761", "image/gif"),
    ("474946383961", "image/gif"),
    ("424D", "image/bmp"),
    ("49492A00", "image/tiff"),
    ("4D4D002A", "image/tiff"),
    ("D7CDC69A", "image/x-wmf"),
]
CFB = "D0CF11E0A1B11AE1"


def _head(data: Column, n: int) -> Column:
    return F.hex(F.substring(data, 1, n))


def sniff_image(data: Column) -> Column:
    out = None
    for magic, kind in IMAGES:
        hit = _head(data, len(magic) // 2) == magic
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    emf = (_head(data, 4) == "01000000") & (F.hex(F.substring(data, 41, 4)) == "20454D46")
    return out.when(emf, "image/x-emf").otherwise("application/octet-stream")


def detect_format(data: Column) -> Column:
    """docx, doc, encrypted_docx, rtf or unknown. A compound file is told apart by its entry names, which
    are UTF-16 in its directory."""
    head = _head(data, 4)
    name = lambda text: F.lit("".join(f"{ord(c):02X}00" for c in text))
    body = F.hex(data)
    compound = (
        F.when(F.contains(body, name("WordDocument")), "doc").when(F.contains(body, name("EncryptedPackage")), "encrypted_docx").otherwise("unknown")
    )
    return (
        F.when(head.isin("504B0304", "504B0506", "504B0708"), "docx")
        .when(_head(data, 5) == "7B5C727466", "rtf")
        .when(_head(data, 8) == CFB, compound)
        .when(F.hex(F.substring(data, 1, 2)).isin("DBA5", "ECA5"), "doc")
        .otherwise("unknown")
    )


def image_size(data: Column) -> Column:
    """(width, height) of a PNG, GIF or BMP from its header; else null."""

    def number(at: int, n: int, little: bool) -> Column:
        raw = F.hex(F.substring(data, at, n))
        if little:
            raw = F.concat(*(F.substring(raw, 2 * k + 1, 2) for k in reversed(range(n))))
        return F.conv(raw, 16, 10).cast("long")

    pair = lambda w, h: F.struct(w.alias("width"), h.alias("height"))
    kind = sniff_image(data)
    return (
        F.when(kind == "image/png", pair(number(17, 4, False), number(21, 4, False)))
        .when(kind == "image/gif", pair(number(7, 2, True), number(9, 2, True)))
        .when(kind == "image/bmp", pair(number(19, 4, True), number(23, 4, True)))
    )
