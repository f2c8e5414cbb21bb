"""Property sets."""

import struct

from paperloom.sources.containers import open_compound
from paperloom.sources.doc import read_doc
from paperloom.sources.properties import iso_time, metadata, read_properties
from tests.test_documents import compound, word_file


def text(kind, value, page="cp1252"):
    raw = value.encode("utf-16-le" if kind == 31 else page) + (b"\0\0" if kind == 31 else b"\0")
    return struct.pack("<II", kind, len(raw) // (2 if kind == 31 else 1)) + raw


def property_set(values):
    body, places, at = b"", b"", 8 + 8 * len(values)
    for key, value in values.items():
        places += struct.pack("<II", key, at + len(body))
        body += value
    return struct.pack("<HHI16sI16sI", 0xFFFE, 0, 0, bytes(16), 1, bytes(16), 48) + struct.pack("<II", at + len(body), len(values)) + places + body


def test_typed_values():
    data = property_set({2: text(30, "Título"), 1: struct.pack("<Ih", 2, 1252) + b"\0\0", 4: text(31, "Ωmega"), 12: struct.pack("<IQ", 64, 116444736000000000), 14: struct.pack("<Ii", 3, 7), 15: struct.pack("<Ih", 11, -1), 16: struct.pack("<I", 99)})
    assert read_properties(data) == {2: "Título", 4: "Ωmega", 12: "1970-01-01T00:00:00Z", 14: 7, 15: True}
    assert isinstance(read_properties(data[:60]), dict) and read_properties(b"") == {}
    cyrillic = property_set({1: struct.pack("<Ih", 2, 1251) + b"\0\0", 2: text(30, "Жук", "cp1251")})
    assert read_properties(cyrillic) == {2: "Жук"}
    assert iso_time(0) is None and iso_time(1 << 63) is None


def test_summary_streams():
    box = open_compound(compound({"\5SummaryInformation": property_set({2: text(30, " T "), 4: text(30, "A")}), "\5DocumentSummaryInformation": property_set({15: text(30, "C")})}))
    assert metadata(box) == {"title": "T", "creator": "A", "company": "C"}
    assert read_doc(word_file("x\r")).metadata == {}
