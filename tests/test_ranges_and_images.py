"""Byte ranges, the parts data source and image encoders."""

import io
import random
import threading
import zipfile
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.outputs import images
from paperloom.sources import ranges


def test_merge_and_missing():
    assert ranges.merge([(0, 10), (12, 20)], 1) == [(0, 10), (12, 20)]
    assert ranges.merge([(12, 20), (0, 10), (3, 4)], 2) == [(0, 20)]
    assert ranges.missing([(10, 20), (30, 40)], 5, 45) == [(5, 10), (20, 30), (40, 45)]
    assert ranges.missing([(0, 50)], 5, 45) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 300), st.integers(0, 300)), max_size=12), st.integers(0, 40))
def test_fetched_bytes_are_right(wanted, gap):
    data = bytes(random.Random(1).randrange(256) for _ in range(280))
    f = ranges.Fetcher(ranges.Memory(data), gap)
    for a, b in wanted:
        if a < b:
            assert f.get(a, b) == data[a:b]
    assert f.bytes_fetched <= len(data)


def test_nothing_is_fetched_twice():
    data = bytes(range(256)) * 800
    f = ranges.Fetcher(ranges.Memory(data))
    f.fetch([(10, 20), (150_000, 150_010)])
    assert (f.requests, f.bytes_fetched) == (2, 20)
    assert f.get(12, 18) == data[12:18] and f.requests == 2
    assert f.get(15, 40) == data[15:40] and f.bytes_fetched == 40


def package():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(20):
            z.writestr(f"word/media/image{i}.png", bytes([i]) * 50_000)
        z.writestr("word/document.xml", "<w:document/>" * 100)
        z.writestr("_rels/.rels", "<r/>")
    return out.getvalue()


@pytest.fixture(params=[True, False])
def server(request):
    data, log = package(), []

    class Handler(BaseHTTPRequestHandler):
        def do_HEAD(self):
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()

        def do_GET(self):
            part, code = data, 200
            if request.param and "Range" in self.headers:
                a, b = self.headers["Range"].removeprefix("bytes=").split("-")
                part, code = data[int(a) : int(b) + 1], 206
            log.append(len(part))
            self.send_response(code)
            self.send_header("Content-Length", str(len(part)))
            self.end_headers()
            self.wfile.write(part)

        def log_message(self, *args):
            pass

    http = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}/a.docx", log, request.param
    http.shutdown()


def test_remote_text_parts(server):
    url, log, by_ranges = server
    f = ranges.Fetcher(ranges.backend(url))
    box = ranges.RemoteArchive(f)
    parts = box.read_many([n for n in box.names() if ranges.needed_for_text(n)])
    assert {n: w for n, (_, w) in parts.items()} == {"word/document.xml": True, "_rels/.rels": True}
    assert parts["word/document.xml"][0] == b"<w:document/>" * 100
    assert sum(log) < 70_000 if by_ranges else len(log) == 1


def test_data_source(spark, tmp_path):
    spark.dataSource.register(ranges.DocumentParts)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for name in "ab":
        (tmp_path / f"{name}.docx").write_bytes(package())
    paths = ",".join(str(tmp_path / f"{n}.docx") for n in "ab")
    parts = spark.read.format("document_parts").option("paths", paths).load()
    assert parts.count() == 44
    rows = parts.where("name = 'word/document.xml'").collect()
    assert len(rows) == 2 and all(r["whole"] and r["size"] == 1300 and r["bytes_fetched"] < 100_000 for r in rows)
    assert parts.where("name in ('_rels/.rels', 'nothing') and size > 0").count() == 2


def test_image_files():
    rng = np.random.default_rng(1)
    flat = np.full((7, 5, 4), 200, np.uint8)
    for pixels in (rng.integers(0, 256, (13, 9, 4)).astype(np.uint8), flat, np.zeros((1, 1, 4), np.uint8)):
        assert np.array_equal(images.from_png(images.to_png(pixels)), pixels)
        height, width = pixels.shape[:2]
        ppm = images.to_ppm(pixels)
        assert ppm.startswith(f"P6\n{width} {height}\n255\n".encode()) and len(ppm) == len(f"P6\n{width} {height}\n255\n") + 3 * width * height
        bmp = images.to_bmp(pixels)
        assert len(bmp) == 54 + (3 * width + 3) // 4 * 4 * height and int.from_bytes(bmp[2:6], "little") == len(bmp)
    assert images.over_white(np.array([[[0, 0, 0, 0], [10, 20, 30, 255]]], np.uint8)).tolist() == [[[255] * 3, [10, 20, 30]]]
