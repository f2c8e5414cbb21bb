"""Column functions by examples, and the Python rules of the writers against them."""

import pytest
from pyspark.sql import functions as F

from paperloom import functions as fn
from paperloom.outputs import markdown as md
from paperloom.outputs import walk


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


NUMBERS = [0, 1, 4, 9, 10, 11, 12, 13, 21, 22, 26, 27, 28, 40, 52, 53, 90, 101, 111, 112, 400, 1994, 3999, 12345]


@pytest.mark.parametrize("fmt", ["decimal", "decimal_zero", "upper_roman", "lower_roman", "upper_letter", "lower_letter", "ordinal", "bullet", "none", "chicago"])
def test_number_labels(spark, fmt):
    assert column(spark, NUMBERS, lambda n: fn.number_label(F.lit(fmt), n), "long") == [walk.number_label(fmt, n) for n in NUMBERS]


def test_label_values(spark):
    assert column(spark, [1994], fn.roman, "long") == ["MCMXCIV"]
    assert column(spark, [28, 27, 0], fn.letters, "long") == ["BB", "AA", ""]
    assert column(spark, [11, 112, 21, 22, 23], fn.ordinal, "long") == ["11th", "112th", "21st", "22nd", "23rd"]
    assert column(spark, [3], lambda n: fn.note_label(F.lit("endnote"), n), "long") == ["iii"]


TEXTS = ["", "plain", "*a* [b] 1_000 _x_", "a_b_", "__init__", "back\\slash `code`", "<tag> ~ |", "é_é _é_"]
LINES = ["", "# no", "- item", "+1", "= x", "> q", "1. not", "1.", "12345678901. x", "1.5", "3) y", "a # b"]


def test_escapes_agree(spark):
    assert column(spark, TEXTS, fn.escape_markdown) == [md.escape(t) for t in TEXTS]
    assert column(spark, TEXTS, lambda t: fn.escape_markdown(t, True)) == [md.escape(t, True) for t in TEXTS]
    assert column(spark, LINES, fn.escape_line_start) == [md.escape_line(t) for t in LINES]
    spans = ["a", "`a", "a``b", "```"]
    assert column(spark, spans, fn.code_span) == [md.code_span(t) for t in spans]
    urls = ["", "http://a.b/c", "http://a.b/(c)", "a b", "x<y>(z)"]
    assert column(spark, urls, fn.wrap_url) == [md.link_target(u) for u in urls]


def test_values(spark):
    assert column(spark, ["0", "false", "off", "False", "FALSE", "1", "on", "", None, "no"], fn.on_off) == [False] * 5 + [True] * 5
    assert column(spark, ["100", "1.5", "1in", "2.54cm", "12pt", "1pc", "x", "-5"], fn.measure) == [100, 2, 1440, 1440, 240, 240, None, -5]
    assert column(spark, ["FF0010", "ff", "auto"], fn.rgb_of) == [[255, 0, 16], None, None]
    assert column(spark, [116444736000000000, 0], fn.filetime, "long") == ["1970-01-01T00:00:00Z", None]
    assert column(spark, [(124 << 20) | (2 << 16) | (29 << 11) | (13 << 6) | 5, 0], fn.dttm, "long") == ["2024-02-29T13:05:00", None]
    assert column(spark, ["a%41+b", "%zz", "plain"], fn.percent_decode) == ["aA+b", "%zz", "plain"]
    assert column(spark, ["  x \t"], fn.trim_all) == ["x"]
    assert column(spark, ["a\x00b<"], fn.xml_text) == ["ab&lt;"]
    assert column(spark, ["10pt", "8", "1in", "e"], fn.css_length) == [10.0, 6.0, 72.0, None]


def test_headers_of_images(spark):
    png = bytes.fromhex("89504E470D0A1A0A0000000D49484452000000640000003208")
    gif = b"GIF89a" + bytes([10, 0, 20, 0])
    bmp = b"BM" + bytes(16) + (7).to_bytes(4, "little") + (9).to_bytes(4, "little")
    df = spark.createDataFrame([(1, png), (2, gif), (3, bmp), (4, b"")], "i int, d binary").orderBy("i")
    assert [tuple(r[0]) if r[0] else None for r in df.select(fn.image_size(F.col("d"))).collect()] == [(100, 50), (10, 20), (7, 9), None]
    assert [r[0] for r in df.select(fn.sniff_image(F.col("d"))).collect()] == ["image/png", "image/gif", "image/bmp", "application/octet-stream"]


def test_office_values(spark):
    from pyspark.sql import functions as F

    from paperloom import functions as fn

    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()["x"]
    for value, pattern, text in [
        (1234567.0, "#,##0", "1,234,567"), (0.125, "0%", "12%"), (0.125, "0.0%", "12.5%"), (2.5, None, "2.5"), (1000.0, "General", "1000"),
        (-1234.5, "#,##0.00;[Red]-0", "-1,234.50"), (3.0, "0", "3"), (-0.0001, "0", "0"),
    ]:
        assert get(fn.axis_number(F.lit(value), F.lit(pattern).cast("string"))) == text
    for rgb, scale, shift in [((255, 0, 0), 0.5, None), ((10, 200, 90), None, 0.2), ((7, 7, 7), 0.3, 0.4), ((0, 128, 255), 0.75, 0.25)]:
        import colorsys

        h, l, s = colorsys.rgb_to_hls(*(c / 255 for c in rgb))
        l = min(1.0, l * (scale or 1) + (shift or 0))
        want = [int(c * 255 + 0.5) for c in colorsys.hls_to_rgb(h, l, s)]
        got = get(fn.luminance(*map(F.lit, rgb), scale and F.lit(scale), shift and F.lit(shift)))
        assert all(abs(a - b) <= 1 for a, b in zip(got, want, strict=True))
    stops = F.array(*(F.struct(F.lit(at).alias("at"), F.array(*map(F.lit, rgb)).alias("rgb")) for at, rgb in [(0, (0, 0, 0)), (50000, (100, 200, 0)), (100000, (0, 0, 255))]))
    assert [get(fn.gradient_at(stops, F.lit(t))) for t in (-1.0, 0.25, 0.5, 0.75, 2.0)] == [[0, 0, 0], [50, 100, 0], [100, 200, 0], [50, 100, 128], [0, 0, 255]]
    assert get(fn.average_colour(stops)) == [100, 200, 0]
    assert get(fn.highlight(F.lit("darkRed"))) == "8B0000" and get(fn.highlight(F.lit("none"))) is None
    assert [get(fn.json_number(F.lit(v))) for v in (1.5, float("nan"), float("inf"))] == [1.5, None, None]
    assert tuple(get(fn.fit(F.lit(2000), F.lit(0), F.lit(1440)))) == (914400, 457)
