"""Codes and values of office files: languages, code pages, palettes, gradients, axis numbers, fitted sizes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numbering formats by their code in binary files.
NUMBER_FORMATS = {
    0: "decimal", 1: "upper_roman", 2: "lower_roman", 3: "upper_letter", 4: "lower_letter", 5: "ordinal", 22: "decimal_zero", 23: "bullet", 255: "none",
}
# The palette of highlights.
HIGHLIGHTS = {
    "black": "000000", "blue": "0000FF", "cyan": "00FFFF", "green": "00FF00", "magenta": "FF00FF", "red": "FF0000", "yellow": "FFFF00", "white": "FFFFFF",
    "darkBlue": "00008B", "darkCyan": "008B8B", "darkGreen": "006400", "darkMagenta": "800080", "darkRed": "8B0000", "darkYellow": "808000",
    "darkGray": "A9A9A9", "lightGray": "D3D3D3",
}
# Language ids and their tags.
LANGUAGES = {
    0x0409: "en-US", 0x0809: "en-GB", 0x0C09: "en-AU", 0x1009: "en-CA", 0x0407: "de-DE", 0x0807: "de-CH", 0x0C07: "de-AT", 0x040C: "fr-FR", 0x0C0C: "fr-CA",
    0x040A: "es-ES", 0x0C0A: "es-ES", 0x080A: "es-MX", 0x0410: "it-IT", 0x0413: "nl-NL", 0x0419: "ru-RU", 0x0411: "ja-JP", 0x0804: "zh-CN", 0x0404: "zh-TW",
    0x0412: "ko-KR", 0x040D: "he-IL", 0x0401: "ar-SA", 0x0416: "pt-BR", 0x0816: "pt-PT", 0x0415: "pl-PL", 0x041D: "sv-SE", 0x0406: "da-DK", 0x0414: "nb-NO",
    0x040B: "fi-FI", 0x0405: "cs-CZ", 0x0408: "el-GR", 0x041F: "tr-TR", 0x040E: "hu-HU", 0x0422: "uk-UA", 0x041E: "th-TH", 0x042A: "vi-VN",
}
# Windows code pages by primary language (the low ten bits of a language id); 1252 is the rest's.
CODE_PAGES = {
    1250: (0x05, 0x0E, 0x15, 0x18, 0x1A, 0x1B, 0x1C, 0x24), 1251: (0x02, 0x19, 0x22, 0x23, 0x2F), 1253: (0x08,), 1254: (0x1F,), 1255: (0x0D,),
    1256: (0x01, 0x20, 0x29), 1257: (0x25, 0x26, 0x27), 1258: (0x2A,), 874: (0x1E,), 932: (0x11,), 949: (0x12,), 950: (0x04,),
}
SIMPLIFIED_CHINESE = 0x0804
EMU_PER_PIXEL, EMU_PER_TWIP = 9525, 635


def _choose(value: Column, table: dict, otherwise: Column | None = None) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    found = F.try_element_at(pairs, value)
    return found if otherwise is None else F.coalesce(found, otherwise)


def number_format(code: Column) -> Column:
    """The numbering format of a binary file's code."""
    return _choose(code.cast("int"), NUMBER_FORMATS, F.concat(F.lit("msonfc"), code.cast("string")))


def highlight(name: Column) -> Column:
    """``RRGGBB`` of a highlight's name, or null."""
    return _choose(name, HIGHLIGHTS)


def language_tag(lid: Column) -> Column:
    """The tag of a language id; others are four hexadecimal digits."""
    return _choose(lid.cast("int"), LANGUAGES, F.lpad(F.hex(lid), 4, "0"))


def code_page(lid: Column) -> Column:
    """The Windows code page of 8-bit text in a language."""
    by_language = {language: page for page, languages in CODE_PAGES.items() for language in languages}
    usual = _choose(lid.cast("int").bitwiseAND(F.lit(0x3FF)), by_language, F.lit(1252))
    return F.when(lid == SIMPLIFIED_CHINESE, 936).otherwise(usual)


def fit(width: Column, height: Column, most_twips: Column) -> Column:
    """(cx, cy) in EMU of a picture in pixels at 96 DPI, scaled down to a width."""
    emu = lambda pixels: F.greatest(pixels, F.lit(1)).cast("long") * EMU_PER_PIXEL
    most = most_twips.cast("long") * EMU_PER_TWIP
    wide = emu(width) > most
    return F.struct(F.when(wide, most).otherwise(emu(width)).alias("cx"), F.when(wide, F.floor(emu(height) * most / emu(width))).otherwise(emu(height)).cast("long").alias("cy"))


def gradient_at(stops: Column, t: Column) -> Column:
    """Red, green and blue at ``t`` from 0 to 1 along stops (at: 0 to 100000 ascending, rgb: three numbers): blended
    between the stops on either side, and the nearest one's outside them."""
    at = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)) * 100_000

    def mixed(a: Column, b: Column) -> Column:
        k = F.when(b["at"] > a["at"], (at - a["at"]) / (b["at"] - a["at"])).otherwise(F.lit(1.0))
        return F.zip_with(a["rgb"], b["rgb"], lambda x, y: F.floor(x + (y - x) * k + 0.5).cast("int"))

    before, after = F.filter(stops, lambda s: s["at"] < at), F.filter(stops, lambda s: s["at"] >= at)
    first, last = F.try_element_at(after, F.lit(1)), F.try_element_at(before, F.lit(-1))
    plain = lambda s: F.transform(s["rgb"], lambda x: x.cast("int"))
    return F.when(F.size(after) == 0, plain(last)).when(F.size(before) == 0, plain(first)).otherwise(mixed(last, first))


def average_colour(stops: Column) -> Column:
    """The middle of a gradient, which text boxes take as their background."""
    return gradient_at(stops, F.lit(0.5))


def luminance(red: Column, green: Column, blue: Column, scale: Column | None = None, shift: Column | None = None) -> Column:
    """Red, green and blue from 0 to 255 with their HSL lightness scaled and shifted, hue and saturation kept."""
    r, g, b = (c.cast("double") / 255 for c in (red, green, blue))
    most, least = F.greatest(r, g, b), F.least(r, g, b)
    light, span = (most + least) / 2, most - least
    saturation = F.when(span == 0, 0.0).otherwise(span / (1 - F.abs(2 * light - 1)))
    new = light if scale is None else light * scale
    new = new if shift is None else new + shift
    new = F.least(F.greatest(new, F.lit(0.0)), F.lit(1.0))
    chroma = (1 - F.abs(2 * new - 1)) * saturation
    # each channel's place between the least and the greatest stays
    channel = lambda c: new - chroma / 2 + F.when(span == 0, 0.0).otherwise((c - least) / span) * chroma
    return F.array(*(F.floor(channel(c) * 255 + 0.5).cast("int") for c in (r, g, b)))


def axis_number(value: Column, pattern: Column) -> Column:
    """A tick's value by its axis' number format: percents, decimals, thousands, or the shortest form."""
    general = F.coalesce(pattern, F.lit("General"))
    body = F.substring_index(general, ";", 1)
    percent, plain = F.contains(general, F.lit("%")), body == "General"
    number = F.when(percent, value * 100).otherwise(value).cast("double")
    places = F.length(F.regexp_extract(body, r"\.([0#]*)", 1))
    by_places = [F.format_number(number, n) for n in range(10)]
    fixed = reduce(lambda out, n: out.when(places == n, by_places[n]), range(1, 10), F.when(places == 0, by_places[0])).otherwise(by_places[9])
    shortest = F.regexp_replace(F.regexp_replace(by_places[9], "0+$", ""), r"\.$", "")
    text = F.when(~plain & (F.contains(body, F.lit(".")) | F.contains(body, F.lit("0"))), fixed).otherwise(shortest)
    text = F.when(F.contains(body, F.lit(",")), text).otherwise(F.replace(text, F.lit(","), F.lit("")))
    text = F.when(text == "-0", "0").otherwise(text)
    return F.when(percent, F.concat(text, F.lit("%"))).otherwise(text)


def border_shows(display: Column, first_page: Column) -> Column:
    """Whether a section's page borders are on a page: on all, on the first, or on all but the first."""
    return F.when(display == "firstPage", first_page).when(display == "notFirstPage", ~first_page).otherwise(F.lit(True))


def json_number(value: Column) -> Column:
    """A number as JSON has it: null where JSON has none."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def header_ids(first: Column, default: Column, even: Column) -> Column:
    """The distinct header or footer ids of a section: first page, default, even."""
    return F.array_distinct(F.array_compact(F.array(first, default, even)))
