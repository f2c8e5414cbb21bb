"""Units, colours, switches and dates of office formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Twips in each unit.
TWIPS = {"pt": 20.0, "in": 1440.0, "cm": 1440 / 2.54, "mm": 144 / 2.54, "pc": 240.0, "pi": 240.0, "px": 15.0}
EMU_PER_POINT, EMU_PER_PIXEL, EMU_PER_TWIP = 12_700, 9_525, 635


def on_off(value: Column) -> Column:
    """False only for the five spellings of no; an absent value is true."""
    return ~F.coalesce(value.isin("0", "false", "off", "False", "FALSE"), F.lit(False))


def toggle(over: Column, base: Column) -> Column:
    """Both set: exclusive or; else whichever is set."""
    return F.when(over.isNotNull() & base.isNotNull(), over != base).otherwise(F.coalesce(over, base))


def measure(text: Column) -> Column:
    """Twips from a bare number (rounded) or a number with a unit; else null."""
    number = F.regexp_extract(text, r"^(-?[0-9]+(?:\.[0-9]+)?)(pt|in|cm|mm|pc|pi)?$", 1)
    suffix = F.regexp_extract(text, r"^(-?[0-9]+(?:\.[0-9]+)?)(pt|in|cm|mm|pc|pi)?$", 2)
    factor = F.when(suffix == "", F.lit(1.0))
    for name, twips in TWIPS.items():
        factor = factor.when(suffix == name, F.lit(twips))
    return F.when(number != "", F.round(number.cast("double") * factor).cast("long"))


def css_length(text: Column) -> Column:
    """Points from a CSS length; pixels without a unit."""
    number = F.regexp_extract(text, r"^\s*(-?[0-9]*\.?[0-9]+)\s*(pt|in|cm|mm|pc|px)?\s*$", 1)
    suffix = F.regexp_extract(text, r"^\s*(-?[0-9]*\.?[0-9]+)\s*(pt|in|cm|mm|pc|px)?\s*$", 2)
    factor = F.when(suffix == "", F.lit(0.75))
    for name, twips in TWIPS.items():
        factor = factor.when(suffix == name, F.lit(twips / 20))
    return F.when(number != "", number.cast("double") * factor)


def unit(value: Column, source: str, target: str) -> Column:
    """Between twips, points, half-points, EMU and pixels."""
    emu = {"twip": EMU_PER_TWIP, "point": EMU_PER_POINT, "half_point": EMU_PER_POINT / 2, "emu": 1, "pixel": EMU_PER_PIXEL}
    return value * F.lit(float(emu[source])) / F.lit(float(emu[target]))


def hex_colour(red: Column, green: Column, blue: Column) -> Column:
    return F.concat(*(F.lpad(F.hex(c), 2, "0") for c in (red, green, blue)))


def rgb_of(colour: Column) -> Column:
    """Red, green and blue of ``RRGGBB``; null for another form."""
    part = lambda at: F.conv(F.substring(colour, at, 2), 16, 10).cast("int")
    return F.when(colour.rlike("^[0-9A-Fa-f]{6}$"), F.array(part(1), part(3), part(5)))


def scale_channel(value: Column, shade: Column | None = None, tint: Column | None = None) -> Column:
    """A channel darkened by a shade or lightened by a tint, each a share of 1."""
    if shade is not None:
        value = value * shade
    if tint is not None:
        value = value * tint + (F.lit(1.0) - tint) * 255
    return F.least(F.lit(255), F.greatest(F.lit(0), F.round(value).cast("int")))


def filetime(ticks: Column) -> Column:
    """ISO time of 100 ns ticks since 1601; 0 is null."""
    micros = (F.floor(ticks / 10) - F.lit(11_644_473_600_000_000)).cast("long")
    return F.when(ticks != 0, F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def dttm(packed: Column) -> Column:
    """ISO time of packed minutes, hours, day, month and year since 1900; 0 is null."""
    field = lambda shift, mask: F.shiftright(packed, shift).bitwiseAND(F.lit(mask)).cast("string")
    year = (F.shiftright(packed, 20).bitwiseAND(F.lit(511)) + 1900).cast("string")
    text = F.concat(
        year, F.lit("-"), F.lpad(field(16, 15), 2, "0"), F.lit("-"), F.lpad(field(11, 31), 2, "0"), F.lit("T"),
        F.lpad(field(6, 31), 2, "0"), F.lit(":"), F.lpad(field(0, 63), 2, "0"), F.lit(":00"),
    )
    return F.when(packed != 0, text)


def civil_date(days: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int"))
