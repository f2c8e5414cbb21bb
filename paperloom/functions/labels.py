"""Numbers as list labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Roman digits of hundreds, tens and ones.
HUNDREDS = ["", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"]
TENS = ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"]
ONES = ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]


def _digit(table: list[str], n: Column) -> Column:
    return F.get(F.array(*(F.lit(x) for x in table)), (n % 10).cast("int"))


def roman(n: Column) -> Column:
    """Upper case; thousands without bound; 0 is ``0``."""
    thousands = F.repeat(F.lit("M"), F.floor(n / 1000).cast("int"))
    text = F.concat(thousands, _digit(HUNDREDS, F.floor(n / 100)), _digit(TENS, F.floor(n / 10)), _digit(ONES, n))
    return F.when(n == 0, "0").otherwise(text)


def letters(n: Column) -> Column:
    """A to Z, then AA to ZZ with the letter repeated; 0 is empty."""
    text = F.repeat(F.chr(F.lit(65) + (n - 1) % 26), F.floor((n - 1) / 26).cast("int") + 1)
    return F.when(n <= 0, "").otherwise(text)


def ordinal(n: Column) -> Column:
    last, two = n % 10, n % 100
    suffix = F.when(two.between(11, 13), "th").when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), suffix)


def number_label(fmt: Column, n: Column) -> Column:
    """A label in a numbering format; formats that aren't known are decimal."""
    plain = n.cast("string")
    return (
        F.when(fmt == "decimal_zero", F.when(n < 10, F.lpad(plain, 2, "0")).otherwise(plain))
        .when(fmt == "upper_roman", roman(n))
        .when(fmt == "lower_roman", F.lower(roman(n)))
        .when(fmt == "upper_letter", letters(n))
        .when(fmt == "lower_letter", F.lower(letters(n)))
        .when(fmt == "ordinal", ordinal(n))
        .when(fmt.isin("bullet", "none"), "")
        .otherwise(plain)
    )


def list_label(template: Column, labels: list[Column]) -> Column:
    """A level text such as ``%1.%2)`` with each place filled from ``labels``."""
    out = template
    for i, label in enumerate(labels, 1):
        out = F.replace(out, F.lit(f"%{i}"), F.coalesce(label, F.lit("")))
    return out


def note_label(kind: Column, n: Column) -> Column:
    """Footnotes count in decimals, endnotes in small Roman numbers."""
    return F.when(kind == "endnote", F.lower(roman(n))).otherwise(n.cast("string"))
