"""Escapes and small text rules of the output formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A character that counts as a letter or digit.
WORD = r"[\p{L}\p{N}]"


def trim_all(text: Column) -> Column:
    """Trim every Unicode space."""
    return F.regexp_replace(F.regexp_replace(text, r"^[\s\p{Z}\x85]+", ""), r"[\s\p{Z}\x85]+$", "")


def escape_markdown(text: Column, in_table: bool = False) -> Column:
    """A backslash before characters with a meaning; underscores inside words stay bare."""
    out = F.regexp_replace(text, r"([\\`*\[\]<~])", r"\\$1")
    out = F.regexp_replace(out, rf"(?<!{WORD})_|_(?!{WORD})", r"\\_")
    return F.replace(out, F.lit("|"), F.lit("\\|")) if in_table else out


def escape_line_start(line: Column) -> Column:
    """A line that would open a heading, quote, list or rule gets a backslash."""
    out = F.regexp_replace(line, r"^([#>\-+=])", r"\\$1")
    return F.regexp_replace(out, r"^([0-9]{1,9})([.)])(?=[ \t]|\z)", r"$1\\$2")


def longest_run(text: Column, char: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(f"[{char}]+"), F.lit(0))
    return F.coalesce(F.array_max(F.transform(found, lambda x: F.length(x))), F.lit(0))


def code_span(text: Column) -> Column:
    """The text between fences longer than any run of backticks in it."""
    fence = F.repeat(F.lit("`"), longest_run(text, "`") + 1)
    pad = F.when(text.startswith("`") | text.endswith("`"), " ").otherwise("")
    return F.concat(fence, pad, text, pad, fence)


def wrap_url(url: Column) -> Column:
    """Angle brackets around a link target that is empty or holds spaces or parentheses."""
    safe = F.replace(F.replace(url, F.lit("<"), F.lit("%3C")), F.lit(">"), F.lit("%3E"))
    return F.when((url == "") | url.rlike(r"[ ()\t\n]"), F.concat(F.lit("<"), safe, F.lit(">"))).otherwise(safe)


def list_marker(label: Column, ordinal: Column) -> Column:
    """Bullets become a dash; short decimal labels stay; others become the ordinal."""
    return (
        F.when(label.isNull() | ~label.rlike(WORD), "-")
        .when(label.rlike(r"^[0-9]{1,9}[.)]$"), label)
        .otherwise(F.concat(ordinal.cast("string"), F.lit(".")))
    )


def escape_html(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def xml_text(text: Column) -> Column:
    """Text for XML: what XML forbids goes, markup characters are escaped."""
    clean = F.regexp_replace(text, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F￾￿]", "")
    return escape_html(clean)


def base64_text(data: Column) -> Column:
    return F.regexp_replace(F.base64(data), "[\\r\\n]", "")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def href(target: Column, anchor: Column) -> Column:
    """A link from its target and anchor, either of which may be null."""
    return F.when(target.isNull() & anchor.isNull(), F.lit(None)).otherwise(
        F.concat(F.coalesce(target, F.lit("")), F.coalesce(F.concat(F.lit("#"), anchor), F.lit("")))
    )


def percent_decode(text: Column) -> Column:
    """``%41`` becomes ``A``; a plus sign stays; bad escapes leave the text as it is."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def resolved_path(target: Column, base: Column | None = None) -> Column:
    """A relationship's target against the folder ``base``: ``.`` and ``..`` are resolved, a leading slash starts anew."""
    whole = target if base is None else F.when(target.startswith("/"), target).otherwise(F.concat(base, F.lit("/"), target))
    none = F.array().cast("array<string>")

    def step(path: Column, segment: Column) -> Column:
        up = F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0)))
        return F.when(segment.isin("", "."), path).when(segment == "..", up).otherwise(F.concat(path, F.array(segment)))

    return F.array_join(F.aggregate(F.split(whole, "/"), none, step), "/")
