"""String helpers whose edge cases Spark's defaults would get wrong."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character with the Unicode White_Space property (plain ``trim`` only strips ' ').
WHITESPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def trim_ws(c: Column) -> Column:
    """Strip Unicode whitespace, including the ``\\r`` of CRLF files, from both ends."""
    return F.btrim(c, F.lit(WHITESPACE))


def fields(c: Column) -> Column:
    """Whitespace-separated words; blank text gives one empty word."""
    return F.split(trim_ws(c), r"(?U)\s+")


def lines(c: Column) -> Column:
    return F.split(c, "\n")


# Any such character but the line end, as Java character classes.
BLANK = "[" + WHITESPACE.replace("\n", "") + "]"
ASCII_BLANK = r"[ \t\x0B\f\r]"


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def trim_lines(c: Column) -> Column:
    """Every line of the text stripped, between two additional blank lines.

    Anchoring on the line ends makes this one cheap pass.  Most files are ASCII, for which
    a far cheaper character class does.
    """
    framed = F.concat(F.lit("\n"), c, F.lit("\n"))
    strip = lambda blank: F.regexp_replace(framed, f"{blank}*+\n{blank}*+", "\n")
    return F.when(is_ascii(c), strip(ASCII_BLANK)).otherwise(strip(BLANK))


def drop_comment_lines(trimmed: Column) -> Column:
    """Trimmed text without its blank lines and ``#`` lines."""
    return F.regexp_replace(trimmed, r"(?dm)^(?:#[^\n]*+)?(?:\n|\z)", "")


def matches(c: Column, regex: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(regex), F.lit(group))


def before(c: Column, sep: str) -> Column:
    """Text before the first ``sep`` (whole text when absent)."""
    return F.substring_index(c, sep, 1)


def after(c: Column, sep: str) -> Column:
    """Text after the first ``sep``; '' when absent."""
    at = F.instr(c, sep)
    return F.when(at > 0, F.substr(c, at + F.lit(len(sep)))).otherwise(F.lit(""))


def is_blank(c: Column) -> Column:
    return F.coalesce(trim_ws(c) == "", F.lit(True))
