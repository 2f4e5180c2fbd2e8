"""Text expressions. Whitespace follows Python's definition, not the ASCII one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters Python counts as whitespace, as a regex class (fixed values).
WS = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

# The same characters as text, for trimming without a regex.
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
NUMBER = r"^((?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][0-9]+)?)$"


def strip(c: Column) -> Column:
    """Remove leading and trailing whitespace of any kind."""
    return F.btrim(c, F.lit(WS_CHARS))


def collapse_ws(c: Column) -> Column:
    return F.regexp_replace(c, f"{WS}+", " ")


def drop_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", "")


def clean_text(c: Column) -> Column:
    """Strip, drop markup tags, collapse whitespace runs to one space."""
    return collapse_ws(drop_tags(strip(c)))


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """First match of a group, null (not ``''``) when nothing matches."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def to_double(c: Column) -> Column:
    """Plain decimal text to double; null for anything else (``12d`` included)."""
    return F.regexp_extract(c, NUMBER, 1).try_cast("double")


def digits_to_long(c: Column) -> Column:
    """``1,234`` to 1234; null when only separators are left."""
    return F.replace(c, F.lit(","), F.lit("")).try_cast("bigint")


def first_decimal(c: Column) -> Column:
    """First run of digits and points as a number (ratings, lot sizes)."""
    return to_double(F.regexp_extract(c, r"([0-9.]+)", 1))


def keep_number(c: Column) -> Column:
    """Drop everything but digits and points, then truncate to an integer."""
    return to_double(F.regexp_replace(c, "[^0-9.]", "")).cast("bigint")


def has_any(c: Column, *words: str) -> Column:
    """True when the text contains one of the words."""
    hit = F.lit(False)
    for w in words:
        hit = hit | c.contains(w)
    return hit


def escape_lines(c: Column) -> Column:
    """Text on one line: backslashes and line breaks as ``\\\\``, ``\\n`` and ``\\r``."""
    for plain, written in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r")):
        c = F.replace(c, F.lit(plain), F.lit(written))
    return c


def unescape_lines(c: Column) -> Column:
    """Undoes :func:`escape_lines`."""
    pairs = F.split(c, r"\\\\", -1)  # what stands between escaped backslashes
    parts = F.transform(
        pairs,
        lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")),
    )
    return F.when(F.contains(c, F.lit("\\")), F.array_join(parts, "\\")).otherwise(c)
