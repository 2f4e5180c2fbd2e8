"""Price and area text to numbers, dollars to cents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from homeledger.functions.text import WS, digits_to_long, strip, to_double

# --- fixed values: patterns and limits that results depend on ----------------
AMOUNT = r"\$?([0-9,]+\.?[0-9]*)"
AMOUNT_WITH_UNIT = rf"(?i)([0-9,]+\.?[0-9]*){WS}*(?:dollars?|usd|\$)"
AREA = rf"(?i)([0-9,]+\.?[0-9]*){WS}*(?:sq\.?{WS}*ft\.?|sqft|square{WS}*feet)"
AREA_SHORT = rf"(?i)([0-9,]+\.?[0-9]*){WS}*sf"
BARE_NUMBER = r"^([0-9,]+\.?[0-9]*)$"
FIRST_INT = r"\$?([0-9,]+)"
INT_RANGE = rf"\$?([0-9,]+){WS}*-{WS}*\$?([0-9,]+)"
CENTS_BELOW = 100000
# ------------------------------------------------------------------------------


def _number(c: Column, pattern: str) -> Column:
    """First match without its thousands separators; null when it is not a number."""
    return to_double(F.replace(F.regexp_extract(c, pattern, 1), F.lit(","), F.lit("")))


def clean_price(c: Column) -> Column:
    """Listing price text to a number.

    ``$``, ``,`` and ``+`` go; a range keeps its left side; text from ``per`` on
    goes (lower case only). Text that is still not a number gives null.
    """
    bare = strip(F.regexp_replace(c, "[$,+]", ""))
    left = strip(F.substring_index(bare, "-", 1))
    return to_double(strip(F.substring_index(left, "per", 1)))


def amount_from_text(c: Column) -> Column:
    """First amount in free text; an amount with a currency word is the second try."""
    return F.coalesce(_number(c, AMOUNT), _number(c, AMOUNT_WITH_UNIT))


def area_from_text(c: Column) -> Column:
    """Square feet from text with a unit, or from a bare number, truncated."""
    return F.coalesce(
        _number(c, AREA), _number(c, AREA_SHORT), _number(strip(c), BARE_NUMBER)
    ).cast("bigint")


def rent_from_range(c: Column) -> Column:
    """``$1,200 - $1,800`` to the mean of both ends; otherwise the first number."""
    lo = digits_to_long(F.regexp_extract(c, INT_RANGE, 1)).cast("double")
    hi = digits_to_long(F.regexp_extract(c, INT_RANGE, 2)).cast("double")
    first = digits_to_long(F.regexp_extract(c, FIRST_INT, 1)).cast("double")
    return F.when((lo > 0) & (hi > 0), (lo + hi) / 2).otherwise(first)


def to_cents(c: Column, already_cents: bool = False) -> Column:
    """Dollars to whole cents (truncated on the double) for non-zero values under 100000.

    Larger values are taken as cents already; ``already_cents=True`` skips the guess.
    """
    d = c.cast("double")
    if already_cents:
        return d
    in_cents = (d * F.lit(100.0)).cast("bigint").cast("double")
    return F.when((d != 0) & (d < CENTS_BELOW), in_cents).otherwise(d)
