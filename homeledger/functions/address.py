"""Address parts, standard forms and address hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from homeledger.functions.text import WS, extract, strip

# --- fixed values -------------------------------------------------------------
STATE_CODES = {
    "ALABAMA": "AL", "ALASKA": "AK", "ARIZONA": "AZ", "ARKANSAS": "AR", "CALIFORNIA": "CA",
    "COLORADO": "CO", "CONNECTICUT": "CT", "DELAWARE": "DE", "FLORIDA": "FL", "GEORGIA": "GA",
    "HAWAII": "HI", "IDAHO": "ID", "ILLINOIS": "IL", "INDIANA": "IN", "IOWA": "IA",
    "KANSAS": "KS", "KENTUCKY": "KY", "LOUISIANA": "LA", "MAINE": "ME", "MARYLAND": "MD",
    "MASSACHUSETTS": "MA", "MICHIGAN": "MI", "MINNESOTA": "MN", "MISSISSIPPI": "MS",
    "MISSOURI": "MO", "MONTANA": "MT", "NEBRASKA": "NE", "NEVADA": "NV", "NEW HAMPSHIRE": "NH",
    "NEW JERSEY": "NJ", "NEW MEXICO": "NM", "NEW YORK": "NY", "NORTH CAROLINA": "NC",
    "NORTH DAKOTA": "ND", "OHIO": "OH", "OKLAHOMA": "OK", "OREGON": "OR", "PENNSYLVANIA": "PA",
    "RHODE ISLAND": "RI", "SOUTH CAROLINA": "SC", "SOUTH DAKOTA": "SD", "TENNESSEE": "TN",
    "TEXAS": "TX", "UTAH": "UT", "VERMONT": "VT", "VIRGINIA": "VA", "WASHINGTON": "WA",
    "WEST VIRGINIA": "WV", "WISCONSIN": "WI", "WYOMING": "WY",
}
# Replaced inside the text, also within words, in this order.
STREET_WORDS = [
    ("street", "st"),
    ("avenue", "ave"),
    ("boulevard", "blvd"),
    ("drive", "dr"),
    ("road", "rd"),
]
# ------------------------------------------------------------------------------


def _lookup(c: Column, table: dict) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), c)


def standard_state(c: Column) -> Column:
    """State name to its code; unknown text is kept in upper case; null becomes ``''``."""
    up = F.upper(strip(F.coalesce(c, F.lit(""))))
    return F.coalesce(_lookup(up, STATE_CODES), up)


def standard_zip(c: Column) -> Column:
    """First five digits, else the stripped input; null becomes ``''``."""
    text = strip(F.coalesce(c, F.lit("")))
    return F.coalesce(extract(text, "([0-9]{5})"), text)


def fingerprint(street: Column, city: Column, state: Column, zip_code: Column) -> Column:
    """MD5 of the lower-cased address line with common street words shortened."""
    parts = [F.lower(strip(F.coalesce(c, F.lit("")))) for c in (street, city, state)]
    parts.append(strip(F.coalesce(zip_code, F.lit(""))))
    line = F.concat_ws(" ", *parts)
    for word, short in STREET_WORDS:
        line = F.replace(line, F.lit(word), F.lit(short))
    return F.md5(line)


def property_hash(street: Column, city: Column, state: Column, zip_code: Column) -> Column:
    """MD5 of the four address parts joined by ``|`` (no street-word shortening)."""
    parts = [F.coalesce(c, F.lit("")) for c in (street, city, state, zip_code)]
    return F.md5(F.lower(F.trim(F.concat_ws("|", *parts))))


def location_text(street: Column, city: Column, state: Column, zip_code: Column) -> Column:
    return F.concat_ws(", ", street, city, state, zip_code)


def location_id(street: Column, city: Column, state: Column, zip_code: Column, turn: int = 0) -> Column:
    """60-bit id from the four address parts; null and ``''`` stay distinct.

    Another ``turn`` gives another id, for an address whose first one is taken.
    """
    parts = [F.coalesce(c, F.lit("\x02")) for c in (street, city, state, zip_code)]
    parts += [F.lit(str(turn))] if turn else []
    return F.conv(F.substring(F.md5(F.concat_ws("\x01", *parts)), 1, 15), 16, 10).cast("bigint")


def split_address(c: Column) -> dict[str, Column]:
    """City, state and zip from ``street, city, ST 12345`` (two comma parts at least)."""
    parts = F.split(c, ",", -1)
    enough = F.size(parts) >= 2
    tail = F.split(strip(F.try_element_at(parts, F.lit(-1))), f"{WS}+", -1)
    state = F.nullif(F.try_element_at(tail, F.lit(1)), F.lit(""))
    return {
        "city": F.when(enough, strip(F.try_element_at(parts, F.lit(-2)))),
        "state": F.when(enough, state),
        "zip_code": F.when(enough, F.try_element_at(tail, F.lit(2))),
    }


def resolve_link(href: Column, base: str) -> Column:
    """Link against the site root ``base`` (scheme and host, no path)."""
    scheme = base.split(":", 1)[0]
    return (
        F.when(href.isNull(), F.lit(None).cast("string"))
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(F.lit(scheme + ":"), href))
        .when(href.startswith("/") | href.startswith("?") | href.startswith("#") | (href == ""),
              F.concat(F.lit(base), href))
        .otherwise(F.concat(F.lit(base + "/"), href))
    )
