"""Classifiers and patterns for listing text, and geographic distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from homeledger.functions.text import WS, digits_to_long, extract, has_any, to_double
from homeledger.schema import JSON_TYPE_CODES, PROPERTY_TYPES

# --- fixed values -------------------------------------------------------------
BEDS = rf"(?i)([0-9]+){WS}*(?:bd|bed)"
BATHS = rf"(?i)([0-9.]+){WS}*(?:ba|bath)"
SQFT = rf"(?i)([0-9,]+){WS}*(?:sqft|sq\.?{WS}*ft)"
ZPID = r"/([0-9]+)_zpid/"
TRAILING_ID = r"/([0-9]+)/?$"
# Checked in this order; the first type with a matching word wins.
TYPE_WORDS = [
    ("house", ["house", "single"]),
    ("condo", ["condo"]),
    ("townhouse", ["townhouse", "townhome"]),
    ("apartment", ["apartment"]),
    ("multi_family", ["multi", "duplex"]),
    ("land", ["land", "lot"]),
]
AMENITY_WORDS = {
    "pool": ["pool"],
    "gym": ["gym", "fitness"],
    "parking": ["parking", "garage"],
    "laundry": ["laundry"],
    "pet_friendly": ["pet"],
}
DETAIL_AMENITY_WORDS = {
    **AMENITY_WORDS,
    "dishwasher": ["dishwasher"],
    "air_conditioning": ["air conditioning", "a/c"],
}
EARTH_RADIUS_KM = 6371.0
# ------------------------------------------------------------------------------


def type_from_text(c: Column) -> Column:
    """Listing type words to the property-type number; unknown or empty is ``other``."""
    low = F.lower(c)
    out = F.lit(PROPERTY_TYPES["other"])
    for name, words in reversed(TYPE_WORDS):
        out = F.when(has_any(low, *words), F.lit(PROPERTY_TYPES[name])).otherwise(out)
    return out.cast("int")


def type_name_from_code(c: Column) -> Column:
    """Type code of a JSON response to the type name."""
    pairs = [F.lit(x) for kv in JSON_TYPE_CODES.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c.cast("int")), F.lit("other"))


def type_number(c: Column) -> Column:
    """Type name or digit to the property-type number; other text is ``other``, null stays."""
    out = F.lit(PROPERTY_TYPES["other"])
    for name, n in PROPERTY_TYPES.items():
        out = F.when((c == name) | (c == str(n)), F.lit(n)).otherwise(out)
    return F.when(c.isNotNull(), out).cast("int")


def status_from_text(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return (
        F.when(low.contains("pending"), "pending").when(low.contains("sold"), "sold")
        .otherwise("active")
    )


def bedrooms(c: Column, studio: bool = False) -> Column:
    n = F.regexp_extract(c, BEDS, 1).try_cast("int")
    if studio:
        n = F.coalesce(n, F.when(F.lower(c).contains("studio"), F.lit(0)))
    return n


def bathrooms(c: Column) -> Column:
    return to_double(F.regexp_extract(c, BATHS, 1))


def square_feet(c: Column) -> Column:
    return digits_to_long(F.regexp_extract(c, SQFT, 1))


def first_integer(c: Column) -> Column:
    return digits_to_long(F.regexp_extract(c, r"([0-9,]+)", 1))


def zpid(url: Column) -> Column:
    return extract(url, ZPID)


def trailing_id(url: Column) -> Column:
    return extract(url, TRAILING_ID)


def available_now(c: Column) -> Column:
    """True when the text speaks of availability at all ("not available" included)."""
    return F.when(has_any(F.lower(c), "now", "available"), F.lit(True))


def amenity_flags(c: Column, words: dict[str, list[str]] = AMENITY_WORDS) -> Column:
    """Map of the flags found in the text, each ``true``; empty when none is."""
    low = F.lower(c)
    pairs = [x for k, ws in words.items() for x in (F.lit(k), has_any(low, *ws))]
    return F.transform_values(
        F.map_filter(F.create_map(*pairs), lambda _, v: v), lambda _, v: v.cast("string")
    )


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance (haversine)."""
    half_dlat = F.radians(lat2 - lat1) / 2
    half_dlon = F.radians(lon2 - lon1) / 2
    a = F.sin(half_dlat) * F.sin(half_dlat) + (
        F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_dlon) * F.sin(half_dlon)
    )
    return F.lit(EARTH_RADIUS_KM) * (F.lit(2.0) * F.asin(F.sqrt(a)))
