"""Landed JSON bodies to records. Bad JSON gives no records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from homeledger.functions import listing
from homeledger.functions.money import clean_price
from homeledger.schema import SCRAPED

HOME = (
    "property_id bigint, property_type int, beds int, baths double, sqft bigint, lot_size double,"
    " year_built int, price bigint, price_per_sqft double, listing_remarks string,"
    " street_line string, city string, state_or_province string, postal_code string, lat double,"
    " lng double, market_display_name string, county_display_name string, dom int, url string,"
    " mls_id string, garage boolean, pool boolean, fireplace boolean, hoa_fee double, stories int,"
    " photo_count int, photo_url string"
)
SITE = "https://www.redfin.com"
LD_TYPE = "application/ld\\+json"
LD_SCRIPT = (
    rf"""(?is)<script[^>]*\btype\s*=\s*(?:"{LD_TYPE}"|'{LD_TYPE}'|{LD_TYPE}(?=[\s>]))[^>]*>(.*?)</script>"""
)


def api_records(responses: DataFrame, body: str = "body", record: str = SCRAPED) -> DataFrame:
    """Records under ``properties``; a missing key gives none."""
    parsed = F.from_json(body, f"struct<properties: array<struct<{record.replace('`', '')}>>>")
    return responses.withColumn("_r", F.explode(parsed["properties"])).select(
        *[c for c in responses.columns if c != body], "_r.*"
    )


def homes(responses: DataFrame, body: str = "body") -> DataFrame:
    """One row per entry of ``homes``, with its position on the page."""
    parsed = F.from_json(body, f"struct<homes: array<struct<{HOME}>>>")
    return responses.select(
        *[c for c in responses.columns if c != body], F.posexplode(parsed["homes"]).alias("pos", "home")
    )


def home_records(exploded: DataFrame) -> DataFrame:
    """Entries of ``homes`` as flat records, the nested address and listing parts flattened."""
    h = F.col("home")

    def text(name: str):
        return F.coalesce(h[name], F.lit(""))

    flags = F.map_filter(
        F.create_map(
            F.lit("garage"), F.when(h["garage"], "true"),
            F.lit("pool"), F.when(h["pool"], "true"),
            F.lit("fireplace"), F.when(h["fireplace"], "true"),
            F.lit("hoa_fee"), h["hoa_fee"].cast("string"),
        ),
        lambda _, v: v.isNotNull(),
    )
    photo = F.when((h["photo_count"] > 0) & (text("photo_url") != ""), F.array(h["photo_url"]))
    type_name = listing.type_name_from_code(F.coalesce(h["property_type"], F.lit(1)))
    return exploded.select(
        *[c for c in exploded.columns if c != "home"],
        F.coalesce(h["property_id"].cast("string"), F.lit("")).alias("external_id"),
        F.lit("redfin").alias("data_source"),
        listing.type_number(type_name).alias("property_type"),
        h["beds"].cast("double").alias("bedrooms"),
        h["baths"].alias("bathrooms"),
        h["sqft"].cast("double").alias("square_feet"),
        h["lot_size"].alias("lot_size"),
        h["year_built"].cast("double").alias("year_built"),
        h["price"].cast("double").alias("price"),
        h["price_per_sqft"].alias("price_per_sqft"),
        text("listing_remarks").alias("description"),
        text("street_line").alias("street_address"),
        text("city").alias("city"),
        text("state_or_province").alias("state"),
        text("postal_code").alias("zip_code"),
        h["lat"].alias("latitude"),
        h["lng"].alias("longitude"),
        text("market_display_name").alias("neighborhood"),
        text("county_display_name").alias("county"),
        F.lit("active").alias("listing_status"),
        h["price"].cast("double").alias("list_price"),
        h["dom"].alias("days_on_market"),
        F.concat(F.lit(SITE), text("url")).alias("listing_url"),
        text("mls_id").alias("mls_number"),
        F.when(h["garage"], F.lit(1)).alias("garage_spaces"),
        F.when(h["pool"], F.lit(True)).alias("pool"),
        F.when(h["fireplace"], F.lit(True)).alias("fireplace"),
        h["stories"].cast("double").alias("stories"),
        flags.alias("features"),
        F.coalesce(photo, F.array().cast("array<string>")).alias("images"),
    )


_LD = "struct<`@type`: string, description: string, offers: string>"


def _product(js):
    """``(is product, description, price text)`` of one JSON-LD object as text."""
    obj = F.from_json(js, _LD)
    return obj["@type"] == "Product", obj["description"], F.get_json_object(js, "$.offers.price")


def with_first_product(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds ``ld_description`` and ``ld_price`` from the first JSON-LD product object.

    Scripts that do not parse, lists and other types are passed over; price text is
    cleaned. ``has_ld`` tells whether there was a product.
    """
    scripts = F.regexp_extract_all(html, F.lit(LD_SCRIPT), F.lit(1))
    is_product = lambda js: F.coalesce(_product(js)[0], F.lit(False))
    first = F.get(F.filter(scripts, is_product), F.lit(0))
    df = pages.withColumn("_ld", first)
    _, text, price = _product(F.col("_ld"))
    return df.select(
        *pages.columns,
        F.col("_ld").isNotNull().alias("has_ld"),
        F.when(F.col("_ld").isNotNull(), F.coalesce(text, F.lit(""))).alias("ld_description"),
        clean_price(price).alias("ld_price"),
    )


def with_first_parsed(pages: DataFrame, html: str = "html") -> DataFrame:
    """As :func:`with_first_product`, but only the first parseable script is looked at.

    A list stands for its first element; the price must be a plain number.
    """
    scripts = F.regexp_extract_all(html, F.lit(LD_SCRIPT), F.lit(1))
    parses = lambda js: F.try_parse_json(js).isNotNull()
    first = F.get(F.filter(scripts, parses), F.lit(0))
    script = F.col("_ld")
    head = F.when(script.rlike(r"^\s*\["), F.get_json_object(script, "$[0]")).otherwise(script)
    df = pages.withColumn("_ld", first).withColumn("_ld", head)
    found, text, price = _product(F.col("_ld"))
    ok = F.coalesce(found, F.lit(False))
    return df.select(
        *pages.columns,
        ok.alias("has_ld"),
        F.when(ok, F.coalesce(text, F.lit(""))).alias("ld_description"),
        F.when(ok, price.try_cast("double")).alias("ld_price"),
    )
