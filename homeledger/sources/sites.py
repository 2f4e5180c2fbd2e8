"""Listing records from landed search and detail pages of each site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from homeledger.functions import address, listing, money
from homeledger.functions.text import extract, first_decimal, keep_number
from homeledger.schema import PROPERTY_TYPES
from homeledger.sources.html import Pick, select_fields
from homeledger.sources.registry import Sources
from homeledger.sources.responses import (
    home_records, homes, with_first_parsed, with_first_product,
)

# --- fixed values: page selectors and site roots ----------------------------------
ZILLOW_SITE = "https://www.zillow.com"
ZILLOW_CARDS = (".list-card-info", ".list-card")
ZILLOW_CARD = {
    "href": Pick('a[href*="/homedetails/"]', ("href",)),
    "price_text": Pick(".list-card-price"),
    "address_text": Pick(".list-card-addr"),
    "details_text": Pick(".list-card-details"),
    "type_text": Pick(".list-card-type"),
    "status_text": Pick(".list-card-status"),
    "image": Pick(".list-card-img img", ("src", "data-src")),
}
ZILLOW_DETAIL = {
    "price_text": Pick(".notranslate"),
    "address_text": Pick("h1.ds-address-container"),
    "details_text": Pick(".ds-bed-bath-living-area"),
    "type_text": Pick(".ds-property-type"),
    "year_text": Pick(".ds-year-built"),
    "lot_text": Pick(".ds-lot-size"),
    "overview": Pick(".ds-overview-section"),
    "zestimate_text": Pick(".zestimate"),
}
REDFIN_DETAIL = {
    "price_text": Pick(".sale-price .price"),
    "beds_text": Pick(".beds .value"),
    "baths_text": Pick(".baths .value"),
    "sqft_text": Pick(".sqft .value"),
    "remarks": Pick(".remarks"),
    "street_text": Pick(".street-address"),
}
APARTMENTS_SITE = "https://www.apartments.com"
APARTMENTS_CARDS = (".property-card, .listingCard, .placard", "[data-listingid], [data-propertyid]")
APARTMENTS_CARD = {
    "has_link": Pick("a.property-link"),
    "href": Pick("a.property-link", ("href",)),
    "own_id": Pick("", ("data-listingid", "data-propertyid")),
    "property_name": Pick(".property-name, .property-title"),
    "address_text": Pick(".property-address"),
    "price_text": Pick(".property-pricing, .rent-range"),
    "rooms_text": Pick(".bed-bath, .property-beds"),
    "sqft_text": Pick(".property-sqft, .sqft"),
    "available_text": Pick(".availability, .available-date"),
    "amenities_text": Pick(".property-amenities, .amenities"),
    "image": Pick(".property-photo img, .photo img", ("src", "data-src")),
    "rating_text": Pick(".property-rating, .rating"),
}
APARTMENTS_DETAIL = {
    "property_name": Pick(".property-title, .propertyName"),
    "street_address": Pick(".property-address, .propertyAddress"),
    "units": Pick(
        ".unit-card, .unit-listing, .rentInfoDetail",
        each=(
            ("price", Pick(".unit-price, .rent-range, .rentInfo")),
            ("rooms", Pick(".unit-bed-bath, .bed-bath")),
            ("sqft", Pick(".unit-sqft, .sqft")),
        ),
    ),
    "description": Pick(".property-description, .description"),
    "amenity_texts": Pick(".amenity-item, .amenity, .feature-item", every=True),
    "contact_phone": Pick(".phone-number, .contact-phone"),
    "rating_text": Pick(".property-rating, .rating-value"),
    "all_images": Pick(".property-photo img, .gallery img", ("src", "data-src"), every=True),
}
# ------------------------------------------------------------------------------------


def _one_image() -> Column:
    return F.when(F.col("image").isNotNull(), F.array("image"))


def identified(records: DataFrame, url_counts: bool = False) -> DataFrame:
    """Records with an external id (or, where the source allows it, a listing URL)."""
    ok = F.coalesce(F.col("external_id"), F.lit("")) != ""
    if url_counts:
        ok = ok | (F.coalesce(F.col("listing_url"), F.lit("")) != "")
    return records.filter(ok)


def _address_columns(text: str) -> list[Column]:
    parts = address.split_address(F.col(text))
    return [F.col(text).alias("street_address"), *[c.alias(n) for n, c in parts.items()]]


def zillow_cards(pages: DataFrame) -> DataFrame:
    """Search pages to records, one per card that has an id."""
    cards = select_fields(pages, ZILLOW_CARD, ZILLOW_CARDS)
    keep = [c for c in pages.columns if c != "html"]
    typed = F.when(F.col("type_text").isNull(), F.lit(PROPERTY_TYPES["house"])).otherwise(
        listing.type_from_text(F.col("type_text"))
    )
    records = cards.select(
        *keep, "pos",
        F.lit("zillow").alias("data_source"),
        listing.zpid(F.col("href")).alias("external_id"),
        address.resolve_link(F.col("href"), ZILLOW_SITE).alias("listing_url"),
        money.clean_price(F.col("price_text")).alias("price"),
        *_address_columns("address_text"),
        listing.bedrooms(F.col("details_text")).alias("bedrooms"),
        listing.bathrooms(F.col("details_text")).alias("bathrooms"),
        listing.square_feet(F.col("details_text")).alias("square_feet"),
        typed.cast("int").alias("property_type"),
        listing.status_from_text(F.col("status_text")).alias("listing_status"),
        _one_image().alias("images"),
    )
    return identified(records)


def zillow_details(pages: DataFrame) -> DataFrame:
    """Detail pages to records; structured data overrides what the page shows."""
    fields = select_fields(with_first_parsed(pages), ZILLOW_DETAIL)
    return fields.select(
        "page_id",
        F.lit("zillow").alias("data_source"),
        F.col("url").alias("listing_url"),
        listing.zpid(F.col("url")).alias("external_id"),
        F.coalesce("ld_price", money.clean_price(F.col("price_text"))).alias("price"),
        F.col("address_text").alias("street_address"),
        listing.bedrooms(F.col("details_text")).alias("bedrooms"),
        listing.bathrooms(F.col("details_text")).alias("bathrooms"),
        listing.square_feet(F.col("details_text")).alias("square_feet"),
        F.when(F.col("type_text").isNotNull(), listing.type_from_text(F.col("type_text")))
        .alias("property_type"),
        extract(F.col("year_text"), "([0-9]{4})").cast("int").alias("year_built"),
        first_decimal(F.col("lot_text")).alias("lot_size"),
        F.coalesce("ld_description", "overview").alias("description"),
        money.clean_price(F.col("zestimate_text")).alias("zestimate"),
    )


def redfin_detail_fields(pages: DataFrame) -> DataFrame:
    """Detail pages read by their selectors alone."""
    fields = select_fields(pages, REDFIN_DETAIL)
    kept = [c for c in pages.columns if c != "html"]
    return fields.select(
        *kept,
        money.clean_price(F.col("price_text")).alias("price"),
        keep_number(F.col("beds_text")).alias("bedrooms"),
        keep_number(F.col("baths_text")).alias("bathrooms"),
        keep_number(F.col("sqft_text")).alias("square_feet"),
        F.col("remarks").alias("description"),
        F.col("street_text").alias("street_address"),
    )


def redfin_details(pages: DataFrame) -> DataFrame:
    """Structured data where the page has a product object, else the page's own fields.

    The choice is made for the whole record, not field by field.
    """
    f = redfin_detail_fields(with_first_product(pages))
    ld = F.col("has_ld")
    html_only = ["bedrooms", "bathrooms", "square_feet", "street_address"]
    return f.select(
        "page_id",
        F.lit("redfin").alias("data_source"),
        F.when(~ld, F.col("url")).alias("listing_url"),
        F.when(ld, F.col("ld_price")).otherwise(F.col("price")).alias("price"),
        F.when(ld, F.col("ld_description")).otherwise(F.col("description")).alias("description"),
        *[F.when(~ld, F.col(c)).alias(c) for c in html_only],
    )


def apartments_cards(pages: DataFrame) -> DataFrame:
    """Search pages to records, one per card with an id or a link."""
    cards = select_fields(pages, APARTMENTS_CARD, APARTMENTS_CARDS)
    keep = [c for c in pages.columns if c != "html"]
    rent = money.rent_from_range(F.col("price_text"))
    flags = F.when(F.col("amenities_text").isNotNull(), listing.amenity_flags(F.col("amenities_text")))
    linked = F.col("has_link").isNotNull()
    href = F.when(linked, F.coalesce("href", F.lit("")))
    records = cards.select(
        *keep, "pos",
        F.lit("apartments_com").alias("data_source"),
        F.lit(PROPERTY_TYPES["apartment"]).alias("property_type"),
        F.lit("active").alias("listing_status"),
        F.when(linked, F.coalesce("own_id", listing.trailing_id(href))).alias("external_id"),
        address.resolve_link(href, APARTMENTS_SITE).alias("listing_url"),
        "property_name",
        *_address_columns("address_text"),
        rent.alias("rent_estimate"),
        rent.alias("price"),
        listing.bedrooms(F.col("rooms_text"), studio=True).alias("bedrooms"),
        listing.bathrooms(F.col("rooms_text")).alias("bathrooms"),
        listing.first_integer(F.col("sqft_text")).alias("square_feet"),
        listing.available_now(F.col("available_text")).alias("available_now"),
        flags.alias("features"),
        F.when(F.map_contains_key(flags, "pool"), F.lit(True)).alias("pool"),
        _one_image().alias("images"),
        first_decimal(F.col("rating_text")).alias("rating"),
    )
    return identified(records, url_counts=True)


def _most_common(values: Column) -> Column:
    """Most frequent element; the smallest one on ties."""
    ranked = F.transform(
        F.array_distinct(values),
        lambda x: F.struct((-F.size(F.filter(values, lambda y: y == x))).alias("n"), x.alias("x")),
    )
    return F.get(F.array_sort(ranked), F.lit(0))["x"]


def _mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    return F.try_divide(total, F.size(values))


def with_unit_summary(df: DataFrame, units: str = "units") -> DataFrame:
    """Rent, room and area summary of a page's units (arrays per page, so no shuffle)."""
    def values(fn, field: str) -> Column:
        return F.array_compact(F.transform(F.col(units), lambda u: fn(u[field])))

    positive = lambda c: F.nullif(money.clean_price(c), F.lit(0.0))
    df = df.withColumns({
        "_prices": values(positive, "price"),
        "_beds": values(lambda c: listing.bedrooms(c, studio=True), "rooms"),
        "_baths": values(listing.bathrooms, "rooms"),
        "_sqft": values(listing.first_integer, "sqft"),
    })
    return df.withColumns({
        "rent_estimate": _mean(F.col("_prices")),
        "price": _mean(F.col("_prices")),
        "min_rent": F.array_min("_prices"),
        "max_rent": F.array_max("_prices"),
        "min_bedrooms": F.array_min("_beds"),
        "max_bedrooms": F.array_max("_beds"),
        "bedrooms": _most_common(F.col("_beds")),
        "min_bathrooms": F.array_min("_baths"),
        "max_bathrooms": F.array_max("_baths"),
        "bathrooms": _most_common(F.col("_baths")),
        "min_square_feet": F.array_min("_sqft"),
        "max_square_feet": F.array_max("_sqft"),
        "square_feet": F.floor(_mean(F.col("_sqft"))).cast("bigint"),
    }).drop("_prices", "_beds", "_baths", "_sqft")


def apartments_details(pages: DataFrame) -> DataFrame:
    """Detail pages to records with their units summarised."""
    f = with_unit_summary(select_fields(pages, APARTMENTS_DETAIL))
    amenities = F.transform("amenity_texts", F.lower)
    # One text per amenity; a separator keeps words of neighbours from joining.
    flags = listing.amenity_flags(F.array_join(amenities, "\n"), listing.DETAIL_AMENITY_WORDS)
    images = F.array_distinct("all_images")
    return (
        f.withColumn("data_source", F.lit("apartments_com"))
        .withColumn("property_type", F.lit(PROPERTY_TYPES["apartment"]))
        .withColumnRenamed("url", "listing_url")
        .withColumn("features", flags)
        .withColumn("pool", F.when(F.map_contains_key("features", "pool"), F.lit(True)))
        .withColumn("amenities", amenities)
        .withColumn("rating", first_decimal(F.col("rating_text")))
        .withColumn("images", F.when(F.size(images) > 0, images))
        .drop("units", "amenity_texts", "rating_text", "all_images")
    )


def stock_sources() -> Sources:
    """The three built-in sources; more can be registered on the result."""
    s = Sources()
    s.register("redfin", lambda responses: home_records(homes(responses)))
    s.register("zillow", zillow_cards)
    s.register("apartments_com", apartments_cards)
    return s
