"""Cleaning and standardising listing rows. Every step is a projection: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from homeledger.functions import address, listing, money
from homeledger.functions.text import clean_text
from homeledger.schema import schema_of

TEXT_FIELDS = ["description", "address", "city", "state"]
PRICE_FIELDS = ["price", "rent_estimate"]


def _is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def clean_text_fields(df: DataFrame, fields: list[str] = TEXT_FIELDS) -> DataFrame:
    return df.withColumns({f: clean_text(F.col(f)) for f in fields if f in df.columns})


def parse_prices(df: DataFrame, fields: list[str] = PRICE_FIELDS) -> DataFrame:
    """Text prices to doubles; the text stays in ``<field>_raw`` where it gave no number."""
    found = [f for f in fields if f in df.columns and _is_text(df, f)]
    if not found:
        return df
    columns = df.columns
    # The amount is its own column first, so that it is worked out once for both results.
    amounts = df.withColumns({f"_amount_{f}": money.amount_from_text(F.col(f)) for f in found})
    out = [F.col(f"_amount_{c}").alias(c) if c in found else F.col(c) for c in columns]
    raw = [F.when(F.col(f"_amount_{f}").isNull(), F.col(f)).alias(f"{f}_raw") for f in found]
    return amounts.select(*out, *raw)


def parse_measurements(df: DataFrame) -> DataFrame:
    if "square_feet" in df.columns and _is_text(df, "square_feet"):
        return df.withColumn("square_feet", money.area_from_text(F.col("square_feet")))
    return df


def standardize_addresses(df: DataFrame) -> DataFrame:
    """State codes and five-digit zips; nulls stay null (unlike :func:`bulk_transform`)."""
    out = {}
    for name, fn in (("state", address.standard_state), ("zip_code", address.standard_zip)):
        if name in df.columns:
            c = F.col(name)
            out[name] = F.when(c.isNotNull(), fn(c))
    return df.withColumns(out) if out else df


def transform_properties(df: DataFrame, processed_at: Column | None = None) -> DataFrame:
    """Row transform: text, prices, measurements, address, processing stamp."""
    stamp = F.current_timestamp() if processed_at is None else processed_at
    return (
        df.transform(clean_text_fields)
        .transform(parse_prices)
        .transform(parse_measurements)
        .transform(standardize_addresses)
        .withColumn("processed_at", stamp)
    )


def transform_existing_columns(df: DataFrame) -> DataFrame:
    """Row transform that keeps the input's column list."""
    return transform_properties(df).select(*df.columns)


def price_per_sqft(price: Column, sqft: Column) -> Column:
    """Dollars per square foot from a price in cents."""
    return F.when(sqft > 0, price / F.lit(100.0) / sqft)


def bulk_transform(
    df: DataFrame,
    now: Column | None = None,
    already_cents: bool = False,
) -> DataFrame:
    """Cents, missing price per area, state, zip, time stamps.

    ``price_per_sqft`` is computed only where the input has no such column; a
    scrape time that is already there is kept.
    """
    now = F.current_timestamp() if now is None else now
    cols = df.columns
    cents = {f: money.to_cents(F.col(f), already_cents) for f in PRICE_FIELDS if f in cols}
    df = df.withColumns(cents) if cents else df
    out = {}
    if {"price", "square_feet"} <= set(cols) and "price_per_sqft" not in cols:
        out["price_per_sqft"] = price_per_sqft(F.col("price"), F.col("square_feet"))
    if "state" in cols:
        out["state"] = address.standard_state(F.col("state"))
    if "zip_code" in cols:
        out["zip_code"] = address.standard_zip(F.col("zip_code"))
    out["scraped_at"] = F.coalesce(F.col("scraped_at"), now) if "scraped_at" in cols else now
    out["processed_at"] = now
    return df.withColumns(out)


def coerce_types(df: DataFrame, table: str = "properties") -> DataFrame:
    """Columns of a declared table to their types; values that do not fit become null."""
    declared = {f.name: f.dataType for f in schema_of(table).fields}
    return df.select(
        *[
            F.col(c).try_cast(declared[c]).alias(c) if c in declared else F.col(c)
            for c in df.columns
        ]
    )


def with_all_columns(df: DataFrame, table: str) -> DataFrame:
    """Declared columns in declared order; absent ones as typed nulls (no extra columns)."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema_of(table).fields
        ]
    )


def number_property_types(df: DataFrame, column: str = "property_type") -> DataFrame:
    return df.withColumn(column, listing.type_number(F.col(column).cast("string")))


def with_location_text(df: DataFrame, street: str = "address") -> DataFrame:
    return df.withColumn(
        "location",
        address.location_text(F.col(street), F.col("city"), F.col("state"), F.col("zip_code")),
    )


def default_country(df: DataFrame, column: str = "country_code") -> DataFrame:
    return df.withColumn(column, F.coalesce(F.col(column), F.lit("US")))
