"""Derived listing metrics and comparison with the local market."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from homeledger.operators.clean import price_per_sqft
from homeledger.operators.grouped import group_median, previous_in_group


def with_price_per_sqft(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "calculated_price_per_sqft", price_per_sqft(F.col("price"), F.col("square_feet"))
    )


def with_rental_yield(df: DataFrame) -> DataFrame:
    """Yearly rent as percent of the price (both in cents)."""
    yearly = F.col("rent_estimate") / F.lit(100.0) * F.lit(12.0)
    return df.withColumn(
        "estimated_rental_yield",
        F.when(F.col("price") > 0, yearly / (F.col("price") / F.lit(100.0)) * F.lit(100.0)),
    )


def with_property_age(df: DataFrame, as_of: Column) -> DataFrame:
    return df.withColumn("property_age", F.year(as_of) - F.col("year_built"))


def with_city_median(df: DataFrame) -> DataFrame:
    """City median price on each row; rows without a city get null.

    Lazy. The medians' size is known at run time, when AQE turns the join into a
    broadcast if they are below its limit; beyond it a hot city is split (skew join).
    """
    return df.join(group_median(df, "city", "price", "city_median_price"), "city", "left")


def with_price_vs_market(df: DataFrame) -> DataFrame:
    med = F.col("city_median_price")
    return df.withColumn(
        "price_vs_market", F.when(med > 0, (F.col("price") - med) / med * F.lit(100.0))
    )


def enrich(df: DataFrame, as_of: Column) -> DataFrame:
    """All enrichment columns."""
    return (
        df.transform(with_price_per_sqft)
        .transform(with_rental_yield)
        .transform(with_property_age, as_of)
        .transform(with_city_median)
        .transform(with_price_vs_market)
    )


def market_summary(df: DataFrame, *by: str) -> DataFrame:
    """Mean price, mean price per square foot and count, overall or per group."""
    return df.groupBy(*by).agg(
        F.avg("price").alias("avg_price"),
        F.avg(F.when(F.col("square_feet") > 0, F.col("price") / F.col("square_feet"))).alias(
            "avg_price_per_sqft"
        ),
        F.count("*").alias("total_listings"),
    )


def city_market(df: DataFrame) -> DataFrame:
    """Per city: listings, mean and median price, mean price per area, mean yield."""
    stats = df.groupBy("city").agg(
        F.count("*").alias("listings"),
        F.avg("price").alias("avg_price"),
        F.avg("calculated_price_per_sqft").alias("avg_price_per_sqft"),
        F.avg("estimated_rental_yield").alias("avg_rental_yield"),
    )
    return stats.join(group_median(df, "city", "price", "median_price"), "city", "left")


def dataset_profile(df: DataFrame) -> DataFrame:
    """One row: size, price range and mean, share of rows missing key fields."""
    total = F.count("*")

    def missing(c: str) -> Column:
        return F.coalesce(F.try_divide(F.count_if(F.col(c).isNull()), total), F.lit(0.0)).alias(
            f"missing_{c}"
        )

    return df.agg(
        total.alias("total"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
        F.avg("price").alias("avg_price"),
        *[missing(c) for c in ("rent_estimate", "square_feet", "state", "zip_code")],
    )


def room_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("bedrooms", "bathrooms").agg(F.count("*").alias("listings"))


def price_changes(
    snapshots: DataFrame,
    threshold_percent: float,
    key: str = "property_id",
    ts: str = "created_at",
    tie: str = "id",
    price: str = "list_price",
) -> DataFrame:
    """Snapshots whose price moved by at least the threshold against the one before."""
    prev = previous_in_group(snapshots, [key], ts, tie, price, "previous_price")
    change = (F.col(price) - F.col("previous_price")) / F.col("previous_price") * F.lit(100.0)
    return (
        prev.withColumn("change_percent", F.when(F.col("previous_price") != 0, change))
        .filter(F.abs("change_percent") >= threshold_percent)
        .drop("previous_price_exists")
    )
