"""Property-listing views over the given star-schema tables.

The tables hold no listings, so orders, customers, nations and parts are read as
listings, their sellers, cities and street names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def orders_as_of() -> Column:
    """Reference time for look-backs over orders: the day after the last one."""
    return F.lit("2001-08-02").cast("timestamp_ntz")


def events_as_of() -> Column:
    """Reference time for look-backs over events: the day after the last one."""
    return F.lit("2024-01-31").cast("timestamp_ntz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listings(spark: SparkSession, sf_dir: str, per_page: int | None = None) -> DataFrame:
    """Flat scraped listings, one per order.

    With ``per_page`` each carries the ``page_id`` of its block of so many keys, and a page's listings lie in one task.
    """
    parts = table(spark, sf_dir, "part")
    n_parts = parts.agg(F.count("*")).scalar()
    orders = table(spark, sf_dir, "orders").withColumn("_p", F.col("o_orderkey") % n_parts)
    joined = (
        orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(parts.select("p_partkey", "p_type"), F.col("_p") == F.col("p_partkey"))
    )
    # These rows are thin and lie in few splits, but much work per row follows: all cores take part in it.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    if per_page:
        joined = joined.withColumn("page_id", F.floor(k / per_page).cast("bigint")).repartition(tasks, "page_id")
    else:
        joined = joined.repartition(tasks, "o_orderkey")
    null = F.lit(None)
    house = (c % 400).cast("string")
    suffix = F.when(k % 3 == 0, " Street").when(k % 3 == 1, " St").otherwise(" Avenue")
    return joined.select(
        k.alias("ingest_seq"),
        k.alias("property_id"),
        k.cast("string").alias("external_id"),
        F.when(k % 3 == 0, "redfin").when(k % 3 == 1, "zillow").otherwise("apartments_com")
        .alias("data_source"),
        (1 + k % 8).cast("int").alias("property_type"),
        F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "P", "pending")
        .otherwise("sold").alias("status"),
        F.col("o_totalprice").alias("price"),
        F.when(k % 4 == 0, null).otherwise(1000 + (k * 13) % 4000).cast("double")
        .alias("rent_estimate"),
        F.when(k % 11 == 0, null).otherwise(400 + (k * 37) % 3600).cast("double")
        .alias("square_feet"),
        (k % 6).cast("double").alias("bedrooms"),
        (F.lit(1.0) + (k % 5) * F.lit(0.5)).alias("bathrooms"),
        (1950 + k % 70).cast("int").alias("year_built"),
        F.concat(house, F.lit(" "), F.col("p_type"), suffix).alias("street_address"),
        F.col("n_name").alias("city"),
        F.when(k % 5 == 0, "california").when(k % 5 == 1, " Texas ").when(k % 5 == 2, "NY")
        .when(k % 5 == 4, "ohio").alias("state"),
        F.when(k % 13 == 0, null).otherwise(
            F.concat(F.lpad(house, 5, "9"), F.when(k % 2 == 0, "-1234").otherwise(""))
        ).alias("zip_code"),
        F.col("o_orderdate").alias("created_at"),
        *(["page_id"] if per_page else []),
    )


def listing_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing rows over time: one per order of a customer, price in cents."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("property_id"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("list_price"),
        F.when(F.col("o_orderstatus") == "O", "active").otherwise("sold").alias("listing_status"),
        F.col("o_orderdate").alias("created_at"),
    )


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One location per customer: the seller's place, with made-to-measure coordinates."""
    joined = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    c, n = F.col("c_custkey"), F.col("n_nationkey")
    state = F.when(c % 4 == 0, "CA").when(c % 4 == 1, "TX").when(c % 4 == 2, "NY")
    return joined.select(
        c.alias("id"),
        F.concat((c % 400).cast("string"), F.lit(" "), F.col("c_mktsegment"), F.lit(" Street"))
        .alias("street_address"),
        F.col("n_name").alias("city"),
        state.alias("state"),
        F.lpad((c % 400).cast("string"), 5, "9").alias("zip_code"),
        F.when(c % 7 != 0, "US").alias("country"),
        (F.lit(25.0) + n.cast("double")).alias("latitude"),
        (F.lit(-120.0) + (c % 50).cast("double")).alias("longitude"),
    )


def located_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Property table with a ``location_id`` pointing at :func:`locations`, price in cents."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("property_id"),
        F.col("o_custkey").alias("location_id"),
        k.cast("string").alias("external_id"),
        F.when(k % 3 == 0, "redfin").when(k % 3 == 1, "zillow").otherwise("apartments_com")
        .alias("data_source"),
        (1 + k % 8).cast("int").alias("property_type"),
        F.when(k % 17 != 0, F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("price"),
        (k % 6).cast("double").alias("bedrooms"),
        (F.lit(1.0) + (k % 5) * F.lit(0.5)).alias("bathrooms"),
        (400 + (k * 37) % 3600).cast("double").alias("square_feet"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderdate").alias("updated_at"),
        F.col("o_orderdate").alias("last_scraped"),
    )


def property_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the properties, from all lines of their orders."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("property_id")).agg(
        F.max(F.col("l_quantity").cast("int")).alias("walk_score"),
        F.max("l_discount").alias("cap_rate"),
        F.max(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("zestimate"),
        F.min("l_shipdate").alias("created_at"),
        F.min("l_shipdate").alias("updated_at"),
    )


def metric_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as metric points tagged with a user bucket."""
    user = (F.col("user_id") % 10).cast("string")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("name"),
        F.when(F.col("event_type").isin("signup", "error"), "counter")
        .when(F.col("event_type") == "click", "gauge").otherwise("histogram").alias("kind"),
        "ts",
        F.col("event_id").alias("seq"),
        "value",
        F.create_map(F.lit("user"), user, F.lit("app"), F.lit("web")).alias("tags"),
    )


def _job_status():
    t = F.col("event_type")
    return (
        F.when(t == "signup", "pending").when(t == "view", "running")
        .when(t == "purchase", "completed").when(t == "error", "failed").otherwise("cancelled")
    )


def scrape_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.lpad(e.cast("string"), 12, "0").alias("job_id"),
        F.when(e % 3 == 0, "redfin").when(e % 3 == 1, "zillow").otherwise("apartments_com")
        .alias("data_source"),
        _job_status().alias("status"),
        F.floor("value").cast("bigint").alias("properties_saved"),
        F.col("ts").alias("created_at"),
    )


def job_status_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("job_id"),
        _job_status().alias("status"),
        "ts",
        F.col("event_id").alias("seq"),
    )


def scrape_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        e.alias("id"),
        F.col("user_id").cast("string").alias("job_id"),
        F.col("props").alias("raw_data"),
        F.lit(None).cast("string").alias("processed_data"),
        F.when(e % 5 != 4, e % 2 == 0).alias("is_processed"),
        F.lit(False).alias("is_saved_to_db"),
        F.lit(None).cast("timestamp_ntz").alias("processed_at"),
        F.col("ts").alias("scraped_at"),
    )


def alert_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per hour: request and error counts and their rate."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.date_trunc("hour", "ts").alias("tick"))
        .agg(
            F.count("*").alias("requests"),
            F.count_if(F.col("event_type") == "error").alias("errors"),
            F.max("value").alias("peak"),
        )
        .withColumn("error_rate", F.col("errors") / F.col("requests"))
    )
