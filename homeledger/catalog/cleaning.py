"""Cleaning, validation and enrichment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from homeledger.catalog.base import (
    LISTINGS, LOCATIONS, SNAPSHOTS, query, s_cents, s_clean, s_fp, s_group, s_num, s_state, s_strip,
    s_zip,
)
from homeledger.functions import address, listing, money
from homeledger.functions.text import WS
from homeledger.operators import clean, enrich, validate
from homeledger.plans import batch
from homeledger.plans.fixtures import (
    listing_snapshots, listings, locations, orders_as_of, table,
)
from homeledger.schema import PROPERTY_TYPES


@query("cln_1_clean_text", f"""
SELECT doc_id AS id, 'document' AS kind, {s_clean('text')} AS cleaned FROM documents
UNION ALL SELECT page_id, 'page', {s_clean('html')} FROM pages""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.lit("document").alias("kind"),
        F.col("text").alias("description"))
    pages = table(spark, sf, "pages").select(
        F.col("page_id").alias("id"), F.lit("page").alias("kind"),
        F.col("html").alias("description"))
    return docs.unionAll(pages).transform(clean.clean_text_fields).select(
        "id", "kind", F.col("description").alias("cleaned"))


def _priced(spark, sf):
    """Listings with text prices in the styles sources use."""
    k = F.col("ingest_seq")
    n = F.format_number(F.floor("price"), 0)
    text = (
        F.when(k % 5 == 0, F.concat(F.lit("$"), n)).when(k % 5 == 1, F.concat(n, F.lit(" USD")))
        .when(k % 5 == 2, F.concat(F.lit("$"), n, F.lit("/month")))
        .when(k % 5 == 3, F.concat(F.lit("from "), n, F.lit(".50 dollars")))
        .otherwise("call for price")
    )
    return listings(spark, sf).select("ingest_seq", text.alias("price"))


_AMOUNT_TEXT = """CASE ingest_seq % 5 WHEN 0 THEN '$' || n WHEN 1 THEN n || ' USD'
  WHEN 2 THEN '$' || n || '/month' WHEN 3 THEN 'from ' || n || '.50 dollars'
  ELSE 'call for price' END"""


@query("cln_2_parse_prices", f"""
WITH {LISTINGS}, t AS (SELECT ingest_seq, format('{{:,}}', CAST(floor(price) AS BIGINT)) AS n
  FROM listings), p AS (SELECT ingest_seq, {_AMOUNT_TEXT} AS raw FROM t),
v AS (SELECT ingest_seq, raw,
  TRY_CAST(replace({s_group('raw', '[$]?([0-9,]+[.]?[0-9]*)')}, ',', '') AS DOUBLE) AS price FROM p)
SELECT ingest_seq, price, CASE WHEN price IS NULL THEN raw END AS price_raw FROM v""")
def _(spark, sf):
    return clean.parse_prices(_priced(spark, sf))


@query("cln_3_parse_measurements", f"""
WITH {LISTINGS} SELECT ingest_seq, CAST(square_feet AS BIGINT) AS square_feet FROM listings""")
def _(spark, sf):
    k = F.col("ingest_seq")
    n = F.format_number("square_feet", 0)
    text = (
        F.when(k % 4 == 0, F.concat(n, F.lit(" sq. ft."))).when(k % 4 == 1, F.concat(n, F.lit("sf")))
        .when(k % 4 == 2, F.concat(F.lit("about "), n, F.lit(" Square Feet"))).otherwise(n)
    )
    return listings(spark, sf).select("ingest_seq", text.alias("square_feet")).transform(
        clean.parse_measurements)


@query("cln_4_standardize_addresses", f"""
WITH {LISTINGS} SELECT ingest_seq, CASE WHEN state IS NOT NULL THEN {s_state('state')} END AS state,
  CASE WHEN zip_code IS NOT NULL THEN {s_zip('zip_code')} END AS zip_code FROM listings""")
def _(spark, sf):
    return listings(spark, sf).select("ingest_seq", "state", "zip_code").transform(
        clean.standardize_addresses)


@query("cln_5_standard_state", f"""
WITH {LISTINGS} SELECT ingest_seq, {s_state('state')} AS state FROM listings""")
def _(spark, sf):
    return listings(spark, sf).select(
        "ingest_seq", address.standard_state(F.col("state")).alias("state"))


@query("cln_6_standard_zip", f"""
WITH {LISTINGS} SELECT ingest_seq, {s_zip('zip_code')} AS zip_code FROM listings""")
def _(spark, sf):
    return listings(spark, sf).select(
        "ingest_seq", address.standard_zip(F.col("zip_code")).alias("zip_code"))


@query("cln_7_to_cents", f"""
SELECT o_orderkey AS id, {s_cents('o_totalprice')} AS cents FROM orders
UNION ALL SELECT -1 - l_orderkey * 10 - l_linenumber, {s_cents('l_extendedprice')} FROM lineitem""")
def _(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), money.to_cents(F.col("o_totalprice")).alias("cents"))
    li = table(spark, sf, "lineitem").select(
        (-1 - F.col("l_orderkey") * 10 - F.col("l_linenumber")).alias("id"),
        money.to_cents(F.col("l_extendedprice")).alias("cents"))
    return o.unionAll(li)


@query("cln_8_price_per_sqft", f"""
WITH {LISTINGS}, c AS (SELECT *, {s_cents('price')} AS cents FROM listings)
SELECT ingest_seq, CASE WHEN square_feet > 0 THEN cents / 100::DOUBLE / square_feet END
  AS price_per_sqft FROM c""")
def _(spark, sf):
    df = listings(spark, sf).withColumn("price", money.to_cents(F.col("price")))
    return df.select(
        "ingest_seq",
        clean.price_per_sqft(F.col("price"), F.col("square_feet")).alias("price_per_sqft"))


@query("cln_9_processing_stamps", f"""
WITH {LISTINGS} SELECT ingest_seq, created_at AS scraped_at,
  TIMESTAMP '2001-08-02' AS processed_at FROM listings""")
def _(spark, sf):
    df = listings(spark, sf).withColumnRenamed("created_at", "scraped_at")
    return clean.bulk_transform(df, orders_as_of()).select("ingest_seq", "scraped_at", "processed_at")


@query("cln_10_coerce_types", f"""
WITH {LISTINGS} SELECT TRY_CAST(external_id AS BIGINT) AS property_id,
  CASE WHEN ingest_seq % 5 = 0 THEN NULL ELSE CAST(ingest_seq AS BIGINT) END AS price,
  square_feet, CAST(year_built AS DOUBLE) AS year_built, zip_code, property_type FROM listings""")
def _(spark, sf):
    k = F.col("ingest_seq")
    raw = listings(spark, sf).select(
        F.col("external_id").alias("property_id"),
        F.when(k % 5 == 0, F.concat(F.lit("about "), k)).otherwise(k.cast("string")).alias("price"),
        F.col("square_feet").cast("string").alias("square_feet"),
        F.col("year_built").cast("string").alias("year_built"),
        "zip_code",
        F.col("property_type").cast("string").alias("property_type"),
    )
    return clean.coerce_types(raw)


_TYPE_NAME = "CASE ingest_seq % 10 " + " ".join(
    f"WHEN {n} THEN '{name}'" for name, n in PROPERTY_TYPES.items()
) + " WHEN 9 THEN 'castle' END"


@query("cln_11_number_property_types", f"""
WITH {LISTINGS}, t AS (SELECT ingest_seq, CASE WHEN ingest_seq % 4 = 3
  THEN CAST(property_type AS VARCHAR) ELSE {_TYPE_NAME} END AS name FROM listings)
SELECT ingest_seq, CAST(CASE WHEN name IS NULL THEN NULL WHEN name IN ('house', '1') THEN 1
  WHEN name IN ('apartment', '2') THEN 2 WHEN name IN ('condo', '3') THEN 3
  WHEN name IN ('townhouse', '4') THEN 4 WHEN name IN ('multi_family', '5') THEN 5
  WHEN name IN ('land', '6') THEN 6 WHEN name IN ('commercial', '7') THEN 7 ELSE 8 END AS INTEGER)
  AS property_type FROM t""")
def _(spark, sf):
    k = F.col("ingest_seq")
    name = F.when(k % 10 == 9, "castle")
    for text, n in PROPERTY_TYPES.items():
        name = name.when(k % 10 == n, text)
    df = listings(spark, sf).select(
        "ingest_seq",
        F.when(k % 4 == 3, F.col("property_type").cast("string")).otherwise(name)
        .alias("property_type"))
    return clean.number_property_types(df)


@query("cln_12_location_text", f"""
WITH {LOCATIONS} SELECT id, concat_ws(', ', street_address, city, state, zip_code) AS location
FROM locations""")
def _(spark, sf):
    return clean.with_location_text(locations(spark, sf), "street_address").select("id", "location")


@query("cln_13_default_country", f"""
WITH {LOCATIONS} SELECT id, COALESCE(country, 'US') AS country FROM locations""")
def _(spark, sf):
    return clean.default_country(locations(spark, sf), "country").select("id", "country")


def _raw_records(spark, sf):
    """Listings with text prices, marked-up descriptions and unit areas."""
    k = F.col("ingest_seq")
    return listings(spark, sf).select(
        "ingest_seq",
        F.concat(F.lit("  <b>Nice</b>\n home in  "), F.col("city"), F.lit(" <br>")).alias("description"),
        F.concat(F.lit("$"), F.format_number(F.floor("price"), 0)).alias("price"),
        "rent_estimate",
        F.when(k % 2 == 0, F.concat(F.format_number("square_feet", 0), F.lit(" sqft")))
        .otherwise(F.format_number("square_feet", 0)).alias("square_feet"),
        "street_address", "city", "state", "zip_code", "bedrooms", "bathrooms",
    )


_ROW_TRANSFORM = f"""ingest_seq, {s_clean("'  <b>Nice</b>' || chr(10) || ' home in  ' || city || ' <br>'")}
  AS description, floor(price) AS price, rent_estimate, CAST(square_feet AS BIGINT) AS square_feet,
  street_address, {s_clean('city')} AS city,
  CASE WHEN state IS NOT NULL THEN {s_state(s_clean('state'))} END AS state,
  CASE WHEN zip_code IS NOT NULL THEN {s_zip('zip_code')} END AS zip_code, bedrooms, bathrooms"""


@query("cln_14_transform_properties", f"""
WITH {LISTINGS} SELECT {_ROW_TRANSFORM}, CAST(NULL AS VARCHAR) AS price_raw,
  TIMESTAMP '2001-08-02' AS processed_at FROM listings""")
def _(spark, sf):
    return clean.transform_properties(_raw_records(spark, sf), orders_as_of())


@query("cln_15_bulk_transform", f"""
WITH {LISTINGS}, c AS (SELECT *, {s_cents('price')} AS cents, {s_cents('rent_estimate')} AS rent
  FROM listings)
SELECT ingest_seq, cents AS price, rent AS rent_estimate, {s_state('state')} AS state,
  {s_zip('zip_code')} AS zip_code,
  CASE WHEN square_feet > 0 THEN cents / 100::DOUBLE / square_feet END AS price_per_sqft,
  TIMESTAMP '2001-08-02' AS scraped_at, TIMESTAMP '2001-08-02' AS processed_at FROM c""")
def _(spark, sf):
    return clean.bulk_transform(listings(spark, sf), orders_as_of()).select(
        "ingest_seq", "price", "rent_estimate", "state", "zip_code", "price_per_sqft",
        "scraped_at", "processed_at")


@query("cln_16_transform_existing_columns", f"""
WITH {LISTINGS} SELECT {_ROW_TRANSFORM} FROM listings""")
def _(spark, sf):
    return clean.transform_existing_columns(_raw_records(spark, sf))


# --- validation -----------------------------------------------------------------------


def _with_faults(spark, sf):
    """Listings with broken rows of every kind."""
    k = F.col("ingest_seq")
    return listings(spark, sf).withColumns({
        "street_address": F.when(k % 19 != 0, F.col("street_address")),
        "external_id": F.when(k % 38 != 0, F.col("external_id")),
        "price": F.when(k % 23 == 0, -F.col("price")).otherwise(F.col("price")),
        "bedrooms": F.when(k % 29 == 0, F.lit(-1.0)).otherwise(F.col("bedrooms")),
        "property_type": F.when(k % 31 == 0, F.lit(99)).otherwise(F.col("property_type")),
        "data_source": F.when(k % 37 == 0, F.lit("unknown")).otherwise(F.col("data_source")),
    })


_FAULTS = """faulty AS (SELECT ingest_seq,
  CASE WHEN ingest_seq % 38 = 0 THEN 1 ELSE 0 END AS e1,
  CASE WHEN ingest_seq % 23 = 0 AND price > 0 THEN 1 ELSE 0 END AS e2,
  CASE WHEN ingest_seq % 29 = 0 THEN 1 ELSE 0 END AS e3,
  CASE WHEN ingest_seq % 31 = 0 THEN 1 ELSE 0 END AS e4,
  CASE WHEN ingest_seq % 37 = 0 THEN 1 ELSE 0 END AS e5 FROM listings)"""


@query("val_1_split_valid", f"""
WITH {LISTINGS}, {_FAULTS} SELECT ingest_seq, 'valid' AS outcome FROM faulty
WHERE e1 + e2 + e3 + e4 + e5 = 0
UNION ALL SELECT ingest_seq, 'invalid' FROM faulty WHERE e1 + e2 + e3 + e4 + e5 > 0""")
def _(spark, sf):
    valid, invalid = validate.split_valid(_with_faults(spark, sf))
    return valid.select("ingest_seq", F.lit("valid").alias("outcome")).unionAll(
        invalid.select("ingest_seq", F.lit("invalid").alias("outcome")))


_ERROR_ROWS = """errs AS (
  SELECT ingest_seq, 'no address and no external_id' AS error FROM faulty WHERE e1 = 1
  UNION ALL SELECT ingest_seq, 'price is negative' FROM faulty WHERE e2 = 1
  UNION ALL SELECT ingest_seq, 'bedrooms is negative' FROM faulty WHERE e3 = 1
  UNION ALL SELECT ingest_seq, 'property_type is unknown' FROM faulty WHERE e4 = 1
  UNION ALL SELECT ingest_seq, 'data_source is unknown' FROM faulty WHERE e5 = 1)"""


@query("val_2_error_report", f"""
WITH {LISTINGS}, {_FAULTS}, {_ERROR_ROWS}
SELECT ingest_seq, error, 'Row ' || ingest_seq || ': ' || error AS message FROM errs""")
def _(spark, sf):
    return validate.error_report(validate.split_valid(_with_faults(spark, sf))[1])


_FILLED = " + ".join(
    f"CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END" for c in validate.COMPLETENESS_FIELDS)


@query("val_4_completeness", f"""
WITH {LISTINGS} SELECT ingest_seq, CAST(({_FILLED}) * 100 // 10 AS INTEGER)
  AS data_completeness_score FROM listings""")
def _(spark, sf):
    return validate.with_completeness(listings(spark, sf)).select(
        "ingest_seq", "data_completeness_score")


@query("val_5_confidence", f"""
WITH {LISTINGS}, {_FAULTS} SELECT ingest_seq,
  CAST((7 - e1 - e2 - e3 - e4 - e5) * 100 // 7 AS INTEGER) AS confidence_score FROM faulty""")
def _(spark, sf):
    return validate.with_confidence(_with_faults(spark, sf)).select("ingest_seq", "confidence_score")


@query("val_6_quality_rates", f"""
WITH {LISTINGS}, {_FAULTS} SELECT count(*) AS total_records,
  count(*) FILTER (e1 + e2 + e3 + e4 + e5 = 0) AS valid_records,
  count(*) FILTER (e1 + e2 + e3 + e4 + e5 > 0) AS invalid_records,
  CAST(sum(e1 + e2 + e3 + e4 + e5) AS BIGINT) AS error_count,
  CAST(count(*) FILTER (e1 + e2 + e3 + e4 + e5 = 0) AS DOUBLE) / count(*) AS validation_rate
FROM faulty""")
def _(spark, sf):
    return validate.quality_rates(_with_faults(spark, sf))


@query("val_6_first_errors", f"""
WITH {LISTINGS}, {_FAULTS}, {_ERROR_ROWS}
SELECT ingest_seq, error, 'Row ' || ingest_seq || ': ' || error AS message FROM errs
ORDER BY ingest_seq, error LIMIT 10""")
def _(spark, sf):
    return validate.first_errors(validate.split_valid(_with_faults(spark, sf))[1], 10)


# --- enrichment -----------------------------------------------------------------------


def _in_cents(spark, sf):
    df = listings(spark, sf)
    return df.withColumns({
        c: money.to_cents(F.col(c)) for c in ("price", "rent_estimate")
    })


_CENTS = f"""cents AS (SELECT ingest_seq, city, {s_cents('price')} AS price,
  {s_cents('rent_estimate')} AS rent_estimate, square_feet, year_built FROM listings)"""


@query("enr_1_price_per_sqft", f"""
WITH {LISTINGS}, {_CENTS} SELECT ingest_seq,
  CASE WHEN square_feet > 0 THEN price / 100::DOUBLE / square_feet END
  AS calculated_price_per_sqft FROM cents""")
def _(spark, sf):
    return enrich.with_price_per_sqft(_in_cents(spark, sf)).select(
        "ingest_seq", "calculated_price_per_sqft")


@query("enr_2_rental_yield", f"""
WITH {LISTINGS}, {_CENTS} SELECT ingest_seq, CASE WHEN price > 0
  THEN rent_estimate / 100::DOUBLE * 12::DOUBLE / (price / 100::DOUBLE) * 100::DOUBLE END
  AS estimated_rental_yield FROM cents""")
def _(spark, sf):
    return enrich.with_rental_yield(_in_cents(spark, sf)).select(
        "ingest_seq", "estimated_rental_yield")


@query("enr_3_property_age", f"""
WITH {LISTINGS} SELECT ingest_seq, CAST(2001 - year_built AS INTEGER) AS property_age
FROM listings""")
def _(spark, sf):
    return enrich.with_property_age(listings(spark, sf), orders_as_of()).select(
        "ingest_seq", "property_age")


@query("enr_4_city_median", f"""
WITH {LISTINGS}, {_CENTS}, m AS (SELECT city, median(price) AS city_median_price FROM cents
  WHERE city IS NOT NULL GROUP BY city)
SELECT ingest_seq, cents.city, city_median_price FROM cents LEFT JOIN m ON cents.city = m.city""")
def _(spark, sf):
    return enrich.with_city_median(_in_cents(spark, sf)).select(
        "ingest_seq", "city", "city_median_price")


@query("enr_5_price_vs_market", f"""
WITH {LISTINGS}, {_CENTS}, m AS (SELECT city, median(price) AS med FROM cents
  WHERE city IS NOT NULL GROUP BY city)
SELECT ingest_seq, CASE WHEN med > 0 THEN (price - med) / med * 100::DOUBLE END AS price_vs_market
FROM cents LEFT JOIN m ON cents.city = m.city""")
def _(spark, sf):
    df = enrich.with_city_median(_in_cents(spark, sf))
    return enrich.with_price_vs_market(df).select("ingest_seq", "price_vs_market")


@query("enr_6_enrich", f"""
WITH {LISTINGS}, {_CENTS}, m AS (SELECT city, median(price) AS med FROM cents
  WHERE city IS NOT NULL GROUP BY city)
SELECT ingest_seq, cents.city, price,
  CASE WHEN square_feet > 0 THEN price / 100::DOUBLE / square_feet END AS calculated_price_per_sqft,
  CASE WHEN price > 0 THEN rent_estimate / 100::DOUBLE * 12::DOUBLE / (price / 100::DOUBLE)
    * 100::DOUBLE END AS estimated_rental_yield,
  CAST(2001 - year_built AS INTEGER) AS property_age, med AS city_median_price,
  CASE WHEN med > 0 THEN (price - med) / med * 100::DOUBLE END AS price_vs_market
FROM cents LEFT JOIN m ON cents.city = m.city""")
def _(spark, sf):
    df = _in_cents(spark, sf).select(
        "ingest_seq", "city", "price", "rent_estimate", "square_feet", "year_built")
    return enrich.enrich(df, orders_as_of()).drop("rent_estimate", "square_feet", "year_built")


@query("enr_7_distance", f"""
WITH {LOCATIONS}, r AS (SELECT id, radians(latitude) AS la, radians(34.0522::DOUBLE) AS lb,
  radians(34.0522::DOUBLE - latitude) / 2 AS dla, radians(-118.2437::DOUBLE - longitude) / 2 AS dlo
  FROM locations)
SELECT id, round(6371 * 2 * asin(sqrt(sin(dla) * sin(dla)
  + cos(la) * cos(lb) * sin(dlo) * sin(dlo))), 6) AS distance_km FROM r""")
def _(spark, sf):
    d = listing.distance_km(
        F.col("latitude"), F.col("longitude"), F.lit(34.0522), F.lit(-118.2437))
    return locations(spark, sf).select("id", F.round(d, 6).alias("distance_km"))


@query("enr_8_market_summary", f"""
WITH {LISTINGS} SELECT data_source, round(avg(price), 4) AS avg_price,
  round(avg(CASE WHEN square_feet > 0 THEN price / square_feet END), 4) AS avg_price_per_sqft,
  count(*) AS total_listings FROM listings GROUP BY data_source""")
def _(spark, sf):
    return enrich.market_summary(listings(spark, sf), "data_source").withColumns({
        c: F.round(c, 4) for c in ("avg_price", "avg_price_per_sqft")})


@query("enr_9_dataset_profile", f"""
WITH {LISTINGS} SELECT count(*) AS total, min(price) AS min_price, max(price) AS max_price,
  round(avg(price), 4) AS avg_price,
  CAST(count(*) FILTER (rent_estimate IS NULL) AS DOUBLE) / count(*) AS missing_rent_estimate,
  CAST(count(*) FILTER (square_feet IS NULL) AS DOUBLE) / count(*) AS missing_square_feet,
  CAST(count(*) FILTER (state IS NULL) AS DOUBLE) / count(*) AS missing_state,
  CAST(count(*) FILTER (zip_code IS NULL) AS DOUBLE) / count(*) AS missing_zip_code
FROM listings""")
def _(spark, sf):
    return enrich.dataset_profile(listings(spark, sf)).withColumn(
        "avg_price", F.round("avg_price", 4))


@query("enr_9_room_distribution", f"""
WITH {LISTINGS} SELECT bedrooms, bathrooms, count(*) AS listings FROM listings GROUP BY 1, 2""")
def _(spark, sf):
    return enrich.room_distribution(listings(spark, sf))


@query("enr_10_price_changes", f"""
WITH {SNAPSHOTS}, p AS (SELECT *, lag(list_price) OVER (PARTITION BY property_id
  ORDER BY created_at, id) AS previous_price FROM snapshots)
SELECT *, CAST(list_price - previous_price AS DOUBLE) / previous_price * 100::DOUBLE
  AS change_percent FROM p WHERE previous_price <> 0
  AND abs(CAST(list_price - previous_price AS DOUBLE) / previous_price * 100::DOUBLE) >= 10""")
def _(spark, sf):
    return enrich.price_changes(listing_snapshots(spark, sf), 10.0)


_STD_FP = s_fp("street_address", s_clean("city"), s_state(s_clean("state")), s_zip("zip_code"))


@query("enr_11_batch_audit", f"""
WITH {LISTINGS}, {_FAULTS}, keyed AS (
  SELECT f.e1 + f.e2 + f.e3 + f.e4 + f.e5 AS n, {_STD_FP.replace('street_address',
    'CASE WHEN l.ingest_seq % 19 <> 0 THEN street_address END')} AS fp
  FROM listings l JOIN faulty f ON l.ingest_seq = f.ingest_seq)
SELECT count(*) AS total_input, count(*) FILTER (n > 0) AS invalid,
  CAST(sum(n) AS BIGINT) AS error_count, count(DISTINCT fp) FILTER (n = 0) AS processed,
  count(*) FILTER (n = 0) - count(DISTINCT fp) FILTER (n = 0) AS duplicates FROM keyed""")
def _(spark, sf):
    return batch.audit(_with_faults(spark, sf), orders_as_of())


@query("enr_12_batch_summary", f"""
WITH {LISTINGS}, {_FAULTS}, keyed AS (
  SELECT f.e1 + f.e2 + f.e3 + f.e4 + f.e5 AS n, {_STD_FP.replace('street_address',
    'CASE WHEN l.ingest_seq % 19 <> 0 THEN street_address END')} AS fp
  FROM listings l JOIN faulty f ON l.ingest_seq = f.ingest_seq),
c AS (SELECT count(*) AS total, count(*) FILTER (n = 0) AS valid, count(DISTINCT fp) FILTER (n = 0) AS saved FROM keyed),
s AS (SELECT 'validation' AS stage, total AS input_records, valid AS output_records FROM c
  UNION ALL SELECT 'deduplication', valid, saved FROM c UNION ALL SELECT 'load', saved, saved FROM c)
SELECT *, input_records - output_records AS dropped_records,
  COALESCE(CAST(output_records AS DOUBLE) / NULLIF(input_records, 0), 0) AS kept_rate FROM s""")
def _(spark, sf):
    return batch.summary(batch.audit(_with_faults(spark, sf), orders_as_of()))


_FIRST = f"""firsts AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY ingest_seq) AS rn
  FROM (SELECT *, {_STD_FP} AS fp FROM listings))"""


@query("enr_11_process_batch", f"""
WITH {LISTINGS}, {_FIRST}, u AS (SELECT ingest_seq, city, {s_cents('price')} AS price
  FROM firsts WHERE rn = 1),
m AS (SELECT city, median(price) AS med FROM u GROUP BY city)
SELECT ingest_seq, u.city, price, med AS city_median_price,
  (price - med) / med * 100::DOUBLE AS price_vs_market FROM u LEFT JOIN m ON u.city = m.city""")
def _(spark, sf):
    return batch.stages(listings(spark, sf), orders_as_of()).enriched.select(
        "ingest_seq", "city", "price", "city_median_price", "price_vs_market")


CITY_MARKET_SQL = f"""
WITH {LISTINGS}, {_FIRST}, u AS (SELECT city, square_feet, {s_cents('price')} AS price,
  {s_cents('rent_estimate')} AS rent FROM firsts WHERE rn = 1)
SELECT city, count(*) AS listings, round(avg(price), 4) AS avg_price,
  round(avg(CASE WHEN square_feet > 0 THEN price / 100::DOUBLE / square_feet END), 4)
    AS avg_price_per_sqft,
  round(avg(rent / 100::DOUBLE * 12::DOUBLE / (price / 100::DOUBLE) * 100::DOUBLE), 4)
    AS avg_rental_yield, median(price) AS median_price FROM u GROUP BY city"""


@query("city_market", CITY_MARKET_SQL)
def city_market(spark, sf):
    unique = batch.stages(listings(spark, sf), orders_as_of()).unique
    df = unique.transform(enrich.with_price_per_sqft).transform(enrich.with_rental_yield)
    return enrich.city_market(df).withColumns({
        c: F.round(c, 4) for c in ("avg_price", "avg_price_per_sqft", "avg_rental_yield")})
