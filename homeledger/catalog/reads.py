"""Search, lookup, table-maintenance and job queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from homeledger.catalog.base import (
    JOB_EVENTS, JOBS, LISTINGS, LOCATIONS, METRICS, ORACLE, PROPERTIES, RESULTS, SNAPSHOTS, query,
)
from homeledger.catalog.dedup import _LOC_ID
from homeledger.functions import sql as sql_functions
from homeledger.operators import jobs, search, tables
from homeledger.operators.clean import with_all_columns
from homeledger.plans.fixtures import (
    events_as_of, job_status_events, listing_snapshots, listings, located_properties, locations,
    orders_as_of, property_metrics, scrape_jobs, scrape_results, table,
)
from homeledger.schema import DATA_SOURCES, JOB_STATUSES, VIEW_COLUMNS
from homeledger.session import scratch_path
from homeledger.sinks import versions
from homeledger.sinks.files import save_clustered, save_table
from homeledger.sources.files import read_table

CRITERIA = dict(
    data_source="zillow", min_price=5_000_000, max_price=45_000_000, min_bedrooms=1,
    max_bedrooms=4, min_bathrooms=1.0, max_bathrooms=2.5, min_sqft=500, max_sqft=3500,
    city="nation_1", state="x",
)
_MATCH = """matching AS (SELECT p.*, l.city, l.state, l.zip_code FROM properties p
  JOIN locations l ON p.location_id = l.id WHERE data_source = 'zillow'
  AND price >= 5000000 AND price <= 45000000 AND bedrooms >= 1 AND bedrooms <= 4
  AND bathrooms >= 1.0 AND bathrooms <= 2.5 AND square_feet >= 500 AND square_feet <= 3500
  AND city ILIKE '%nation_1%' AND state ILIKE '%x%')"""
_COLS = ["property_id", "location_id", "price", "city", "state", "zip_code", "created_at"]
_COL_SQL = ", ".join(_COLS)


def _tables(spark, sf):
    return located_properties(spark, sf), locations(spark, sf)


@query("qry_1_search", f"""
WITH {PROPERTIES}, {LOCATIONS}, {_MATCH} SELECT {_COL_SQL} FROM matching
ORDER BY created_at DESC NULLS FIRST, property_id LIMIT 100""")
def _(spark, sf):
    return search.search(*_tables(spark, sf), search.Criteria(**CRITERIA, limit=100)).select(*_COLS)


@query("qry_2_equality_filters", f"""
WITH {PROPERTIES}, {LOCATIONS} SELECT property_id, l.zip_code FROM properties p
JOIN locations l ON p.location_id = l.id
WHERE data_source = 'redfin' AND property_type = 4 AND l.zip_code = '99123'""")
def _(spark, sf):
    c = search.Criteria(data_source="redfin", property_type=4, zip_code="99123")
    return search.matching(*_tables(spark, sf), c).select("property_id", "zip_code")


@query("qry_3_range_filters", f"""
WITH {PROPERTIES} SELECT property_id FROM properties WHERE price >= 10000000 AND price <= 20000000
  AND bedrooms >= 2 AND bathrooms <= 2 AND square_feet >= 1000 AND square_feet <= 2000""")
def _(spark, sf):
    return search.range_filters(
        located_properties(spark, sf), price=(10_000_000, 20_000_000), bedrooms=(2, None),
        bathrooms=(None, 2), square_feet=(1000, 2000)).select("property_id")


@query("qry_4_contains_filters", f"""
WITH {LOCATIONS} SELECT id, city, state FROM locations WHERE city ILIKE '%TION_2%' AND state ILIKE '%n%'""")
def _(spark, sf):
    return search.contains_filters(locations(spark, sf), city="TION_2", state="n").select(
        "id", "city", "state")


@query("qry_5_order_nulls_first", f"""
WITH {PROPERTIES}, {LOCATIONS}, j AS (SELECT p.property_id, p.price, l.city FROM properties p
  JOIN locations l ON p.location_id = l.id)
SELECT *, row_number() OVER (ORDER BY price DESC NULLS FIRST, property_id) AS place FROM j
ORDER BY place LIMIT 1500""")
def _(spark, sf):
    c = search.Criteria(order_by="price", limit=1500)
    page = search.search(*_tables(spark, sf), c).select("property_id", "price", "city")
    # The page is already limited to 1500 rows; the window only numbers them.
    w = Window.orderBy(*search.ordering("price", "desc", "property_id"))
    return page.withColumn("place", F.row_number().over(w).cast("bigint"))


@query("qry_5_order_by_location", f"""
WITH {PROPERTIES}, {LOCATIONS} SELECT p.property_id, l.state FROM properties p
JOIN locations l ON p.location_id = l.id ORDER BY l.state ASC NULLS LAST, property_id LIMIT 100""")
def _(spark, sf):
    c = search.Criteria(order_by="state", order_direction="asc", limit=100)
    return search.search(*_tables(spark, sf), c).select("property_id", "state")


@query("qry_6_page", f"""
WITH {PROPERTIES}, {LOCATIONS}, {_MATCH} SELECT property_id, price FROM matching
ORDER BY created_at DESC NULLS FIRST, property_id LIMIT 20 OFFSET 20""")
def _(spark, sf):
    c = search.Criteria(**CRITERIA, limit=20, offset=search.page_offset(2, 20))
    return search.search(*_tables(spark, sf), c).select("property_id", "price")


@query("qry_6_deep_page", f"""
WITH {SNAPSHOTS} SELECT id, created_at, list_price FROM snapshots
ORDER BY created_at DESC NULLS FIRST, id LIMIT 50 OFFSET (SELECT count(*) // 2 FROM snapshots)""")
def _(spark, sf):
    rows = listing_snapshots(spark, sf).select("id", "created_at", "list_price")
    return search.page(rows, "created_at", "desc", "id", rows.count() // 2, 50)


@query("qry_6_rest_after_offset", f"""
WITH {SNAPSHOTS} SELECT id, list_price FROM snapshots ORDER BY list_price NULLS LAST, id OFFSET 1000""")
def _(spark, sf):
    return search.page(listing_snapshots(spark, sf).select("id", "list_price"), "list_price", "asc", "id", 1000)


@query("qry_7_dollar_bounds", f"""
WITH {PROPERTIES} SELECT property_id, price FROM properties WHERE price >= 0 AND price <= 15000050""")
def _(spark, sf):
    bounds = (search.dollars_to_cents(0), search.dollars_to_cents(150000.5))
    return search.range_filters(located_properties(spark, sf), price=bounds).select(
        "property_id", "price")


@query("qry_8_match_count", f"""
WITH {PROPERTIES}, {LOCATIONS}, {_MATCH} SELECT count(*) AS total_count FROM matching""")
def _(spark, sf):
    return search.match_count(*_tables(spark, sf), search.Criteria(**CRITERIA))


@query("qry_9_by_id", f"""
WITH {PROPERTIES} SELECT property_id, price FROM properties
WHERE property_id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def _(spark, sf):
    ids = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("property_id"))
    return search.by_keys(located_properties(spark, sf), ids, ["property_id"]).select(
        "property_id", "price")


@query("qry_9_stored_look_up", ORACLE["qry_9_by_id"])
def _(spark, sf):
    path = scratch_path(spark, "versions")
    versions.create(located_properties(spark, sf), path, "property_id", buckets=16)
    ids = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("property_id"))
    return versions.lookup(spark, path, ids).select("property_id", "price")


@query("qry_10_by_external_id", f"""
WITH {PROPERTIES}, keys AS (SELECT CAST(l_orderkey AS VARCHAR) AS external_id, 'zillow' AS data_source
  FROM lineitem WHERE l_linestatus = 'F')
SELECT property_id FROM properties p WHERE EXISTS (SELECT 1 FROM keys k
  WHERE k.external_id = p.external_id AND k.data_source = p.data_source)""")
def _(spark, sf):
    keys = table(spark, sf, "lineitem").filter("l_linestatus = 'F'").select(
        F.col("l_orderkey").cast("string").alias("external_id"), F.lit("zillow").alias("data_source"))
    return search.by_keys(
        located_properties(spark, sf), keys, ["external_id", "data_source"]).select("property_id")


@query("qry_11_stale", f"""
WITH {PROPERTIES} SELECT property_id, last_scraped FROM properties
WHERE last_scraped < TIMESTAMP '2001-08-02' - INTERVAL 24 HOURS""")
def _(spark, sf):
    return search.stale(located_properties(spark, sf), orders_as_of()).select(
        "property_id", "last_scraped")


@query("qry_12_locations_in_area", f"""
WITH {LOCATIONS} SELECT * FROM locations WHERE city ILIKE '%nation_1%' AND state ILIKE '%ca%'
ORDER BY id LIMIT 100""")
def _(spark, sf):
    return search.locations_in_area(locations(spark, sf), "nation_1", "ca", 100)


@query("qry_13_locations_by_address", f"""
WITH {LOCATIONS}, keys AS (SELECT DISTINCT street_address, city, state, zip_code FROM locations
  WHERE id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'))
SELECT l.id, l.state FROM locations l WHERE EXISTS (SELECT 1 FROM keys k
  WHERE k.street_address IS NOT DISTINCT FROM l.street_address AND k.city IS NOT DISTINCT FROM l.city
  AND k.state IS NOT DISTINCT FROM l.state AND k.zip_code IS NOT DISTINCT FROM l.zip_code)""")
def _(spark, sf):
    loc = locations(spark, sf)
    ids = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(
        F.col("o_custkey").alias("id"))
    keys = search.by_keys(loc, ids, ["id"])
    return search.by_keys(
        loc, keys, ["street_address", "city", "state", "zip_code"]).select("id", "state")


@query("qry_14_listings_of_properties", f"""
WITH {SNAPSHOTS} SELECT property_id, id, created_at, list_price FROM snapshots
WHERE property_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def _(spark, sf):
    ids = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(
        F.col("c_custkey").alias("property_id"))
    return search.listings_of(listing_snapshots(spark, sf), ids).select(
        "property_id", "id", "created_at", "list_price")


@query("qry_15_latest_listing", f"""
WITH {SNAPSHOTS}, r AS (SELECT *, row_number() OVER (PARTITION BY property_id
  ORDER BY created_at DESC, id DESC) AS rn FROM snapshots)
SELECT id, property_id, list_price, listing_status, created_at FROM r WHERE rn = 1""")
def _(spark, sf):
    return search.latest_listing(listing_snapshots(spark, sf))


@query("qry_16_price_history", f"""
WITH {SNAPSHOTS}, p AS (SELECT *, lag(list_price) OVER w AS old_price, row_number() OVER w AS rn
  FROM snapshots WINDOW w AS (PARTITION BY property_id ORDER BY created_at, id))
SELECT property_id, id, created_at AS date, old_price, list_price AS new_price,
  list_price - COALESCE(old_price, 0) AS change_amount,
  CAST(list_price - COALESCE(old_price, 0) AS DOUBLE) /
    CASE WHEN COALESCE(old_price, 0) = 0 THEN 1 ELSE old_price END * 100::DOUBLE AS change_percent
FROM p WHERE rn > 1 AND list_price IS DISTINCT FROM old_price""")
def _(spark, sf):
    return search.price_history(listing_snapshots(spark, sf))


@query("qry_17_with_metrics", f"""
WITH {PROPERTIES}, {METRICS} SELECT p.property_id, walk_score, cap_rate, zestimate,
  m.property_id IS NOT NULL AS has_metrics
FROM properties p LEFT JOIN metrics m ON p.property_id = m.property_id""")
def _(spark, sf):
    m = property_metrics(spark, sf).withColumn("id", F.col("property_id"))
    return search.with_metrics(located_properties(spark, sf), m).select(
        "property_id", "walk_score", "cap_rate", "zestimate", "has_metrics")


_VIEW_HAS = {
    "property_id": "property_id", "price": "price", "square_feet": "square_feet",
    "bedrooms": "bedrooms", "bathrooms": "bathrooms", "property_type": "property_type",
}
_VIEW_TYPES = {
    "listing_id": "BIGINT", "lot_size": "DOUBLE", "stories": "DOUBLE", "year_built": "DOUBLE",
    "latitude": "DOUBLE", "longitude": "DOUBLE",
}
_VIEW_SQL = ", ".join(
    c if c in _VIEW_HAS else f"CAST(NULL AS {_VIEW_TYPES.get(c, 'VARCHAR')}) AS {c}"
    for c in VIEW_COLUMNS)


@query("qry_18_properties_view", f"WITH {PROPERTIES} SELECT {_VIEW_SQL} FROM properties")
def _(spark, sf):
    full = with_all_columns(located_properties(spark, sf), "properties")
    search.properties_view(full).createOrReplaceTempView("properties_view")
    return spark.table("properties_view")


@query("src_8_table_scan", f"WITH {PROPERTIES} SELECT {_VIEW_SQL} FROM properties")
def _(spark, sf):
    path = scratch_path(spark, "src8")
    save_table(located_properties(spark, sf), path, "properties")
    return read_table(spark, path, VIEW_COLUMNS)


@query("udf_sql_functions", f"""
WITH {LOCATIONS} SELECT id, md5(lower(trim(COALESCE(street_address, '') || '|' || COALESCE(city, '')
  || '|' || COALESCE(state, '') || '|' || COALESCE(zip_code, '')))) AS hash,
  round(6371 * 2 * asin(sqrt(pow(sin(radians(40 - latitude) / 2), 2) + cos(radians(latitude))
    * cos(radians(40)) * pow(sin(radians(-74 - longitude) / 2), 2))), 6) AS km FROM locations""")
def _(spark, sf):
    sql_functions.register(spark)
    locations(spark, sf).createOrReplaceTempView("locations_for_sql")
    return spark.sql("""SELECT id, generate_property_hash(street_address, city, state, zip_code) AS hash,
        round(calculate_distance(latitude, longitude, 40D, -74D), 6) AS km FROM locations_for_sql""")


# --- table maintenance ------------------------------------------------------------------


@query("mut_1_insert_properties", f"""
WITH {LISTINGS}, stored AS (SELECT external_id, data_source FROM listings WHERE status = 'active'),
locs AS (SELECT ingest_seq AS id, street_address, city, state, zip_code FROM listings
  WHERE status = 'active'),
old AS (SELECT min(id) AS id, street_address, city, state, zip_code FROM locs GROUP BY ALL),
fresh AS (SELECT * FROM listings n WHERE NOT EXISTS (SELECT 1 FROM stored s
  WHERE s.external_id = n.external_id AND s.data_source = n.data_source))
SELECT f.ingest_seq, f.external_id, COALESCE(o.id, {_LOC_ID.replace('street_address', 'f.street_address')
  .replace('city', 'f.city').replace('state', 'f.state').replace('zip_code', 'f.zip_code')})
  AS location_id
FROM fresh f LEFT JOIN old o ON o.street_address IS NOT DISTINCT FROM f.street_address
  AND o.city IS NOT DISTINCT FROM f.city AND o.state IS NOT DISTINCT FROM f.state
  AND o.zip_code IS NOT DISTINCT FROM f.zip_code""")
def _(spark, sf):
    df = listings(spark, sf)
    stored = df.filter("status = 'active'")
    # Many stored locations share an address; the smallest id counts.
    old = stored.select(F.col("ingest_seq").alias("id"), "street_address", "city", "state", "zip_code")
    rows, _ = tables.insert_properties(df, stored, old)
    return rows.select("ingest_seq", "external_id", "location_id")


@query("mut_2_partial_update", f"""
WITH {PROPERTIES}, u AS (SELECT l_orderkey AS property_id, max(l_linenumber) AS last FROM lineitem
  WHERE l_returnflag = 'R' GROUP BY 1)
SELECT p.property_id, CASE WHEN u.property_id IS NOT NULL THEN price + 100 * last ELSE price END AS price,
  CASE WHEN u.property_id IS NOT NULL AND p.property_id % 2 = 0 THEN NULL ELSE bedrooms END
    AS bedrooms, bathrooms,
  CASE WHEN u.property_id IS NOT NULL THEN TIMESTAMP '2001-08-02' ELSE updated_at END AS updated_at
FROM properties p LEFT JOIN u ON p.property_id = u.property_id""")
def _(spark, sf):
    props, updates = _price_changes(spark, sf)
    return _update(props, updates).select("property_id", "price", "bedrooms", "bathrooms", "updated_at")


def _price_changes(spark, sf):
    props = located_properties(spark, sf)
    # One change for each returned line; the last line's change counts.
    lines = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("property_id"), "l_linenumber")
    even = F.col("property_id") % 2 == 0
    return props, props.join(lines, "property_id").select(
        "property_id", (F.col("price") + 100 * F.col("l_linenumber")).alias("price"), "l_linenumber",
        F.lit(None).cast("double").alias("bedrooms"),
        F.when(even, F.array(F.lit("price"), F.lit("bedrooms"))).otherwise(F.array(F.lit("price")))
        .alias("set_fields"))


def _update(rows, updates):
    return tables.update_rows(
        rows, updates, "property_id", orders_as_of(), ["price", "bedrooms"], "l_linenumber")


def _stored(spark, df, key="property_id"):
    path = scratch_path(spark, "versions")
    versions.create(df, path, key, buckets=16)
    return path


@query("mut_2_stored_update", ORACLE["mut_2_partial_update"])
def _(spark, sf):
    props, updates = _price_changes(spark, sf)
    path = _stored(spark, props)
    versions.change(spark, path, updates, lambda rows: _update(rows, updates))
    return versions.read(spark, path).select("property_id", "price", "bedrooms", "bathrooms", "updated_at")


@query("mut_3_delete_cascade", f"""
WITH {PROPERTIES}, {METRICS}, {SNAPSHOTS}, gone AS (SELECT o_orderkey AS property_id FROM orders
  WHERE o_orderpriority = '5-LOW')
SELECT 'properties' AS tbl, property_id FROM properties WHERE property_id NOT IN (FROM gone)
UNION ALL SELECT 'listings', property_id FROM snapshots WHERE property_id NOT IN (FROM gone)
UNION ALL SELECT 'metrics', property_id FROM metrics WHERE property_id NOT IN (FROM gone)""")
def _(spark, sf):
    gone = table(spark, sf, "orders").filter("o_orderpriority = '5-LOW'").select(
        F.col("o_orderkey").alias("property_id"))
    names = ["properties", "listings", "metrics"]
    kept = tables.delete_properties(
        gone, located_properties(spark, sf), listing_snapshots(spark, sf),
        property_metrics(spark, sf))
    parts = [t.select(F.lit(n).alias("tbl"), "property_id") for n, t in zip(names, kept)]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query("mut_3_stored_delete", ORACLE["mut_3_delete_cascade"])
def _(spark, sf):
    gone = table(spark, sf, "orders").filter("o_orderpriority = '5-LOW'").select(
        F.col("o_orderkey").alias("property_id"))
    parts = []
    for name, rows in (("properties", located_properties(spark, sf)), ("listings", listing_snapshots(spark, sf)),
                       ("metrics", property_metrics(spark, sf))):
        path = _stored(spark, rows)
        versions.change(spark, path, gone, lambda old: tables.delete_rows(old, gone))
        parts.append(versions.read(spark, path).select(F.lit(name).alias("tbl"), "property_id"))
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query("mut_4_upsert_metrics", f"""
WITH {METRICS}, d AS (SELECT o_orderkey // 2 AS property_id, o_orderkey AS seq, CASE WHEN o_orderkey % 3 <> 0
  THEN CAST(o_orderkey % 100 AS INTEGER) END AS walk_score FROM orders WHERE o_orderstatus = 'O'),
c AS (SELECT property_id, arg_max_null(walk_score, seq) AS walk_score FROM d GROUP BY property_id)
SELECT COALESCE(m.property_id, c.property_id) AS property_id,
  COALESCE(c.walk_score, m.walk_score) AS walk_score, cap_rate,
  CASE WHEN m.property_id IS NULL THEN TIMESTAMP '2001-08-02' ELSE created_at END AS created_at,
  CASE WHEN c.property_id IS NOT NULL THEN TIMESTAMP '2001-08-02' ELSE updated_at END AS updated_at
FROM metrics m FULL JOIN c ON m.property_id = c.property_id""")
def _(spark, sf):
    return _upsert(property_metrics(spark, sf).drop("zestimate"), _scores(spark, sf))


def _scores(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").filter("o_orderstatus = 'O'").select(
        F.expr("o_orderkey div 2").alias("property_id"), k.alias("seq"),
        F.when(k % 3 != 0, (k % 100).cast("int")).alias("walk_score"))


def _upsert(rows, changes):
    return tables.upsert_metrics(rows, changes, orders_as_of(), ["walk_score"], "seq")


@query("mut_4_stored_upsert", ORACLE["mut_4_upsert_metrics"])
def _(spark, sf):
    changes = _scores(spark, sf)
    path = _stored(spark, property_metrics(spark, sf).drop("zestimate"))
    versions.change(spark, path, changes, lambda rows: _upsert(rows, changes))
    return versions.read(spark, path)


@query("mut_5_append_listings", f"""
WITH {SNAPSHOTS} SELECT property_id, id, list_price, CAST(NULL AS VARCHAR) AS listing_url FROM snapshots
UNION ALL SELECT l_orderkey, -l_orderkey * 10 - l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT),
  'line/' || l_linenumber FROM lineitem""")
def _(spark, sf):
    old = listing_snapshots(spark, sf).select("property_id", "id", "list_price")
    new = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("property_id"),
        (-F.col("l_orderkey") * 10 - F.col("l_linenumber")).alias("id"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("list_price"),
        F.concat(F.lit("line/"), F.col("l_linenumber")).alias("listing_url"))
    return tables.append_rows(old, new)


@query("mut_6_denormalise_locations", f"""
WITH {PROPERTIES}, {LOCATIONS}, pt AS (SELECT *, CASE WHEN property_id % 9 = 0 THEN -1
  ELSE location_id END AS lid FROM properties)
SELECT property_id, street_address AS address, COALESCE(l.city, 'old') AS city, l.state, l.zip_code,
  CASE WHEN l.id IS NOT NULL THEN COALESCE(l.country, 'US') END AS country_code,
  l.latitude, l.longitude,
  CASE WHEN l.id IS NOT NULL THEN concat_ws(', ', street_address, l.city, l.state, l.zip_code) END
    AS location
FROM pt LEFT JOIN locations l ON pt.lid = l.id""")
def _(spark, sf):
    p = located_properties(spark, sf)
    null = F.lit(None).cast("string")
    old = p.select(
        "property_id",
        F.when(F.col("property_id") % 9 == 0, F.lit(-1)).otherwise(F.col("location_id"))
        .alias("location_id"),
        null.alias("address"), F.lit("old").alias("city"), null.alias("state"),
        null.alias("zip_code"), null.alias("country_code"),
        F.lit(None).cast("double").alias("latitude"), F.lit(None).cast("double").alias("longitude"),
        null.alias("location"))
    # Every location is stored twice, the second time with a larger zip code.
    loc = locations(spark, sf)
    again = loc.withColumn("zip_code", F.concat(F.col("zip_code"), F.lit("9")))
    return tables.denormalise_locations(old, again.unionByName(loc))


@query("mut_7_upgrade_schema", f"""
WITH {PROPERTIES} SELECT property_id, price, bedrooms, CAST(NULL AS VARCHAR) AS mls_id,
  CAST(NULL AS DOUBLE) AS latitude, property_type FROM properties""")
def _(spark, sf):
    old = located_properties(spark, sf).select(
        F.col("property_id").cast("int").alias("id"), F.col("price").cast("string").alias("price"),
        F.col("bedrooms").cast("int").alias("bedrooms"),
        F.col("property_type").cast("string").alias("property_type"))
    new = tables.upgrade_schema(tables.upgrade_schema(old))
    return new.select("property_id", "price", "bedrooms", "mls_id", "latitude", "property_type")


@query("mut_8_updated_at", f"""
WITH {PROPERTIES} SELECT property_id, CASE WHEN bedrooms = 3 THEN TIMESTAMP '2001-08-02'
  ELSE updated_at END AS updated_at FROM properties""")
def _(spark, sf):
    props = located_properties(spark, sf)
    touch = props.filter("bedrooms = 3").select("property_id", F.array(F.lit("bedrooms")).alias(
        "set_fields"), "bedrooms")
    return tables.update_rows(
        props, touch, "property_id", orders_as_of(), ["bedrooms"]).select("property_id", "updated_at")


@query("mut_9_retain_days", """
SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 14 DAYS""")
def _(spark, sf):
    return tables.retain_days(
        table(spark, sf, "events"), "ts", events_as_of(), 14).select("event_id", "ts")


@query("mut_9_clustered_retention", ORACLE["mut_9_retain_days"])
def _(spark, sf):
    stored = save_clustered(table(spark, sf, "events"), scratch_path(spark, "clustered"), "ts", "event_id")
    return tables.retain_days(stored, "ts", events_as_of(), 14).select("event_id", "ts")


# --- jobs -------------------------------------------------------------------------------


@query("job_1_new_jobs", """
SELECT sha256(CASE event_type WHEN 'view' THEN 'zillow' ELSE 'redfin' END || '|' || props || '|' ||
  CAST(user_id AS VARCHAR) || '|' || CAST(event_id AS VARCHAR)) AS job_id, 'pending' AS status,
  props AS search_criteria, TIMESTAMP '2024-01-31' AS created_at FROM events""")
def _(spark, sf):
    requests = table(spark, sf, "events").select(
        F.when(F.col("event_type") == "view", "zillow").otherwise("redfin").alias("data_source"),
        F.col("props").alias("search_criteria"), F.lit(10).alias("max_pages"),
        F.lit(1000).alias("max_results"), F.col("user_id").cast("string").alias("created_by"),
        F.col("event_id").alias("requested_at"))
    return jobs.new_jobs(requests, events_as_of()).select(
        "job_id", "status", "search_criteria", "created_at")


JOB_FOLD_SQL = f"""
WITH {JOB_EVENTS} SELECT job_id, arg_max(status, (ts, seq)) AS status,
  min(ts) FILTER (status = 'running') AS started_at,
  min(ts) FILTER (status IN ('completed', 'failed', 'cancelled')) AS completed_at,
  max(ts) AS updated_at FROM job_events GROUP BY job_id"""


@query("job_2_fold_status", JOB_FOLD_SQL)
def _(spark, sf):
    return jobs.fold_status(job_status_events(spark, sf))


def _requests(spark, sf):
    """Requests for existing jobs and for some that do not exist."""
    return table(spark, sf, "events").select(
        F.lpad((F.col("event_id") * 2).cast("string"), 12, "0").alias("job_id"),
        F.col("event_id").alias("request_id"))


_REQUESTS = """requests AS (SELECT lpad(CAST(event_id * 2 AS VARCHAR), 12, '0') AS job_id,
  event_id AS request_id FROM events)"""


def _decision(ok: str, new: str) -> str:
    return f"""
WITH {JOBS}, {_REQUESTS} SELECT r.job_id, request_id, status AS job_status,
  COALESCE({ok}, FALSE) AS accepted, CASE WHEN COALESCE({ok}, FALSE) THEN '{new}' ELSE status END
  AS new_status FROM requests r LEFT JOIN jobs j ON r.job_id = j.job_id"""


@query("job_3_cancel", _decision("status NOT IN ('completed', 'failed', 'cancelled')", "cancelled"))
def _(spark, sf):
    return jobs.cancel(_requests(spark, sf), scrape_jobs(spark, sf))


@query("job_4_retry", _decision("status = 'failed'", "retrying"))
def _(spark, sf):
    return jobs.retry(_requests(spark, sf), scrape_jobs(spark, sf))


@query("job_5_recent", f"WITH {JOBS} SELECT * FROM jobs ORDER BY created_at DESC, job_id DESC LIMIT 50")
def _(spark, sf):
    return jobs.recent(scrape_jobs(spark, sf), 50)


@query("job_6_active", f"WITH {JOBS} SELECT * FROM jobs WHERE status IN ('pending', 'running', 'retrying')")
def _(spark, sf):
    return jobs.active(scrape_jobs(spark, sf))


@query("job_7_failed", f"""
WITH {JOBS} SELECT * FROM jobs WHERE status = 'failed'
AND created_at >= TIMESTAMP '2024-01-31' - INTERVAL 24 HOURS""")
def _(spark, sf):
    return jobs.failed(scrape_jobs(spark, sf), events_as_of())


@query("job_8_list", f"""
WITH {JOBS}, f AS (SELECT * FROM jobs WHERE status = 'failed' AND data_source = 'zillow')
SELECT *, (SELECT count(*) FROM f) AS total_count FROM f
ORDER BY created_at DESC, job_id DESC LIMIT 20 OFFSET 20""")
def _(spark, sf):
    return jobs.job_list(
        scrape_jobs(spark, sf), status="failed", data_source="zillow", page=2, page_size=20)


@query("job_8_list_newest_1000", f"""
WITH {JOBS}, n AS (SELECT * FROM jobs ORDER BY created_at DESC, job_id DESC LIMIT 1000),
f AS (SELECT * FROM n WHERE status = 'failed')
SELECT *, (SELECT count(*) FROM f) AS total_count FROM f ORDER BY created_at DESC, job_id DESC LIMIT 20""")
def _(spark, sf):
    return jobs.job_list(scrape_jobs(spark, sf), status="failed", page_size=20, window=1000)


_STATS = ", ".join(
    [f"count(*) FILTER (status = '{s}') AS status_{s}" for s in JOB_STATUSES]
    + [f"count(*) FILTER (data_source = '{s}') AS source_{s}" for s in DATA_SOURCES])


@query("job_9_statistics", f"""
WITH {JOBS} SELECT count(*) AS total_jobs, {_STATS},
  round(COALESCE(CAST(count(*) FILTER (status = 'completed') AS DOUBLE)
    / NULLIF(count(*) FILTER (status IN ('completed', 'failed')), 0), 0) * 100, 2) AS success_rate,
  CAST(COALESCE(sum(properties_saved), 0) AS BIGINT) AS total_properties_scraped
FROM jobs WHERE created_at >= TIMESTAMP '2024-01-31' - INTERVAL 168 HOURS""")
def _(spark, sf):
    return jobs.statistics(scrape_jobs(spark, sf), events_as_of(), 168)


@query("job_10_results_of_job", f"""
WITH {RESULTS} SELECT id, job_id, raw_data FROM results WHERE job_id = '7' ORDER BY id LIMIT 1000""")
def _(spark, sf):
    return jobs.results_of(scrape_results(spark, sf), "7", 1000).select("id", "job_id", "raw_data")


@query("job_11_unprocessed", f"""
WITH {RESULTS} SELECT id, job_id FROM results WHERE NOT is_processed ORDER BY id LIMIT 100""")
def _(spark, sf):
    return jobs.unprocessed(scrape_results(spark, sf), 100).select("id", "job_id")


@query("job_12_mark_processed", f"""
WITH {RESULTS}, done AS (SELECT event_id // 3 AS id, max(CASE WHEN event_type = 'view' THEN 'ok' END) AS data
  FROM events WHERE event_type IN ('view', 'click') GROUP BY 1)
SELECT r.id, CASE WHEN d.id IS NOT NULL THEN TRUE ELSE is_processed END AS is_processed,
  data AS processed_data,
  CASE WHEN d.id IS NOT NULL THEN TIMESTAMP '2024-01-31' END AS processed_at,
  d.id IS NOT NULL AS is_saved_to_db
FROM results r LEFT JOIN done d ON r.id = d.id""")
def _(spark, sf):
    done = table(spark, sf, "events").filter("event_type IN ('view', 'click')").select(
        F.expr("event_id div 3").alias("id"),
        F.when(F.col("event_type") == "view", "ok").alias("processed_data"))
    marked = jobs.mark_processed(scrape_results(spark, sf), done, events_as_of())
    return jobs.mark_saved(marked, done).select(
        "id", "is_processed", "processed_data", "processed_at", "is_saved_to_db")


@query("job_13_append_results", f"""
WITH {RESULTS} SELECT id, job_id, raw_data FROM results
UNION ALL SELECT -1 - doc_id, 'docs', lang FROM documents""")
def _(spark, sf):
    new = table(spark, sf, "documents").select(
        (-1 - F.col("doc_id")).alias("id"), F.lit("docs").alias("job_id"),
        F.col("lang").alias("raw_data"))
    return tables.append_rows(scrape_results(spark, sf), new).select("id", "job_id", "raw_data")


@query("job_14_refresh_queue", f"""
WITH {PROPERTIES} SELECT property_id, last_scraped FROM properties
WHERE last_scraped < TIMESTAMP '2001-08-02' - INTERVAL 24 HOURS
ORDER BY last_scraped, property_id LIMIT 100""")
def _(spark, sf):
    return search.stale(located_properties(spark, sf), orders_as_of(), limit=100).select(
        "property_id", "last_scraped")


@query("job_15_by_id", f"""
WITH {JOBS} SELECT * FROM jobs WHERE job_id IN (SELECT lpad(CAST(o_custkey AS VARCHAR), 12, '0')
  FROM orders)""")
def _(spark, sf):
    ids = table(spark, sf, "orders").select(
        F.lpad(F.col("o_custkey").cast("string"), 12, "0").alias("job_id"))
    return search.by_keys(scrape_jobs(spark, sf), ids, ["job_id"])
