"""Source, sink and page-extraction queries.

The landed pages and responses are written by Spark from the listings, one card or
entry per listing, and read back by the extractors; the SQL twin states what must
come out straight from the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from homeledger.catalog.base import LISTINGS, query, s_group, s_num, s_price, s_strip
from homeledger.functions import address, listing, money
from homeledger.functions.text import first_decimal, keep_number
from homeledger.operators.clean import with_all_columns
from homeledger.plans.fixtures import listings, table
from homeledger.schema import schema_of
from homeledger.session import scratch_path
from homeledger.sinks import files as sinks
from homeledger.sources import files, responses, sites
from homeledger.sources.html import Pick, select_fields
from homeledger.sources.registry import cap_per_search

CSV_COLUMNS = [
    "ingest_seq", "external_id", "data_source", "street_address", "city", "state", "zip_code",
    "price", "rent_estimate", "bedrooms", "property_type", "created_at",
]
_CSV_SQL = f"WITH {LISTINGS} SELECT {', '.join(CSV_COLUMNS)} FROM listings"


def _flat(spark, sf) -> DataFrame:
    return listings(spark, sf).select(*CSV_COLUMNS)


def _bundle(spark, sf, per_page: int, item: Column, wrap, name: str) -> DataFrame:
    """Listings into pages of ``per_page`` items, in key order.

    The thin listings are dealt by page before their items are written, so that no item and no page is shuffled.
    """
    k = F.col("ingest_seq")
    items = F.transform(F.array_sort(F.collect_list(F.struct(k, item.alias("x")))), lambda s: s["x"])
    return listings(spark, sf, per_page).groupBy("page_id").agg(wrap(items).alias(name))


# --- files ------------------------------------------------------------------------------


@query("src_1_csv", _CSV_SQL)
def _(spark, sf):
    df = _flat(spark, sf)
    path = sinks.save_csv(df, scratch_path(spark, "csv"), "listings")
    return files.read_file(spark, path, df.schema)


@query("src_2_json", _CSV_SQL)
def _(spark, sf):
    path = scratch_path(spark, "json") + ".json"
    body = _bundle(spark, sf, 500, F.to_json(F.struct(*CSV_COLUMNS)),
                   lambda x: F.concat(F.lit("["), F.array_join(x, ","), F.lit("]")), "value")
    body.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return files.read_file(spark, path, _flat(spark, sf).schema)


@query("snk_1_save_csv", _CSV_SQL)
def _(spark, sf):
    df = _flat(spark, sf)
    return files.read_csv(spark, sinks.save_csv(df, scratch_path(spark, "save")), df.schema)


@query("snk_2_append_csv", f"""
WITH {LISTINGS}, old AS (SELECT * FROM listings WHERE status <> 'sold'),
new AS (SELECT * FROM listings WHERE status <> 'active')
SELECT {', '.join(CSV_COLUMNS)} FROM old UNION SELECT {', '.join(CSV_COLUMNS)} FROM new""")
def _(spark, sf):
    df = listings(spark, sf)
    path = scratch_path(spark, "append")
    sinks.append_csv(df.filter("status <> 'sold'").select(*CSV_COLUMNS), path)
    more = df.filter("status <> 'active'").select(*CSV_COLUMNS)
    sinks.append_csv(more, path)
    return files.read_csv(spark, path, more.schema)


@query("snk_3_save_json", _CSV_SQL)
def _(spark, sf):
    df = _flat(spark, sf)
    return files.read_json(spark, sinks.save_json(df, scratch_path(spark, "save")), df.schema)


@query("snk_4_save_job_csv", f"""
WITH {LISTINGS} SELECT data_source AS job_id, ingest_seq, price, count(*) OVER () AS saved FROM listings""")
def _(spark, sf):
    path = scratch_path(spark, "jobs")
    df = listings(spark, sf).select(F.col("data_source").alias("job_id"), "ingest_seq", "price")
    saved = sinks.save_job_csv(df, path)
    back = spark.read.schema("ingest_seq bigint, price double, job_id string").csv(path, header=True)
    return back.withColumn("saved", F.lit(saved).cast("bigint"))


@query("snk_5_typed_tables", f"""
WITH {LISTINGS} SELECT property_id, CAST(floor(price) AS BIGINT) AS price, bedrooms,
  CAST(year_built AS DOUBLE) AS year_built, city, CAST(NULL AS VARCHAR) AS mls_id FROM listings""")
def _(spark, sf):
    df = listings(spark, sf).withColumn("price", F.floor("price"))
    stored = sinks.save_table(df.drop("created_at"), scratch_path(spark, "tables"), "properties")
    return stored.select("property_id", "price", "bedrooms", "year_built", "city", "mls_id")


@query("snk_7_export", _CSV_SQL)
def _(spark, sf):
    df = _flat(spark, sf)
    path = sinks.export(df, scratch_path(spark, "export"), "csv", "utf-8")
    return files.read_csv(spark, path, df.schema)


# --- JSON responses -----------------------------------------------------------------------


def _no_data(spark, sf) -> DataFrame:
    """Responses that hold no records: an error body and broken JSON."""
    n = table(spark, sf, "nation")
    bad = F.array(F.concat(F.lit('{"error": "'), F.col("n_name"), F.lit('"}')), F.lit('{"broken": '))
    return n.select((-1 - F.col("n_nationkey")).cast("bigint").alias("page_id"),
                    F.explode(bad).alias("body"))


@query("src_4_api_records", f"""
WITH {LISTINGS} SELECT ingest_seq // 100 AS page_id, ingest_seq, external_id, city, price FROM listings""")
def _(spark, sf):
    fields = ["ingest_seq", "external_id", "city", "price"]
    pages = _bundle(spark, sf, 100, F.to_json(F.struct(*fields)),
                    lambda x: F.concat(F.lit('{"properties": ['), F.array_join(x, ","), F.lit("]}")), "body")
    return responses.api_records(pages.unionByName(_no_data(spark, sf))).select("page_id", *fields)


def _home_json() -> Column:
    k = F.col("ingest_seq")
    return F.to_json(F.struct(
        k.alias("property_id"), F.when(k % 9 != 0, (k % 9).cast("int")).alias("property_type"),
        F.col("bedrooms").cast("int").alias("beds"), F.col("bathrooms").alias("baths"),
        F.col("square_feet").cast("bigint").alias("sqft"), "year_built",
        F.floor("price").alias("price"), F.col("street_address").alias("street_line"), "city",
        F.col("state").alias("state_or_province"), F.col("zip_code").alias("postal_code"),
        F.concat(F.lit("/home/"), k).alias("url"), (k % 2 == 0).alias("garage"),
        (k % 3 == 0).alias("pool"), (k % 5 == 0).alias("fireplace"),
        F.when(k % 4 == 0, (k % 400).cast("double")).alias("hoa_fee"),
        (k % 3).cast("int").alias("photo_count"),
        F.when(k % 2 == 0, F.concat(F.lit("http://img/"), k)).alias("photo_url"),
    ))


def _home_responses(spark, sf) -> DataFrame:
    pages = _bundle(spark, sf, 350, _home_json(),
                    lambda x: F.concat(F.lit('{"homes": ['), F.array_join(x, ","), F.lit("]}")), "body")
    return pages.unionByName(_no_data(spark, sf))


@query("src_5_homes", f"""
WITH {LISTINGS} SELECT ingest_seq // 350 AS page_id, CAST(row_number() OVER (
  PARTITION BY ingest_seq // 350 ORDER BY ingest_seq) - 1 AS INTEGER) AS pos, ingest_seq AS property_id
FROM listings""")
def _(spark, sf):
    h = responses.homes(_home_responses(spark, sf))
    return h.select("page_id", "pos", F.col("home.property_id").alias("property_id"))


_TYPE_CODE = """CASE ingest_seq % 9 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 4
  WHEN 4 THEN 5 WHEN 5 THEN 6 ELSE 8 END"""


@query("ext_5_home_records", f"""
WITH {LISTINGS} SELECT external_id, CAST({_TYPE_CODE} AS INTEGER) AS property_type, bedrooms,
  bathrooms, square_feet, CAST(year_built AS DOUBLE) AS year_built, floor(price) AS price,
  street_address, city, COALESCE(state, '') AS state, COALESCE(zip_code, '') AS zip_code,
  'https://www.redfin.com/home/' || external_id AS listing_url,
  CASE WHEN ingest_seq % 2 = 0 THEN 1 END AS garage_spaces,
  CASE WHEN ingest_seq % 3 = 0 THEN TRUE END AS pool,
  concat_ws(',', CASE WHEN ingest_seq % 5 = 0 THEN 'fireplace=true' END,
    CASE WHEN ingest_seq % 2 = 0 THEN 'garage=true' END,
    CASE WHEN ingest_seq % 4 = 0 THEN 'hoa_fee=' || CAST(ingest_seq % 400 AS DOUBLE) END,
    CASE WHEN ingest_seq % 3 = 0 THEN 'pool=true' END) AS features,
  CASE WHEN ingest_seq % 3 > 0 AND ingest_seq % 2 = 0 THEN 'http://img/' || external_id ELSE '' END
    AS images
FROM listings""")
def _(spark, sf):
    r = responses.home_records(responses.homes(_home_responses(spark, sf)))
    return r.select(
        "external_id", "property_type", "bedrooms", "bathrooms", "square_feet", "year_built",
        "price", "street_address", "city", "state", "zip_code", "listing_url", "garage_spaces",
        "pool", _flags(F.col("features")).alias("features"), F.array_join("images", ",").alias("images"))


def _flags(c: Column) -> Column:
    return F.array_join(F.transform(
        F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")


@query("ext_6_type_name", """
SELECT p_partkey, CASE p_size WHEN 1 THEN 'house' WHEN 2 THEN 'condo' WHEN 3 THEN 'townhouse'
  WHEN 4 THEN 'multi_family' WHEN 5 THEN 'land' ELSE 'other' END AS type_name FROM part""")
def _(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", listing.type_name_from_code(F.col("p_size")).alias("type_name"))


@query("src_7_plugged_sources", f"""
WITH {LISTINGS} SELECT 'redfin' AS data_source, external_id, floor(price) AS price FROM listings
UNION ALL SELECT 'zillow', external_id, floor(price) FROM listings
UNION ALL SELECT 'county', CAST(s_suppkey AS VARCHAR), s_acctbal FROM supplier""")
def _(spark, sf):
    s = sites.stock_sources()
    s.register("county", lambda df: df.select(
        F.col("s_suppkey").cast("string").alias("external_id"), F.col("s_acctbal").alias("price")))
    return s.extract({
        "redfin": _home_responses(spark, sf), "zillow": _zillow_search(spark, sf),
        "county": table(spark, sf, "supplier"),
    }).select("data_source", "external_id", "price")


@query("src_9_cap_per_search", f"""
WITH {LISTINGS}, r AS (SELECT data_source AS job_id, ingest_seq // 350 AS page, ingest_seq AS pos,
  row_number() OVER (PARTITION BY data_source ORDER BY ingest_seq // 350, ingest_seq) AS rn FROM listings)
SELECT job_id, page, pos FROM r WHERE rn <= 1000""")
def _(spark, sf):
    k = F.col("ingest_seq")
    return cap_per_search(listings(spark, sf).select(
        F.col("data_source").alias("job_id"), F.floor(k / 350).alias("page"), k.alias("pos")), 1000)


# --- search pages ---------------------------------------------------------------------------

_TYPE_TEXT = ["Apartment for rent", "Condo", "House", "Townhome", "Duplex", "Land", "Castle", "Townhouse"]


def _div(cls: str, text: Column) -> Column:
    """An element, or nothing where the text is null."""
    tag = F.concat(F.lit(f'<div class="{cls}">'), text, F.lit("</div>"))
    return F.coalesce(tag, F.lit(""))


def _type_text() -> Column:
    k = F.col("ingest_seq")
    c = F.when(k % 10 == 9, F.lit(None))
    for i, t in enumerate(_TYPE_TEXT):
        c = c.when(k % 10 == i, t)
    return c


def _full_address() -> Column:
    state = F.upper(F.trim(F.coalesce("state", F.lit("XX"))))
    return F.concat("street_address", F.lit(", "), "city", F.lit(", "), F.concat_ws(" ", state, "zip_code"))


def _sqft_text(unit: str) -> Column:
    return F.concat(F.format_number("square_feet", 0), F.lit(unit))


def _zillow_search(spark, sf) -> DataFrame:
    k = F.col("ingest_seq")
    rooms = F.concat(
        F.lit("<ul><li>"), F.col("bedrooms").cast("int"), F.lit(" bds</li><li>"), "bathrooms",
        F.lit(" ba</li>"), F.coalesce(F.concat(F.lit("<li>"), _sqft_text(" sqft"), F.lit("</li>")), F.lit("")),
        F.lit("</ul>"))
    status = F.when(F.col("status") == "pending", "Pending offer").when(
        F.col("status") == "sold", "Recently Sold").when(k % 2 == 0, "For sale")
    source = F.when(k % 2 == 0, "src").otherwise("data-src")
    card = F.concat(
        F.lit('<li><article class="list-card"><div class="list-card-info x"><a href="/homedetails/h/'), k,
        F.lit('_zpid/">see</a>'),
        _div("list-card-price", F.concat(F.lit("$"), F.format_number(F.floor("price"), 0), F.lit("+"))),
        _div("list-card-addr", _full_address()), _div("list-card-details", rooms),
        _div("list-card-type", _type_text()), _div("list-card-status", status),
        F.lit('<div class="list-card-img"><img '), source, F.lit('="http://img/'), k,
        F.lit('.jpg"></div></div></article>'))
    # Every page also carries a card without an id, which must be left out.
    stray = '<li><div class="list-card-info"><a href="/about">x</a><div class="list-card-price">$1</div></div>'
    return _bundle(
        spark, sf, 40, card,
        lambda x: F.concat(F.lit("<html><body><ul>"), F.array_join(x, ""), F.lit(stray + "</ul></body></html>")),
        "html")


_FULL_ADDRESS = """street_address || ', ' || city || ', ' || concat_ws(' ',
  upper(trim(COALESCE(state, 'XX'))), zip_code)"""
_ZTYPE = """CAST(CASE ingest_seq % 10 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 1 WHEN 3 THEN 4
  WHEN 4 THEN 5 WHEN 5 THEN 6 WHEN 6 THEN 8 WHEN 7 THEN 1 {rest} END AS INTEGER)"""


@query("ext_11_zillow_cards", f"""
WITH {LISTINGS} SELECT ingest_seq // 40 AS page_id, CAST(row_number() OVER (PARTITION BY ingest_seq // 40
    ORDER BY ingest_seq) - 1 AS INTEGER) AS pos, external_id,
  'https://www.zillow.com/homedetails/h/' || external_id || '_zpid/' AS listing_url,
  floor(price) AS price, {_FULL_ADDRESS} AS street_address, city,
  upper(trim(COALESCE(state, 'XX'))) AS state, zip_code, CAST(bedrooms AS INTEGER) AS bedrooms,
  bathrooms, CAST(square_feet AS BIGINT) AS square_feet,
  {_ZTYPE.format(rest='WHEN 9 THEN 1 ELSE 1')} AS property_type,
  CASE status WHEN 'pending' THEN 'pending' WHEN 'sold' THEN 'sold' ELSE 'active' END AS listing_status,
  'http://img/' || external_id || '.jpg' AS images
FROM listings""")
def _(spark, sf):
    return sites.zillow_cards(_zillow_search(spark, sf)).drop("data_source").withColumn(
        "images", F.array_join("images", ","))


@query("src_6_search_cards", f"""
WITH {LISTINGS}, p AS (SELECT ingest_seq // 40 AS page_id, count(*) + 1 AS cards FROM listings GROUP BY 1)
SELECT page_id, 'zillow' AS site, cards FROM p
UNION ALL SELECT page_id, 'apartments_com', cards - 1 FROM p""")
def _(spark, sf):
    link = {"href": Pick("a", ("href",))}
    z = select_fields(_zillow_search(spark, sf), link, sites.ZILLOW_CARDS)
    a = select_fields(_apartments_search(spark, sf), link, sites.APARTMENTS_CARDS)
    count = F.count("*").alias("cards")
    return z.groupBy("page_id", F.lit("zillow").alias("site")).agg(count).unionAll(
        a.groupBy("page_id", F.lit("apartments_com").alias("site")).agg(count))


_AMENITIES = "Heated POOL · Fitness room · covered parking"


def _apartments_search(spark, sf) -> DataFrame:
    k = F.col("ingest_seq")
    n = F.floor("price")
    price = F.when(k % 3 == 0, F.concat(F.lit("$"), F.format_number(n, 0), F.lit(" - $"),
                                        F.format_number(n + 1001, 0))).when(
        k % 3 == 1, F.concat(F.lit("$"), F.format_number(n, 0), F.lit("/mo"))).otherwise("Call for Rent")
    beds = F.when(k % 6 == 0, "Studio").otherwise(
        F.concat(F.col("bedrooms").cast("int"), F.lit(" Bed")))
    rooms = F.concat(beds, F.lit(", "), "bathrooms", F.lit(" Bath"))
    amenities = F.when(k % 4 == 0, _AMENITIES).when(k % 4 == 1, "Pet friendly").when(k % 4 == 2, "none")
    available = F.when(k % 5 == 0, "Available Now").when(k % 5 == 1, "Jan 1")
    # One page in two uses the fallback markup, where the card is known by its id attribute.
    page = F.floor(k / 40)
    own = F.when(page % 2 == 1, F.concat(F.lit('<section data-listingid="L'), k, F.lit('">'))).otherwise(
        '<section class="placard big">')
    card = F.concat(
        own, F.lit('<a class="property-link" href="https://www.apartments.com/p/'), k, F.lit('/">x</a>'),
        _div("property-title", F.concat(F.lit("  Home &amp; "), "city")),
        _div("property-address", _full_address()), _div("rent-range", price), _div("bed-bath", rooms),
        _div("sqft", _sqft_text(" Sq Ft")), _div("availability", available), _div("amenities", amenities),
        _div("rating", F.concat(F.lit("★ "), (k % 50) / 10.0)), F.lit("</section>"))
    return _bundle(
        spark, sf, 40, card,
        lambda x: F.concat(F.lit("<body><main>"), F.array_join(x, "\n"), F.lit("</main></body>")), "html")


@query("ext_21_apartments_cards", f"""
WITH {LISTINGS} SELECT
  CASE WHEN (ingest_seq // 40) % 2 = 1 THEN 'L' ELSE '' END || external_id AS external_id,
  'https://www.apartments.com/p/' || external_id || '/' AS listing_url,
  'Home & ' || city AS property_name, city, zip_code,
  CASE ingest_seq % 3 WHEN 0 THEN (floor(price) + floor(price) + 1001) / 2 WHEN 1 THEN floor(price) END
    AS rent_estimate,
  CASE WHEN ingest_seq % 6 = 0 THEN 0 ELSE CAST(bedrooms AS INTEGER) END AS bedrooms, bathrooms,
  CAST(square_feet AS BIGINT) AS square_feet, CASE WHEN ingest_seq % 5 = 0 THEN TRUE END AS available_now,
  CASE ingest_seq % 4 WHEN 0 THEN 'gym=true,parking=true,pool=true' WHEN 1 THEN 'pet_friendly=true'
    WHEN 2 THEN '' END AS features,
  CASE WHEN ingest_seq % 4 = 0 THEN TRUE END AS pool,
  CAST(ingest_seq % 50 AS DOUBLE) / 10 AS rating
FROM listings""")
def _(spark, sf):
    return sites.apartments_cards(_apartments_search(spark, sf)).select(
        "external_id", "listing_url", "property_name", "city", "zip_code", "rent_estimate",
        "bedrooms", "bathrooms", "square_feet", "available_now",
        _flags(F.col("features")).alias("features"), "pool", "rating")


@query("ext_28_identified", f"""
WITH {LISTINGS} SELECT ingest_seq // 40 AS page_id, count(*) AS cards FROM listings GROUP BY 1""")
def _(spark, sf):
    cards = select_fields(_zillow_search(spark, sf), sites.ZILLOW_CARD, sites.ZILLOW_CARDS)
    named = cards.withColumn("external_id", listing.zpid(F.col("href")))
    return sites.identified(named).groupBy("page_id").agg(F.count("*").alias("cards"))


# --- detail pages -----------------------------------------------------------------------------


def _ld(obj: Column) -> Column:
    return F.concat(F.lit('<script type="application/ld+json">'), obj, F.lit("</script>"))


def _product(price: Column) -> Column:
    return F.to_json(F.struct(
        F.lit("Product").alias("@type"), F.concat(F.lit("ld "), "city").alias("description"),
        F.struct(price.alias("price")).alias("offers")))


def _redfin_detail(spark, sf) -> DataFrame:
    k = F.col("ingest_seq")
    price = F.concat(F.lit("$"), F.format_number(F.floor("price"), 0))
    other = F.lit('{"@type": "Place", "description": "no"}')
    scripts = (
        F.when(k % 4 == 0, F.concat(_ld(other), _ld(F.lit("{broken")), _ld(_product(price))))
        .when(k % 4 == 1, _ld(F.concat(F.lit("["), _product(price), F.lit("]"))))
        .when(k % 4 == 2, _ld(other)).otherwise("")
    )
    html = F.concat(
        F.lit("<html><head>"), scripts, F.lit('</head><body><div class="sale-price"><span class="price">'),
        price, F.lit("</span></div>"),
        F.lit('<p class="beds"><b class="value">'), F.col("bedrooms").cast("int"), F.lit("</b> beds</p>"),
        F.lit('<p class="baths"><b class="value">'), "bathrooms", F.lit("</b></p>"),
        F.coalesce(F.concat(F.lit('<p class="sqft"><b class="value">'), _sqft_text(" sq"), F.lit("</b></p>")), F.lit("")),
        F.lit('<div class="remarks">A <i>fine</i> home</div><h1 class="street-address">'), "street_address",
        F.lit("</h1></body></html>"))
    return listings(spark, sf).select(
        k.alias("page_id"), F.concat(F.lit("https://www.redfin.com/home/"), k).alias("url"), html.alias("html"))


@query("ext_7_json_ld_product", f"""
WITH {LISTINGS} SELECT ingest_seq AS page_id, ingest_seq % 4 = 0 AS has_ld,
  CASE WHEN ingest_seq % 4 = 0 THEN 'ld ' || city END AS ld_description,
  CASE WHEN ingest_seq % 4 = 0 THEN floor(price) END AS ld_price FROM listings""")
def _(spark, sf):
    return responses.with_first_product(_redfin_detail(spark, sf)).select(
        "page_id", "has_ld", "ld_description", "ld_price")


@query("ext_8_redfin_detail_fields", f"""
WITH {LISTINGS} SELECT ingest_seq AS page_id, floor(price) AS price, CAST(bedrooms AS BIGINT) AS bedrooms,
  CAST(floor(bathrooms) AS BIGINT) AS bathrooms, CAST(square_feet AS BIGINT) AS square_feet,
  'Afinehome' AS description, street_address FROM listings""")
def _(spark, sf):
    return sites.redfin_detail_fields(_redfin_detail(spark, sf)).drop("url")


@query("ext_10_redfin_details", f"""
WITH {LISTINGS}, l AS (SELECT *, ingest_seq % 4 = 0 AS ld FROM listings)
SELECT ingest_seq AS page_id, 'redfin' AS data_source,
  CASE WHEN NOT ld THEN 'https://www.redfin.com/home/' || external_id END AS listing_url,
  floor(price) AS price, CASE WHEN ld THEN 'ld ' || city ELSE 'Afinehome' END AS description,
  CASE WHEN NOT ld THEN CAST(bedrooms AS BIGINT) END AS bedrooms,
  CASE WHEN NOT ld THEN CAST(floor(bathrooms) AS BIGINT) END AS bathrooms,
  CASE WHEN NOT ld THEN CAST(square_feet AS BIGINT) END AS square_feet,
  CASE WHEN NOT ld THEN street_address END AS street_address FROM l""")
def _(spark, sf):
    return sites.redfin_details(_redfin_detail(spark, sf))


def _zillow_detail(spark, sf) -> DataFrame:
    k = F.col("ingest_seq")
    price = F.floor("price")
    scripts = (
        F.when(k % 4 == 0, F.concat(_ld(F.lit("{broken")), _ld(_product(price))))
        .when(k % 4 == 1, _ld(F.concat(F.lit("["), _product(price), F.lit(', {"@type": "Place"}]'))))
        .when(k % 4 == 2, F.concat(_ld(F.lit('{"@type": "Place"}')), _ld(_product(price)))).otherwise("")
    )
    summary = F.concat(F.col("bedrooms").cast("int"), F.lit(" bd <span>"), "bathrooms", F.lit(" ba</span> "),
                       F.coalesce(_sqft_text(" sqft"), F.lit("")))
    html = F.concat(
        F.lit("<html><head>"), scripts, F.lit("</head><body>"),
        _div("notranslate", F.concat(F.lit("$"), F.format_number(price + 7, 0))),
        F.lit('<h1 class="ds-address-container">'), "street_address", F.lit("</h1>"),
        _div("ds-bed-bath-living-area", summary), _div("ds-property-type", _type_text()),
        _div("ds-year-built", F.concat(F.lit("Built in "), "year_built")),
        _div("ds-lot-size", F.concat((k % 90) / 10.0, F.lit(" acres"))),
        _div("ds-overview-section", F.concat(F.lit("page "), "city")),
        _div("zestimate", F.concat(F.lit("$"), F.format_number(price, 0), F.lit(" per estimate"))),
        F.lit("</body></html>"))
    return listings(spark, sf).select(
        k.alias("page_id"),
        F.concat(F.lit("https://www.zillow.com/homedetails/h/"), k, F.lit("_zpid/")).alias("url"),
        html.alias("html"))


@query("ext_19_json_ld_first", f"""
WITH {LISTINGS} SELECT ingest_seq AS page_id, ingest_seq % 4 IN (0, 1) AS has_ld,
  CASE WHEN ingest_seq % 4 IN (0, 1) THEN 'ld ' || city END AS ld_description,
  CASE WHEN ingest_seq % 4 IN (0, 1) THEN floor(price) END AS ld_price FROM listings""")
def _(spark, sf):
    return responses.with_first_parsed(_zillow_detail(spark, sf)).select(
        "page_id", "has_ld", "ld_description", "ld_price")


_DETAIL_SQL = f"""
WITH {LISTINGS}, l AS (SELECT *, ingest_seq % 4 IN (0, 1) AS ld FROM listings)
SELECT ingest_seq AS page_id, 'zillow' AS data_source, external_id,
  'https://www.zillow.com/homedetails/h/' || external_id || '_zpid/' AS listing_url,
  CASE WHEN ld THEN floor(price) ELSE floor(price) + 7 END AS price, street_address,
  CAST(bedrooms AS INTEGER) AS bedrooms, bathrooms, CAST(square_feet AS BIGINT) AS square_feet,
  {_ZTYPE.format(rest='WHEN 8 THEN NULL')} AS property_type, year_built,
  CAST(ingest_seq % 90 AS DOUBLE) / 10 AS lot_size,
  CASE WHEN ld THEN 'ld ' ELSE 'page ' END || city AS description, floor(price) AS zestimate FROM l"""


@query("ext_18_zillow_details", _DETAIL_SQL)
def _(spark, sf):
    return sites.zillow_details(_zillow_detail(spark, sf))


@query("ext_20_zillow_detail_assembly", f"SELECT page_id, price, description FROM ({_DETAIL_SQL})")
def _(spark, sf):
    return sites.zillow_details(_zillow_detail(spark, sf)).select("page_id", "price", "description")


def _apartments_detail(spark, sf) -> DataFrame:
    k = F.col("ingest_seq")
    rooms = F.concat(
        F.when(k % 6 == 0, "Studio").otherwise(F.concat(F.col("bedrooms").cast("int"), F.lit(" bd"))),
        F.lit(" / "), "bathrooms", F.lit(" ba"))
    unit = F.concat(
        F.lit('<div class="unit-card">'),
        _div("unit-price", F.concat(F.lit("$"), F.format_number("rent_estimate", 0), F.lit(" per month"))),
        _div("unit-bed-bath", rooms), _div("unit-sqft", _sqft_text(" sq ft")),
        F.lit('<div class="property-photo"><img src="http://img/'), k % 3, F.lit('"></div></div>'))
    head = '<h1 class="propertyName"> The Place </h1><div class="propertyAddress">1 Main St</div>'
    tail = (
        '<ul><li class="amenity">Laundry</li><li class="amenity-item">A/C units</li>'
        '<li class="feature-item">Dishwasher</li></ul><span class="phone-number">555-0100</span>'
        '<b class="rating-value">4.5 of 5</b><p class="description">Nice</p></body>')
    pages = _bundle(spark, sf, 8, unit,
                    lambda x: F.concat(F.lit("<body>" + head), F.array_join(x, ""), F.lit(tail)), "html")
    return pages.withColumn("url", F.concat(F.lit("https://www.apartments.com/p/"), "page_id"))


_UNITS = f"""{LISTINGS}, u AS (SELECT ingest_seq // 8 AS page_id, rent_estimate AS rent,
  CASE WHEN ingest_seq % 6 = 0 THEN 0 ELSE CAST(bedrooms AS INTEGER) END AS beds, bathrooms AS baths,
  CAST(square_feet AS BIGINT) AS sqft FROM listings),
bm AS (SELECT page_id, arg_min(beds, (-n, beds)) AS beds FROM (SELECT page_id, beds, count(*) AS n FROM u
  GROUP BY ALL) GROUP BY page_id),
am AS (SELECT page_id, arg_min(baths, (-n, baths)) AS baths FROM (SELECT page_id, baths, count(*) AS n FROM u
  GROUP BY ALL) GROUP BY page_id)"""


@query("ext_26_unit_summary", f"""
WITH {_UNITS}
SELECT u.page_id, avg(rent) AS rent_estimate, min(rent) AS min_rent, max(rent) AS max_rent,
  min(u.beds) AS min_bedrooms, max(u.beds) AS max_bedrooms, any_value(bm.beds) AS bedrooms,
  min(u.baths) AS min_bathrooms, max(u.baths) AS max_bathrooms, any_value(am.baths) AS bathrooms,
  min(sqft) AS min_square_feet, max(sqft) AS max_square_feet,
  CAST(floor(avg(sqft)) AS BIGINT) AS square_feet
FROM u JOIN bm ON bm.page_id = u.page_id JOIN am ON am.page_id = u.page_id GROUP BY u.page_id""")
def _(spark, sf):
    return sites.apartments_details(_apartments_detail(spark, sf)).select(
        "page_id", "rent_estimate", "min_rent", "max_rent", "min_bedrooms", "max_bedrooms", "bedrooms",
        "min_bathrooms", "max_bathrooms", "bathrooms", "min_square_feet", "max_square_feet", "square_feet")


@query("ext_27_apartments_details", f"""
WITH {LISTINGS}, i AS (SELECT ingest_seq // 8 AS page_id, 'http://img/' || (ingest_seq % 3) AS img,
  min(ingest_seq) AS first FROM listings GROUP BY 1, 2),
p AS (SELECT page_id, string_agg(img, ',' ORDER BY first) AS images FROM i GROUP BY page_id)
SELECT page_id, 'https://www.apartments.com/p/' || page_id AS listing_url, 2 AS property_type,
  'The Place' AS property_name, '1 Main St' AS street_address, 'Nice' AS description,
  'laundry,a/c units,dishwasher' AS amenities,
  'air_conditioning=true,dishwasher=true,laundry=true' AS features, '555-0100' AS contact_phone,
  4.5::DOUBLE AS rating, images FROM p""")
def _(spark, sf):
    return sites.apartments_details(_apartments_detail(spark, sf)).select(
        "page_id", "listing_url", "property_type", "property_name", "street_address", "description",
        F.array_join("amenities", ",").alias("amenities"), _flags(F.col("features")).alias("features"),
        "contact_phone", "rating", F.array_join("images", ",").alias("images"))


# --- generic selectors over the given pages -------------------------------------------------------


def _s_text(pattern: str) -> str:
    """Text of the given pages' element that a pattern finds, character references resolved."""
    text = s_group("html", pattern)
    for ref, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&amp;", "&")):
        text = f"replace({text}, '{ref}', '{char}')"
    return s_strip(text)


@query("ext_1_select_text", f"""
SELECT page_id, url, {_s_text('<title>([^<]*)</title>')} AS title,
  {_s_text('<article><h1>([^<]*)</h1>')} AS heading,
  {_s_text('<nav><ul><li><a href="[^"]*">([^<]*)</a>')} AS menu,
  {_s_text('<div class="ad">([^<]*)</div>')} AS ad, CAST(NULL AS VARCHAR) AS absent FROM pages""")
def _(spark, sf):
    return select_fields(table(spark, sf, "pages"), {
        "title": Pick("title"), "heading": Pick("article h1"), "menu": Pick("nav ul li a"),
        "ad": Pick("div.ad"), "absent": Pick(".list-card-price")})


@query("ext_2_select_attribute", f"""
SELECT page_id, {s_group('html', '<html lang="([^"]*)"')} AS lang,
  {s_group('html', '<nav><ul><li><a href="([^"]*)"')} AS first_link FROM pages""")
def _(spark, sf):
    return select_fields(table(spark, sf, "pages"), {
        "lang": Pick("html", ("lang",)), "first_link": Pick("nav a[href]", ("href",))}).drop("url")


@query("ext_3_parse_counts", r"""
SELECT page_id, CAST(len(regexp_extract_all(html, '<p[ >]')) AS INTEGER) AS paragraphs,
  CAST(len(regexp_extract_all(html, '<a href=')) AS INTEGER) AS links FROM (SELECT page_id,
  regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<script.*?</script>', '', 'gs') AS html
  FROM pages)""")
def _(spark, sf):
    f = select_fields(table(spark, sf, "pages"), {
        "p": Pick("p", every=True), "a": Pick("a[href]", ("href",), every=True)})
    return f.select("page_id", F.size("p").alias("paragraphs"), F.size("a").alias("links"))


# --- text columns -----------------------------------------------------------------------------------


def _price_text() -> Column:
    k, n = F.col("ingest_seq"), F.format_number(F.floor("price"), 0)
    return (
        F.when(k % 6 == 0, F.concat(F.lit(" $"), n, F.lit("+ "))).when(k % 6 == 1, F.concat(F.lit("$"), n, F.lit(" - $9")))
        .when(k % 6 == 2, F.concat(n, F.lit(" per month"))).when(k % 6 == 3, F.concat(n, F.lit("/mo")))
        .when(k % 6 == 4, F.concat(F.lit("-"), n)).otherwise(F.concat(n, F.lit(" PER WEEK")))
    )


_PRICE_TEXT = """CASE ingest_seq % 6 WHEN 0 THEN ' $' || n || '+ ' WHEN 1 THEN '$' || n || ' - $9'
  WHEN 2 THEN n || ' per month' WHEN 3 THEN n || '/mo' WHEN 4 THEN '-' || n ELSE n || ' PER WEEK' END"""
_N = "format('{:,}', CAST(floor(price) AS BIGINT))"


@query("ext_4_clean_price", f"""
WITH {LISTINGS}, t AS (SELECT ingest_seq, {_PRICE_TEXT.replace('|| n', '|| ' + _N).replace('n ||', _N + ' ||')}
  AS text FROM listings)
SELECT ingest_seq, {s_price('text')} AS price FROM t""")
def _(spark, sf):
    return listings(spark, sf).select("ingest_seq", money.clean_price(_price_text()).alias("price"))


@query("ext_9_keep_number", f"""
SELECT doc_id, CAST(trunc({s_num("regexp_replace(text, '[^0-9.]', '', 'g')")}) AS BIGINT) AS n
FROM (SELECT doc_id, doc_id || ' baths ' || (doc_id % 4) || '.5' || lang AS text FROM documents)""")
def _(spark, sf):
    d = F.col("doc_id")
    text = F.concat(d, F.lit(" baths "), d % 4, F.lit(".5"), "lang")
    return table(spark, sf, "documents").select("doc_id", keep_number(text).alias("n"))


@query("ext_12_type_from_text", """
WITH t AS (SELECT doc_id, lower(text) AS t FROM documents)
SELECT doc_id, CAST(CASE WHEN contains(t, 'house') OR contains(t, 'single') THEN 1
  WHEN contains(t, 'condo') THEN 3 WHEN contains(t, 'townhouse') OR contains(t, 'townhome') THEN 4
  WHEN contains(t, 'apartment') THEN 2 WHEN contains(t, 'multi') OR contains(t, 'duplex') THEN 5
  WHEN contains(t, 'land') OR contains(t, 'lot') THEN 6 ELSE 8 END AS INTEGER) AS property_type FROM t""")
def _(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", listing.type_from_text(F.col("text")).alias("property_type"))


@query("ext_13_ids_from_urls", f"""
WITH u AS (SELECT page_id, url, '/homedetails/x/' || page_id || '_zpid/' AS z FROM pages)
SELECT page_id, {s_group('z', '/([0-9]+)_zpid/')} AS zpid, {s_group('url', '/([0-9]+)/?$')} AS trailing_id
FROM u""")
def _(spark, sf):
    z = F.concat(F.lit("/homedetails/x/"), F.col("page_id"), F.lit("_zpid/"))
    return table(spark, sf, "pages").select(
        "page_id", listing.zpid(z).alias("zpid"), listing.trailing_id(F.col("url")).alias("trailing_id"))


@query("ext_14_resolve_link", f"""
WITH h AS (SELECT page_id, url, {s_group('html', '<nav><ul><li><a href="([^"]*)"')} AS href FROM pages)
SELECT page_id, url AS absolute, 'https://www.zillow.com' || href AS rooted,
  'https://www.zillow.com/' || page_id || '/x' AS relative FROM h""")
def _(spark, sf):
    f = select_fields(table(spark, sf, "pages"), {"href": Pick("nav a[href]", ("href",))})
    base = sites.ZILLOW_SITE
    return f.select(
        "page_id", address.resolve_link(F.col("url"), base).alias("absolute"),
        address.resolve_link(F.col("href"), base).alias("rooted"),
        address.resolve_link(F.concat(F.col("page_id"), F.lit("/x")), base).alias("relative"))


@query("ext_15_split_address", f"""
WITH {LISTINGS} SELECT ingest_seq, city, upper(trim(COALESCE(state, 'XX'))) AS state, zip_code FROM listings""")
def _(spark, sf):
    parts = address.split_address(_full_address())
    return listings(spark, sf).select("ingest_seq", *[c.alias(n) for n, c in parts.items()])


@query("ext_16_rooms_and_area", f"""
WITH {LISTINGS} SELECT ingest_seq, CASE WHEN ingest_seq % 6 = 0 THEN 0 ELSE CAST(bedrooms AS INTEGER) END
  AS bedrooms, bathrooms, CAST(square_feet AS BIGINT) AS square_feet FROM listings""")
def _(spark, sf):
    k = F.col("ingest_seq")
    text = F.concat_ws(
        " ", F.when(k % 6 == 0, "STUDIO").otherwise(F.concat(F.col("bedrooms").cast("int"), F.lit("BD"))),
        F.concat("bathrooms", F.lit(" Baths")), _sqft_text(" Sq. Ft"))
    return listings(spark, sf).select(
        "ingest_seq", listing.bedrooms(text, studio=True).alias("bedrooms"),
        listing.bathrooms(text).alias("bathrooms"), listing.square_feet(text).alias("square_feet"))


@query("ext_17_status", """
WITH t AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'Sale PENDING, not sold' WHEN 'F' THEN
  'Sold ' || o_orderpriority END AS t FROM orders)
SELECT o_orderkey, CASE WHEN contains(lower(t), 'pending') THEN 'pending' WHEN contains(lower(t), 'sold')
  THEN 'sold' ELSE 'active' END AS status FROM t""")
def _(spark, sf):
    s = F.col("o_orderstatus")
    text = F.when(s == "P", "Sale PENDING, not sold").when(s == "F", F.concat(F.lit("Sold "), "o_orderpriority"))
    return table(spark, sf, "orders").select("o_orderkey", listing.status_from_text(text).alias("status"))


@query("ext_22_rent_from_range", f"""
WITH {LISTINGS}, n AS (SELECT ingest_seq, floor(price) AS n FROM listings)
SELECT ingest_seq, CASE ingest_seq % 3 WHEN 0 THEN (n + n + 501) / 2 WHEN 1 THEN n END AS rent FROM n""")
def _(spark, sf):
    k, n = F.col("ingest_seq"), F.floor("price")
    text = F.when(k % 3 == 0, F.concat(F.lit("$"), F.format_number(n, 0), F.lit(" -"), F.format_number(n + 501, 0))).when(
        k % 3 == 1, F.concat(F.lit("from $"), F.format_number(n, 0), F.lit(".75"))).otherwise("ask")
    return listings(spark, sf).select("ingest_seq", money.rent_from_range(text).alias("rent"))


@query("ext_23_available_now", """
SELECT doc_id, CASE WHEN contains(lower(text), 'now') OR contains(lower(text), 'available') THEN TRUE END
  AS available_now FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", listing.available_now(F.col("text")).alias("available_now"))


@query("ext_24_amenity_flags", """
WITH t AS (SELECT doc_id, lower(text) AS t FROM documents)
SELECT doc_id, concat_ws(',',
  CASE WHEN contains(t, 'air conditioning') OR contains(t, 'a/c') THEN 'air_conditioning=true' END,
  CASE WHEN contains(t, 'dishwasher') THEN 'dishwasher=true' END,
  CASE WHEN contains(t, 'gym') OR contains(t, 'fitness') THEN 'gym=true' END,
  CASE WHEN contains(t, 'laundry') THEN 'laundry=true' END,
  CASE WHEN contains(t, 'parking') OR contains(t, 'garage') THEN 'parking=true' END,
  CASE WHEN contains(t, 'pet') THEN 'pet_friendly=true' END,
  CASE WHEN contains(t, 'pool') THEN 'pool=true' END) AS features FROM t""")
def _(spark, sf):
    flags = listing.amenity_flags(F.col("text"), listing.DETAIL_AMENITY_WORDS)
    return table(spark, sf, "documents").select("doc_id", _flags(flags).alias("features"))


@query("ext_25_first_decimal", f"""
SELECT doc_id, {s_num("NULLIF(regexp_extract(text, '([0-9.]+)', 1), '')")} AS n FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", first_decimal(F.col("text")).alias("n"))
