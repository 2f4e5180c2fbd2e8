"""Deduplication and merge queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from homeledger.catalog.base import LISTINGS, LOCATIONS, query, s_fp
from homeledger.functions.similarity import numeric_similarity, score_pairs, FIELDS
from homeledger.operators import dedup, fuzzy, merge
from homeledger.plans.fixtures import listings, locations, table
from homeledger.session import scratch_path
from homeledger.sinks import fingerprints

_FP = s_fp("street_address", "city", "state", "zip_code")
KEYED = f"keyed AS (SELECT *, {_FP} AS fp FROM listings)"


@query("dup_1_address_fingerprint", f"""
WITH {LISTINGS}, {KEYED} SELECT ingest_seq, fp FROM keyed""")
def _(spark, sf):
    return dedup.with_fingerprint(listings(spark, sf)).select("ingest_seq", "fp")


@query("dup_2_property_hash", f"""
WITH {LISTINGS} SELECT ingest_seq, md5(lower(trim(COALESCE(street_address, '') || '|' ||
  COALESCE(city, '') || '|' || COALESCE(state, '') || '|' || COALESCE(zip_code, ''))))
  AS property_hash FROM listings""")
def _(spark, sf):
    return dedup.with_property_hash(listings(spark, sf)).select("ingest_seq", "property_hash")


@query("dup_3_first_per_fingerprint", f"""
WITH {LISTINGS}, {KEYED} SELECT min(ingest_seq) AS ingest_seq, fp FROM keyed GROUP BY fp""")
def _(spark, sf):
    return dedup.deduplicate(listings(spark, sf)).select("ingest_seq", "fp")


@query("dup_3_across_runs", f"""
WITH {LISTINGS}, {KEYED}, seen AS (SELECT DISTINCT fp FROM keyed
  WHERE created_at < TIMESTAMP '1998-01-01')
SELECT min(ingest_seq) AS ingest_seq, fp FROM keyed
WHERE created_at >= TIMESTAMP '1998-01-01' AND fp NOT IN (SELECT fp FROM seen) GROUP BY fp""")
def _(spark, sf):
    df = listings(spark, sf)
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    earlier = dedup.with_fingerprint(df.filter(F.col("created_at") < cut))
    state = scratch_path(spark, "fingerprints")
    fingerprints.append(earlier, state)
    later = df.filter(F.col("created_at") >= cut)
    return dedup.deduplicate(later, fingerprints.load(spark, state)).select("ingest_seq", "fp")


@query("dup_3_keep_blank", f"""
WITH {LISTINGS}, faded AS (SELECT ingest_seq,
  CASE WHEN ingest_seq % 3 <> 0 THEN street_address END AS street_address,
  CASE WHEN ingest_seq % 3 <> 0 THEN city END AS city,
  CASE WHEN ingest_seq % 3 <> 0 THEN state END AS state,
  CASE WHEN ingest_seq % 3 <> 0 THEN zip_code END AS zip_code FROM listings)
SELECT min(ingest_seq) AS ingest_seq FROM faded WHERE street_address IS NOT NULL GROUP BY {_FP}
UNION ALL SELECT ingest_seq FROM faded WHERE street_address IS NULL""")
def _(spark, sf):
    known = F.col("ingest_seq") % 3 != 0
    faded = listings(spark, sf).withColumns(
        {c: F.when(known, F.col(c)) for c in dedup.ADDRESS_KEYS})
    return dedup.deduplicate(faded, keep_blank=True).select("ingest_seq")


def _first_pairs(spark, sf):
    """Every later row of a fingerprint next to the first one."""
    keyed = dedup.with_fingerprint(listings(spark, sf))
    firsts = dedup.deduplicate(listings(spark, sf)).select(
        "fp", F.col("ingest_seq").alias("a_seq"), *[F.col(f).alias(f"a_{f}") for f in FIELDS])
    later = keyed.select(
        "fp", F.col("ingest_seq").alias("b_seq"), *[F.col(f).alias(f"b_{f}") for f in FIELDS])
    return firsts.join(later, "fp").filter(F.col("a_seq") < F.col("b_seq"))


def _s_numeric(f: str, t: str) -> str:
    a, b = f"a.{f}", f"b.{f}"
    off = f"(abs({a} - {b}) / greatest(abs({a}), abs({b})))"
    return (
        f"CASE WHEN {a} = {b} THEN 1::DOUBLE WHEN {off} <= {t}::DOUBLE THEN 1::DOUBLE "
        f"WHEN {a} IS NULL OR {b} IS NULL THEN NULL "
        f"ELSE greatest(0::DOUBLE, 1::DOUBLE - ({off} - {t}::DOUBLE) / (1 - {t}::DOUBLE)) END"
    )


# Rows of one fingerprint have equal texts, but for a street that ends in "St" or in "Street":
# one text then begins the other, and the matcher's ratio follows from the lengths.
@query("dup_5_record_similarity", f"""
WITH {LISTINGS}, {KEYED}, firsts AS (SELECT fp, min(ingest_seq) AS first_seq FROM keyed GROUP BY fp),
s AS (SELECT a.ingest_seq AS a_seq, b.ingest_seq AS b_seq,
  CASE WHEN lower(a.street_address) = lower(b.street_address) THEN 1::DOUBLE
    ELSE 2::DOUBLE * least(length(a.street_address), length(b.street_address))
      / (length(a.street_address) + length(b.street_address)) END AS street,
  CASE WHEN a.state IS NOT NULL THEN 0.1::DOUBLE ELSE 0::DOUBLE END AS state,
  CASE WHEN a.zip_code IS NOT NULL THEN 0.15::DOUBLE ELSE 0::DOUBLE END AS zip,
  CASE WHEN a.bedrooms = b.bedrooms THEN 1::DOUBLE ELSE 0::DOUBLE END AS bedrooms,
  {_s_numeric('bathrooms', '0.5')} AS bathrooms, {_s_numeric('square_feet', '0.1')} AS area
  FROM firsts f JOIN keyed a ON a.ingest_seq = f.first_seq JOIN keyed b ON b.fp = f.fp
  WHERE a.ingest_seq < b.ingest_seq)
SELECT a_seq, b_seq, round((street * 0.3::DOUBLE + 0.15::DOUBLE + state + zip + (bedrooms + bathrooms
  + COALESCE(area, 0)) * 0.1::DOUBLE) / (0.3::DOUBLE + 0.15::DOUBLE + state + zip + 0.2::DOUBLE
  + CASE WHEN area IS NULL THEN 0::DOUBLE ELSE 0.1::DOUBLE END), 6) AS similarity FROM s""")
def _(spark, sf):
    return score_pairs(_first_pairs(spark, sf)).select(
        "a_seq", "b_seq", F.round("similarity", 6).alias("similarity"))


@query("dup_8_numeric_similarity", f"""
WITH {LISTINGS}, {KEYED}, firsts AS (SELECT fp, min(ingest_seq) AS first_seq FROM keyed GROUP BY fp)
SELECT a.ingest_seq AS a_seq, b.ingest_seq AS b_seq,
  CASE WHEN a.bedrooms = b.bedrooms THEN 1::DOUBLE ELSE 0::DOUBLE END AS bedrooms,
  {_s_numeric('bathrooms', '0.5')} AS bathrooms,
  {_s_numeric('square_feet', '0.1')} AS square_feet
FROM firsts f JOIN keyed a ON a.ingest_seq = f.first_seq JOIN keyed b ON b.fp = f.fp
WHERE a.ingest_seq < b.ingest_seq""")
def _(spark, sf):
    pairs = _first_pairs(spark, sf)
    return pairs.select("a_seq", "b_seq", *[
        numeric_similarity(F.col(f"a_{f}"), F.col(f"b_{f}"), f).alias(f)
        for f in ("bedrooms", "bathrooms", "square_feet")])


@query("dup_9_duplicate_groups")
def _(spark, sf):
    return fuzzy.duplicate_groups(listings(spark, sf))


@query("dup_12_duplicate_statistics")
def _(spark, sf):
    return fuzzy.duplicate_statistics(listings(spark, sf))


def _equal_only(spark, sf):
    """Addresses whose records are either equal or alike in nothing.

    Each address becomes one digest used for every text field, so two different
    addresses share no block and only equal ones can be similar. It is written in letters:
    five digits in a row would be read as a zip code, a block shared by chance.
    """
    fp = dedup.with_fingerprint(listings(spark, sf)).select(
        "ingest_seq", F.translate("fp", "0123456789", "ghijklmnop").alias("fp"))
    return fp.select(
        "ingest_seq", *[F.col("fp").alias(c) for c in dedup.ADDRESS_KEYS],
        F.lit(3.0).alias("bedrooms"), F.lit(2.0).alias("bathrooms"),
        F.lit(1500.0).alias("square_feet"))


@query("dup_9_groups_of_equal_addresses", f"""
WITH {LISTINGS}, {KEYED}, g AS (SELECT ingest_seq, min(ingest_seq) OVER (PARTITION BY fp) AS group_id,
  count(*) OVER (PARTITION BY fp) AS n FROM keyed)
SELECT group_id, ingest_seq FROM g WHERE n > 1""")
def _(spark, sf):
    return fuzzy.duplicate_groups(_equal_only(spark, sf))


@query("dup_12_statistics_of_equal_addresses", f"""
WITH {LISTINGS}, {KEYED}, g AS (SELECT fp, count(*) AS n FROM keyed GROUP BY fp)
SELECT CAST(sum(n) AS BIGINT) AS total_properties, count(*) FILTER (n > 1) AS duplicate_groups,
  CAST(COALESCE(sum(n) FILTER (n > 1), 0) AS BIGINT) AS total_duplicates,
  count(*) AS unique_properties,
  CAST(COALESCE(sum(n) FILTER (n > 1), 0) AS DOUBLE) / sum(n) AS duplication_rate FROM g""")
def _(spark, sf):
    return fuzzy.duplicate_statistics(_equal_only(spark, sf))


_MERGE_INPUT = """records AS (SELECT fp AS group_id, ingest_seq,
  CASE WHEN ingest_seq % 3 = 0 THEN '' ELSE city END AS city, year_built, bedrooms,
  CASE WHEN ingest_seq % 5 = 0 THEN 0 ELSE price END AS price, rent_estimate,
  repeat('x', CAST(ingest_seq % 7 AS INTEGER)) AS description, data_source, status, external_id
  FROM keyed)"""


def _merge_input(spark, sf):
    k = F.col("ingest_seq")
    df = dedup.with_fingerprint(listings(spark, sf))
    return df.select(
        F.col("fp").alias("group_id"), "ingest_seq",
        F.when(k % 3 == 0, "").otherwise(F.col("city")).alias("city"), "year_built", "bedrooms",
        F.when(k % 5 == 0, 0.0).otherwise(F.col("price")).alias("price"), "rent_estimate",
        F.repeat(F.lit("x"), (k % 7).cast("int")).alias("description"),
        F.array("data_source", "status").alias("images"),
        F.create_map(F.col("data_source"), F.col("external_id"), F.lit("status"), F.col("status"))
        .alias("features"),
    )


def _first(c: str, cond: str) -> str:
    return f"arg_min({c}, ingest_seq) FILTER ({cond})"


@query("dup_10_merge_groups", f"""
WITH {LISTINGS}, {KEYED}, {_MERGE_INPUT}
SELECT group_id, min(ingest_seq) AS ingest_seq, count(*) AS merged_rows,
  {_first('city', "city <> ''")} AS city, {_first('year_built', 'year_built IS NOT NULL')} AS year_built,
  {_first('bedrooms', 'bedrooms IS NOT NULL')} AS bedrooms,
  COALESCE({_first('price', 'price <> 0')}, {_first('price', 'price IS NOT NULL')}) AS price,
  {_first('rent_estimate', 'rent_estimate IS NOT NULL')} AS rent_estimate,
  NULLIF(max(description), '') AS description
FROM records GROUP BY group_id""")
def _(spark, sf):
    return merge.merge_groups(_merge_input(spark, sf).drop("images", "features"))


@query("dup_11_merge_collections", f"""
WITH {LISTINGS}, {KEYED}, {_MERGE_INPUT},
img AS (SELECT group_id, data_source AS x FROM records UNION SELECT group_id, status FROM records),
feat AS (SELECT group_id, k, arg_max(v, ingest_seq) AS v FROM (
  SELECT group_id, ingest_seq, data_source AS k, external_id AS v FROM records
  UNION ALL SELECT group_id, ingest_seq, 'status', status FROM records) GROUP BY group_id, k),
i AS (SELECT group_id, string_agg(x, ',' ORDER BY x) AS images FROM img GROUP BY group_id),
f AS (SELECT group_id, string_agg(k || '=' || v, ',' ORDER BY k) AS features FROM feat
  GROUP BY group_id)
SELECT i.group_id, images, features FROM i JOIN f ON i.group_id = f.group_id""")
def _(spark, sf):
    merged = merge.merge_groups(_merge_input(spark, sf))
    pairs = F.transform(
        F.array_sort(F.map_entries("features")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return merged.select(
        "group_id", F.array_join("images", ",").alias("images"),
        F.array_join(pairs, ",").alias("features"))


@query("dup_13_whole_row_duplicates", """
SELECT DISTINCT text, lang FROM documents""")
def _(spark, sf):
    return dedup.drop_duplicate_rows(table(spark, sf, "documents").select("text", "lang"))


_LOC_ID = """CAST('0x' || substr(md5(concat_ws(chr(1), COALESCE(street_address, chr(2)),
  COALESCE(city, chr(2)), COALESCE(state, chr(2)), COALESCE(zip_code, chr(2)))), 1, 15) AS BIGINT)"""


@query("dup_14_resolve_locations", f"""
WITH {LISTINGS}, old AS (SELECT DISTINCT street_address, city, state, zip_code FROM listings
  WHERE created_at < TIMESTAMP '1998-01-01'),
new AS (SELECT DISTINCT street_address, city, state, zip_code FROM listings)
SELECT {_LOC_ID} AS id, street_address, city, state, zip_code FROM new n WHERE NOT EXISTS (
  SELECT 1 FROM old o WHERE o.street_address IS NOT DISTINCT FROM n.street_address
  AND o.city IS NOT DISTINCT FROM n.city AND o.state IS NOT DISTINCT FROM n.state
  AND o.zip_code IS NOT DISTINCT FROM n.zip_code)""")
def _(spark, sf):
    df = listings(spark, sf)
    old = df.filter(F.col("created_at") < F.lit("1998-01-01").cast("timestamp_ntz"))
    return dedup.resolve_locations(df, old)


@query("dup_14_location_id_collisions", f"""
WITH {LISTINGS}, new AS (SELECT DISTINCT street_address, city, state, zip_code FROM listings),
ids AS (SELECT {_LOC_ID} AS id FROM new)
SELECT ((id % 1000) + 1000) % 1000 AS id, count(*) AS n FROM ids GROUP BY 1 HAVING count(*) > 1""")
def _(spark, sf):
    # Ids cut to three digits, so that some clash.
    df = listings(spark, sf)
    found = dedup.resolve_locations(df, df.limit(0))
    return dedup.location_id_collisions(found.withColumn("id", F.pmod("id", F.lit(1000))))


@query("dup_15_accept_new", f"""
WITH {LISTINGS}, batch AS (SELECT ingest_seq, CAST(ingest_seq // 2 AS VARCHAR) AS external_id,
  'redfin' AS data_source FROM listings),
stored AS (SELECT external_id, data_source FROM listings WHERE status = 'active'),
fresh AS (SELECT b.*, row_number() OVER (PARTITION BY external_id ORDER BY ingest_seq) AS rn
  FROM batch b WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.external_id = b.external_id
  AND s.data_source = b.data_source))
SELECT b.ingest_seq, CASE WHEN f.rn = 1 THEN 'accepted' ELSE 'rejected' END AS outcome
FROM batch b LEFT JOIN fresh f ON b.ingest_seq = f.ingest_seq""")
def _(spark, sf):
    df = listings(spark, sf)
    incoming = df.select(
        "ingest_seq", F.expr("ingest_seq div 2").cast("string").alias("external_id"),
        F.lit("redfin").alias("data_source"))
    accepted, rejected = dedup.accept_new(incoming, df.filter("status = 'active'"))
    return accepted.select("ingest_seq", F.lit("accepted").alias("outcome")).unionAll(
        rejected.select("ingest_seq", F.lit("rejected").alias("outcome")))


@query("dup_16_deduplication_summary", f"""
WITH {LISTINGS}, {KEYED} SELECT count(*) AS input_records, count(DISTINCT fp) AS unique_records,
  count(*) - count(DISTINCT fp) AS duplicates,
  CAST(count(*) - count(DISTINCT fp) AS DOUBLE) / count(*) AS duplication_rate FROM keyed""")
def _(spark, sf):
    df = listings(spark, sf)
    return dedup.deduplication_summary(df, dedup.deduplicate(df))


@query("snk_6_fingerprint_state", f"""
WITH {LISTINGS}, {KEYED} SELECT fp, count(*) AS times FROM (SELECT DISTINCT fp FROM keyed)
GROUP BY fp""")
def _(spark, sf):
    keyed = dedup.with_fingerprint(listings(spark, sf))
    state = scratch_path(spark, "fingerprints")
    for part in (keyed.filter("status = 'active'"), keyed):
        fingerprints.append(part, state)
    return fingerprints.load(spark, state).groupBy("fp").agg(F.count("*").alias("times"))
