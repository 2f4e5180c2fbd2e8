"""Registry of named queries with their DuckDB twins, and shared SQL fragments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from homeledger.functions.address import STATE_CODES, STREET_WORDS
from homeledger.functions.text import WS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return keep


# --- DuckDB expressions for the Spark functions of the same meaning -----------------


def s_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def s_clean(x: str) -> str:
    return (
        f"regexp_replace(regexp_replace({s_strip(x)}, '<[^>]+>', '', 'g'), '{WS}+', ' ', 'g')"
    )


def s_group(x: str, pattern: str, group: int = 1) -> str:
    return f"NULLIF(regexp_extract({x}, '{pattern}', {group}), '')"


def s_num(x: str) -> str:
    ok = r"^([0-9]+\.?[0-9]*|\.[0-9]+)([eE][0-9]+)?$"
    return f"CASE WHEN regexp_matches({x}, '{ok}') THEN TRY_CAST({x} AS DOUBLE) END"


def s_price(x: str) -> str:
    bare = s_strip(f"regexp_replace({x}, '[$,+]', '', 'g')")
    left = s_strip(f"split_part({bare}, '-', 1)")
    return s_num(s_strip(f"split_part({left}, 'per', 1)"))


def s_cents(x: str) -> str:
    return f"CASE WHEN {x} <> 0 AND {x} < 100000 THEN trunc({x} * 100::DOUBLE) ELSE {x} END"


def s_state(x: str) -> str:
    up = f"upper({s_strip(f'COALESCE({x}, {chr(39) * 2})')})"
    whens = " ".join(f"WHEN '{n}' THEN '{c}'" for n, c in STATE_CODES.items())
    return f"CASE {up} {whens} ELSE {up} END"


def s_zip(x: str) -> str:
    text = s_strip(f"COALESCE({x}, '')")
    return f"COALESCE({s_group(text, '([0-9]{5})')}, {text})"


def s_fp(street: str, city: str, state: str, zip_code: str) -> str:
    parts = [f"lower({s_strip(f'COALESCE({x}, {chr(39) * 2})')})" for x in (street, city, state)]
    parts.append(s_strip(f"COALESCE({zip_code}, '')"))
    line = " || ' ' || ".join(parts)
    for word, short in STREET_WORDS:
        line = f"replace({line}, '{word}', '{short}')"
    return f"md5({line})"


# --- DuckDB twins of plans/fixtures.py ------------------------------------------------

LISTINGS = """listings AS (
  SELECT o_orderkey AS ingest_seq, o_orderkey AS property_id,
    CAST(o_orderkey AS VARCHAR) AS external_id,
    CASE o_orderkey % 3 WHEN 0 THEN 'redfin' WHEN 1 THEN 'zillow' ELSE 'apartments_com' END
      AS data_source,
    CAST(1 + o_orderkey % 8 AS INTEGER) AS property_type,
    CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'P' THEN 'pending' ELSE 'sold' END AS status,
    o_totalprice AS price,
    CASE WHEN o_orderkey % 4 = 0 THEN NULL
      ELSE CAST(1000 + (o_orderkey * 13) % 4000 AS DOUBLE) END AS rent_estimate,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL
      ELSE CAST(400 + (o_orderkey * 37) % 3600 AS DOUBLE) END AS square_feet,
    CAST(o_orderkey % 6 AS DOUBLE) AS bedrooms,
    1 + CAST(o_orderkey % 5 AS DOUBLE) * CAST(0.5 AS DOUBLE) AS bathrooms,
    CAST(1950 + o_orderkey % 70 AS INTEGER) AS year_built,
    (c_custkey % 400) || ' ' || p_type || CASE o_orderkey % 3 WHEN 0 THEN ' Street'
      WHEN 1 THEN ' St' ELSE ' Avenue' END AS street_address,
    n_name AS city,
    CASE o_orderkey % 5 WHEN 0 THEN 'california' WHEN 1 THEN ' Texas ' WHEN 2 THEN 'NY'
      WHEN 4 THEN 'ohio' END AS state,
    CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE lpad(CAST(c_custkey % 400 AS VARCHAR), 5, '9')
      || CASE WHEN o_orderkey % 2 = 0 THEN '-1234' ELSE '' END END AS zip_code,
    o_orderdate AS created_at
  FROM orders
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part)
)"""

SNAPSHOTS = """snapshots AS (
  SELECT o_orderkey AS id, o_custkey AS property_id,
    CAST(round(o_totalprice * 100) AS BIGINT) AS list_price,
    CASE WHEN o_orderstatus = 'O' THEN 'active' ELSE 'sold' END AS listing_status,
    o_orderdate AS created_at
  FROM orders
)"""

LOCATIONS = """locations AS (
  SELECT c_custkey AS id, (c_custkey % 400) || ' ' || c_mktsegment || ' Street' AS street_address,
    n_name AS city,
    CASE c_custkey % 4 WHEN 0 THEN 'CA' WHEN 1 THEN 'TX' WHEN 2 THEN 'NY' END AS state,
    lpad(CAST(c_custkey % 400 AS VARCHAR), 5, '9') AS zip_code,
    CASE WHEN c_custkey % 7 <> 0 THEN 'US' END AS country,
    CAST(25 + n_nationkey AS DOUBLE) AS latitude,
    CAST(-120 + c_custkey % 50 AS DOUBLE) AS longitude
  FROM customer JOIN nation ON c_nationkey = n_nationkey
)"""

PROPERTIES = """properties AS (
  SELECT o_orderkey AS property_id, o_custkey AS location_id,
    CAST(o_orderkey AS VARCHAR) AS external_id,
    CASE o_orderkey % 3 WHEN 0 THEN 'redfin' WHEN 1 THEN 'zillow' ELSE 'apartments_com' END
      AS data_source,
    CAST(1 + o_orderkey % 8 AS INTEGER) AS property_type,
    CASE WHEN o_orderkey % 17 <> 0 THEN CAST(round(o_totalprice * 100) AS BIGINT) END AS price,
    CAST(o_orderkey % 6 AS DOUBLE) AS bedrooms,
    1 + CAST(o_orderkey % 5 AS DOUBLE) * CAST(0.5 AS DOUBLE) AS bathrooms,
    CAST(400 + (o_orderkey * 37) % 3600 AS DOUBLE) AS square_feet,
    o_orderdate AS created_at, o_orderdate AS updated_at, o_orderdate AS last_scraped
  FROM orders
)"""

METRICS = """metrics AS (
  SELECT l_orderkey AS property_id, max(CAST(l_quantity AS INTEGER)) AS walk_score,
    max(l_discount) AS cap_rate,
    max(CAST(round(l_extendedprice * 100) AS BIGINT)) AS zestimate,
    min(l_shipdate) AS created_at, min(l_shipdate) AS updated_at
  FROM lineitem GROUP BY l_orderkey
)"""

POINTS = """points AS (
  SELECT event_type AS name,
    CASE WHEN event_type IN ('signup', 'error') THEN 'counter' WHEN event_type = 'click'
      THEN 'gauge' ELSE 'histogram' END AS kind,
    ts, event_id AS seq, value, CAST(user_id % 10 AS VARCHAR) AS user_tag,
    event_type || '|app=web,user=' || CAST(user_id % 10 AS VARCHAR) AS key
  FROM events
)"""

_STATUS = """CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running'
      WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'cancelled' END"""

JOBS = f"""jobs AS (
  SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS job_id,
    CASE event_id % 3 WHEN 0 THEN 'redfin' WHEN 1 THEN 'zillow' ELSE 'apartments_com' END
      AS data_source,
    {_STATUS} AS status, CAST(floor(value) AS BIGINT) AS properties_saved, ts AS created_at
  FROM events
)"""

JOB_EVENTS = f"""job_events AS (
  SELECT CAST(user_id AS VARCHAR) AS job_id, {_STATUS} AS status, ts, event_id AS seq FROM events
)"""

RESULTS = """results AS (
  SELECT event_id AS id, CAST(user_id AS VARCHAR) AS job_id, props AS raw_data,
    CASE WHEN event_id % 5 <> 4 THEN event_id % 2 = 0 END AS is_processed, ts AS scraped_at
  FROM events
)"""

TICKS = """ticks AS (
  SELECT date_trunc('hour', ts) AS tick, count(*) AS requests,
    count(*) FILTER (event_type = 'error') AS errors, max(value) AS peak,
    CAST(count(*) FILTER (event_type = 'error') AS DOUBLE) / count(*) AS error_rate
  FROM events GROUP BY 1
)"""
