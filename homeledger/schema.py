"""Table schemas and the fixed value lists they rely on."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
PROPERTY_TYPES = {
    "house": 1,
    "apartment": 2,
    "condo": 3,
    "townhouse": 4,
    "multi_family": 5,
    "land": 6,
    "commercial": 7,
    "other": 8,
}
LISTING_STATUSES = ["active", "pending", "sold", "off_market", "coming_soon", "price_reduced"]
DATA_SOURCES = ["redfin", "zillow", "apartments_com"]
JOB_STATUSES = ["pending", "running", "completed", "failed", "cancelled", "retrying"]
ALERT_SEVERITIES = ["low", "medium", "high", "critical"]
ALERT_STATUSES = ["active", "acknowledged", "resolved"]
# Type codes used by JSON search responses; any other code means "other".
JSON_TYPE_CODES = {1: "house", 2: "condo", 3: "townhouse", 4: "multi_family", 5: "land"}
# ----------------------------------------------------------------------------


def _struct(spec: str) -> T.StructType:
    return T._parse_datatype_string(spec)


PRICE_HISTORY = (
    "array<struct<date timestamp, old_price bigint, new_price bigint,"
    " change_amount bigint, change_percent double>>"
)

PROPERTIES = (
    "property_id bigint, listing_id bigint, mls_id string, status string, price bigint,"
    " hoa_fee string, square_feet double, lot_size double, bedrooms double, bathrooms double,"
    " location string, stories double, address string, city string, state string,"
    " zip_code string, year_built double, url string, latitude double, longitude double,"
    " description string, property_type int, country_code string, external_id string,"
    " data_source string, features map<string,string>, images array<string>,"
    " created_at timestamp, updated_at timestamp, last_scraped timestamp"
)

# The 23 columns of the analyst-facing view, in view order.
VIEW_COLUMNS = [
    "property_id", "listing_id", "mls_id", "status", "price", "hoa_fee", "square_feet",
    "lot_size", "bedrooms", "bathrooms", "location", "stories", "address", "city", "state",
    "zip_code", "year_built", "url", "latitude", "longitude", "description", "property_type",
    "country_code",
]

PROPERTY_LISTINGS = (
    "id bigint, property_id bigint, listing_status string, list_price bigint,"
    " listing_date timestamp, days_on_market int, price_history " + PRICE_HISTORY + ","
    " listing_agent string, brokerage string, listing_url string, mls_number string,"
    " created_at timestamp, updated_at timestamp"
)

PROPERTY_METRICS = (
    "id bigint, property_id bigint, zestimate int, rent_zestimate int, market_value int,"
    " price_per_sqft_area double, cap_rate double, cash_flow int, roi double,"
    " appreciation_rate double, rental_yield double, median_home_value int, median_rent int,"
    " walk_score int, school_rating double, crime_score double,"
    " created_at timestamp, updated_at timestamp"
)

LOCATIONS = (
    "id bigint, street_address string, city string, state string, zip_code string,"
    " country string, latitude double, longitude double, neighborhood string, county string"
)

# Flat scraped record, the union of what every source yields.
SCRAPED = (
    "ingest_seq bigint, external_id string, data_source string, listing_url string,"
    " property_name string, street_address string, city string, state string, zip_code string,"
    " neighborhood string, county string, latitude double, longitude double,"
    " listing_status string, description string, price double, rent_estimate double,"
    " price_per_sqft double, bedrooms double, bathrooms double, square_feet double,"
    " year_built double, lot_size double, stories double, garage_spaces int,"
    " days_on_market int, mls_number string, rating double, zestimate double,"
    " property_type int, pool boolean, fireplace boolean, available_now boolean,"
    " features map<string,string>, images array<string>, scraped_at timestamp"
)

SCRAPE_JOBS = (
    "job_id string, data_source string, status string, search_criteria string, max_pages int,"
    " max_results int, pages_scraped int, properties_found int, properties_saved int,"
    " errors_count int, started_at timestamp, completed_at timestamp, estimated_duration int,"
    " error_message string, results_summary string, created_by string,"
    " created_at timestamp, updated_at timestamp"
)

SCRAPE_RESULTS = (
    "id bigint, job_id string, data_source string, source_url string, external_id string,"
    " raw_data string, processed_data string, is_processed boolean, is_saved_to_db boolean,"
    " processing_errors string, data_completeness_score int, confidence_score int,"
    " scraped_at timestamp, processed_at timestamp, created_at timestamp, updated_at timestamp"
)

METRIC_POINTS = (
    "name string, kind string, ts timestamp, seq bigint, value double, tags map<string,string>"
)

TABLES = {
    "properties": PROPERTIES,
    "property_listings": PROPERTY_LISTINGS,
    "property_metrics": PROPERTY_METRICS,
    "locations": LOCATIONS,
    "scraped": SCRAPED,
    "scrape_jobs": SCRAPE_JOBS,
    "scrape_results": SCRAPE_RESULTS,
    "metric_points": METRIC_POINTS,
}


def schema_of(table: str) -> T.StructType:
    """Declared schema of a table as a ``StructType``."""
    return _struct(TABLES[table])
