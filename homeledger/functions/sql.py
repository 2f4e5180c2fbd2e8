"""SQL-surface functions for use in ``spark.sql``."""

from __future__ import annotations

from pyspark.sql import SparkSession

_FUNCTIONS = [
    """
    CREATE OR REPLACE TEMPORARY FUNCTION calculate_distance(
        lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE
    RETURN 6371D * 2D * asin(sqrt(
        pow(sin(radians(lat2 - lat1) / 2), 2)
        + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)))
    """,
    """
    CREATE OR REPLACE TEMPORARY FUNCTION generate_property_hash(
        street STRING, city STRING, state STRING, zip STRING) RETURNS STRING
    RETURN md5(lower(trim(concat_ws('|', coalesce(street, ''), coalesce(city, ''),
        coalesce(state, ''), coalesce(zip, '')))))
    """,
]


def register(spark: SparkSession) -> None:
    """Create ``calculate_distance`` and ``generate_property_hash`` in the session."""
    for statement in _FUNCTIONS:
        spark.sql(statement)
