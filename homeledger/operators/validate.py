"""Rule-based validation and quality scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from homeledger.schema import DATA_SOURCES, LISTING_STATUSES, PROPERTY_TYPES

# Fields counted for completeness.
COMPLETENESS_FIELDS = [
    "street_address", "city", "state", "zip_code", "price", "bedrooms", "bathrooms",
    "square_feet", "property_type", "year_built",
]


def default_rules(columns: list[str]) -> dict[str, Column]:
    """Message -> "row breaks the rule", for the columns that exist. Null never breaks a bound."""
    has = set(columns)
    rules: dict[str, Column] = {}
    keys = [c for c in ("street_address", "address", "external_id") if c in has]
    if keys:
        blank = [F.trim(F.coalesce(F.col(c), F.lit(""))) == "" for c in keys]
        missing = blank[0]
        for b in blank[1:]:
            missing = missing & b
        rules["no address and no external_id"] = missing
    for c in ("price", "square_feet", "bedrooms", "bathrooms"):
        if c in has:
            rules[f"{c} is negative"] = F.col(c) < 0
    for c, bound in (("latitude", 90), ("longitude", 180)):
        if c in has:
            rules[f"{c} out of range"] = F.abs(F.col(c)) > bound
    for c, allowed in (
        ("property_type", list(PROPERTY_TYPES.values())),
        ("data_source", DATA_SOURCES),
        ("listing_status", LISTING_STATUSES),
    ):
        if c in has:
            rules[f"{c} is unknown"] = ~F.col(c).isin(allowed)
    return rules


def with_errors(df: DataFrame, rules: dict[str, Column] | None = None) -> DataFrame:
    """Adds ``errors``, the messages of the rules the row breaks (empty = valid)."""
    rules = default_rules(df.columns) if rules is None else rules
    found = F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(m)) for m, bad in rules.items()])
    return df.withColumn("errors", F.array_compact(found))


def split_valid(df: DataFrame, rules: dict[str, Column] | None = None):
    """``(valid rows, invalid rows with their errors)``, two lazy filters over one input."""
    checked = with_errors(df, rules)
    return (
        checked.filter(F.size("errors") == 0).drop("errors"),
        checked.filter(F.size("errors") > 0),
    )


def error_report(invalid: DataFrame, row_key: str = "ingest_seq") -> DataFrame:
    """One row per broken rule: ``Row <key>: <message>``."""
    return invalid.select(F.col(row_key), F.explode("errors").alias("error")).withColumn(
        "message", F.format_string("Row %s: %s", F.col(row_key).cast("string"), F.col("error"))
    )


def with_completeness(df: DataFrame, fields: list[str] = COMPLETENESS_FIELDS) -> DataFrame:
    filled = sum((F.when(F.col(f).isNotNull(), 1).otherwise(0) for f in fields), F.lit(0))
    return df.withColumn(
        "data_completeness_score", F.floor(filled * 100 / len(fields)).cast("int")
    )


def with_confidence(df: DataFrame, rules: dict[str, Column] | None = None) -> DataFrame:
    """Share of rules that hold, 0 to 100."""
    rules = default_rules(df.columns) if rules is None else rules
    passed = sum(
        (F.when(F.coalesce(bad, F.lit(False)), 0).otherwise(1) for bad in rules.values()),
        F.lit(0),
    )
    return df.withColumn("confidence_score", F.floor(passed * 100 / len(rules)).cast("int"))


def quality_rates(df: DataFrame, rules: dict[str, Column] | None = None) -> DataFrame:
    """One row: total, valid and invalid counts, error count, share of valid rows."""
    n_errors = F.size("errors")
    return with_errors(df, rules).agg(
        F.count("*").alias("total_records"),
        F.count_if(n_errors == 0).alias("valid_records"),
        F.count_if(n_errors > 0).alias("invalid_records"),
        F.coalesce(F.sum(n_errors), F.lit(0)).alias("error_count"),
        F.coalesce(
            F.try_divide(F.count_if(n_errors == 0), F.count("*")), F.lit(0.0)
        ).alias("validation_rate"),
    )


def first_errors(invalid: DataFrame, n: int, row_key: str = "ingest_seq") -> DataFrame:
    """The first ``n`` error lines in row order (a top-k, not a full sort)."""
    return error_report(invalid, row_key).orderBy(row_key, "error").limit(n)
