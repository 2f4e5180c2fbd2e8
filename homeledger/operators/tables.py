"""Batch table maintenance: each function returns the new version of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from homeledger.functions import address
from homeledger.operators.clean import coerce_types
from homeledger.operators.dedup import ADDRESS_KEYS, accept_new, resolve_locations
from homeledger.schema import schema_of


def insert_properties(new: DataFrame, properties: DataFrame, locations: DataFrame):
    """``(property rows to append, location rows to append)`` (actions).

    Known ``(external_id, data_source)`` pairs are left out. Location ids come from the address; one that is
    taken already gives way to another. Of stored locations with one address the smallest id counts.
    """
    accepted, _ = accept_new(new, properties)
    new_locations = resolve_locations(accepted, locations)
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"l.{c}")) for c in ADDRESS_KEYS]
    stored = locations.groupBy(*ADDRESS_KEYS).agg(F.min("id").alias("id"))
    known = stored.unionByName(new_locations.select(*stored.columns)).alias("l")
    rows = accepted.alias("a").join(known, same, "left").select("a.*", F.col("l.id").alias("location_id"))
    return rows, new_locations


def last_per_key(changes: DataFrame, key: str, fields: list[str], order: str | None) -> DataFrame:
    """One row per key: the change with the greatest ``order``; ties, or no order, by value."""
    row = F.struct(*fields)
    rank = row if order is None else F.struct(F.col(order), row)
    return changes.groupBy(key).agg(F.max_by(row, rank).alias("_last")).select(key, "_last.*")


def update_rows(
    table: DataFrame, updates: DataFrame, key: str, now: Column, fields: list[str],
    order: str | None = None,
) -> DataFrame:
    """Partial update by key.

    ``updates`` has a ``set_fields`` array naming what it sets (so a field can be set
    to null), and the new values. Of several changes to a key the last one by ``order``
    counts. ``updated_at`` moves on every touched row.
    """
    last = last_per_key(updates, key, ["set_fields", *fields], order)
    u = last.select(key, "set_fields", *[F.col(f).alias(f"_new_{f}") for f in fields])
    joined = table.join(u, key, "left")
    changed = {
        f: F.when(F.array_contains("set_fields", f), F.col(f"_new_{f}")).otherwise(F.col(f))
        for f in fields
    }
    stamp = F.when(F.col("set_fields").isNotNull(), now).otherwise(F.col("updated_at"))
    return joined.withColumns({**changed, "updated_at": stamp}).select(*table.columns)


def delete_rows(table: DataFrame, ids: DataFrame, key: str = "property_id") -> DataFrame:
    return table.join(ids.select(key), key, "left_anti")


def delete_properties(ids: DataFrame, properties, listings, metrics):
    """Delete from the property table and, cascading, its listings and metrics."""
    return tuple(delete_rows(t, ids) for t in (properties, listings, metrics))


def upsert_metrics(
    metrics: DataFrame, changes: DataFrame, now: Column, fields: list[str],
    order: str | None = None,
) -> DataFrame:
    """Create or update by property: one full outer join on the key.

    Fields a change leaves null keep their old value; ``updated_at`` moves on
    updated rows, new rows get both stamps. Of several changes to a property the last
    one by ``order`` counts.
    """
    c = last_per_key(changes, "property_id", fields, order).select(
        "property_id", F.lit(True).alias("_c"), *[F.col(f).alias(f"_new_{f}") for f in fields]
    )
    m = metrics.withColumn("_m", F.lit(True))
    both = m.join(c, "property_id", "full_outer")
    out = {f: F.coalesce(F.col(f"_new_{f}"), F.col(f)) for f in fields}
    out["created_at"] = F.when(F.col("_m").isNull(), now).otherwise(F.col("created_at"))
    out["updated_at"] = F.when(F.col("_c"), now).otherwise(F.col("updated_at"))
    return both.withColumns(out).select(*metrics.columns)


def append_rows(table: DataFrame, new: DataFrame) -> DataFrame:
    return table.unionByName(new, allowMissingColumns=True)


def denormalise_locations(properties: DataFrame, locations: DataFrame) -> DataFrame:
    """Copy address columns from locations onto properties and drop ``location_id``.

    Properties without a matching location keep their own values. Of rows stored under
    one location id the smallest, by value, counts.
    """
    stored = F.struct(*[F.col(c) for c in locations.columns if c != "id"])
    locations = locations.groupBy("id").agg(F.min(stored).alias("_row")).select("id", "_row.*")
    loc = locations.select(
        F.col("id").alias("location_id"),
        F.lit(True).alias("_l"),
        F.col("street_address").alias("_address"),
        *[F.col(c).alias(f"_{c}") for c in ("city", "state", "zip_code", "latitude", "longitude")],
        F.coalesce("country", F.lit("US")).alias("_country_code"),
        address.location_text(
            F.col("street_address"), F.col("city"), F.col("state"), F.col("zip_code")
        ).alias("_location"),
    )
    copied = [
        "address", "city", "state", "zip_code", "country_code", "latitude", "longitude", "location",
    ]
    joined = properties.join(loc, "location_id", "left")
    out = {c: F.when(F.col("_l"), F.col(f"_{c}")).otherwise(F.col(c)) for c in copied}
    kept = [c for c in properties.columns if c != "location_id"]
    return joined.withColumns(out).select(*kept)


def upgrade_schema(old: DataFrame) -> DataFrame:
    """Old property layout to the declared one: rename the id, add missing columns, retype.

    Running it on an upgraded table changes nothing.
    """
    if "property_id" not in old.columns and "id" in old.columns:
        old = old.withColumnRenamed("id", "property_id")
    fields = schema_of("properties").fields
    missing = {f.name: F.lit(None).cast(f.dataType) for f in fields if f.name not in old.columns}
    full = old.withColumns(missing) if missing else old
    return coerce_types(full.select(*[f.name for f in fields]))


def since(df: DataFrame, ts: str, from_: Column) -> DataFrame:
    """Rows of ``ts`` from a time on; a table clustered by ``ts`` opens the folders of those days only."""
    day = f"{ts}_day"
    recent = df.filter(F.col(ts) >= from_)
    return recent.filter(F.col(day) >= F.to_date(from_)) if day in df.columns else recent


def before(df: DataFrame, ts: str, until: Column) -> DataFrame:
    """Rows of ``ts`` before a time; a table clustered by ``ts`` opens the folders up to that day only."""
    day = f"{ts}_day"
    old = df.filter(F.col(ts) < until)
    return old.filter(F.col(day) <= F.to_date(until)) if day in df.columns else old


def retain_days(df: DataFrame, ts: str, as_of: Column, days: int = 90) -> DataFrame:
    """Rows newer than the retention limit; on a table clustered by ``ts`` this prunes folders."""
    return since(df, ts, as_of - F.expr(f"INTERVAL {int(days)} DAYS"))
