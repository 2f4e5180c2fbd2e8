"""Exact deduplication by address fingerprint, across runs through a state table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from homeledger.functions import address
from homeledger.operators.grouped import top_per_group
from homeledger.session import materialize

ADDRESS_KEYS = ["street_address", "city", "state", "zip_code"]


def with_fingerprint(df: DataFrame, out: str = "fp") -> DataFrame:
    return df.withColumn(out, address.fingerprint(*[F.col(c) for c in ADDRESS_KEYS]))


def with_property_hash(df: DataFrame, out: str = "property_hash") -> DataFrame:
    return df.withColumn(out, address.property_hash(*[F.col(c) for c in ADDRESS_KEYS]))


def _blank_address():
    blank = F.lit(True)
    for c in ADDRESS_KEYS:
        blank = blank & (F.trim(F.coalesce(F.col(c), F.lit(""))) == "")
    return blank


def deduplicate(
    df: DataFrame,
    seen: DataFrame | None = None,
    order: str = "ingest_seq",
    keep_blank: bool = False,
) -> DataFrame:
    """Keep the first row of each fingerprint that earlier runs have not seen.

    ``seen`` holds the ``fp`` values of earlier runs. Rows without any address
    share one fingerprint and collapse to one row; ``keep_blank=True`` keeps them all.
    """
    return deduplicate_keyed(with_fingerprint(df), seen, order, keep_blank)


def deduplicate_keyed(
    keyed: DataFrame, seen: DataFrame | None = None, order: str = "ingest_seq", keep_blank: bool = False
) -> DataFrame:
    """:func:`deduplicate` of rows that have their fingerprint ``fp`` already."""
    blanks = None
    if keep_blank:
        blanks = keyed.filter(_blank_address())
        keyed = keyed.filter(~_blank_address())
    firsts = top_per_group(keyed, ["fp"], [F.col(order)])
    if seen is not None:
        firsts = firsts.join(seen.select("fp"), "fp", "left_anti")
    return firsts if blanks is None else firsts.unionByName(blanks)


def deduplication_summary(total: DataFrame, unique: DataFrame) -> DataFrame:
    """One row: input, unique and duplicate counts and the duplicate rate."""
    counts = total.select(F.lit(1).alias("n"), F.lit(0).alias("u")).unionAll(
        unique.select(F.lit(0).alias("n"), F.lit(1).alias("u"))
    )
    n, u = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("u"), F.lit(0))
    return counts.agg(n.alias("input_records"), u.alias("unique_records")).select(
        "input_records",
        "unique_records",
        (F.col("input_records") - F.col("unique_records")).alias("duplicates"),
        F.coalesce(
            F.try_divide(F.col("input_records") - F.col("unique_records"), F.col("input_records")),
            F.lit(0.0),
        ).alias("duplication_rate"),
    )


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """Whole-row duplicate removal; map columns compare by their sorted entries."""
    maps = [f.name for f in df.schema.fields if isinstance(f.dataType, T.MapType)]
    if not maps:
        return df.dropDuplicates()
    types = {m: df.schema[m].dataType for m in maps}
    as_entries = {m: F.array_sort(F.map_entries(m)) for m in maps}
    back = {m: F.map_from_entries(m).cast(types[m]) for m in maps}
    return df.withColumns(as_entries).dropDuplicates().withColumns(back)


def new_locations(df: DataFrame, existing: DataFrame) -> DataFrame:
    """Addresses that are not in ``existing`` yet, one row each."""
    new = df.select(*ADDRESS_KEYS).distinct()
    same = [F.col(f"n.{c}").eqNullSafe(F.col(f"e.{c}")) for c in ADDRESS_KEYS]
    return new.alias("n").join(existing.select(*ADDRESS_KEYS).alias("e"), same, "left_anti")


def resolve_locations(
    df: DataFrame, existing: DataFrame, id_of: Callable[[int], Column] | None = None
) -> DataFrame:
    """Address rows that are not in ``existing`` yet, one each, with ids of their own (actions).

    Ids come from the address itself, so reruns agree and no global counter is needed. Ids that are stored
    stay. Of new addresses that ask for one free id the smallest, by value, has it; the others, and those whose id
    is taken, ask again with the next turn of the hash, in rounds over them alone. The result depends on the sets of
    addresses only, not on their order. ``id_of`` makes the id of a turn.
    """
    if id_of is None:
        id_of = lambda turn: address.location_id(*[F.col(c) for c in ADDRESS_KEYS], turn=turn)
    given = F.struct(*ADDRESS_KEYS)
    # Addresses stored without ids take none.
    ids = F.col("id") if "id" in existing.columns else F.lit(None).cast("bigint")
    taken = existing.select(ids.alias("id")).distinct()
    asking, out, turn = new_locations(df, existing), None, 0
    while True:
        asked = materialize(asking.select(id_of(turn).alias("id"), *ADDRESS_KEYS), "locations-asked")
        if asked.isEmpty() and out is not None:
            return out
        first = asked.join(taken, "id", "left_anti").groupBy("id").agg(F.min(given).alias("_first"))
        winners = materialize(first.select("id", "_first.*"), "locations-won")
        out = winners if out is None else out.union(winners)
        taken = taken.union(winners.select("id"))
        won = winners.select("id", given.alias("_won"))
        asking = asked.join(won, "id", "left").filter(
            F.col("_won").isNull() | ~given.eqNullSafe(F.col("_won"))
        ).select(*ADDRESS_KEYS)
        turn += 1


def location_id_collisions(locations: DataFrame) -> DataFrame:
    """Ids shared by several stored addresses; :func:`resolve_locations` adds none."""
    return locations.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")


def accept_new(df: DataFrame, existing: DataFrame):
    """``(accepted, rejected)`` by whether ``(external_id, data_source)`` exists already.

    Within the batch the first row of a key wins; later ones are rejected too.
    """
    keys = ["external_id", "data_source"]
    known = existing.select(*keys)
    fresh = df.join(known, keys, "left_anti")
    accepted = top_per_group(fresh, keys, [F.col("ingest_seq")])
    rejected = df.join(accepted.select("ingest_seq"), "ingest_seq", "left_anti")
    return accepted, rejected
