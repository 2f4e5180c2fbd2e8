"""Places and prefix sums over a whole table, by a distributed sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from homeledger.session import materialize


def _sorted(df: DataFrame, order: list[Column], label: str) -> DataFrame:
    """The stored table in range partitions, each sorted: ``_part`` and ``_mono``, ascending with ``order``."""
    stored = materialize(df.orderBy(*order).withColumn("_mono", F.monotonically_increasing_id()), label)
    return stored.withColumn("_part", F.shiftright("_mono", 33))


def prefix_sums(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, label: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the earlier rows, by ``order``, with the same ``keys``.

    ``keys`` hold no nulls. Rows are range-sorted and stored; sums per sort partition and key are few and are
    added up first, then each partition adds up its own rows. A key of any size is spread over its partitions.
    """
    rows = _sorted(df, [F.col(c) for c in (*keys, *order)], label)
    sums = rows.groupBy("_part", *keys).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_part", *keys, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_part", *keys).orderBy("_mono").rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("_local", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return local.join(before, ["_part", *keys]).withColumn(out, F.col("_before") + F.col("_local")).drop(
        "_part", "_mono", "_before", "_local"
    )


def numbered(df: DataFrame, order: list[Column], out: str, label: str) -> DataFrame:
    """Adds ``out``: each row's place, from 0, in the order of the whole table.

    One row per sort partition is added up in one task; the rows themselves stay where the sort put them.
    """
    rows = _sorted(df, order, label)
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_mono").alias("_first"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(
        "_part", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift")
    )
    return rows.join(before, "_part").withColumn(out, F.col("_mono") + F.col("_shift")).drop("_part", "_mono", "_shift")
