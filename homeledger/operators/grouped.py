"""Grouped building blocks that stay balanced when one key holds most rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Log-scale buckets per e-fold used to narrow a quantile down to a small value range.
_BUCKETS_PER_E = 256


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first ``k`` rows of each group in the given order.

    For ``k`` up to ``spark.sql.optimizer.windowGroupLimitThreshold`` Spark keeps only ``k``
    rows per group and map task before the shuffle. For many rows of a time series use
    :func:`newest_per_group`.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def newest_per_group(
    df: DataFrame, keys: list[str], ts: str, tie: str, k: int, slice_by: str = "hour"
) -> DataFrame:
    """The newest ``k`` rows of each group by ``(ts, tie)``, for any ``k``; rows without ``ts`` come last.

    Rows are counted per time slice, which shows the slice that holds rank ``k``; only rows
    from that slice on are shuffled and ranked. The work follows ``k``, not the table.
    """
    at = F.date_trunc(slice_by, F.col(ts))
    slices = df.groupBy(*keys, at.alias("_slice")).agg(F.count("*").alias("_n"))
    newer = Window.partitionBy(*keys).orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    cuts = (
        slices.withColumn("_before", F.coalesce(F.sum("_n").over(newer), F.lit(0)))
        .filter(F.col("_before") < k)
        .groupBy(*keys)
        .agg(F.min("_slice").alias("_from"), F.max(F.col("_slice").isNull()).alias("_all"))
    )
    same = reduce(lambda a, b: a & b, [F.col(f"d.{c}").eqNullSafe(F.col(f"c.{c}")) for c in keys])
    left = df.alias("d").join(cuts.alias("c"), same).filter((at >= F.col("_from")) | F.col("_all"))
    return top_per_group(left.select("d.*"), keys, [F.desc(ts), F.desc(tie)], k)


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``(keys, _v, _n)``: how often each value occurs in its group; null keys and values take no part."""
    v = F.col(value).cast("double")
    given = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return df.filter(given & v.isNotNull()).groupBy(*keys, v.alias("_v")).agg(F.count("*").alias("_n"))


def counts_at_ranks(
    counts: DataFrame, keys: list[str], ranks: dict[str, Callable[[Column], Column]]
) -> DataFrame:
    """``(keys, <name> ...)``: the value at a rank of each group of :func:`value_counts`, ascending from 0.

    ``ranks`` maps an output name to a function from the group's count to the rank. The
    counts are summed per coarse log-scale bucket, which shows the buckets holding the
    ranks, and only the values of those buckets are then ordered. No task ever sees a whole group.
    """
    counts = counts.withColumn(
        "_b", (F.signum("_v") * F.floor(F.log(1.0 + F.abs("_v")) * _BUCKETS_PER_E)).cast("int")
    )
    by_bucket = counts.groupBy(*keys, "_b").agg(F.sum("_n").alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("_b")
    total = F.sum("_n").over(Window.partitionBy(*keys))
    placed = by_bucket.select(
        *keys, "_b", F.sum("_n").over(upto).alias("_end"), "_n", total.alias("_total")
    ).select(
        *keys, "_b", "_end", (F.col("_end") - F.col("_n")).alias("_before"),
        *[rank(F.col("_total")).cast("long").alias(f"_rank_{name}") for name, rank in ranks.items()],
    )
    holds = [
        (F.col(f"_rank_{name}") < F.col("_end")) & (F.col(f"_rank_{name}") >= F.col("_before"))
        for name in ranks
    ]
    middle = placed.filter(reduce(lambda a, b: a | b, holds)).drop("_end")
    in_bucket = Window.partitionBy(*keys, "_b").orderBy("_v")
    ranked = (
        counts.join(middle, [*keys, "_b"])
        .withColumn("_end", F.col("_before") + F.sum("_n").over(in_bucket))
        .withColumn("_start", F.col("_end") - F.col("_n"))
    )

    def at(name: str) -> Column:
        rank = F.col(f"_rank_{name}")
        return F.max(F.when((rank >= F.col("_start")) & (rank < F.col("_end")), F.col("_v")))

    return ranked.groupBy(*keys).agg(*[at(name).alias(name) for name in ranks])


def values_at_ranks(
    df: DataFrame, key: str, value: str, ranks: dict[str, Callable[[Column], Column]]
) -> DataFrame:
    """``(key, <name> ...)``: the value at a rank of each group; equal values are counted first."""
    return counts_at_ranks(value_counts(df, [key], value), [key], ranks)


def group_median(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Exact interpolated median of ``value`` per ``key`` as ``(key, out)``."""
    ends = {"_a": lambda n: F.floor((n - 1) / 2), "_z": lambda n: F.floor(n / 2)}
    found = values_at_ranks(df, key, value, ends)
    return found.select(key, (F.col("_a") + (F.col("_z") - F.col("_a")) * 0.5).alias(out))


def previous_in_group(
    df: DataFrame, keys: list[str], ts: str, tie: str, value: str, out: str, slice_by: str = "month"
) -> DataFrame:
    """Value of the preceding row of the group (a skew-safe ``lag``).

    Order is ``(ts, tie)``. Each group is cut into time slices, so a hot group is
    spread over tasks; the first row of a slice takes the last value of the
    slice before. Adds ``out`` and ``<out>_exists`` (false on a group's first row).
    """
    sliced = df.withColumn("_slice", F.date_trunc(slice_by, F.col(ts)))
    order = F.struct(ts, tie)
    w = Window.partitionBy(*keys, "_slice").orderBy(ts, tie)
    inner = sliced.withColumn("_prev", F.lag(value).over(w)).withColumn(
        "_rn", F.row_number().over(w)
    )
    before = Window.partitionBy(*keys).orderBy("_slice")
    edges = (
        sliced.groupBy(*keys, "_slice")
        .agg(F.max(F.struct(order.alias("o"), F.col(value).alias("v"))).alias("_last"))
        .select(
            *keys,
            "_slice",
            F.lag("_last.v").over(before).alias("_edge"),
            (F.row_number().over(before) > 1).alias("_has_edge"),
        )
    )
    first = F.col("_rn") == 1
    return (
        inner.join(edges, [*keys, "_slice"])
        .withColumn(out, F.when(first, F.col("_edge")).otherwise(F.col("_prev")))
        .withColumn(f"{out}_exists", ~first | F.col("_has_edge"))
        .drop("_slice", "_prev", "_rn", "_edge", "_has_edge")
    )
