"""Metric aggregation over a ``metric_points`` table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from homeledger.operators.grouped import counts_at_ranks, newest_per_group, value_counts
from homeledger.session import materialize

# --- fixed values ---------------------------------------------------------------
RETENTION_HOURS = 24
# --------------------------------------------------------------------------------

NEWEST = ["ts", "seq"]


def tag_key(name: Column, tags: Column) -> Column:
    """``name|k=v,...`` with the tags sorted by key; just the name without tags."""
    entries = F.array_sort(F.map_entries(tags))
    text = F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return F.when(F.coalesce(F.size(tags), F.lit(0)) > 0, F.concat_ws("|", name, text)).otherwise(
        name
    )


def parse_tags(text: Column) -> Column:
    """``a=1,b=x=y`` to a map, cut at the first ``=``; parts without one are skipped.

    A key that occurs twice keeps its last value.
    """
    parts = F.filter(F.split(text, ",", -1), lambda p: p.contains("="))
    keys = F.array_distinct(F.transform(parts, lambda p: F.substring_index(p, "=", 1)))

    def last_value(k):
        same = F.filter(parts, lambda p: F.substring_index(p, "=", 1) == k)
        last = F.element_at(same, -1)
        return F.struct(k, F.substring(last, F.length(k) + 2, F.length(last)))

    return F.map_from_entries(F.transform(keys, last_value))


def with_key(points: DataFrame) -> DataFrame:
    return points.withColumn("key", tag_key(F.col("name"), F.col("tags")))


def counters(points: DataFrame) -> DataFrame:
    return with_key(points).groupBy("key").agg(F.sum("value").alias("value"))


def gauges(points: DataFrame) -> DataFrame:
    return with_key(points).groupBy("key").agg(F.max_by("value", F.struct(*NEWEST)).alias("value"))


def histogram_values(points: DataFrame, keep: int | None = None) -> DataFrame:
    """The values of a histogram per key: all of them, or the newest ``keep``."""
    keyed = with_key(points)
    return keyed if keep is None else newest_per_group(keyed, ["key"], *NEWEST, keep)


def rank_percentile(p: float):
    """Rank ``int(p * (n - 1))`` of a group of ``n`` values."""
    return lambda n: F.floor(F.lit(p) * (n - 1))


PERCENTILES = {"p50": rank_percentile(0.5), "p95": rank_percentile(0.95), "p99": rank_percentile(0.99)}


def stats_of_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Count, min, max, mean and percentiles per group of value counts (``keys, _v, _n``)."""
    n = F.sum("_n")
    plain = counts.groupBy(*keys).agg(
        n.alias("count"), F.min("_v").alias("min"), F.max("_v").alias("max"),
        (F.sum(F.col("_v") * F.col("_n")) / n).alias("mean"),
    )
    return plain.join(counts_at_ranks(counts, keys, PERCENTILES), keys)


def histogram_stats(points: DataFrame, keep: int | None = None) -> DataFrame:
    """Count, min, max, mean and percentiles per key, of all values or of the newest ``keep`` (an action).

    Equal values are counted once and stored; every figure comes from those counts. Null values
    count for nothing.
    """
    counts = value_counts(histogram_values(points, keep), ["key"], "value")
    return stats_of_counts(materialize(counts, "histogram-counts"), ["key"])


def stats_for(keys: DataFrame, points: DataFrame, keep: int | None = None) -> DataFrame:
    """Histogram statistics for the asked keys, zeros where a key has no values."""
    found = keys.select("key").distinct().join(histogram_stats(points, keep), "key", "left")
    return found.na.fill(0)


def look_back(points: DataFrame, name: str, as_of: Column, hours: int = 1) -> DataFrame:
    cutoff = as_of - F.expr(f"INTERVAL {int(hours)} HOURS")
    return points.filter((F.col("name") == name) & (F.col("ts") >= cutoff))


def retain(points: DataFrame, as_of: Column, hours: int = RETENTION_HOURS) -> DataFrame:
    """Points within the retention time; names without any vanish by themselves."""
    return points.filter(F.col("ts") >= as_of - F.expr(f"INTERVAL {int(hours)} HOURS"))


def newest_points(points: DataFrame, keep: int) -> DataFrame:
    return newest_per_group(points, ["name"], *NEWEST, keep)


def snapshot(points: DataFrame, keep: int | None = None) -> DataFrame:
    """Long table of everything current: ``kind, key, stat, value`` (an action)."""
    def of(kind: str) -> DataFrame:
        return points.filter(F.col("kind") == kind)

    def flat(df: DataFrame, kind: str) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), "key", F.lit("value").alias("stat"), "value")

    stats = ["count", "min", "max", "mean", "p50", "p95", "p99"]
    pairs = F.array(
        *[F.struct(F.lit(s).alias("stat"), F.col(s).cast("double").alias("value")) for s in stats]
    )
    histograms = (
        histogram_stats(of("histogram"), keep)
        .select(F.lit("histogram").alias("kind"), "key", F.explode(pairs).alias("p"))
        .select("kind", "key", "p.stat", "p.value")
    )
    return (
        flat(counters(of("counter")), "counter")
        .unionByName(flat(gauges(of("gauge")), "gauge"))
        .unionByName(histograms)
    )


def read_values(keys: DataFrame, values: DataFrame) -> DataFrame:
    """Counter or gauge values for the asked keys, 0 where unknown."""
    return keys.join(values, "key", "left").withColumn(
        "value", F.coalesce(F.col("value"), F.lit(0.0))
    )


def lifecycle(
    runs: DataFrame, prefix: str, subject: str = "name", keep: int | None = None
) -> DataFrame:
    """Started, completed and failed counts and duration statistics per subject.

    ``runs`` has one row per run: ``name``, ``outcome`` (``completed``, ``failed`` or
    null while running), ``duration``, ``ts`` and ``seq``. All runs count; ``keep`` limits the
    durations to the newest of a subject.
    """
    ended = runs.filter(F.col("outcome").isNotNull()).select(
        F.col(subject).alias("name"), "ts", "seq", F.col("duration").alias("value"),
        F.lit(None).cast("map<string,string>").alias("tags"),
    )
    counts = runs.groupBy(F.col(subject).alias("key")).agg(
        F.count("*").alias("started"),
        F.count_if(F.col("outcome") == "completed").alias("completed"),
        F.count_if(F.col("outcome") == "failed").alias("failed"),
    )
    durations = histogram_stats(ended, keep).select(
        "key", F.col("count").alias("timed"), F.col("mean").alias("duration_mean"),
        F.col("p95").alias("duration_p95"),
    )
    return counts.join(durations, "key", "left").withColumn("metric", F.lit(prefix))


def record_counters(audit: DataFrame) -> DataFrame:
    """Processed, saved and error totals over the audit rows of many batches."""
    return audit.agg(
        F.sum("processed").alias("etl.records.processed"),
        F.sum("saved").alias("etl.records.saved"),
        F.sum("error_count").alias("etl.records.errors"),
    )


def daily(points: DataFrame) -> DataFrame:
    """Per day and name: count, sum, min, max and mean."""
    return points.groupBy(F.date_trunc("day", "ts").alias("day"), "name").agg(
        F.count("*").alias("n"),
        F.sum("value").alias("total"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.avg("value").alias("mean"),
    )
