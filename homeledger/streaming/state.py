"""Structured Streaming forms of the operators that keep state across batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from homeledger.operators.alerts import AlertRule, evaluate, step
from homeledger.operators.clean import transform_properties
from homeledger.operators.dedup import with_fingerprint
from homeledger.operators.jobs import ENDED
from homeledger.operators.metrics import stats_of_counts
from homeledger.operators.validate import split_valid
from homeledger.session import scratch_path, ship_package


def landed(
    spark: SparkSession, path: str, schema, only: str = "*.parquet", files_per_batch: int = 1000
) -> DataFrame:
    """Stream of parquet files as they land in a folder, a bounded number per batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", only)
    return reader.option("maxFilesPerTrigger", files_per_batch).parquet(path)


def first_seen(stream: DataFrame, horizon: str | None = None, ts: str | None = None) -> DataFrame:
    """First row of each address fingerprint.

    Without a horizon the state keeps every fingerprint for ever; with one, a
    fingerprint may come back after that time, unless the stream is run by :func:`run_first_seen`, which
    also knows what has left the state.
    """
    keyed = with_fingerprint(stream)
    if horizon is None:
        return keyed.dropDuplicates(["fp"])
    timed = keyed.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, horizon)
    return timed.dropDuplicatesWithinWatermark(["fp"])


def process_records(
    stream: DataFrame, processed_at: Column | None = None,
    horizon: str | None = None, ts: str | None = None,
) -> DataFrame:
    """Per-record chain: validate, transform, drop known addresses. No enrichment here.

    ``horizon`` bounds the state as in :func:`first_seen`.
    """
    valid, _ = split_valid(stream)
    return first_seen(transform_properties(valid, processed_at), horizon, ts)


def _timed(points: DataFrame, delay: str) -> DataFrame:
    return points.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


WINDOW = ["window_start", "window_end"]


def windowed_metrics(
    points: DataFrame, width: str = "1 hour", delay: str = "24 hours", slide: str | None = None
) -> DataFrame:
    """Counts, sums, extremes and the last value per window and name.

    The watermark is the retention time: older windows leave the state. With a ``slide`` the points are summed up once
    per pane of that length, and a second window over the panes adds up those it spans;
    such a stream gives closed windows only (append mode). :func:`sliding` does the same to stored panes.
    """
    panes = _panes(_timed(points, delay), slide or width)
    if slide is None:
        return panes.select(*_window("w"), "name", *_PANE_VALUES, F.col("last.value").alias("last"))
    return _over_panes(panes.withColumn("at", F.window_time("w")), width, slide)


_PANE_VALUES = ["n", "total", "min", "max"]


def _window(w: str) -> list[Column]:
    return [F.col(f"{w}.start").alias(WINDOW[0]), F.col(f"{w}.end").alias(WINDOW[1])]


def _panes(points: DataFrame, width: str) -> DataFrame:
    return points.groupBy(F.window("ts", width).alias("w"), "name").agg(
        F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("min"),
        F.max("value").alias("max"), F.max(F.struct("ts", "seq", "value")).alias("last"),
    )


def _over_panes(panes: DataFrame, width: str, slide: str) -> DataFrame:
    return (
        panes.groupBy(F.window("at", width, slide).alias("v"), "name")
        .agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("min").alias("min"),
             F.max("max").alias("max"), F.max("last").alias("last"))
        .select(*_window("v"), "name", *_PANE_VALUES, F.col("last.value").alias("last"))
    )


def pane_metrics(points: DataFrame, pane: str = "5 minutes", delay: str = "24 hours") -> DataFrame:
    """Partial figures per pane and name, from which :func:`sliding` makes windows of several panes."""
    panes = _panes(_timed(points, delay), pane)
    return panes.select(*_window("w"), "name", *_PANE_VALUES, "last")


def sliding(panes: DataFrame, width: str = "1 hour", slide: str = "5 minutes") -> DataFrame:
    """Windows over the rows of :func:`pane_metrics`: each pane, not each point, counts in several."""
    return _over_panes(panes.withColumn("at", F.col("window_start")), width, slide)


def windowed_values(points: DataFrame, width: str = "1 hour", delay: str = "24 hours") -> DataFrame:
    """How often each value occurs per window and name: the state that exact percentiles need.

    Counts merge, and equal values take one entry. A window's rows leave the state, together, when the
    watermark closes it. Null values count for nothing.
    """
    timed = _timed(points, delay).filter(F.col("value").isNotNull() & F.col("name").isNotNull())
    counts = timed.groupBy(F.window("ts", width).alias("w"), "name", F.col("value").cast("double").alias("_v"))
    return counts.agg(F.count("*").alias("_n")).select(*_window("w"), "name", "_v", "_n")


def window_stats(counts: DataFrame) -> DataFrame:
    """Count, min, max, mean and exact p50, p95 and p99 of the closed windows of :func:`windowed_values`.

    For the table, or for each micro-batch (``run_to_end(..., each=window_stats)``), as a window closes in one.
    """
    return stats_of_counts(counts, [*WINDOW, "name"])


def job_state(events: DataFrame) -> DataFrame:
    """Running fold of job status events (update mode)."""
    order = F.struct("ts", "seq")
    return events.groupBy("job_id").agg(
        F.max_by("status", order).alias("status"),
        F.min(F.when(F.col("status") == "running", F.col("ts"))).alias("started_at"),
        F.min(F.when(F.col("status").isin(ENDED), F.col("ts"))).alias("completed_at"),
        F.max("ts").alias("updated_at"),
    )


def _advance(
    key: tuple, frames: Iterator[pd.DataFrame], state: GroupState
) -> Iterator[pd.DataFrame]:
    """Ticks wait in the state, by time, until the watermark has passed them; then they are evaluated."""
    active, last_us, waiting = state.get if state.exists else (False, None, [])
    now = (active, None if last_us is None else pd.Timestamp(last_us, unit="us"))
    held = [tuple(w) for w in waiting]
    for frame in frames:
        held += [(int(r.tick.value // 1000), bool(r.firing), float(r.cooldown_minutes)) for r in frame.itertuples(index=False)]
    held.sort()
    closed_us = state.getCurrentWatermarkMs() * 1000
    out, rest = [], []
    for tick_us, firing, cooldown in held:
        if tick_us > closed_us:
            rest.append((tick_us, firing, cooldown))
            continue
        tick = pd.Timestamp(tick_us, unit="us")
        now, event = step(now, tick, firing, cooldown * 60.0)
        if event:
            out.append((key[0], tick, event))
    state.update((now[0], None if now[1] is None else int(now[1].value // 1000), rest))
    if rest:
        # Called again when the watermark has reached the first tick that waits.
        state.setTimeoutTimestamp(max(rest[0][0] // 1000 - 1, state.getCurrentWatermarkMs() + 1))
    if out:
        yield pd.DataFrame(out, columns=["rule", "tick", "event"])


def alert_stream(ticks: DataFrame, rules: list[AlertRule], delay: str = "0 seconds") -> DataFrame:
    """Alert events from a stream of ticks, with the cooldown state kept per rule.

    Event time decides, not arrival: a tick waits in the state until the watermark, ``delay`` behind the
    latest tick, has passed it, so ticks of one another's micro-batches may come in any order within that
    delay. Later ones are dropped, as in every stream with a watermark.
    """
    ship_package(ticks.sparkSession)
    timed = ticks.withColumn("tick", F.col("tick").cast("timestamp")).withWatermark("tick", delay)
    return evaluate(timed, rules).groupBy("rule").applyInPandasWithState(
        _advance,
        outputStructType="rule string, tick timestamp, event string",
        stateStructType="active boolean, last_us bigint, waiting array<struct<us: bigint, firing: boolean, cooldown: double>>",
        outputMode="append",
        timeoutConf=GroupStateTimeout.EventTimeTimeout,
    )


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _rocks(spark: SparkSession):
    """State on disk rather than in the heap for the queries started within."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def _finish(query, label: str, timeout: int | None):
    """Wait for a query's end, without a limit unless one is given."""
    if timeout is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError(f"{label}: stream did not finish")
    if query.exception() is not None:
        raise query.exception()
    return query


def run_to_end(
    df: DataFrame, label: str, keys: list[str] | None = None, timeout: int | None = None,
    each: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Run a stream over everything that has landed and return its result table.

    Without ``keys`` rows are appended. With them the stream runs in update mode: each
    batch stores the rows it changed in its own folder (a retried batch rewrites only
    itself), and the table holds the last row of each key. State that the watermark has passed is dropped.
    ``each`` turns every micro-batch of an appending stream into the rows to store.
    """
    spark = df.sparkSession
    out, log = scratch_path(spark, label), scratch_path(spark, f"{label}-log")
    writer = df.writeStream.option("checkpointLocation", log).trigger(availableNow=True)
    made = df.schema
    with _rocks(spark):
        if keys is None and each is None:
            query = writer.outputMode("append").format("parquet").option("path", out).start()
        elif keys is None:
            made = each(spark.createDataFrame([], df.schema)).schema
            query = writer.outputMode("append").foreachBatch(
                lambda batch, n: each(batch).write.mode("overwrite").parquet(f"{out}/batch={n}")
            ).start()
        else:
            query = writer.outputMode("update").foreachBatch(
                lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")
            ).start()
        _finish(query, label, timeout)
    if keys is None and each is None:
        return spark.read.schema(df.schema).parquet(out)
    changes = spark.read.option("basePath", out).parquet(out)
    if keys is None:
        return changes.select(*made.names)
    row = F.struct(*[c for c in df.columns if c not in keys])
    last = changes.groupBy(*keys).agg(F.max_by(row, "batch").alias("_row"))
    return last.select(*keys, "_row.*").select(*df.columns)


def run_first_seen(
    stream: DataFrame, out: str, log: str, known: DataFrame | None = None, timeout: int | None = None
):
    """Run a stream of :func:`first_seen` rows over what has landed, letting no fingerprint in twice.

    The state of a stream with a horizon forgets; what has left it is found in the rows stored by earlier
    micro-batches and in ``known`` (column ``fp``, e.g. the fingerprints of batch jobs), by an anti-join. Each
    micro-batch writes its own folder below ``out`` and does not look into it, so a retried one gives the same. Returns
    the finished query, whose progress shows the size of the state.
    """
    spark = stream.sparkSession
    names = stream.columns

    def store(batch: DataFrame, n: int) -> None:
        new = batch
        if known is not None:
            new = new.join(known.select("fp"), "fp", "left_anti")
        if n > 0:
            stored = spark.read.schema("fp string, batch bigint").option("basePath", out).parquet(out).filter(F.col("batch") < n)
            new = new.join(stored.select("fp"), "fp", "left_anti")
        new.select(*names).write.mode("overwrite").parquet(f"{out}/batch={n}")

    with _rocks(spark):
        query = (
            stream.writeStream.option("checkpointLocation", log).trigger(availableNow=True)
            .outputMode("append").foreachBatch(store).start()
        )
        return _finish(query, "first-seen", timeout)
