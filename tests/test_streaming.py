"""Streams over several micro-batches against the batch operators."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from homeledger.operators import alerts, dedup, jobs
from homeledger.plans.fixtures import alert_ticks, job_status_events, listings, metric_points, orders_as_of
from homeledger.streaming import state as streams

SF = "/root/testdata/sf0.001"


def land_in_order(spark, df, path, column, parts):
    """Several files, each later in ``column`` than the one before."""
    cut = df.withColumn("_p", F.ntile(parts).over(Window.orderBy(column)))
    for i in range(1, parts + 1):
        cut.filter(F.col("_p") == i).drop("_p").coalesce(1).write.mode("append").parquet(path)
    return streams.landed(spark, path, df.schema, files_per_batch=1)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_first_seen_across_batches(spark, scratch):
    df = listings(spark, SF)
    stream = land_in_order(spark, df, f"{scratch}/in", "ingest_seq", 3)
    got = streams.run_to_end(streams.first_seen(stream), "t-first")
    assert rows(got, "ingest_seq", "fp") == rows(dedup.deduplicate(df), "ingest_seq", "fp")


def test_per_record_chain_drops_invalid_rows(spark, scratch):
    df = listings(spark, SF).withColumn("price", F.when(F.col("ingest_seq") % 2 == 0, -1.0).otherwise(1.0))
    stream = land_in_order(spark, df, f"{scratch}/in", "ingest_seq", 2)
    got = streams.run_to_end(streams.process_records(stream, orders_as_of()), "t-chain")
    assert got.filter("price < 0").count() == 0 and got.count() > 0
    assert got.select("fp").distinct().count() == got.count()


def test_windows_closed_by_the_watermark_equal_the_batch(spark, scratch):
    points = metric_points(spark, SF).drop("tags", "kind")
    stream = land_in_order(spark, points, f"{scratch}/in", "ts", 4)
    got = streams.run_to_end(streams.windowed_metrics(stream, "1 hour", "24 hours"), "t-win")
    batch = points.groupBy(F.date_trunc("hour", "ts").alias("window_start"), "name").agg(F.count("*").alias("n"))
    all_rows = set(rows(batch, "window_start", "name", "n"))
    closed = rows(got, "window_start", "name", "n")
    assert closed and set(closed) <= all_rows
    last = max(r[0] for r in closed)
    assert set(closed) == {r for r in all_rows if r[0] <= last}


def test_job_state_in_update_mode(spark, scratch):
    events = job_status_events(spark, SF)
    stream = land_in_order(spark, events, f"{scratch}/in", "ts", 3)
    got = streams.run_to_end(streams.job_state(stream), "t-jobs", ["job_id"])
    cols = ("job_id", "status", "updated_at")
    assert rows(got, *cols) == rows(jobs.fold_status(events), *cols)


def test_alert_state_survives_batches(spark, scratch):
    rules = [
        alerts.AlertRule("often", F.col("error_rate") > 0.1, "high", "t", cooldown_minutes=0),
        alerts.AlertRule("slow", F.col("error_rate") > 0.25, "high", "t", cooldown_minutes=190),
    ]
    ticks = alert_ticks(spark, SF)
    stream = land_in_order(spark, ticks, f"{scratch}/in", "tick", 3)
    got = streams.run_to_end(streams.alert_stream(stream, rules), "t-alerts")
    want = alerts.alert_events(alerts.evaluate(ticks, rules))
    cols = ("rule", "tick", "event")
    assert rows(got, *cols) == rows(want, *cols)


def test_ticks_out_of_order_across_batches(spark, scratch):
    """Ticks shuffled among micro-batches, none later than the delay, give the events of the batch."""
    rules = [
        alerts.AlertRule("often", F.col("error_rate") > 0.1, "high", "t", cooldown_minutes=0),
        alerts.AlertRule("slow", F.col("error_rate") > 0.25, "high", "t", cooldown_minutes=190),
    ]
    ticks = alert_ticks(spark, SF)
    hours = Window.orderBy("tick")
    # Blocks of six ticks land in turn; within a block the halves change places.
    place = ticks.withColumn("_n", F.row_number().over(hours) - 1)
    swapped = place.withColumn("_p", F.floor(F.col("_n") / 6) * 2 + F.when(F.col("_n") % 6 < 3, 1).otherwise(0))
    end = ticks.agg(F.max("tick")).first()[0]
    last = ticks.limit(1).withColumn("tick", F.lit(end) + F.expr("INTERVAL 10 DAYS"))
    files = [r[0] for r in swapped.select("_p").distinct().orderBy("_p").collect()]
    for p in files[:30]:
        swapped.filter(F.col("_p") == p).drop("_n", "_p").coalesce(1).write.mode("append").parquet(f"{scratch}/in")
    last.write.mode("append").parquet(f"{scratch}/in")
    stream = streams.landed(spark, f"{scratch}/in", ticks.schema, files_per_batch=1)
    got = streams.run_to_end(streams.alert_stream(stream, rules, "12 hours"), "t-shuffled")
    seen = swapped.filter(F.col("_p").isin(files[:30])).drop("_n", "_p")
    want = alerts.alert_events(alerts.evaluate(seen, rules))
    cols = ("rule", "tick", "event")
    assert rows(got, *cols) == rows(want, *cols) and got.count() > 5


def test_percentiles_of_closed_windows(spark, scratch):
    points = metric_points(spark, SF).drop("tags", "kind")
    stream = land_in_order(spark, points, f"{scratch}/in", "ts", 4)
    got = streams.run_to_end(streams.windowed_values(stream, "6 hours", "24 hours"), "t-pct", each=streams.window_stats)
    values = {}
    for r in points.select(F.window("ts", "6 hours").start.alias("w"), "name", "value").collect():
        values.setdefault((r.w, r.name), []).append(r.value)
    found = got.collect()
    assert len(found) > 20
    for r in found:
        v = sorted(values[r.window_start, r.name])
        assert (r["count"], r.min, r.max) == (len(v), v[0], v[-1])
        assert (r.p50, r.p95, r.p99) == tuple(v[int(p * (len(v) - 1))] for p in (0.5, 0.95, 0.99))


def test_sliding_windows_from_panes(spark, scratch):
    points = metric_points(spark, SF).drop("tags", "kind")
    batch = points.groupBy(F.window("ts", "1 hour", "15 minutes").alias("w"), "name").agg(
        F.count("*").alias("n"), F.max_by("value", F.struct("ts", "seq")).alias("last")
    ).select("w.start", "name", "n", "last")
    want = rows(batch, "start", "name", "n", "last")
    stream = land_in_order(spark, points, f"{scratch}/in", "ts", 3)
    panes = streams.run_to_end(streams.pane_metrics(stream, "15 minutes"), "t-panes", [*streams.WINDOW, "name"])
    cols = ("window_start", "name", "n", "last")
    assert rows(streams.sliding(panes, "1 hour", "15 minutes"), *cols) == want
    # Chained in one stream: the windows that the watermark has closed.
    stream = streams.landed(spark, f"{scratch}/in", points.schema, files_per_batch=1)
    chained = streams.run_to_end(streams.windowed_metrics(stream, "1 hour", "24 hours", "15 minutes"), "t-chained")
    closed = rows(chained, *cols)
    assert len(closed) > 50 and set(closed) <= set(want)


def test_state_forgets_but_nothing_comes_twice(spark, scratch):
    """Addresses that come back after the horizon: the state shrinks, the stored rows know them."""
    df = listings(spark, SF).limit(300)
    start = F.lit("2024-01-01").cast("timestamp")
    for day in range(4):
        again = df.withColumn("at", start + F.make_dt_interval(F.lit(day * 5)))
        part = again.filter(F.col("ingest_seq") % 4 <= day)
        part.coalesce(1).write.mode("append").parquet(f"{scratch}/in")
    schema = spark.read.parquet(f"{scratch}/in").schema
    stream = streams.landed(spark, f"{scratch}/in", schema, files_per_batch=1)
    known = dedup.with_fingerprint(df.filter("ingest_seq % 7 = 0")).select("fp").distinct()
    query = streams.run_first_seen(
        streams.first_seen(stream, "2 days", "at"), f"{scratch}/out", f"{scratch}/log", known)
    got = spark.read.parquet(f"{scratch}/out")
    fps = dedup.with_fingerprint(df).select("fp").distinct()
    assert got.count() == got.select("fp").distinct().count()
    assert rows(got, "fp") == rows(fps.join(known, "fp", "left_anti"), "fp")
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(sizes) > sizes[-1] and max(sizes) < 2 * fps.count()
