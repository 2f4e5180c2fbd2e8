"""Metric, alert and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from homeledger.catalog.base import LISTINGS, POINTS, TICKS, query, s_clean, s_state, s_zip, s_fp
from homeledger.catalog.reads import JOB_FOLD_SQL
from homeledger.operators import alerts, dedup, metrics
from homeledger.plans import batch
from homeledger.plans.fixtures import (
    alert_ticks, events_as_of, job_status_events, listings, metric_points, orders_as_of, table,
)
from homeledger.session import scratch_path
from homeledger.streaming import state as streams


def _stats_sql(source: str, keep: int | None = None) -> str:
    """Histogram statistics of a CTE with ``key, ts, seq, value``."""
    def pct(p: str) -> str:
        return f"v[CAST(floor({p}::DOUBLE * (len(v) - 1)) AS INTEGER) + 1]"

    limit = "" if keep is None else f"WHERE rn <= {keep}"
    return f"""kept AS (SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key
    ORDER BY ts DESC, seq DESC) AS rn FROM {source}) {limit}),
  arr AS (SELECT key, list(value ORDER BY value) AS v, avg(value) AS mean FROM kept GROUP BY key),
  stats AS (SELECT key, CAST(len(v) AS BIGINT) AS count, v[1] AS min, v[len(v)] AS max,
    round(mean, 6) AS mean, {pct('0.5')} AS p50, {pct('0.95')} AS p95, {pct('0.99')} AS p99 FROM arr)"""


def _r(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("met_1_counters", f"""
WITH {POINTS} SELECT key, round(sum(value), 6) AS value FROM points WHERE kind = 'counter' GROUP BY key""")
def _(spark, sf):
    return _r(metrics.counters(metric_points(spark, sf).filter("kind = 'counter'")), "value")


@query("met_2_gauges", f"""
WITH {POINTS} SELECT key, arg_max(value, (ts, seq)) AS value FROM points WHERE kind = 'gauge' GROUP BY key""")
def _(spark, sf):
    return metrics.gauges(metric_points(spark, sf).filter("kind = 'gauge'"))


@query("met_3_histogram_values", f"""
WITH {POINTS}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) AS rn
  FROM (SELECT * REPLACE (name AS key) FROM points))
SELECT key, seq, value FROM r WHERE rn <= 1000""")
def _(spark, sf):
    untagged = metric_points(spark, sf).withColumn("tags", F.lit(None).cast("map<string,string>"))
    return metrics.histogram_values(untagged, 1000).select("key", "seq", "value")


@query("met_4_histogram_stats", f"WITH {POINTS}, {_stats_sql('points')} SELECT * FROM stats")
def _(spark, sf):
    return _r(metrics.histogram_stats(metric_points(spark, sf)), "mean")


@query("met_4_newest_1000", f"""
WITH {POINTS}, named AS (SELECT * REPLACE (name AS key) FROM points), {_stats_sql('named', 1000)}
SELECT * FROM stats""")
def _(spark, sf):
    untagged = metric_points(spark, sf).withColumn("tags", F.lit(None).cast("map<string,string>"))
    return _r(metrics.histogram_stats(untagged, keep=1000), "mean")


@query("met_3_histogram_all_values", f"WITH {POINTS} SELECT key, seq, value FROM points")
def _(spark, sf):
    return metrics.histogram_values(metric_points(spark, sf)).select("key", "seq", "value")


@query("met_4_stats_with_defaults", f"""
WITH {POINTS}, {_stats_sql('points')}, asked AS (SELECT DISTINCT key FROM points
  UNION SELECT 'unknown.' || r_name FROM region)
SELECT a.key, COALESCE(count, 0) AS count, COALESCE(min, 0) AS min, COALESCE(max, 0) AS max,
  COALESCE(mean, 0) AS mean, COALESCE(p50, 0) AS p50, COALESCE(p95, 0) AS p95,
  COALESCE(p99, 0) AS p99 FROM asked a LEFT JOIN stats s ON a.key = s.key""")
def _(spark, sf):
    points = metric_points(spark, sf)
    unknown = table(spark, sf, "region").select(F.concat(F.lit("unknown."), "r_name").alias("key"))
    keys = metrics.with_key(points).select("key").unionAll(unknown)
    return _r(metrics.stats_for(keys, points), "mean")


@query("met_5_rank_percentile", f"""
WITH {POINTS}, named AS (SELECT * REPLACE (name AS key) FROM points), {_stats_sql('named', 500)}
SELECT key, p50, p95, p99 FROM stats""")
def _(spark, sf):
    untagged = metric_points(spark, sf).withColumn("tags", F.lit(None).cast("map<string,string>"))
    return metrics.histogram_stats(untagged, keep=500).select("key", "p50", "p95", "p99")


@query("met_6_look_back", """
SELECT event_id AS seq, ts, value FROM events WHERE event_type = 'click'
AND ts >= TIMESTAMP '2024-01-31' - INTERVAL 6 HOURS""")
def _(spark, sf):
    return metrics.look_back(metric_points(spark, sf), "click", events_as_of(), 6).select(
        "seq", "ts", "value")


@query("met_7_retention", """
SELECT event_id AS seq, event_type AS name FROM events
WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 24 HOURS""")
def _(spark, sf):
    return metrics.retain(metric_points(spark, sf), events_as_of()).select("seq", "name")


@query("met_8_newest_points", """
SELECT event_id AS seq, event_type AS name FROM (SELECT *, row_number() OVER (PARTITION BY event_type
  ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 10000""")
def _(spark, sf):
    return metrics.newest_points(metric_points(spark, sf), 10000).select("seq", "name")


@query("met_8_newest_points_cut", """
SELECT event_id AS seq, event_type AS name FROM (SELECT *, row_number() OVER (PARTITION BY event_type
  ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 1500""")
def _(spark, sf):
    return metrics.newest_points(metric_points(spark, sf), 1500).select("seq", "name")


@query("met_9_tag_key", f"WITH {POINTS} SELECT seq, key FROM points")
def _(spark, sf):
    return metrics.with_key(metric_points(spark, sf)).select("seq", "key")


@query("met_10_parse_tags", """
SELECT event_id AS seq, 'app=' || event_type || '=x;k=' || CAST(user_id AS VARCHAR) AS tags FROM events""")
def _(spark, sf):
    e = table(spark, sf, "events")
    text = F.concat(F.lit("noise,k=0,app="), "event_type", F.lit("=x,k="), F.col("user_id"))
    entries = F.array_sort(F.map_entries(metrics.parse_tags(text)))
    shown = F.array_join(F.transform(entries, lambda t: F.concat_ws("=", t["key"], t["value"])), ";")
    return e.select(F.col("event_id").alias("seq"), shown.alias("tags"))


@query("met_11_snapshot", f"""
WITH {POINTS}, hist AS (SELECT * FROM points WHERE kind = 'histogram'), {_stats_sql('hist')}
SELECT 'counter' AS kind, key, 'value' AS stat, round(sum(value), 6) AS value FROM points
  WHERE kind = 'counter' GROUP BY key
UNION ALL SELECT 'gauge', key, 'value', round(arg_max(value, (ts, seq)), 6) FROM points
  WHERE kind = 'gauge' GROUP BY key
UNION ALL SELECT 'histogram', key, stat, round(value, 6) FROM (
  UNPIVOT (SELECT key, CAST(count AS DOUBLE) AS count, min, max, mean, p50, p95, p99 FROM stats)
  ON count, min, max, mean, p50, p95, p99 INTO NAME stat VALUE value)""")
def _(spark, sf):
    return _r(metrics.snapshot(metric_points(spark, sf)), "value")


@query("met_12_read_values", f"""
WITH {POINTS}, c AS (SELECT key, sum(value) AS value FROM points WHERE kind = 'counter' GROUP BY key),
asked AS (SELECT DISTINCT key FROM points)
SELECT a.key, round(COALESCE(c.value, 0), 6) AS value FROM asked a LEFT JOIN c ON a.key = c.key""")
def _(spark, sf):
    points = metric_points(spark, sf)
    asked = metrics.with_key(points).select("key").distinct()
    return _r(metrics.read_values(asked, metrics.counters(points.filter("kind = 'counter'"))), "value")


@query("met_13_lifecycle", f"""
WITH runs AS (SELECT CAST(user_id % 20 AS VARCHAR) AS key, ts, event_id AS seq, value,
  CASE WHEN event_type IN ('purchase', 'view', 'click') THEN 'completed'
    WHEN event_type = 'error' THEN 'failed' END AS outcome FROM events),
ended AS (SELECT * FROM runs WHERE outcome IS NOT NULL), {_stats_sql('ended')},
c AS (SELECT key, count(*) AS started, count(*) FILTER (outcome = 'completed') AS completed,
  count(*) FILTER (outcome = 'failed') AS failed FROM runs GROUP BY key)
SELECT c.key, started, completed, failed, count AS timed, mean AS duration_mean, p95 AS duration_p95,
  'scraping.jobs' AS metric FROM c LEFT JOIN stats s ON c.key = s.key""")
def _(spark, sf):
    t = F.col("event_type")
    runs = table(spark, sf, "events").select(
        (F.col("user_id") % 20).cast("string").alias("name"), "ts", F.col("event_id").alias("seq"),
        F.col("value").alias("duration"),
        F.when(t.isin("purchase", "view", "click"), "completed").when(t == "error", "failed")
        .alias("outcome"))
    return _r(metrics.lifecycle(runs, "scraping.jobs"), "duration_mean")


@query("met_14_record_counters", """
WITH audit AS (SELECT o_orderdate AS batch, count(*) AS processed,
  count(*) FILTER (o_orderstatus = 'O') AS saved, count(*) FILTER (o_orderstatus = 'F') AS errors
  FROM orders GROUP BY o_orderdate)
SELECT CAST(sum(processed) AS BIGINT) AS "etl.records.processed",
  CAST(sum(saved) AS BIGINT) AS "etl.records.saved",
  CAST(sum(errors) AS BIGINT) AS "etl.records.errors" FROM audit""")
def _(spark, sf):
    s = F.col("o_orderstatus")
    audit = table(spark, sf, "orders").groupBy("o_orderdate").agg(
        F.count("*").alias("processed"), F.count_if(s == "O").alias("saved"),
        F.count_if(s == "F").alias("error_count"))
    return metrics.record_counters(audit)


@query("met_15_daily", """
SELECT date_trunc('day', ts) AS day, event_type AS name, count(*) AS n, round(sum(value), 6) AS total,
  min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2""")
def _(spark, sf):
    return _r(metrics.daily(metric_points(spark, sf)), "total", "mean")


# --- alerts -----------------------------------------------------------------------------


def _rules() -> list[alerts.AlertRule]:
    """Rules over the hourly ticks, with and without a cooldown that spans ticks."""
    rate = F.col("error_rate")
    return [
        alerts.AlertRule("rate_low", rate > 0.1, "high", "Error rate", "above a tenth", {"part": "api"}, 30),
        alerts.AlertRule("rate_mid", rate > 0.25, "medium", "Error rate", "above a quarter", {"part": "api"}, 180),
        alerts.AlertRule("peak", F.col("peak") > 55, "critical", "Peak", "a large value", {"part": "db", "kind": "max"}, 150),
    ]


def _tag_text(df):
    pairs = F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return df.withColumn("tags", F.array_join(pairs, ","))


_EVAL = """ev AS (
  SELECT tick, 'rate_low' AS rule, 'high' AS severity, 'Error rate' AS title,
    'above a tenth' AS description, 'part=api' AS tags, 30 AS cooldown_minutes, error_rate > 0.1 AS firing FROM ticks
  UNION ALL SELECT tick, 'rate_mid', 'medium', 'Error rate', 'above a quarter', 'part=api', 180,
    error_rate > 0.25 FROM ticks
  UNION ALL SELECT tick, 'peak', 'critical', 'Peak', 'a large value', 'kind=max,part=db', 150, peak > 55 FROM ticks)"""


@query("alr_1_evaluate_rules", f"WITH {TICKS}, {_EVAL} SELECT *, 'alert_rule:' || rule AS source FROM ev")
def _(spark, sf):
    return _tag_text(alerts.evaluate(alert_ticks(spark, sf), _rules()))


@query("alr_2_default_rules", f"""
WITH {TICKS} SELECT tick, 'high_api_error_rate' AS rule, 'high' AS severity, 30 AS cooldown_minutes,
  error_rate > 0.1 AS firing FROM ticks
UNION ALL SELECT tick, 'high_scraping_failure_rate', 'medium', 60, error_rate > 0.2 FROM ticks
UNION ALL SELECT tick, 'high_memory_usage', 'critical', 15, peak > 90 FROM ticks
UNION ALL SELECT tick, 'high_cpu_usage', 'high', 15, peak > 95 FROM ticks""")
def _(spark, sf):
    t = alert_ticks(spark, sf).select(
        "tick", F.col("errors").alias("api_requests_error"), F.col("requests").alias("api_requests"),
        F.col("errors").alias("scraping_jobs_failed"),
        F.col("requests").alias("scraping_jobs_started"),
        F.col("peak").alias("system_memory_usage"), F.col("peak").alias("system_cpu_usage"))
    return alerts.evaluate(t, alerts.default_rules()).drop("title", "description", "source", "tags")


ALERT_EVENTS_SQL = f"""
WITH RECURSIVE {TICKS}, {_EVAL}, o AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY tick)
  AS rn FROM ev),
run AS (
  SELECT rule, CAST(0 AS BIGINT) AS rn, CAST(NULL AS TIMESTAMP) AS tick, FALSE AS active,
    CAST(NULL AS TIMESTAMP) AS last, CAST(NULL AS VARCHAR) AS event FROM (SELECT DISTINCT rule FROM ev)
  UNION ALL
  SELECT o.rule, o.rn, o.tick,
    CASE WHEN r.last IS NOT NULL AND o.tick < r.last + to_minutes(o.cooldown_minutes) THEN r.active
      ELSE o.firing END,
    CASE WHEN r.last IS NOT NULL AND o.tick < r.last + to_minutes(o.cooldown_minutes) THEN r.last
      WHEN o.firing THEN o.tick ELSE r.last END,
    CASE WHEN r.last IS NOT NULL AND o.tick < r.last + to_minutes(o.cooldown_minutes) THEN NULL
      WHEN o.firing AND r.active THEN 'updated' WHEN o.firing THEN 'triggered'
      WHEN r.active THEN 'resolved' END
  FROM run r JOIN o ON o.rule = r.rule AND o.rn = r.rn + 1)
SELECT rule, tick, event FROM run WHERE event IS NOT NULL"""


@query("alr_3_alert_events", ALERT_EVENTS_SQL)
def _(spark, sf):
    return alerts.alert_events(alerts.evaluate(alert_ticks(spark, sf), _rules()))


@query("alr_4_alert_records", f"""
WITH e AS ({ALERT_EVENTS_SQL}), n AS (SELECT *, sum(CASE WHEN event = 'triggered' THEN 1 ELSE 0 END)
  OVER (PARTITION BY rule ORDER BY tick) AS number FROM e),
a AS (SELECT rule, CAST(number AS BIGINT) AS number, min(tick) AS created_at, max(tick) AS updated_at,
  max(tick) FILTER (event = 'resolved') AS resolved_at FROM n GROUP BY rule, number)
SELECT 'rule_' || rule AS alert_id, number, CASE rule WHEN 'peak' THEN 'Peak' ELSE 'Error rate' END AS title,
  CASE rule WHEN 'peak' THEN 'a large value' WHEN 'rate_low' THEN 'above a tenth' ELSE 'above a quarter' END
    AS description,
  CASE rule WHEN 'peak' THEN 'critical' WHEN 'rate_low' THEN 'high' ELSE 'medium' END AS severity,
  CASE WHEN resolved_at IS NULL THEN 'active' ELSE 'resolved' END AS status,
  'alert_rule:' || rule AS source,
  CASE rule WHEN 'peak' THEN 'kind=max,part=db' ELSE 'part=api' END AS tags,
  created_at, updated_at, resolved_at FROM a""")
def _(spark, sf):
    rules = _rules()
    events = alerts.alert_events(alerts.evaluate(alert_ticks(spark, sf), rules))
    return _tag_text(alerts.alert_records(events, rules))


@query("alr_4_firing_periods", f"""
WITH {TICKS}, {_EVAL}, s AS (SELECT *, COALESCE(lag(firing) OVER w, FALSE) AS before,
  lead(tick) OVER w AS nxt FROM ev WINDOW w AS (PARTITION BY rule ORDER BY tick)),
p AS (SELECT *, sum(CASE WHEN firing AND NOT before THEN 1 ELSE 0 END)
  OVER (PARTITION BY rule ORDER BY tick) AS period FROM s)
SELECT rule, CAST(period AS BIGINT) AS period, min(tick) AS created_at, max(tick) AS updated_at,
  arg_max_null(nxt, tick) AS resolved_at, count(*) AS firing_ticks
FROM p WHERE firing GROUP BY rule, period""")
def _(spark, sf):
    return alerts.firing_periods(alerts.evaluate(alert_ticks(spark, sf), _rules()))


def _alert_events(spark, sf):
    t = F.col("event_type")
    return table(spark, sf, "events").select(
        F.concat(F.lit("rule_"), F.col("user_id")).alias("alert_id"),
        F.when(t == "error", "active").when(t == "view", "acknowledged")
        .when(t == "purchase", "resolved").otherwise("active").alias("status"),
        "ts", F.col("event_id").alias("seq"))


_ALERTS = """ae AS (SELECT 'rule_' || user_id AS alert_id, CASE event_type WHEN 'view' THEN
    'acknowledged' WHEN 'purchase' THEN 'resolved' ELSE 'active' END AS status, ts, event_id AS seq
  FROM events),
alerts AS (SELECT alert_id, arg_max(status, (ts, seq)) AS status, min(ts) AS created_at,
  max(ts) AS updated_at, max(ts) FILTER (status = 'resolved') AS resolved_at,
  max(ts) FILTER (status = 'acknowledged') AS acknowledged_at FROM ae GROUP BY alert_id)"""


@query("alr_5_fold_alert_events", f"WITH {_ALERTS} SELECT * FROM alerts")
def _(spark, sf):
    return alerts.fold_alert_events(_alert_events(spark, sf))


@query("alr_6_active_alerts", f"""
WITH {_ALERTS} SELECT * FROM alerts WHERE status IN ('active', 'acknowledged')""")
def _(spark, sf):
    return alerts.active_alerts(alerts.fold_alert_events(_alert_events(spark, sf)))


@query("alr_6_alert_history", f"""
WITH {_ALERTS} SELECT * FROM alerts WHERE created_at >= TIMESTAMP '2024-01-31' - INTERVAL 705 HOURS""")
def _(spark, sf):
    return alerts.alert_history(
        alerts.fold_alert_events(_alert_events(spark, sf)), events_as_of(), 705)


# --- streaming --------------------------------------------------------------------------


def _land(spark, df, label):
    """Write rows as landed files and open a stream over them."""
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return streams.landed(spark, path, df.schema)


_ROW_FP = s_fp("street_address", s_clean("city"),
               f"CASE WHEN state IS NOT NULL THEN {s_state(s_clean('state'))} END",
               f"CASE WHEN zip_code IS NOT NULL THEN {s_zip('zip_code')} END")


@query("str_1_first_seen", f"""
WITH {LISTINGS} SELECT DISTINCT {s_fp('street_address', 'city', 'state', 'zip_code')} AS fp FROM listings""")
def _(spark, sf):
    stream = _land(spark, listings(spark, sf), "str1-in")
    return streams.run_to_end(streams.first_seen(stream).select("fp"), "str1")


@query("str_2_process_records", f"""
WITH {LISTINGS} SELECT DISTINCT {_ROW_FP} AS fp FROM listings""")
def _(spark, sf):
    stream = _land(spark, listings(spark, sf), "str2-in")
    done = streams.process_records(stream, orders_as_of())
    return streams.run_to_end(done, "str2").select("fp")


@query("val_3_single_record_path", f"""
WITH {LISTINGS} SELECT DISTINCT {_ROW_FP} AS fp FROM listings WHERE price < 250000""")
def _(spark, sf):
    priced = F.when(F.col("price") < 250000, F.col("price")).otherwise(F.lit(-1.0))
    stream = _land(spark, listings(spark, sf).withColumn("price", priced), "val3-in")
    return streams.run_to_end(streams.process_records(stream, orders_as_of()), "val3").select("fp")


def _points_stream(spark, sf):
    e = table(spark, sf, "events")
    stream = streams.landed(spark, sf, e.schema, "events.parquet")
    return stream.select(
        F.col("event_type").alias("name"), "ts", F.col("event_id").alias("seq"), "value")


@query("str_3_hourly_metrics", """
SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end,
  event_type AS name, count(*) AS n, round(sum(value), 6) AS total, min(value) AS min,
  max(value) AS max, arg_max(value, (ts, event_id)) AS last FROM events GROUP BY 1, 2, 3""")
def _(spark, sf):
    w = streams.windowed_metrics(_points_stream(spark, sf))
    return _r(streams.run_to_end(w, "str3", ["window_start", "window_end", "name"]), "total")


@query("str_4_sliding_look_back", """
WITH s AS (SELECT *, time_bucket(INTERVAL 5 MINUTES, ts) - to_minutes(CAST(5 * i AS INTEGER)) AS ws
  FROM events, range(12) r(i))
SELECT ws AS window_start, ws + INTERVAL 1 HOUR AS window_end, event_type AS name, count(*) AS n,
  round(sum(value), 6) AS total, min(value) AS min, max(value) AS max,
  arg_max(value, (ts, event_id)) AS last FROM s GROUP BY 1, 2, 3""")
def _(spark, sf):
    panes = streams.run_to_end(
        streams.pane_metrics(_points_stream(spark, sf)), "str4", ["window_start", "window_end", "name"])
    return _r(streams.sliding(panes), "total")


@query("str_3_hourly_percentiles", f"""
WITH p AS (SELECT date_trunc('hour', ts) AS window_start, event_type AS name, value,
  date_trunc('hour', ts) || '|' || event_type AS key, ts, event_id AS seq FROM events
  WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 24 HOURS FROM events)),
{_stats_sql('p')}
SELECT DISTINCT p.window_start, p.window_start + INTERVAL 1 HOUR AS window_end, p.name, s.count, s.min, s.max, s.mean,
  s.p50, s.p95, s.p99 FROM p JOIN stats s ON p.key = s.key""")
def _(spark, sf):
    counts = streams.windowed_values(_points_stream(spark, sf))
    return _r(streams.run_to_end(counts, "str3p", each=streams.window_stats), "mean")


@query("str_5_alert_stream", ALERT_EVENTS_SQL)
def _(spark, sf):
    stream = _land(spark, alert_ticks(spark, sf), "str5-in")
    return streams.run_to_end(streams.alert_stream(stream, _rules()), "str5")


@query("str_6_job_state", JOB_FOLD_SQL)
def _(spark, sf):
    stream = _land(spark, job_status_events(spark, sf), "str6-in")
    return streams.run_to_end(streams.job_state(stream), "str6", ["job_id"])
