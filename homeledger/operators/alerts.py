"""Alert rules over per-tick metrics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from homeledger.session import ship_package


@dataclass(frozen=True)
class AlertRule:
    """``condition`` is a boolean Column over the columns of the tick table."""

    name: str
    condition: Column
    severity: str
    title: str
    description: str = ""
    tags: dict[str, str] = field(default_factory=dict)
    cooldown_minutes: int = 60


def _rate(errors: str, total: str) -> Column:
    return F.coalesce(
        F.try_divide(F.col(errors).cast("double"), F.col(total).cast("double")), F.lit(0.0)
    )


def default_rules() -> list[AlertRule]:
    """The stock rules (fixed names, limits and cooldowns).

    Ticks carry ``api_requests_error``, ``api_requests``, ``scraping_jobs_failed``,
    ``scraping_jobs_started`` (summed over tags) and the two system gauges.
    """
    return [
        AlertRule(
            "high_api_error_rate", _rate("api_requests_error", "api_requests") > 0.1, "high",
            "High API Error Rate", "API error rate is above 10%", {"component": "api"}, 30,
        ),
        AlertRule(
            "high_scraping_failure_rate",
            _rate("scraping_jobs_failed", "scraping_jobs_started") > 0.2, "medium",
            "High Scraping Failure Rate", "Scraping job failure rate is above 20%",
            {"component": "scraping"}, 60,
        ),
        AlertRule(
            "high_memory_usage", F.coalesce(F.col("system_memory_usage"), F.lit(0.0)) > 90,
            "critical", "High Memory Usage", "System memory usage is above 90%",
            {"component": "system"}, 15,
        ),
        AlertRule(
            "high_cpu_usage", F.coalesce(F.col("system_cpu_usage"), F.lit(0.0)) > 95, "high",
            "High CPU Usage", "System CPU usage is above 95%", {"component": "system"}, 15,
        ),
    ]


def _tags(tags: dict[str, str]) -> Column:
    pairs = [F.lit(x) for pair in sorted(tags.items()) for x in pair]
    return F.create_map(*pairs).cast("map<string,string>")


def describe(df: DataFrame, rules: list[AlertRule]) -> DataFrame:
    """Adds what a rule says about its alerts to rows with ``rule``; rules are few, so a projection."""
    def by_rule(value) -> Column:
        out = F.lit(None)
        for r in rules:
            out = F.when(F.col("rule") == r.name, value(r)).otherwise(out)
        return out

    return df.withColumns({
        "severity": by_rule(lambda r: F.lit(r.severity)),
        "title": by_rule(lambda r: F.lit(r.title)),
        "description": by_rule(lambda r: F.lit(r.description)),
        "source": F.concat(F.lit("alert_rule:"), F.col("rule")),
        "tags": by_rule(lambda r: _tags(r.tags)),
    })


def evaluate(ticks: DataFrame, rules: list[AlertRule]) -> DataFrame:
    """One row per tick and rule with ``firing``; rules are few, so this is a projection."""
    cells = F.array(
        *[
            F.struct(
                F.lit(r.name).alias("rule"),
                F.lit(r.severity).alias("severity"),
                F.lit(r.title).alias("title"),
                F.lit(r.description).alias("description"),
                F.lit(f"alert_rule:{r.name}").alias("source"),
                _tags(r.tags).alias("tags"),
                F.lit(r.cooldown_minutes).alias("cooldown_minutes"),
                F.coalesce(r.condition, F.lit(False)).alias("firing"),
            )
            for r in rules
        ]
    )
    return ticks.select("tick", F.explode(cells).alias("c")).select("tick", "c.*")


def firing_periods(evaluated: DataFrame) -> DataFrame:
    """Alerts without cooldown: each unbroken run of firing ticks is one alert.

    Ticks are few (one per time step whatever the data volume), so the per-rule
    window stays small.
    """
    w = Window.partitionBy("rule").orderBy("tick")
    before = F.coalesce(F.lag("firing").over(w), F.lit(False))
    starts = F.when(F.col("firing") & ~before, 1).otherwise(0)
    numbered = (
        evaluated.withColumn("_start", starts)
        .withColumn("_next", F.lead("tick").over(w))
        .withColumn("period", F.sum("_start").over(w))
        .filter("firing")
    )
    return numbered.groupBy("rule", "period").agg(
        F.min("tick").alias("created_at"),
        F.max("tick").alias("updated_at"),
        F.max_by("_next", "tick").alias("resolved_at"),
        F.count("*").alias("firing_ticks"),
    )


ALERT_EVENTS = "rule string, tick timestamp, event string"


def step(state: tuple, tick, firing: bool, cooldown_s: float) -> tuple[tuple, str | None]:
    """One evaluation of one rule. ``state`` is ``(active, last_triggered)``.

    During cooldown the rule is not looked at, so nothing is resolved then either.
    """
    active, last = state
    if last is not None and (tick - last).total_seconds() < cooldown_s:
        return state, None
    if firing:
        return (True, tick), "updated" if active else "triggered"
    return (False, last), "resolved" if active else None


def _fold_sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rule, state = None, (False, None)
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            if r.rule != rule:
                rule, state = r.rule, (False, None)
            state, event = step(state, r.tick, r.firing, r.cooldown_minutes * 60.0)
            if event:
                out.append((r.rule, r.tick, event))
        yield pd.DataFrame(out, columns=["rule", "tick", "event"])


def alert_events(evaluated: DataFrame) -> DataFrame:
    """Trigger, update and resolve events with cooldown.

    Each rule's ticks stream through one task in time order with constant memory;
    there is one tick per time step, whatever the volume of the metrics.
    """
    ordered = (
        evaluated.select("rule", F.col("tick").cast("timestamp"), "firing", "cooldown_minutes")
        .repartition("rule")
        .sortWithinPartitions("rule", "tick")
    )
    ship_package(evaluated.sparkSession)
    return ordered.mapInPandas(_fold_sorted, ALERT_EVENTS)


def alert_records(events: DataFrame, rules: list[AlertRule]) -> DataFrame:
    """Alerts as rows, from the events of :func:`alert_events` or of the stream.

    A trigger opens an alert, updates move ``updated_at``, a resolve closes it; ``number``
    counts the alerts of a rule. An alert that was not resolved is active.
    """
    w = Window.partitionBy("rule").orderBy("tick")
    opened = F.sum(F.when(F.col("event") == "triggered", 1).otherwise(0)).over(w)
    folded = events.withColumn("number", opened).groupBy("rule", "number").agg(
        F.min("tick").alias("created_at"),
        F.max("tick").alias("updated_at"),
        F.max(F.when(F.col("event") == "resolved", F.col("tick"))).alias("resolved_at"),
    )
    status = F.when(F.col("resolved_at").isNull(), "active").otherwise("resolved")
    return describe(folded, rules).select(
        F.concat(F.lit("rule_"), "rule").alias("alert_id"), "number", "title", "description", "severity",
        status.alias("status"), "source", "tags", "created_at", "updated_at", "resolved_at",
    )


def fold_alert_events(events: DataFrame) -> DataFrame:
    """Current alert state from trigger, acknowledge and resolve events.

    An acknowledged alert is still active.
    """
    order = F.struct("ts", "seq")
    return events.groupBy("alert_id").agg(
        F.max_by("status", order).alias("status"),
        F.min("ts").alias("created_at"),
        F.max("ts").alias("updated_at"),
        F.max(F.when(F.col("status") == "resolved", F.col("ts"))).alias("resolved_at"),
        F.max(F.when(F.col("status") == "acknowledged", F.col("ts"))).alias("acknowledged_at"),
    )


def active_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.filter(F.col("status").isin("active", "acknowledged"))


def alert_history(alerts: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    return alerts.filter(F.col("created_at") >= as_of - F.expr(f"INTERVAL {int(hours)} HOURS"))
