"""Scrape-job and result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from homeledger.operators.search import page_offset
from homeledger.schema import DATA_SOURCES, JOB_STATUSES

ENDED = ["completed", "failed", "cancelled"]
ACTIVE = ["pending", "running", "retrying"]


def new_jobs(requests: DataFrame, now: Column) -> DataFrame:
    """Requests to pending job rows; the id is a hash of the request, so reruns agree."""
    key = ["data_source", "search_criteria", "created_by", "requested_at"]
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key]
    return requests.select(
        F.sha2(F.concat_ws("|", *parts), 256).alias("job_id"),
        "data_source",
        F.lit("pending").alias("status"),
        "search_criteria",
        "max_pages",
        "max_results",
        *[F.lit(0).alias(c) for c in
          ("pages_scraped", "properties_found", "properties_saved", "errors_count")],
        "created_by",
        now.alias("created_at"),
        now.alias("updated_at"),
    )


def fold_status(events: DataFrame, tie: str = "seq") -> DataFrame:
    """Current state per job from its status events: a mergeable aggregation.

    ``started_at`` is the first time it ran, ``completed_at`` the first time it ended.
    """
    order = F.struct("ts", tie)
    return events.groupBy("job_id").agg(
        F.max_by("status", order).alias("status"),
        F.min(F.when(F.col("status") == "running", F.col("ts"))).alias("started_at"),
        F.min(F.when(F.col("status").isin(ENDED), F.col("ts"))).alias("completed_at"),
        F.max("ts").alias("updated_at"),
    )


def decide_requests(
    requests: DataFrame, jobs: DataFrame, refused: list[str] | None = None,
    required: list[str] | None = None,
) -> DataFrame:
    """Each request with the job's current status and ``accepted``; unknown jobs are refused."""
    state = jobs.select("job_id", F.col("status").alias("job_status"))
    ok = F.col("job_status").isNotNull()
    if refused is not None:
        ok = ok & ~F.col("job_status").isin(refused)
    if required is not None:
        ok = ok & F.col("job_status").isin(required)
    return requests.join(state, "job_id", "left").withColumn(
        "accepted", F.coalesce(ok, F.lit(False))
    )


def cancel(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    return decide_requests(requests, jobs, refused=ENDED).withColumn(
        "new_status", F.when(F.col("accepted"), F.lit("cancelled")).otherwise(F.col("job_status"))
    )


def retry(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Only failed jobs are retried; an accepted retry clears the error message."""
    return decide_requests(requests, jobs, required=["failed"]).withColumn(
        "new_status", F.when(F.col("accepted"), F.lit("retrying")).otherwise(F.col("job_status"))
    )


def recent(jobs: DataFrame, limit: int) -> DataFrame:
    return jobs.orderBy(F.col("created_at").desc(), F.col("job_id").desc()).limit(limit)


def active(jobs: DataFrame) -> DataFrame:
    return jobs.filter(F.col("status").isin(ACTIVE))


def failed(jobs: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    cutoff = as_of - F.expr(f"INTERVAL {int(hours)} HOURS")
    return jobs.filter((F.col("status") == "failed") & (F.col("created_at") >= cutoff))


def job_list(
    jobs: DataFrame, status: str | None = None, data_source: str | None = None,
    page: int = 1, page_size: int = 50, window: int | None = None,
) -> DataFrame:
    """A page of the jobs that pass the filters, newest first, with their count.

    With ``window`` only the newest so many jobs are looked at, before the filters.
    """
    found = jobs if window is None else recent(jobs, window)
    if status:
        found = found.filter(F.col("status") == status)
    if data_source:
        found = found.filter(F.col("data_source") == data_source)
    total = found.agg(F.count("*")).scalar()
    ordered = found.orderBy(F.col("created_at").desc(), F.col("job_id").desc())
    return ordered.offset(page_offset(page, page_size)).limit(page_size).withColumn("total_count", total)


def statistics(jobs: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """One row: counts per status and source (zeros included), success percent, rows saved."""
    cutoff = as_of - F.expr(f"INTERVAL {int(hours)} HOURS")
    done, bad = F.count_if(F.col("status") == "completed"), F.count_if(F.col("status") == "failed")
    rate = F.coalesce(F.try_divide(done, done + bad), F.lit(0.0)) * F.lit(100.0)
    return jobs.filter(F.col("created_at") >= cutoff).agg(
        F.count("*").alias("total_jobs"),
        *[F.count_if(F.col("status") == s).alias(f"status_{s}") for s in JOB_STATUSES],
        *[F.count_if(F.col("data_source") == s).alias(f"source_{s}") for s in DATA_SOURCES],
        F.round(rate, 2).alias("success_rate"),
        F.coalesce(F.sum("properties_saved"), F.lit(0)).alias("total_properties_scraped"),
    )


def _first(results: DataFrame, limit: int | None) -> DataFrame:
    return results if limit is None else results.orderBy("id").limit(limit)


def results_of(results: DataFrame, job_id: str, limit: int | None = None) -> DataFrame:
    """A job's results: all, or the first ``limit`` by id."""
    return _first(results.filter(F.col("job_id") == job_id), limit)


def unprocessed(results: DataFrame, limit: int | None = None) -> DataFrame:
    """Results still to process, all or the oldest; a null flag is not "unprocessed"."""
    return _first(results.filter(~F.col("is_processed")), limit)


def mark_processed(results: DataFrame, done: DataFrame, now: Column) -> DataFrame:
    """Set the flag and time for the ids in ``done``, and the data where it brings some.

    An id listed more than once counts once, with the largest data it brings.
    """
    d = done.groupBy("id").agg(F.max("processed_data").alias("_data"), F.lit(True).alias("_d"))
    return (
        results.join(d, "id", "left")
        .withColumns({
            "is_processed": F.when(F.col("_d"), F.lit(True)).otherwise(F.col("is_processed")),
            "processed_at": F.when(F.col("_d"), now).otherwise(F.col("processed_at")),
            "processed_data": F.coalesce("_data", "processed_data"),
        })
        .select(*results.columns)
    )


def mark_saved(results: DataFrame, ids: DataFrame) -> DataFrame:
    d = ids.select("id", F.lit(True).alias("_d")).distinct()
    flag = F.when(F.col("_d"), F.lit(True)).otherwise(F.col("is_saved_to_db"))
    return results.join(d, "id", "left").withColumn("is_saved_to_db", flag).select(*results.columns)
