"""The batch job: validate, transform, deduplicate, enrich, save, with an audit row."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from homeledger.operators.clean import bulk_transform, transform_existing_columns
from homeledger.operators.dedup import deduplicate, deduplicate_keyed, with_fingerprint
from homeledger.operators.enrich import enrich
from homeledger.operators.validate import error_report, split_valid, with_errors
from homeledger.session import materialize
from homeledger.sinks import fingerprints
from homeledger.sinks.files import save_job_csv


@dataclass(frozen=True)
class Stages:
    """The lazy tables of one batch; ``enriched`` is planned only where it is asked for."""

    valid: DataFrame
    errors: DataFrame
    transformed: DataFrame
    unique: DataFrame
    as_of: Column

    @property
    def enriched(self) -> DataFrame:
        """Stores the unique rows (an action): the medians and the rows they are joined to both come from there."""
        return enrich(materialize(self.unique, "batch-unique"), self.as_of)


def transform(df: DataFrame, now: Column) -> DataFrame:
    return df.transform(transform_existing_columns).transform(bulk_transform, now)


def stages(
    df: DataFrame, as_of: Column, seen: DataFrame | None = None, order: str = "ingest_seq"
) -> Stages:
    """All stages of a batch; the wide rows are shuffled for the fingerprint only. Lazy."""
    valid, invalid = split_valid(df)
    transformed = transform(valid, as_of)
    unique = deduplicate(transformed, seen, order)
    return Stages(valid, error_report(invalid, order), transformed, unique, as_of)


def audit(
    df: DataFrame, as_of: Column, seen: DataFrame | None = None
) -> DataFrame:
    """One row of counts for a batch, in a single pass with one mergeable aggregation.

    ``total_input = invalid + duplicates + processed`` always holds.
    """
    return _counts(_checked(df, as_of), seen)


def _checked(df: DataFrame, as_of: Column) -> DataFrame:
    """Every row, transformed, with its errors and its fingerprint."""
    return with_fingerprint(transform(with_errors(df), as_of))


def _counts(checked: DataFrame, seen: DataFrame | None) -> DataFrame:
    n_errors = F.size("errors")
    per_fp = checked.groupBy(F.when(n_errors == 0, F.col("fp")).alias("fp")).agg(
        F.count("*").alias("rows"), F.sum(n_errors).alias("errors")
    )
    if seen is None:
        per_fp = per_fp.withColumn("known", F.lit(False))
    else:
        marks = seen.select("fp").distinct().withColumn("known", F.lit(True))
        per_fp = per_fp.join(marks, "fp", "left")
    is_new = F.col("fp").isNotNull() & ~F.coalesce(F.col("known"), F.lit(False))
    zero = F.lit(0)
    counts = per_fp.agg(
        F.coalesce(F.sum("rows"), zero).alias("total_input"),
        F.coalesce(F.sum(F.when(F.col("fp").isNull(), F.col("rows"))), zero).alias("invalid"),
        F.coalesce(F.sum("errors"), zero).alias("error_count"),
        F.count_if(is_new).alias("processed"),
    )
    return counts.withColumn(
        "duplicates", F.col("total_input") - F.col("invalid") - F.col("processed")
    )


def summary(counts: DataFrame) -> DataFrame:
    """The audit of a batch as one row per stage: records in, out and dropped, and the share kept."""
    valid = F.col("total_input") - F.col("invalid")

    def stage(name: str, given: Column, kept: Column) -> Column:
        rate = F.coalesce(F.try_divide(kept.cast("double"), given), F.lit(0.0))
        return F.struct(
            F.lit(name).alias("stage"), given.alias("input_records"), kept.alias("output_records"),
            (given - kept).alias("dropped_records"), rate.alias("kept_rate"),
        )

    rows = [
        stage("validation", F.col("total_input"), valid),
        stage("deduplication", valid, F.col("processed")),
        stage("load", F.col("processed"), F.col("processed")),
    ]
    return counts.select(F.inline(F.array(*rows)))


def run(
    df: DataFrame, job_id: str, as_of: Column, output: str, state: str | None = None
) -> dict:
    """Run a batch: save the enriched rows, extend the fingerprint state, return the summary.

    An empty input ends early. The input is read, validated and transformed once; the counts and
    the unique rows come from what is stored of that.
    """
    spark = df.sparkSession
    started = time.monotonic()
    seen = None if state is None else fingerprints.load(spark, state)
    checked = materialize(_checked(df, as_of), "batch-checked")
    counts = _counts(checked, seen).first().asDict()
    saved = 0
    if counts["processed"] > 0:
        valid = checked.filter(F.size("errors") == 0).drop("errors")
        unique = materialize(deduplicate_keyed(valid, seen), "batch-unique")
        done = enrich(unique, as_of).withColumn("job_id", F.lit(job_id))
        saved = save_job_csv(done, output)
        if state is not None:
            fingerprints.append(unique, state)
    return {**counts, "job_id": job_id, "saved": saved,
            "processing_time": time.monotonic() - started}
