"""Fingerprint state that lives across runs: a parquet table that is only appended to."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

STATE = "fp string"


def load(spark: SparkSession, path: str) -> DataFrame:
    """Known fingerprints; a state that does not exist yet is empty.

    A damaged state raises: taking it for empty would let every known row in again.
    """
    try:
        return spark.read.schema(STATE).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition()):
            raise
        return spark.createDataFrame([], STATE)


def append(new: DataFrame, path: str) -> None:
    """Add the fingerprints that are not there yet (one append per batch)."""
    known = load(new.sparkSession, path)
    fresh = new.select("fp").distinct().join(known, "fp", "left_anti")
    fresh.write.mode("append").parquet(path)
