"""Listing files to DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from homeledger.functions.text import unescape_lines
from homeledger.schema import schema_of
from homeledger.sources import records


_CSV = {"header": True, "quote": '"', "escape": '"', "enforceSchema": False}


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, one_line: bool = False) -> DataFrame:
    """CSV with a header and a declared schema (zip codes stay text, no inference pass).

    A large file is read by many tasks, also where quoted cells hold line breaks: a first native pass
    looks whether any does, and only then records are cut at the line breaks outside of quotes. Texts
    are taken as they stand; ``one_line`` is for files that our sinks wrote with it. Empty cells are null, also quoted
    ones. A file whose header names other columns raises.
    """
    schema = schema_of("scraped") if schema is None else schema
    text = records.lines(spark, path)
    if records.csv_breaks(text):
        rows = _broken_csv(text, schema)
    else:
        rows = spark.read.schema(schema).csv(path, **_CSV)
    texts = [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)]
    return rows.withColumns({c: unescape_lines(F.col(c)) for c in texts}) if one_line and texts else rows


def _broken_csv(text: DataFrame, schema: T.StructType) -> DataFrame:
    found = records.csv_records(text).withColumn("record", F.rtrim(F.col("record"), F.lit("\r")))
    # Parsed as one value, a record keeps the line breaks within its cells.
    options = {"quote": '"', "escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"}
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    header = found.filter("first").select(F.from_csv("record", F.lit(texts.toDDL()), options).alias("h"))
    named = [F.lower(F.coalesce(F.col("h").getField(f.name), F.lit(""))) == f.name.lower() for f in schema.fields]
    other = header.filter(~reduce(lambda a, b: a & b, named)).head()
    if other:
        raise ValueError(f"the header does not name the columns of the schema: {list(other.h)}")
    folders = [c for c in found.columns if c not in ("file", "record", "first")]
    rows = found.filter(~F.col("first") & (F.col("record") != "")).select(
        F.from_csv("record", F.lit(schema.toDDL()), options).alias("r"), *folders
    )
    return rows.select("r.*", *folders)


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None, mode: str = "PERMISSIVE") -> DataFrame:
    """JSON records: on a line each or spread over lines, in arrays or not.

    A large file is read by many tasks: a first native pass looks whether every line is whole records, and if not, records
    are cut at the brackets' depth. ``mode="FAILFAST"`` raises on what is no JSON.
    """
    schema = schema_of("scraped") if schema is None else schema
    text = records.lines(spark, path)
    if not records.json_breaks(text):
        return spark.read.schema(schema).json(path, mode=mode)
    found = records.json_records(text)
    folders = [c for c in found.columns if c not in ("file", "record", "first")]
    return found.select(F.from_json("record", schema, {"mode": mode}).alias("r"), *folders).select("r.*", *folders)


def read_file(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV or JSON by suffix. Anything else raises: an empty result would hide lost input."""
    name = path.rstrip("/").lower()
    if name.endswith(".csv"):
        return read_csv(spark, path, schema)
    if name.endswith(".json"):
        return read_json(spark, path, schema)
    raise ValueError(f"unsupported file type: {path}")


def read_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Stored table with only the asked columns read."""
    return spark.read.parquet(path).select(*columns)
