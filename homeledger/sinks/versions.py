"""Stored table versions: a change rewrites the hash buckets it touches and then swaps a manifest.

A table is a folder of parquet files per bucket of its key. A version is a manifest that names the folder of
each bucket; the highest-numbered manifest counts. Writers put new files beside the old ones and add
the next manifest at the end, so a failed change leaves the table as it was, and readers of an older version keep it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64


class ChangedMeanwhile(Exception):
    """Another change was committed first; read the new version and try again."""


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at, jvm


def versions(spark: SparkSession, path: str) -> list[int]:
    """The stored versions' numbers, ascending; none for a table that does not exist."""
    fs, at, _ = _fs(spark, f"{path}/manifest")
    found = [str(f.getPath().getName()) for f in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n.removesuffix(".json")) for n in found if n.endswith(".json"))


def _manifest(spark: SparkSession, path: str, version: int | None) -> tuple[int, dict]:
    stored = versions(spark, path)
    if not stored or version is not None and version not in stored:
        raise FileNotFoundError(f"{path} has no version {version}")
    number = stored[-1] if version is None else version
    # A few lines of text: one name a bucket.
    text = spark.read.option("wholetext", "true").text(f"{path}/manifest/{number}.json").first()[0]
    return number, json.loads(text)


def _commit(spark: SparkSession, path: str, number: int, manifest: dict) -> None:
    """Adds a manifest under a name that no other writer has taken."""
    fs, at, jvm = _fs(spark, f"{path}/manifest/{number}.json")
    fs.mkdirs(at.getParent())
    draft = jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/.{uuid.uuid4().hex}")
    out = fs.create(draft)
    try:
        out.write(bytearray(json.dumps(manifest).encode()))
    finally:
        out.close()
    if fs.exists(at) or not fs.rename(draft, at):
        fs.delete(draft, False)
        raise ChangedMeanwhile(f"{path}: version {number} is there already")


def _write(df: DataFrame, path: str, key: str, buckets: int) -> tuple[str, set[int]]:
    """New files, sorted by key within each bucket; the folder and the buckets that have rows."""
    spark = df.sparkSession
    folder = f"data/{uuid.uuid4().hex}"
    rows = df.withColumn("_bucket", bucket_of(key, buckets))
    rows.repartition("_bucket").sortWithinPartitions("_bucket", key).write.partitionBy("_bucket").parquet(f"{path}/{folder}")
    fs, at, _ = _fs(spark, f"{path}/{folder}")
    names = [str(f.getPath().getName()) for f in fs.listStatus(at)]
    return folder, {int(n.removeprefix("_bucket=")) for n in names if n.startswith("_bucket=")}


def create(df: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> int:
    """Stores a table as version 0."""
    folder, filled = _write(df, path, key, buckets)
    manifest = {"key": key, "buckets": buckets, "schema": df.schema.json(), "folders": {str(b): folder for b in filled}}
    _commit(df.sparkSession, path, 0, manifest)
    return 0


def _rows(spark: SparkSession, path: str, manifest: dict, only: set[int] | None = None) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(manifest["schema"]))
    paths = [f"{path}/{folder}/_bucket={b}" for b, folder in sorted(manifest["folders"].items())
             if only is None or int(b) in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version, by default of the last one."""
    return _rows(spark, path, _manifest(spark, path, version)[1])


def _touched(keys: DataFrame, manifest: dict) -> set[int]:
    """Buckets of the keys: at most as many rows as the table has buckets."""
    found = keys.select(bucket_of(manifest["key"], manifest["buckets"]).alias("b")).distinct().collect()
    return {r.b for r in found}


def lookup(spark: SparkSession, path: str, keys: DataFrame, version: int | None = None) -> DataFrame:
    """The rows with one of the keys (an action); only their buckets are opened."""
    _, manifest = _manifest(spark, path, version)
    key = manifest["key"]
    rows = _rows(spark, path, manifest, _touched(keys, manifest))
    return rows.join(keys.select(key).distinct(), key, "left_semi").select(*rows.columns)


def change(spark: SparkSession, path: str, keys: DataFrame, step: Callable[[DataFrame], DataFrame]) -> int:
    """Stores the next version and returns its number.

    ``keys`` has the keys that may change, appear or go. ``step`` gets the rows of their buckets and returns
    the new ones, e.g. ``lambda rows: tables.update_rows(rows, updates, ...)``. Other buckets' files are
    part of the new version as they are. A change that fails, or that another one overtakes, changes nothing.
    """
    number, manifest = _manifest(spark, path, None)
    touched = _touched(keys, manifest)
    if not touched:
        return number
    rows = _rows(spark, path, manifest, touched)
    folder, filled = _write(step(rows).select(*rows.columns), path, manifest["key"], manifest["buckets"])
    if not filled <= touched:
        raise ValueError("the change made rows with keys it was not asked to change")
    kept = {b: f for b, f in manifest["folders"].items() if int(b) not in touched}
    _commit(spark, path, number + 1, {**manifest, "folders": {**kept, **{str(b): folder for b in filled}}})
    return number + 1
