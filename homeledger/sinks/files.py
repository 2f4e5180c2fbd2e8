"""Saving listings. Outputs are directories written by all tasks in parallel."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from homeledger.functions.text import escape_lines
from homeledger.operators.clean import with_all_columns
from homeledger.sources.files import read_csv

ISO_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
_NESTED = (T.ArrayType, T.MapType, T.StructType)
# Values are written as they are: outer spaces kept, quotes doubled.
_CSV = {
    "header": True, "quote": '"', "escape": '"', "emptyValue": '""',
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def default_name(prefix: str = "properties", suffix: str = ".csv") -> str:
    return f"{prefix}_{datetime.now(timezone.utc):%Y%m%d_%H%M%S}{suffix}"


def _with_suffix(path: str, suffix: str) -> str:
    return path if path.endswith(suffix) else path + suffix


def flat(df: DataFrame, one_line: bool = False) -> DataFrame:
    """Rows as CSV can hold them: nested columns as JSON text.

    ``one_line`` writes line breaks and backslashes in texts as escapes, for readers that take every line
    as a record; such files are read back with ``read_csv(..., one_line=True)``.
    """
    cells = {f.name: F.to_json(f.name) for f in df.schema.fields if isinstance(f.dataType, _NESTED)}
    if one_line:
        cells |= {f.name: F.col(f.name) for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
        cells = {c: escape_lines(x) for c, x in cells.items()}
    return df.withColumns(cells) if cells else df


def _write_counted(df: DataFrame, write) -> int:
    """Run the write and return its row count without a second pass."""
    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    return seen.get["rows"]


def save_csv(
    df: DataFrame, folder: str, name: str | None = None, encoding: str = "utf-8", one_line: bool = False
) -> str:
    """Texts are quoted where needed and stand as they are; see :func:`flat` for ``one_line``."""
    path = _with_suffix(f"{folder}/{name or default_name()}", ".csv")
    flat(df, one_line).write.options(**_CSV).csv(path, encoding=encoding, mode="overwrite")
    return path


def append_csv(new: DataFrame, path: str, deduplicate: bool = True) -> int:
    """Add rows to a CSV folder, which may not exist yet; returns the number of rows given.

    Only new files are written, in one commit. With ``deduplicate`` each distinct row that
    is not stored yet is added once; empty text counts as null, as CSV cannot tell them apart.
    """
    rows = flat(new)
    if deduplicate:
        texts = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.StringType)]
        rows = rows.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in texts}) if texts else rows
        stored = _stored_csv(rows.sparkSession, path, rows.schema)
        rows = rows.distinct() if stored is None else rows.subtract(flat(stored))
    rows.write.options(**_CSV).csv(path, mode="append")
    # Counted apart: where nothing is new, the plan that would be observed is optimised away.
    return new.count()


def _stored_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    try:
        return read_csv(spark, path, schema)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition()):
            raise
        return None


def save_json(df: DataFrame, folder: str, name: str | None = None) -> str:
    """JSON lines with ISO time stamps."""
    path = _with_suffix(f"{folder}/{name or default_name(suffix='.json')}", ".json")
    df.write.json(path, mode="overwrite", timestampFormat=ISO_MICROS + "XXX",
                  ignoreNullFields=False)
    return path


def save_job_csv(df: DataFrame, folder: str, job_column: str = "job_id") -> int:
    """Output of one or more jobs, one sub-folder per job; returns the row count.

    Every task writes its own file per job, so a job with most of the rows is not a
    bottleneck. A failing write raises.
    """
    return _write_counted(
        flat(df),
        lambda d: d.write.partitionBy(job_column).options(**_CSV).csv(folder, mode="append"),
    )


def save_table(
    df: DataFrame, path: str, table: str, mode: str = "overwrite", cluster: tuple[str, str] | None = None
) -> DataFrame:
    """Write with the declared columns and types of a table; returns the stored table.

    ``cluster=(ts, key)`` stores it by day of ``ts``, a folder each (column ``<ts>_day``), and sorted by key
    within, so that look-backs and retention open the days they need and look-ups skip row groups. A day of any
    size is spread over files by ranges of the key.
    """
    rows = with_all_columns(df, table)
    return save_clustered(rows, path, *cluster, mode=mode) if cluster else _stored(rows, path, mode)


def _stored(rows: DataFrame, path: str, mode: str) -> DataFrame:
    rows.write.mode(mode).parquet(path)
    return rows.sparkSession.read.parquet(path)


def save_clustered(rows: DataFrame, path: str, ts: str, key: str, mode: str = "overwrite") -> DataFrame:
    """Any table by day and key; see :func:`save_table`. Rows without ``ts`` are in a folder of their own."""
    day = f"{ts}_day"
    sorted_ = rows.withColumn(day, F.to_date(ts)).repartitionByRange(day, key).sortWithinPartitions(day, key)
    sorted_.write.mode(mode).partitionBy(day).parquet(path)
    schema = T.StructType([*rows.schema.fields, T.StructField(day, T.DateType())])
    return rows.sparkSession.read.schema(schema).parquet(path)


def export(df: DataFrame, path: str, fmt: str = "csv", encoding: str = "utf-8") -> str:
    if fmt == "csv":
        df = flat(df)
    options = _CSV if fmt == "csv" else {}
    df.write.format(fmt).mode("overwrite").options(encoding=encoding, **options).save(path)
    return path
