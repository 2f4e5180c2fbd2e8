"""Token sequences in a keyed random training order, written as fixed-stride shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from homeledger.llm import tokens
from homeledger.session import materialize, ship_package

SEQUENCE = 2048
SHARD_SLOTS = 8192
ROUNDS = 6
DTYPE = "<u2"  # ids below 65,536; "<u4" for larger vocabularies


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, count: int, key: int) -> np.ndarray:
    """Slots of the given indices: a keyed permutation of ``0 .. count - 1``.

    A balanced Feistel network permutes the smallest domain of 4^h values that holds ``count``;
    a value that falls outside walks on along its cycle until it is inside again.
    """
    half = max(1, ((max(count, 2) - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    seeds = _mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) ^ _mix(np.array([key % (1 << 64)], dtype=np.uint64)))

    def network(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for seed in seeds:
            left, right = right, left ^ (_mix(right ^ seed) & mask)
        return (left << shift) | right

    slot = network(index.astype(np.uint64))
    while len(out := np.flatnonzero(slot >= np.uint64(count))):
        slot[out] = network(slot[out])
    return slot.astype(np.int64)


def sequences(
    docs: DataFrame,
    sequence: int = SEQUENCE,
    vocabulary: str = tokens.VOCABULARY,
    dtype: str = DTYPE,
) -> DataFrame:
    """Documents of a scan task, one after another, cut every ``sequence`` ids.

    ``part, local`` (task and number within it), ``first_doc_id, first_start`` (where the
    first id comes from), ``n_tokens`` and ``ids``: always ``sequence`` ids, the last sequence of
    a task padded with the closing id. Null texts count as empty; empty tasks give no rows.
    """
    ship_package(docs.sparkSession)
    columns = ["part", "local", "first_doc_id", "first_start", "n_tokens", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, local, size = TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        first = (None, 0)

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=columns
            )

        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = tokens.document_ids(text.as_py(), vocabulary)
                at = 0
                while at < len(ids):
                    if not size:
                        first = (doc_id, at)
                    taken = ids[at : at + sequence - size]
                    held.append(taken)
                    at, size = at + len(taken), size + len(taken)
                    if size == sequence:
                        rows.append((part, local, *first, size, np.concatenate(held).astype(dtype).tobytes()))
                        held, size, local = [], 0, local + 1
            if rows:
                yield emit(rows)
        if size:
            padding = np.full(sequence - size, tokens.EOS, dtype=tokens.DTYPE)
            ids = np.concatenate([*held, padding]).astype(dtype)
            yield emit([(part, local, *first, size, ids.tobytes())])

    schema = "part int, local long, first_doc_id long, first_start long, n_tokens int, ids binary"
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, schema)


def write_shards(
    docs: DataFrame,
    path: str,
    key: int = 0,
    sequence: int = SEQUENCE,
    shard_slots: int = SHARD_SLOTS,
    vocabulary: str = tokens.VOCABULARY,
    dtype: str = DTYPE,
) -> None:
    """Writes all documents as token sequences in training order below ``path`` (an action).

    ``path/shards/shard=<n>`` holds the slots ``n * shard_slots`` up to the next shard, in
    order, every one with the same number of bytes; ``path/manifest`` holds one row with what
    a reader needs. The sequences are stored once, so that their number and each task's first
    index are known; then each goes straight to the task that writes its shard. The order
    depends on the key and the input's splits only. An empty table gives a manifest of no slots. Repeated rows are
    written each, very long texts take as many sequences as they need, other columns are not read. A
    vocabulary with ids that ``dtype`` cannot hold raises.
    """
    spark = docs.sparkSession
    if tokens.encoding(vocabulary).n_vocab > np.iinfo(np.dtype(dtype)).max + 1:
        raise ValueError(f"{dtype} cannot hold the ids of {vocabulary}")
    spread = materialize(sequences(docs, sequence, vocabulary, dtype), "sequences", compression="zstd")
    parts = spread.groupBy("part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    # Stored, one row per task, so that Spark knows it can broadcast them and leaves the ids in place.
    parts = materialize(parts, "sequence-parts")
    count = spread.count()

    @F.pandas_udf("long")
    def slot_of(index: pd.Series) -> pd.Series:
        return pd.Series(permute(index.to_numpy(), count, key))

    placed = (
        spread.join(parts, "part")
        .withColumn("index", F.col("_first") + F.col("local"))
        .withColumn("slot", slot_of("index"))
        .withColumn("shard", F.expr(f"cast(slot div {shard_slots} as int)"))
    )
    (
        placed.select("slot", "index", "first_doc_id", "first_start", "n_tokens", "ids", "shard")
        .repartitionById(max(1, -(-count // shard_slots)), F.col("shard"))
        .sortWithinPartitions("shard", "slot")
        .write.option("compression", "zstd")
        .partitionBy("shard")
        .parquet(f"{path}/shards")
    )
    width = np.dtype(dtype).itemsize
    spark.range(1).selectExpr(
        f"{count}L slots", f"{sequence} sequence", f"{sequence * width} stride", f"{shard_slots}L shard_slots",
        f"'{dtype}' dtype", f"{key}L key",
    ).write.parquet(f"{path}/manifest")


def read_shards(spark: SparkSession, path: str, first_slot: int = 0) -> DataFrame:
    """The written sequences from ``first_slot`` on, to resume training there.

    Whole shards before it are not opened. ``byte_offset`` is where the slot's ids begin when those of its shard are
    laid one after the other, as every slot has the same number of bytes; the stored files themselves are compressed.
    """
    meta = spark.read.parquet(f"{path}/manifest").first()
    schema = "slot long, index long, first_doc_id long, first_start long, n_tokens int, ids binary, shard int"
    if not meta.slots:
        return spark.createDataFrame([], f"{schema}, byte_offset long")
    return (
        spark.read.schema(schema)
        .parquet(f"{path}/shards")
        .filter((F.col("shard") >= first_slot // meta.shard_slots) & (F.col("slot") >= first_slot))
        .withColumn("byte_offset", (F.col("slot") % meta.shard_slots) * meta.stride)
    )
