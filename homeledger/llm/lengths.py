"""Exact histogram of encoded document lengths, and what it answers for every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from homeledger.llm import tokens
from homeledger.session import materialize, ship_package

BUCKET = 1024


def encoded_lengths(docs: DataFrame, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """One row per document: ``n_tokens`` long, the closing id included (null text: 1).

    Repeated rows give a row each; very long texts are encoded whole; other columns are not read.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(tokens.document_ids(t.as_py(), vocabulary)) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], names=["n_tokens"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "n_tokens long")


def histogram(lengths: DataFrame, length: str = "n_tokens") -> DataFrame:
    """Documents per encoded length: ``n_tokens, docs``, combined before the shuffle."""
    return lengths.groupBy(F.col(length).alias("n_tokens")).agg(F.count("*").alias("docs"))


def length_table(hist: DataFrame) -> DataFrame:
    """The histogram with its suffix sums: the answers for each length as a context limit.

    ``n_tokens, docs``; ``docs_at_most, tokens_at_most`` (documents that fit whole);
    ``docs_longer, tokens_longer`` (suffix sums over the longer ones); ``truncated_tokens``
    (all tokens kept when every document is cut to ``n_tokens``); ``lost_tokens``;
    ``quantile`` (share of documents of at most this length). An empty histogram gives no rows.

    The sums run in two levels, over buckets of lengths and within a bucket, so no task holds
    more lengths than one bucket has, or more buckets than the longest document needs. The histogram
    is stored first (an action), as its rows are read more than once.
    """
    hist = materialize(hist, "length-histogram")
    hist = hist.withColumn("_b", F.floor(F.col("n_tokens") / BUCKET)).withColumn(
        "_t", F.col("n_tokens") * F.col("docs")
    )
    above = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    buckets = (
        hist.groupBy("_b")
        .agg(F.sum("docs").alias("_d"), F.sum("_t").alias("_s"))
        .select(
            "_b",
            F.coalesce(F.sum("_d").over(above), zero).alias("_da"),
            F.coalesce(F.sum("_s").over(above), zero).alias("_ta"),
            F.sum("_d").over(every).alias("_dn"),
            F.sum("_s").over(every).alias("_tn"),
        )
    )
    longer = (
        Window.partitionBy("_b").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    )
    table = (
        hist.join(buckets, "_b")
        .withColumn("docs_longer", F.col("_da") + F.coalesce(F.sum("docs").over(longer), zero))
        .withColumn("tokens_longer", F.col("_ta") + F.coalesce(F.sum("_t").over(longer), zero))
    )
    kept = F.col("_tn") - F.col("tokens_longer") + F.col("docs_longer") * F.col("n_tokens")
    return table.select(
        "n_tokens",
        "docs",
        (F.col("_dn") - F.col("docs_longer")).alias("docs_at_most"),
        (F.col("_tn") - F.col("tokens_longer")).alias("tokens_at_most"),
        "docs_longer",
        "tokens_longer",
        kept.alias("truncated_tokens"),
        (F.col("_tn") - kept).alias("lost_tokens"),
        ((F.col("_dn") - F.col("docs_longer")) / F.col("_dn")).alias("quantile"),
    )


def truncated_totals(table: DataFrame, limits: list[int]) -> DataFrame:
    """For any context limits: ``context_limit, docs_cut, tokens_kept`` from a length table.

    A limit lies between two lengths: the documents up to it are whole, the longer ones give
    ``limit`` tokens each. A limit below every length cuts all. An empty table gives zeros.
    """
    rows = [
        F.struct(
            F.lit(limit).cast("long").alias("context_limit"),
            F.coalesce(F.sum(F.when(F.col("n_tokens") > limit, F.col("docs"))), F.lit(0)).alias("docs_cut"),
            F.coalesce(
                F.sum(F.col("docs") * F.least(F.col("n_tokens"), F.lit(limit))), F.lit(0)
            ).alias("tokens_kept"),
        )
        for limit in limits
    ]
    return table.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def length_quantile(table: DataFrame, shares: list[float]) -> DataFrame:
    """``share, n_tokens``: the smallest length that at least this share of documents fits in."""
    rows = [
        F.struct(
            F.lit(float(share)).alias("share"),
            F.min(F.when(F.col("quantile") >= share, F.col("n_tokens"))).alias("n_tokens"),
        )
        for share in shares
    ]
    return table.agg(F.array(*rows).alias("r")).select(F.inline("r"))
