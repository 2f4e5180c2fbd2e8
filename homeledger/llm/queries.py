"""The operators as named queries over the given tables, with DuckDB twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from homeledger.llm import (
    decontaminate, language, lengths, licenses, linerules, merkle, mixing, packing, periodic, pii, quality, shards,
    simhash,
)
from homeledger.llm.text import documents, fold
from homeledger.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str):
    def keep(fn):
        QUERIES[name] = fn
        return fn

    return keep


@query("op1_decontaminate")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.contaminated(documents(spark, sf_dir), benchmark).drop("key")


@query("op2_pack")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir)).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
        "cost",
    )


@query("op3_training_order")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "training-order")
    shards.write_shards(documents(spark, sf_dir), path, key=20240229)
    return shards.read_shards(spark, path).select(
        "slot", "shard", "byte_offset", "index", "first_doc_id", "first_start", "n_tokens",
        F.crc32("ids").alias("ids_crc32"),
    )


@query("op4_license_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


@query("op5_personal_data")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(documents(spark, sf_dir)).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans"
    )


@query("op6_quality_classifier")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(fold("doc_id", 5) != 0)
    scored, _ = quality.quality_scores(documents(spark, sf_dir), labels)
    return scored.select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


@query("op7_simhash")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


@query("op8_language")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language.fit(docs.filter(fold("doc_id", 3) != 1))
    return language.predict(docs, model, ["doc_id"]).select("row.doc_id", "lang_pred", "score").select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score"
    )


@query("op9_length_histogram")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return lengths.length_table(lengths.histogram(lengths.encoded_lengths(docs)))


@query("op10_line_rules")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linerules.quality_rules(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "common_words",
    )


ORACLE["op10_line_rules"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^ \t-\r]+') AS w FROM d),
x AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
g AS (SELECT r, i, [x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o] AS k
  FROM x WINDOW o AS (PARTITION BY r ORDER BY i)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM g WHERE k[5] IS NOT NULL)
  WHERE n > 1),
covered AS (SELECT r, sum(least(5, coalesce(next - i, 5))) AS n FROM (SELECT r, i,
  lead(i) OVER (PARTITION BY r ORDER BY i) AS next FROM again) GROUP BY r),
lines AS (SELECT r, source, l, trim(regexp_replace(lower(l), '[ \t-\r]+', ' ', 'g')) AS nl
  FROM (SELECT r, source, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^ \t-\r]')),
dup AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM lines GROUP BY r),
common AS (SELECT source, nl FROM lines GROUP BY source, nl HAVING count(DISTINCT r) > 100),
removed AS (SELECT l.r, sum(len(string_split(l.nl, ' '))) AS n FROM lines l JOIN common c
  ON l.nl = c.nl AND l.source IS NOT DISTINCT FROM c.source GROUP BY l.r),
c AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
  CAST(coalesce(list_sum(list_transform(w, lambda v: length(v))), 0) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(coalesce(removed.n, 0) AS BIGINT) AS common_words
  FROM d JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN covered USING (r) LEFT JOIN removed USING (r)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
SELECT *, NOT base_failed AND n_words - common_words >= 0.2 * n_words AS kept FROM f"""

def periodic_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, text``, where every tenth id's text ends in a repetition of some of its own words.

    Ids are drawn by their crc32; a missing id has none, and its text stays.
    """
    text = F.col("text").cast("string")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.floor(h / 10).cast("long").alias("g"),
        F.when(h % 10 == 0, F.array_remove(F.split(text, mixing.SPACE), "")).alias("w"),
    )
    n = F.size("w").cast("long")
    first = words.withColumn("a", F.when(n > 0, F.col("g") % n))
    period = 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)).cast("long")
    again = F.transform(
        "w",
        lambda w, i: F.when(i < F.col("a"), w).otherwise(
            F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))
        ),
    )
    return first.withColumn("p", period).select(
        "doc_id", F.when(F.col("a").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text")
    )


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(periodic_texts(documents(spark, sf_dir)))
    line = lambda r: F.concat_ws(",", r.start, r.length, r.period)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "strongest.start", "strongest.length",
        "strongest.period", F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )


@query("op12_mix_sources")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "start"
    )


ORACLE["op12_mix_sources"] = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+')) AS BIGINT) AS size,
  CAST('0x' || substr(md5('12:' || coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || coalesce(text, '')), 1, 15)
    AS BIGINT) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, CAST(2 * source_size AS DOUBLE) AS cap, CAST(CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3
  WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight FROM s),
w AS (SELECT *, (1.5 * (SELECT sum(source_size) FROM r) - coalesce(sum(cap) OVER (ORDER BY cap / weight, source
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) / sum(weight) OVER (ORDER BY cap / weight, source
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
l AS (SELECT max(level) AS level FROM w), -- capping a source below the level raises it, any other lowers it
t AS (SELECT r.source, r.source_size, CASE WHEN cap <= l.level * weight THEN cap ELSE l.level * weight END AS target
  FROM r, l),
o AS (SELECT d.*, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM d),
b AS (SELECT o.*, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
  CASE WHEN t.source_size > 0 THEN CAST(floor(t.target) AS BIGINT) // t.source_size ELSE 0 END AS whole
  FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(whole * size + greatest(0, least(size, budget - whole * source_size - start)) AS BIGINT) AS taken, source, start
FROM b"""


@query("op13_merkle_manifest")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    fields = {c: F.col(c) for c in merkle.FIELDS}
    # Every third id's text is found in lower case later.
    lower = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    changed = F.when(third, merkle.leaf(list((fields | {"text": lower}).values())))
    return merkle.manifest(docs, claimed=changed).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "n_siblings"
    )


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
