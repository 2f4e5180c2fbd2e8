"""Quality rules: text counts, and the removal of lines that too many documents of a host share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from homeledger.session import materialize

SPACE = r"[ \t-\r]+"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_HOST_DOCS = 100  # a line in more documents of one host than this is removed
MIN_LEFT = 0.2  # a document keeps at least this share of its words, or is rejected


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _texts(docs: DataFrame, host: str) -> DataFrame:
    """``doc_id, host`` (its hash), ``text`` (null: empty) and ``key``, which rows equal in all three share."""
    text = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.col(host).isNull(), F.col(host)).alias("host"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return text.withColumn("key", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "host", "text"))


def _normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), SPACE, " "))


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^ \t-\r]")


def text_counts(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row per document with its counts and its lines' hashes, in one pass over the texts.

    ``key, doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` and, for each line
    with a word, its hash in ``lines`` (of host and normalised line: lower case, single spaces).
    A null text has no words; null hosts are one host.
    """
    split = _texts(docs, host).select(
        "key", "doc_id", "host", _words(F.col("text")).alias("w"),
        (F.char_length("text") - F.char_length(F.translate("text", "#*$%&|<>", ""))).alias("n_symbols"),
        F.filter(F.split("text", "\n"), _has_word).alias("raw"),
    )
    hashed = split.select(
        "key", "doc_id", "host", "n_symbols", "raw",
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).alias("word_chars"),
        F.when(
            F.size("w") >= WINDOW,
            F.transform(
                F.sequence(F.lit(1), F.size("w") - (WINDOW - 1)),
                lambda i: F.xxhash64(*[F.element_at("w", i + k) for k in range(WINDOW)]),
            ),
        ).alias("h"),
        F.transform("raw", _normal).alias("normal"),
    )
    # Only texts with a window that comes again sort their windows.
    sorted_ = hashed.select(
        "*",
        F.when(
            F.size(F.array_distinct("h")) < F.size("h"),
            F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias("s"),
    )

    def again(x: Column, i: Column) -> Column:
        same = [F.coalesce(F.get("s", i + step).h == x.h, F.lit(False)) for step in (-1, 1)]
        return same[0] | same[1]

    places = sorted_.select("*", F.sort_array(F.transform(F.filter("s", again), lambda x: x.i)).alias("p"))
    covered = F.aggregate(
        F.transform("p", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("p", i + 1) - p, F.lit(WINDOW)))),
        F.lit(0).cast("long"), lambda a, b: a + b,
    )
    return places.select(
        "key", "doc_id", "n_words",
        F.col("word_chars").cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        (F.size("raw") - F.size(F.array_distinct("raw"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.transform("normal", lambda x: F.xxhash64(F.col("host"), x)).alias("lines"),
    )


def common_lines(counts: DataFrame, max_host_docs: int = MAX_HOST_DOCS) -> DataFrame:
    """Hashes ``line`` of the lines in more than ``max_host_docs`` documents of one host.

    A document counts once, however often it has the line; counts are combined before the shuffle.
    """
    each = counts.select(F.explode(F.array_distinct("lines")).alias("line"))
    return each.groupBy("line").agg(F.count("*").alias("n")).filter(F.col("n") > max_host_docs).select("line")


def without_common_lines(docs: DataFrame, counts: DataFrame, common: DataFrame, host: str = "source") -> DataFrame:
    """``key, clean, n_left``: the texts that hold common lines without these lines, and the words left.

    One row per key. The other lines stand as they were, blank ones too. The lines that go are joined to their texts as
    hashes; where Spark does not broadcast these, each text is shuffled once.
    """
    lines = counts.select("key", F.explode("lines").alias("line"))
    gone = lines.join(common, "line").groupBy("key").agg(F.collect_set("line").alias("gone"))
    stays = lambda x: ~(_has_word(x) & F.array_contains("gone", F.xxhash64(F.col("host"), _normal(x))))
    clean = _texts(docs, host).join(gone, "key").select(
        "key", F.array_join(F.filter(F.split("text", "\n"), stays), "\n").alias("clean"))
    counted = clean.withColumn("n_left", F.size(_words(F.col("clean"))).cast("long"))
    return counted.groupBy("key").agg(F.first("clean").alias("clean"), F.first("n_left").alias("n_left"))


def quality_rules(
    docs: DataFrame, host: str = "source", max_host_docs: int = MAX_HOST_DOCS, min_left: float = MIN_LEFT
) -> DataFrame:
    """The counts of every document, its text without common lines, and the verdicts (an action per step).

    ``base_failed``: fewer than ``MIN_WORDS`` words, or over ``MAX_REPEAT_PERCENT`` % of them
    in repeated windows. ``clean``: the text without the lines common to the host, null where none is
    removed and the text stands as it is. ``common_words``: the words that went with them.
    ``kept``: not failed, and what is left is at least ``min_left`` of the words. The counts are
    stored, and each row is a document of its own, repeated rows and null ids too; equal rows share one
    cleaned text. A null or empty text fails. Very long texts and lines count whole. An empty table gives no rows.
    """
    counts = materialize(text_counts(docs, host), "line-counts")
    common = materialize(common_lines(counts, max_host_docs), "common-lines")
    cleaned = without_common_lines(docs, counts, common, host)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    n_left = F.coalesce("n_left", "n_words")
    return (
        counts.drop("lines").join(cleaned, "key", "left")
        .withColumn("common_words", F.col("n_words") - n_left)
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (n_left >= min_left * F.col("n_words")))
        .drop("key", "n_left")
    )
