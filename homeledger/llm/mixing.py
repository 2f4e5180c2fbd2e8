"""Mixing sources to target weights: hash-random order per source, cut at each source's budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from homeledger.llm.order import numbered
from homeledger.session import materialize

SPACE = r"[ \t-\r]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2
SEED = 12
KEY_BITS = 60
RANGE_BITS = 12  # a source's keys fall in so many halvings, 4096 ranges of equal width


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")).cast("long")


def random_key(seed: int, doc_id: Column, text: Column) -> Column:
    """``KEY_BITS`` bits of a hash of seed, id and text."""
    given = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(":"),
                     F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(given), 1, KEY_BITS // 4), 16, 10).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS
) -> DataFrame:
    """``known, name, source_size, target`` for each source of ``sizes (known, name, source_size)`` (actions).

    Sources in the order of their names' code points, the missing one (``known`` is false) last, have the weights
    in turn and share ``share`` times all sizes. No target exceeds ``epochs`` times its source's size; what
    is above is shared again by weight. That ends at one level: each target is the smaller of its cap and
    ``level * weight``. Every round sets the level from two sums, which alone reach the driver,
    and caps the sources below it; no more capped, no more rounds.
    """
    ranked = numbered(sizes, [(~F.col("known")), F.col("name")], "rank", "mixing-sources")
    given = F.array(*[F.lit(float(w)) for w in weights])
    sources = materialize(
        ranked.select(
            "known", "name", "source_size", (F.col("source_size") * epochs).cast("double").alias("cap"),
            F.get(given, (F.col("rank") % len(weights)).cast("int")).alias("weight"),
        ),
        "mixing-weights",
    )
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    capped, level, count = F.lit(False), 0.0, -1
    while True:
        sums = sources.agg(
            F.count_if(capped).alias("n"), F.sum(F.when(capped, F.col("cap"))).alias("cap"),
            F.sum(F.when(~capped, F.col("weight"))).alias("weight"),
        ).first()
        if sums.n == count:
            break
        count = sums.n
        if sums.weight:
            level = (share * total - (sums.cap or 0.0)) / sums.weight
        capped = F.lit(not sums.weight) | (F.col("cap") <= F.lit(level) * F.col("weight"))
    target = F.when(capped, F.col("cap")).otherwise(F.lit(level) * F.col("weight"))
    return sources.select("known", "name", "source_size", target.alias("target"))


def mix(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """How many words of each document the mix takes (an action per step).

    ``doc_id, source, size, source_size, target, start, taken``: ``size`` words, at ``start`` words of its source
    in the order of hash-random keys. A source's budget is its target rounded down. It gives all its documents
    as often as the budget holds the whole source, then from the first on what is left; the document at
    the cut gives its first words only, so the words taken are exactly the budget.

    One pass over the texts stores thin rows. Keys are random, so ranges of equal width hold about
    equally many documents of a source: sizes are summed per range before the shuffle, the sums of at most 4096
    ranges are added up per source, and each range sorts and adds up its own documents. No task has more than a
    4096th of a source, however much of the table that is. The same rows give the same mix.

    Null, empty and blank texts have size 0 and give nothing; null sources are one source, the last in
    order. Very long texts count whole. Repeated rows, of one key, count one after the other;
    rows of one key go by size. Without rows, or without words, nothing is taken. Other columns are not read.
    """
    text = F.col("text").cast("string")
    thin = materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").isNotNull().alias("known"),
            F.coalesce(F.col("source").cast("string"), F.lit("")).alias("name"),
            word_count(text).alias("size"),
            random_key(seed, F.col("doc_id").cast("long"), text).alias("key"),
        ),
        "mixing-sizes",
    )
    place = F.shiftright("key", KEY_BITS - RANGE_BITS).cast("int")
    thin = thin.withColumn("range", place)
    ranges = materialize(thin.groupBy("known", "name", "range").agg(F.sum("size").alias("words")), "mixing-ranges")
    targets = source_targets(
        ranges.groupBy("known", "name").agg(F.sum("words").alias("source_size")), weights, share, epochs
    )
    earlier = Window.partitionBy("known", "name").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.select(
        "known", "name", "range", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before")
    ).join(targets, ["known", "name"])
    within = (
        Window.partitionBy("known", "name", "range").orderBy("key", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = thin.withColumn("local", F.coalesce(F.sum("size").over(within), F.lit(0)))
    budget = F.floor("target")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - F.col("whole") * F.col("source_size") - F.col("start")
    return (
        local.join(before, ["known", "name", "range"])
        .withColumn("start", F.col("before") + F.col("local"))
        .withColumn("whole", whole)
        .select(
            "doc_id", F.when(F.col("known"), F.col("name")).alias("source"), "size", "source_size", "target", "start",
            (F.col("whole") * F.col("size") + F.greatest(F.lit(0), F.least("size", rest))).cast("long").alias("taken"),
        )
    )
