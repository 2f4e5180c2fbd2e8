"""Benchmark decontamination by greedy string tiling over shared-token seeds."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from homeledger.llm.text import row_key
from homeledger.session import materialize, ship_package

MIN_TILE = 5
COVERAGE = 0.5  # share of a test item; what texts share by chance stays well below it
BITS_PER_SEED = 1024  # of the bit array, as far as its largest size goes
LEAST_BITS, MOST_BITS = 1 << 24, 1 << 27
WORD = re.compile(r"\w+")
# Letters of scripts written without spaces are words of their own (code blocks; fixed values).
UNSPACED = (
    "\u0e00-\u0eff\u0f00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
    "\U00020000-\U0003ffff"
)
ANY_UNSPACED = re.compile(f"[{UNSPACED}]")
MIXED_WORD = re.compile(f"[{UNSPACED}]|(?:(?![{UNSPACED}])\\w)+")
BASE = np.uint64(0x9E3779B97F4A7C15)
CACHED_WORDS = 200_000

_known: dict[str, int] = {}


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words (letters, digits, underscore) of a lower-cased text.

    In scripts written without spaces every letter is a word.
    """
    if len(_known) > CACHED_WORDS:
        _known.clear()
    out, low = [], text.lower() if text else ""
    pattern = WORD if low.isascii() or not ANY_UNSPACED.search(low) else MIXED_WORD
    for word in pattern.findall(low):
        h = _known.get(word)
        if h is None:
            h = _known[word] = xxhash.xxh64_intdigest(word)
        out.append(h)
    return np.array(out, dtype=np.uint64)


def _forgetting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; the words kept for them are forgotten after the last one, as Python workers live on."""
    yield from batches
    _known.clear()


def rolling(words: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``length`` words, modulo 2^64."""
    count = len(words) - length + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64)
    words = words.astype(np.uint64)  # signed input wraps to the same bits
    out = np.zeros(count, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(length):
            out = out * BASE + words[at : at + count]
    return out


def tiles(test: np.ndarray, doc: np.ndarray, at: np.ndarray, least: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling: non-overlapping common runs ``(test start, doc index, length)``.

    ``at`` gives each document word's position; runs do not cross gaps in it. Again and again
    the longest runs of unmarked words are marked, found by Karp-Rabin hashes of a search
    length that starts long, jumps to any much longer run it meets, and halves down to
    ``least``. Equal lengths: the first in the test, then in the document.
    """
    used_test, used_doc = np.zeros(len(test), bool), np.zeros(len(doc), bool)
    found: list[tuple[int, int, int]] = []
    length = max(least, min(len(test), len(doc)))

    def windows(words: np.ndarray, used: np.ndarray, where: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        count = len(words) - length + 1
        if count <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        marks = np.r_[0, np.cumsum(used)]
        free = marks[length:] == marks[:-length]
        if where is not None:
            free &= where[length - 1 :] - where[:count] == length - 1
        start = np.flatnonzero(free)
        return start, rolling(words, length)[start]

    while True:
        i, test_hash = windows(test, used_test, None)
        j, doc_hash = windows(doc, used_doc, at)
        order = np.argsort(doc_hash, kind="stable")
        j, doc_hash = j[order], doc_hash[order]
        low = np.searchsorted(doc_hash, test_hash)
        count = np.searchsorted(doc_hash, test_hash, "right") - low
        a = np.repeat(i, count)
        step = np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count)
        b = j[np.repeat(low, count) + step]
        # Only the leftmost window of each common run is extended.
        pairs = a * (len(doc) + 1) + b
        inner = np.isin(pairs - (len(doc) + 2), pairs) & (a > 0) & (b > 0)
        runs = []
        for x, y in zip(a[~inner].tolist(), b[~inner].tolist()):
            n = length
            while (
                x + n < len(test) and y + n < len(doc) and test[x + n] == doc[y + n]
                and at[y + n] - at[y] == n and not used_test[x + n] and not used_doc[y + n]
            ):
                n += 1
            runs.append((n, x, y))
        longest = max(runs, default=(0,))[0]
        if longest > 2 * length:
            length = longest
            continue
        marked = False
        for n, x, y in sorted(runs, key=lambda r: (-r[0], r[1], r[2])):
            if not used_test[x : x + n].any() and not used_doc[y : y + n].any():
                used_test[x : x + n] = used_doc[y : y + n] = True
                found.append((x, y, n))
                marked = True
        if marked:
            continue
        if length == least:
            return found
        length = max(least, length // 2)


def _words(table: DataFrame, id_column: str) -> DataFrame:
    """``id, key, words`` of texts with at least one word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _forgetting(batches):
            words = [word_hashes(t.as_py()).view(np.int64) for t in batch.column(2)]
            keep = pa.array([len(w) > 0 for w in words])
            out = [batch.column(0), batch.column(1), pa.array(words, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(out, names=["id", "key", "words"]).filter(keep)

    return table.select(
        F.col(id_column).cast("long").alias("id"),
        row_key(id_column).alias("key"),
        F.col("text").cast("string").alias("text"),
    ).mapInArrow(run, "id long, key long, words array<long>")


def _seed_filter(seeds: DataFrame, bits: int) -> np.ndarray:
    """Bit array of the seeds' places; ``bits / 64`` longs however many seeds there are."""
    place = F.pmod(F.col("seed"), F.lit(bits))
    filled = seeds.groupBy((place / 64).cast("int").alias("w")).agg(
        F.expr(f"bit_or(shiftleft(1L, cast(pmod(pmod(seed, {bits}), 64) as int)))").alias("b")
    )
    words = np.zeros(bits // 64, dtype=np.int64)
    for row in filled.toLocalIterator():
        words[row.w] = row.b
    return words.view(np.uint64)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    coverage: float = COVERAGE,
    min_tile: int = MIN_TILE,
    filter_bits: int | None = None,
) -> DataFrame:
    """Documents that hold a test item, if only in pieces and in another order (an action per step).

    One row per pair: ``doc_id, key, item_id, test_words, covered_words, n_tiles,
    longest_tile, coverage``, where tiles of at least ``min_tile`` words cover at least
    ``coverage`` of the item's words.

    Seeds are runs of ``min_tile`` words, in shorter items of all their words. One pass over the
    documents keeps the words under seeds that a bit array of the benchmark's seeds lets through
    (``filter_bits``, by default after their number, up to 16 MB; false hits only cost work). A pair that reaches
    the coverage shares enough seeds, counted at all their places in the item, that one of the item's
    rarest is among them: only those are joined, so a phrase of many items makes no
    pairs. What shares too few seeds is dropped before it is tiled.

    Null and empty texts match nothing; an item of one word is found wherever that word stands. Repeated
    rows of documents or items give one row. Other columns are not read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    items = materialize(
        _words(benchmark, "item_id").dropDuplicates(["key"]).withColumnsRenamed({"id": "item_id", "key": "item"}),
        "tiling-items",
    )

    def item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, words in zip(batch.column(0), batch.column(1)):
                words = np.array(words.as_py(), np.int64).view(np.uint64)
                grams = rolling(words, min(min_tile, len(words)))
                seeds, places = np.unique(grams, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item.as_py()] * len(seeds), pa.int64()), pa.array(seeds.view(np.int64)), pa.array(places)],
                    names=["item", "seed", "places"],
                )

    seeds = materialize(
        items.select("item", "words").mapInArrow(item_seeds, "item long, seed long, places long"), "tiling-seeds"
    )
    common = seeds.groupBy("seed").agg(F.count("*").alias("items"))
    if filter_bits is None:
        filter_bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_SEED * common.count()).bit_length()))
    sieve = spark.sparkContext.broadcast(_seed_filter(common.select("seed"), filter_bits))
    # At most min_tile numbers: how many words seeds have.
    lengths = sorted(
        r.n for r in items.select(F.least(F.size("words"), F.lit(min_tile)).alias("n")).distinct().collect()
    )

    def document_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sieve.value
        for batch in _forgetting(batches):
            rows = []
            for doc_id, key, text in zip(batch.column(0), batch.column(1), batch.column(2)):
                words = word_hashes(text.as_py())
                at, seeds = [], []
                for length in lengths:
                    grams = rolling(words, length)
                    # pmod of the signed value; the size is a power of two
                    place = grams & np.uint64(filter_bits - 1)
                    hit = np.flatnonzero(bits[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1))
                    if len(hit):
                        at.append((hit[:, None] + np.arange(length)).ravel())
                        seeds.append(grams[hit])
                if at:
                    at = np.unique(np.concatenate(at))
                    rows.append((
                        doc_id.as_py(), key.as_py(), np.unique(np.concatenate(seeds)).view(np.int64),
                        at.astype(np.int32), words[at].view(np.int64),
                    ))
            if rows:
                types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), t) for c, t in zip(zip(*rows), types)],
                    names=["doc_id", "key", "seeds", "at", "words"],
                )

    hits = materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"),
            F.col("text").cast("string").alias("text"),
        ).mapInArrow(
            document_seeds, "doc_id long, key long, seeds array<long>, at array<int>, words array<long>"
        ),
        "tiling-hits",
    )
    # Every covered word lies under a shared seed, and a place of a seed covers its words. A pair that has the
    # places needed cannot do without the rarest seeds, up to those whose places all others together lack.
    size = F.size("words")
    reach = items.select("item", (size * coverage / F.least(size, F.lit(min_tile))).alias("need"))
    rising = Window.partitionBy("item").orderBy("items", "seed")
    rare = (
        seeds.join(common, "seed").join(reach, "item")
        .withColumn("before", F.sum("places").over(rising.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("total", F.sum("places").over(Window.partitionBy("item")))
        .filter(F.coalesce("before", F.lit(0)) <= F.col("total") - F.col("need"))
        .select("item", "seed")
    )
    pairs = hits.select("key", F.explode("seeds").alias("seed")).distinct().join(rare, "seed").select("key", "item").distinct()

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                test, words = np.array(row["test"], np.int64), np.array(row["words"], np.int64)
                least = min(min_tile, len(test))
                shared = np.isin(rolling(test, least), rolling(words, least)).sum()
                if shared * least < len(test) * coverage:
                    continue
                found = [n for _, _, n in tiles(test, words, np.array(row["at"], np.int64), least)]
                rows.append((
                    row["doc_id"], row["key"], row["item_id"], len(test), sum(found), len(found),
                    max(found, default=0), sum(found) / len(test),
                ))
            if rows:
                types = [pa.int64()] * 7 + [pa.float64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), t) for c, t in zip(zip(*rows), types)],
                    names=["doc_id", "key", "item_id", "test_words", "covered_words", "n_tiles",
                           "longest_tile", "coverage"],
                )

    return (
        pairs.join(hits.drop("seeds").dropDuplicates(["key"]), "key")
        .join(items.withColumnRenamed("words", "test"), "item")
        .select("doc_id", "key", "item_id", "words", "at", "test")
        .mapInArrow(
            tile,
            "doc_id long, key long, item_id long, test_words long, covered_words long, n_tiles long, "
            "longest_tile long, coverage double",
        )
        .filter(F.col("coverage") >= coverage)
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The documents' rows without the contaminated ones, all columns kept.

    Null and empty texts stay; of repeated rows all stay or none.
    """
    bad = contaminated(docs, benchmark, coverage).select(F.col("key").alias("_key")).distinct()
    bad = materialize(bad, "tiling-contaminated")  # its size then tells Spark how to join it
    columns = [F.col(f"`{c}`") for c in docs.columns]
    packed = docs.select(row_key().alias("_key"), F.struct(*columns).alias("_row"))
    return packed.join(bad, "_key", "left_anti").select("_row.*")
