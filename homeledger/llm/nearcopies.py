"""Near copies: min-hash candidates, an exact check of their word shingles, greedy leaders in rounds."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from homeledger.llm.decontaminate import rolling
from homeledger.llm.text import row_key
from homeledger.session import materialize, ship_package

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 32  # a pair of similarity 0.8 shares no band in one case of 20 million
ROWS = 4
MOST_PIVOTS = 256
FEW = 8  # one band in so many is compared first
# Of 128 two-bit pieces of min-hashes a pair of similarity 0.8 differs in 19; in more than this in one case of a million.
SKETCH_LIMIT = 40
SKETCH = [f"s{i}" for i in range(BANDS * ROWS // 32)]
CACHED_WORDS = 200_000
PIECE = 4096  # shingles hashed at a time

_known: dict[bytes, int] = {}
_random = np.random.default_rng(42)
_FACTOR = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERM = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _forgetting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; the words kept for them are forgotten after the last one, as Python workers live on."""
    yield from batches
    _known.clear()


def grams(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's runs of ``shingle`` words; words as for SimHash.

    A text of fewer words has one, of all its words; none or null has none.
    """
    if len(_known) > CACHED_WORDS:
        _known.clear()
    hashes = []
    for word in text.lower().split() if text else ():
        h = _known.get(word)
        if h is None:
            h = _known[word] = xxhash.xxh64_intdigest(word)
        hashes.append(h)
    if not hashes:
        return np.empty(0, dtype=np.uint64)
    length = min(shingle, len(hashes))
    return np.unique(_mix(rolling(np.array(hashes, dtype=np.uint64), length) + np.uint64(length)))


def signature(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``BANDS`` numbers and a sketch of two bits of each min-hash.

    Two sets agree on a band with the ``ROWS``-th power of their similarity; on a piece of the sketch
    with their similarity, and by chance on a quarter of the others.
    """
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(found), PIECE):
            part = found[at : at + PIECE]
            np.minimum(least, (_FACTOR[:, None] * part + _TERM[:, None]).min(axis=1), out=least)
        out = np.arange(BANDS, dtype=np.uint64)
        for column in least.reshape(BANDS, ROWS).T:
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + column)
        pieces = (_mix(least) & np.uint64(3)).reshape(-1, 32) << np.arange(0, 64, 2, dtype=np.uint64)
    return out, np.bitwise_or.reduce(pieces, axis=1)


def _apart(a: str, b: str) -> Column:
    """How many pieces of two sketches differ."""
    counts = []
    for c in SKETCH:
        x = F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))
        low = F.lit(0x5555555555555555)
        counts.append(F.bit_count(x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(low)))
    return reduce(lambda m, n: m + n, counts)


def _signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, key, whole`` (hash of the set of shingles; null: none), ``bands`` and ``sketch``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _forgetting(batches):
            whole, keys, sketches = [], [], []
            for text in batch.column(2):
                found = grams(text.as_py(), shingle)
                whole.append(xxhash.xxh64_intdigest(found.tobytes()) - (1 << 63) if len(found) else None)
                both = signature(found) if len(found) else ([], [0] * len(SKETCH))
                keys.append(np.asarray(both[0]).view(np.int64) if len(found) else [])
                sketches.append([int(n) - (1 << 64) * (int(n) >> 63) for n in both[1]])
            pieces = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*sketches)) or [()] * len(SKETCH)], names=SKETCH)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(whole, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pieces],
                names=["doc_id", "key", "whole", "bands", "sketch"],
            )

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"),
        F.col("text").cast("string").cast("binary").alias("text"),
    ).mapInArrow(
        run, f"doc_id long, key long, whole long, bands array<long>, sketch struct<{', '.join(f'{c}: bigint' for c in SKETCH)}>"
    )


def _shingles(docs: DataFrame, keys: DataFrame, shingle: int) -> DataFrame:
    """``key, grams`` of the documents with these keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _forgetting(batches):
            found = [grams(text.as_py(), shingle).view(np.int64) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["key", "grams"]
            )

    texts = docs.select(row_key().alias("key"), F.col("text").cast("string").cast("binary").alias("text"))
    return texts.join(keys, "key", "left_semi").mapInArrow(run, "key long, grams array<long>").dropDuplicates(["key"])


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``a, b`` of keys whose sets of shingles are similar enough, counted exactly."""
    left = sets.select(F.col("key").alias("a"), F.col("grams").alias("x"))
    right = sets.select(F.col("key").alias("b"), F.col("grams").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return (
        pairs.join(right, "b").join(left, "a")
        .filter(F.least(F.size("x"), F.size("y")) >= similarity * F.greatest(F.size("x"), F.size("y")))
        .filter(both >= similarity * (F.size("x") + F.size("y") - both))
        .select("a", "b")
    )


def _close(asks: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of keys in one band whose sketches are close, the one that asks being the earlier."""
    return (
        asks.select("band", F.col("rank").alias("p"), F.col("sketch").alias("q")).join(members, "band")
        .filter((F.col("p") < F.col("rank")) & (_apart("q", "sketch") <= SKETCH_LIMIT))
        .select(F.col("p.key").alias("a"), F.col("rank.key").alias("b")).distinct()
    )


def near_copies(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``key`` of every document that is a near copy of one that stays (an action per step).

    Documents are taken by id (null last), then key; one stays unless the Jaccard similarity of
    its set of ``shingle``-word runs with those of an earlier one that stays is at least
    ``similarity``. So no two that stay are near copies, and nothing goes for a chain of others.

    Equal sets are folded first. Candidates share one of ``BANDS`` min-hash bands, and their sketches differ
    in at most ``SKETCH_LIMIT`` pieces, so that texts of half the similarity that share a
    band by the hundreds, by a common passage, make no pairs. In each
    round the first open documents of a band ("pivots") are compared with each other and those of them that
    stay with the rest of it, so a group of n near copies gives no n^2 pairs. No candidates are capped or dropped.
    """
    ship_package(docs.sparkSession)
    signed = materialize(_signatures(docs, shingle), "copies-bands")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    nodes = materialize(
        signed.groupBy("whole").agg(
            F.min(order).alias("rank"), F.min_by(F.struct("bands", "sketch"), order).alias("_s")
        ).select("rank", F.col("rank.key").alias("key"), "_s.bands", "_s.sketch"),
        "copies-nodes",
    )
    folded = signed.select("key").distinct().join(nodes.select("key"), "key", "left_anti")
    each = nodes.select("key", F.explode("bands").alias("band"))
    shared = each.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band")
    # Most bands are one document's own; only the shared ones get what the comparison needs.
    alike = materialize(each.join(shared, "band", "left_semi"), "copies-bands-shared")
    members = alike.join(nodes.select("key", "rank", "sketch"), "key").select("band", "rank", "sketch")
    members = materialize(members, "copies-members")
    keys = materialize(members.select(F.col("rank.key").alias("key")).distinct(), "copies-keys")
    sets = materialize(_shingles(docs, keys, shingle), "copies-shingles")

    gone, pivots = folded, 1
    while not members.isEmpty():
        # Pivots per band; row_number() <= k is cut in each map task before the shuffle.
        first = F.row_number().over(Window.partitionBy("band").orderBy("rank"))
        picked = materialize(
            members.withColumn("at", first).filter(F.col("at") <= pivots).select("band", "rank", "sketch"), "copies-pivots"
        )
        # A pivot in all its bands meets all earlier open ones among the pivots, so it is settled among them.
        degree = members.groupBy(F.col("rank.key").alias("key")).agg(F.count("*").alias("n"))
        full = (
            picked.groupBy(F.col("rank.key").alias("key")).agg(F.count("*").alias("m"))
            .join(degree, "key").filter("m = n").select("key")
        )
        leaders = full
        if pivots > 1:
            settled = picked.join(full, F.col("rank.key") == F.col("key"), "left_semi")
            edges = _similar(_close(picked, settled), sets, similarity)
            leaders = full.join(edges.select(F.col("b").alias("key")), "key", "left_anti")
        leaders = materialize(leaders, "copies-leaders")
        # Only leaders meet the rest of their bands. Copies share most bands and nearly all go in a few of
        # them, so that the others compare what is left.
        asks = materialize(picked.join(leaders, F.col("rank.key") == F.col("key"), "left_semi"), "copies-asks")
        parts = []
        for few in (True, False):
            own = (F.pmod("band", F.lit(FEW)) == 0) == F.lit(few)
            rest = members.filter(own)
            for part in parts:
                rest = rest.join(part, F.col("rank.key") == F.col("key"), "left_anti")
            found = _similar(_close(asks.filter(own), rest), sets, similarity)
            parts.append(materialize(found.select(F.col("b").alias("key")).distinct(), "copies-covered"))
        covered = parts[0].union(parts[1])
        gone = gone.union(covered)
        done = leaders.union(covered).withColumnRenamed("key", "done")
        members = members.join(done, F.col("rank.key") == F.col("done"), "left_anti")
        live = members.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band")
        members = materialize(members.join(live, "band", "left_semi"), "copies-members")
        pivots = min(4 * pivots, MOST_PIVOTS)
    return materialize(gone, "copies-gone")


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The documents' rows without near copies of rows that stay, all columns kept.

    Of rows equal in id and text one stays; null, empty and blank texts count as equal.
    """
    gone = near_copies(docs, shingle, similarity).withColumnRenamed("key", "_key")
    again = docs.select(row_key().alias("_key")).groupBy("_key").agg(F.count("*").alias("n")).filter("n > 1")
    again = materialize(again.select("_key"), "copies-repeated")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    kept = docs.select(row_key().alias("_key"), F.struct(*columns).alias("_row")).join(gone, "_key", "left_anti")
    once = kept.join(again, "_key", "left_semi").dropDuplicates(["_key"])
    return kept.join(again, "_key", "left_anti").union(once).select("_row.*")
