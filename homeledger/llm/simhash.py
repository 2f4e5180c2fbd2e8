"""SimHash near duplicates: fingerprints, BK-tree search in shards, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from homeledger.llm.components import components
from homeledger.llm.text import row_key
from homeledger.session import materialize, ship_package

SHINGLE = 4
RADIUS = 4
SEED = 42
BLOCKS = 6
SLICE = 16384  # fingerprints of one shard that one task answers queries for
PAIRS = 4_000_000  # bound of a search frontier


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a text as UTF-8; A-Z count as a-z, words are split at ASCII white space.

    Each run of ``shingle`` words is hashed, repeats included. A bit is set if over half the
    hashes have it. Fewer words: their whole sequence is hashed; none or null: 0.
    """
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    end = np.cumsum(size + 1) - 1
    first = (end - size)[: len(words) - shingle + 1].tolist()
    last = end[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    set_bits = np.zeros(64, dtype=np.int64)
    for at in range(0, len(first), 65536):
        part = zip(first[at : at + 65536], last[at : at + 65536])
        hashes = np.array([digest(joined[a:b], SEED) for a, b in part], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64)
        set_bits += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > len(first), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, key, fp`` (64 bits as a signed long) of every document; ``key`` tells rows apart."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(2)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "key", "fp"]
            )

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        row_key().alias("key"),
        F.col("text").cast("string").cast("binary").alias("text"),
    ).mapInArrow(run, "doc_id long, key long, fp long")


def shard_keys(fp: Column, radius: int = RADIUS, blocks: int = BLOCKS) -> list[Column]:
    """Shards of a fingerprint: the values of every choice of ``blocks - radius`` bit blocks.

    Fingerprints that differ in at most ``radius`` bits differ in at most ``radius`` blocks, so
    they agree on all the others and share a shard: sharding loses no link.
    """
    edges = [64 * b // blocks for b in range(blocks + 1)]

    def block(b: int) -> Column:
        return F.shiftrightunsigned(fp, edges[b]).bitwiseAND(F.lit((1 << (edges[b + 1] - edges[b])) - 1))

    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        keys.append(F.xxhash64(F.lit(number), *[block(b) for b in chosen]))
    return keys


class Forest:
    """BK-trees of many shards, built and searched together level by level.

    ``fps`` are distinct within a shard and sorted by shard. A tree's root is its shard's first
    fingerprint; a node's children are keyed by their Hamming distance to it.
    """

    def __init__(self, fps: np.ndarray, shards: np.ndarray):
        self.fps = fps
        starts = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1]])
        self.sizes = np.repeat(np.diff(np.r_[starts, len(fps)]), np.diff(np.r_[starts, len(fps)]))
        self.root = np.repeat(starts, np.diff(np.r_[starts, len(fps)]))
        waiting = np.setdiff1d(np.arange(len(fps)), starts, assume_unique=True)
        at = self.root[waiting]
        keys, nodes = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        while len(waiting):
            slot = at * 65 + np.bitwise_count(fps[waiting] ^ fps[at])
            taken, first, back = np.unique(slot, return_index=True, return_inverse=True)
            keys.append(taken)
            nodes.append(waiting[first])
            at = waiting[first][back]
            rest = np.ones(len(waiting), dtype=bool)
            rest[first] = False
            waiting, at = waiting[rest], at[rest]
        key, node = np.concatenate(keys), np.concatenate(nodes)
        order = np.argsort(key, kind="stable")
        self.key, self.node = key[order], node[order]

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, node) within the radius, in pieces; only edges within it are followed."""
        load = np.cumsum(self.sizes[queries]) // PAIRS
        for part in np.split(queries, np.flatnonzero(np.diff(load)) + 1):
            query, node = part, self.root[part]
            while len(query):
                gap = np.bitwise_count(self.fps[query] ^ self.fps[node]).astype(np.int64)
                near = (gap <= radius) & (query != node)
                yield query[near], node[near]
                low = np.searchsorted(self.key, node * 65 + np.maximum(gap - radius, 0))
                count = np.searchsorted(self.key, node * 65 + np.minimum(gap + radius, 64), "right") - low
                query = np.repeat(query, count)
                step = np.arange(len(query)) - np.repeat(np.cumsum(count) - count, count)
                node = self.node[np.repeat(low, count) + step]


def merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joins the classes of each pair; ``labels`` holds for each item the smallest of its class."""
    while len(a):
        x, y = labels[a], labels[b]
        differ = x != y
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while (labels[labels] != labels).any():
            labels = labels[labels]
    return labels


def links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, slice_size: int = SLICE) -> DataFrame:
    """Edges ``a, b`` whose components are those of all pairs of ``fp`` within the radius.

    ``fps`` holds distinct fingerprints. Each shard becomes a BK-tree in the task it is shuffled
    to, and gives at most one edge per fingerprint, so a group of n near copies gives no n^2
    pairs. A shard beyond ``slice_size`` goes to several tasks: each gets the tree's
    fingerprints and answers its own slice of the queries.
    """
    ship_package(fps.sparkSession)
    members = fps.select("fp", F.explode(F.array(*shard_keys(F.col("fp"), radius, blocks))).alias("shard"))
    sizes = members.groupBy("shard").agg(F.count("*").alias("n")).filter("n > 1")
    slices = F.ceil(F.col("n") / slice_size).cast("int")
    dealt = (
        members.join(sizes, "shard")
        .select("shard", "fp", slices.alias("slices"))
        .select("shard", "fp", "slices", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
        .select("shard", "slice", "fp", (F.pmod(F.xxhash64("fp"), "slices") == F.col("slice")).alias("asks"))
        .repartition("shard", "slice")
        .sortWithinPartitions("shard", "slice", "fp")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def solve(table: pa.Table) -> pa.RecordBatch:
            fp = table["fp"].to_numpy().view(np.uint64)
            shard, part = table["shard"].to_numpy(), table["slice"].to_numpy()
            group = np.cumsum(np.r_[0, (shard[1:] != shard[:-1]) | (part[1:] != part[:-1])])
            forest, labels = Forest(fp, group), np.arange(len(fp))
            for a, b in forest.search(np.flatnonzero(table["asks"].to_numpy(zero_copy_only=False)), radius):
                labels = merge(labels, a, b)
            linked = np.flatnonzero(labels != np.arange(len(fp)))
            a, b = fp[linked].view(np.int64), fp[labels[linked]].view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < 200_000:
                continue
            table = pa.Table.from_batches(held)
            shard, part = table["shard"].to_numpy(), table["slice"].to_numpy()
            new = np.flatnonzero((shard[1:] != shard[:-1]) | (part[1:] != part[:-1]))
            if len(new):  # the last group may go on
                cut = int(new[-1]) + 1
                yield solve(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
                rows = rows - cut
        if rows:
            yield solve(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, "a long, b long").distinct()


def classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Per distinct fingerprint ``fp, root, component_id``: its group and the group's smallest doc_id."""
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = components(materialize(links(distinct, radius), "simhash-links"), "simhash")
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(smallest, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per document: ``doc_id, key, fp, root, component_id`` (an action per step).

    Documents whose fingerprints differ in at most ``radius`` bits are linked; a group is what
    links reach. ``component_id`` is its smallest non-null doc_id (null if it has none).
    Equal texts share a fingerprint and are folded before the search; null, empty and blank
    texts share fingerprint 0. Repeated rows stay rows of one group; an empty table gives none.
    Only ``doc_id`` and ``text`` are read, so other columns cannot clash.
    """
    prints = materialize(fingerprints(docs, shingle), "simhash-prints")
    return prints.join(classes(prints, radius), "fp")


def deduplicate(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The documents' rows, one for each near-duplicate group: that of the smallest doc_id.

    Null ids count as larger than any; among rows of one id the smallest key stays, among
    repeated rows any one. All columns are kept.
    """
    found = near_duplicates(docs, shingle, radius)
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("key"))
    winners = found.groupBy("root").agg(F.min(order).alias("w"), F.min_by("key", order).alias("_key"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    packed = docs.select(row_key().alias("_key"), F.struct(*columns).alias("_row"))
    winners = materialize(winners.select("_key"), "simhash-winners")
    kept = packed.join(winners, "_key", "left_semi")
    return kept.dropDuplicates(["_key"]).select("_row.*")
