"""Merkle manifest of a dataset: leaf places by bitmap ranks, levels reduced in keyed slot arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from homeledger.llm.order import numbered, prefix_sums
from homeledger.session import materialize, ship_package

FANOUT = 8
LEVELS = 4  # levels that one slot array covers
SLOT_BITS = 3 * LEVELS
CHUNK_BITS = 15  # ids per bitmap: as many as Spark's bitmap functions take
WORD_BITS = 9  # bits per entry of a bitmap's popcount directory
NO_ID = -(1 << 60)  # the chunk of missing ids, before all others
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
GROUP = ["known", "name"]


def field(c: Column) -> Column:
    """A value as it is hashed: its length in bytes, a colon, the value; ``-`` if null."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def id_bitmaps(rows: DataFrame) -> DataFrame:
    """``known, name, chunk, bits, ones, n, before, total, directory`` per group and 2^15 ids.

    ``bits`` has the ids of the chunk, put together per task and merged; ``n`` its rows, ``before`` the
    group's rows in earlier chunks, ``total`` all of them; ``directory`` the ones before every 512th bit.
    """
    bitmaps = materialize(
        rows.groupBy(*GROUP, "chunk").agg(F.bitmap_construct_agg("bit").alias("bits"), F.count("*").alias("n")),
        "merkle-bitmaps", "zstd",
    )
    places = materialize(prefix_sums(
        bitmaps.select(*GROUP, "chunk", "n"), GROUP, ["chunk"], "n", "before", "merkle-chunks"
    ).drop("n"), "merkle-chunk-places")
    totals = bitmaps.groupBy(*GROUP).agg(F.sum("n").alias("total"))
    words = 1 << (CHUNK_BITS - WORD_BITS)
    size = 1 << (WORD_BITS - 3)
    counts = F.transform(
        F.sequence(F.lit(0), F.lit(words - 1)),
        lambda i: F.bitmap_count(F.substring("bits", i * size + 1, F.lit(size))).cast("int"),
    )
    sums = F.transform(
        "counts", lambda _, i: F.aggregate(F.slice("counts", F.lit(1), i), F.lit(0), lambda a, b: a + b)
    )
    return (
        bitmaps.join(places, [*GROUP, "chunk"]).join(totals, GROUP)
        .withColumn("ones", F.bitmap_count("bits")).withColumn("counts", counts)
        .withColumn("directory", sums).drop("counts")
    )


def _rank() -> Column:
    """Ones before ``bit`` in ``bits``: a directory entry, the whole bytes after it, the rest of a byte."""
    word, byte = F.shiftright("bit", WORD_BITS), F.shiftright("bit", 3)
    start = F.shiftleft(word, WORD_BITS - 3)
    last = F.conv(F.hex(F.substring("bits", byte + 1, F.lit(1))), 16, 10).cast("int")
    mask = F.expr("shiftleft(1, cast(bit & 7 as int)) - 1")
    return (
        F.get("directory", word) + F.bitmap_count(F.substring("bits", start + 1, byte - start))
        + F.bit_count(last.bitwiseAND(mask))
    )


def leaf_places(rows: DataFrame) -> DataFrame:
    """Adds ``index``, each leaf's place in its group, and ``total``, the group's leaves (actions).

    Ids ascend, missing ones first. An id that stands alone finds its place by its rank among the bits of its chunk, without
    any sort. In chunks whose rows outnumber their bits some id repeats; only their rows are
    range-sorted, by id, then leaf.
    """
    given = rows.withColumns({
        "chunk": F.coalesce(F.shiftright("doc_id", CHUNK_BITS), F.lit(NO_ID)),
        "bit": F.coalesce(F.col("doc_id").bitwiseAND(F.lit((1 << CHUNK_BITS) - 1)).cast("int"), F.lit(0)),
    })
    index = materialize(id_bitmaps(given), "merkle-index", "zstd")
    keys = [*GROUP, "chunk"]
    # Bitmaps take far more room than their files, which compress well: they are not to be broadcast.
    placed = given.join(index.filter("n = ones").hint("merge"), keys).withColumn("index", F.col("before") + _rank())
    out = placed.select(*rows.columns, "index", "total")
    again = index.filter("n > ones").select(*keys, "before", "total")
    if not again.isEmpty():
        order = [F.col(c) for c in (*keys, "bit", "leaf")]
        sorted_ = materialize(
            numbered(given.join(again, keys), order, "place", "merkle-repeats"), "merkle-repeat-places"
        )
        first = sorted_.groupBy(*keys).agg(F.min("place").alias("first"))
        rest = sorted_.join(first, keys).withColumn("index", F.col("before") + F.col("place") - F.col("first"))
        out = out.union(rest.select(*out.columns))
    return materialize(out, "merkle-leaves")


def digest(nodes: list[bytes]) -> bytes:
    """Hash of digests, written as hex text one after the other."""
    return hashlib.sha256("".join(n.hex() for n in nodes).encode()).digest()


def levels(nodes: list[bytes], total: int) -> list[list[bytes]]:
    """The levels over one slot array: ``LEVELS``, or where the whole group lies in it up to its root."""
    out = [nodes]
    while len(out[-1]) > 1 if total <= FANOUT**LEVELS else len(out) <= LEVELS:
        below = out[-1]
        out.append([digest(below[i : i + FANOUT]) for i in range(0, len(below), FANOUT)])
    return out


def _slots(table: pa.Table) -> tuple[list[int], list[bytes]]:
    """Slots of a group's rows, and the digests by slot."""
    slots = [i & ((1 << SLOT_BITS) - 1) for i in table.column("index").to_pylist()]
    nodes = [b""] * len(slots)
    for slot, value in zip(slots, table.column("leaf").to_pylist()):
        nodes[slot] = value
    return slots, nodes


def _block() -> Column:
    return F.shiftright("index", SLOT_BITS).alias("block")


def reduced(nodes: DataFrame) -> DataFrame:
    """The nodes ``LEVELS`` levels up: one per slot array of 4096, in the columns of ``nodes``.

    ``known, name, index, total, leaf``: a group's nodes of one level and their number. A group of one node stays.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        total = table.column("total")[0].as_py()
        _, slots = _slots(table)
        values = [[k.as_py()] for k in key[:2]]
        return pa.table(
            [*[pa.array(v) for v in values], pa.array([key[2].as_py()], pa.int64()),
             pa.array([-(-total // FANOUT**LEVELS)], pa.int64()), pa.array([levels(slots, total)[-1][0]], pa.binary())],
            names=[*GROUP, "index", "total", "leaf"],
        )

    return nodes.groupBy(*GROUP, _block()).applyInArrow(
        run, "known boolean, name string, index long, total long, leaf binary"
    )


def tree(leaves: DataFrame) -> list[DataFrame]:
    """Stored levels of every group, ``LEVELS`` apart, up to one node a group (an action per step)."""
    out = [leaves]
    most = leaves.agg(F.max("total")).first()[0] or 0
    while most > 1:
        out.append(materialize(reduced(out[-1].select(*GROUP, "index", "total", "leaf")), "merkle-level"))
        most = -(-most // FANOUT**LEVELS)
    return out


def _siblings(below: list[list[bytes]], slot: int) -> tuple[list[bytes], list[int]]:
    """The others of each run on the way up, left to right, and how many stand left and right."""
    others, shape = [], []
    for nodes in below[:-1]:
        first = slot - slot % FANOUT
        last = min(first + FANOUT, len(nodes))
        others += nodes[first:slot] + nodes[slot + 1 : last]
        shape += [slot - first, last - slot - 1]
        slot //= FANOUT
    return others, shape


def fold(value: bytes, siblings: list[bytes], shape: bytes) -> bytes:
    """The root that a leaf and the siblings on its way up give."""
    at = 0
    for left, right in zip(shape[::2], shape[1::2]):
        value = digest([*siblings[at : at + left], value, *siblings[at + left : at + left + right]])
        at += left + right
    return value


def _cut(joined: bytes) -> list[bytes]:
    return [joined[i : i + 32] for i in range(0, len(joined), 32)]


PATH = "known boolean, name string, index long, siblings binary, shape binary, subroot binary, root binary"


def paths_below(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """The way up of each of ``nodes``, from that of its slot array: ``PATH`` (one cogroup)."""

    def run(key: tuple, table: pa.Table, path: pa.Table) -> pa.Table:
        slots, values = _slots(table)
        below = levels(values, table.column("total")[0].as_py())
        up = path.to_pylist()[0]
        rows = []
        for slot, index in zip(slots, table.column("index").to_pylist()):
            others, shape = _siblings(below, slot)
            rows.append((index, b"".join(others) + up["siblings"], bytes(shape) + up["shape"]))
        n = len(rows)
        return pa.table({
            "known": pa.array([key[0].as_py()] * n), "name": pa.array([key[1].as_py()] * n),
            "index": pa.array([r[0] for r in rows], pa.int64()), "siblings": pa.array([r[1] for r in rows], pa.binary()),
            "shape": pa.array([r[2] for r in rows], pa.binary()),
            "subroot": pa.array([up["subroot"]] * n, pa.binary()), "root": pa.array([up["root"]] * n, pa.binary()),
        })

    given = nodes.select(*GROUP, "index", "total", "leaf")
    return given.groupBy(*GROUP, _block()).cogroup(above.groupBy(*GROUP, "index")).applyInArrow(run, PATH)


PROOF = (
    "doc_id long, leaf binary, subroot binary, root binary, n_siblings long, proof_sha256 string, folded_root binary"
)


def proofs(leaves: DataFrame, above: DataFrame) -> DataFrame:
    """Each leaf's proof, and the root that folds from ``claimed`` (one cogroup): ``PROOF``."""

    def run(key: tuple, table: pa.Table, path: pa.Table) -> pa.Table:
        slots, values = _slots(table)
        below = levels(values, table.column("total")[0].as_py())
        up = path.to_pylist()[0]
        more, more_hex = _cut(up["siblings"]), up["siblings"].hex().encode()
        n, hashes, folded = [], [], []
        for slot, claimed in zip(slots, table.column("claimed").to_pylist()):
            others, shape = _siblings(below, slot)
            hashes.append(hashlib.sha256(b"".join(others).hex().encode() + more_hex).hexdigest())
            folded.append(fold(claimed, others + more, bytes(shape) + up["shape"]))
            n.append(len(others) + len(more))
        count = len(slots)
        return pa.table([
            table.column("doc_id"), table.column("leaf"), pa.array([up["subroot"]] * count, pa.binary()),
            pa.array([up["root"]] * count, pa.binary()), pa.array(n, pa.int64()), pa.array(hashes, pa.string()),
            pa.array(folded, pa.binary()),
        ], names=[c.split()[0] for c in PROOF.split(", ")])

    return leaves.groupBy(*GROUP, _block()).cogroup(above.groupBy(*GROUP, "index")).applyInArrow(run, PROOF)


def manifest(
    docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", claimed: Column | None = None
) -> DataFrame:
    """Leaf, roots and proof of every document, and the root that another leaf folds to (an action per step).

    ``doc_id, leaf, subroot, root, proof_sha256, n_siblings, folded_root, verified``, digests as hex text. A leaf hashes
    ``fields``, each with its length in bytes. A group's leaves ascend by id, and every 8
    neighbours become a node until one is left, the subroot; the subroots, by group (null first), give the root the
    same way. ``claimed`` is the leaf to verify, e.g. of the texts as they are found later (null: the same leaf).

    One pass over the texts stores the leaves. Bitmaps of the ids, merged per group, give each leaf its place; slot arrays
    of 4096 nodes, keyed by group and place, are reduced four levels at a time, so no group, however large, is in one task.
    The way down again hands every slot array its siblings up to the root.

    Null values hash as ``-``, null groups are one, null ids come first. Rows of equal ids ascend by leaf; repeated rows are a leaf
    each. Empty and very long texts are hashed whole. A table without rows gives none. Other columns are not read.
    """
    ship_package(docs.sparkSession)
    own = leaf([F.col(c) for c in fields])
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col(group).isNotNull().alias("known"),
        F.coalesce(F.col(group).cast("string"), F.lit("")).alias("name"),
        F.unhex(own).alias("leaf"),
        F.unhex(F.lit(None).cast("string") if claimed is None else claimed).alias("claimed"),
    )
    rows = materialize(rows.withColumn("claimed", F.coalesce("claimed", "leaf")), "merkle-rows")
    stored = tree(leaf_places(rows))
    # One node a group is left; by group they are the leaves of one more tree.
    subroots = stored[-1].select(*GROUP, "leaf")
    order = [F.col("known"), F.col("name")]
    top = materialize(
        numbered(subroots, order, "index", "merkle-subroots").select(
            F.lit(True).alias("known"), F.lit("").alias("name"), "index", "leaf",
            F.struct("known", "name").alias("of"), F.lit(subroots.count()).cast("long").alias("total"),
        ),
        "merkle-top",
    )
    upper = tree(top)
    path = upper[-1].select(
        *GROUP, "index", F.lit(b"").alias("siblings"), F.lit(b"").alias("shape"),
        F.lit(None).cast("binary").alias("subroot"), F.col("leaf").alias("root"),
    )
    for nodes in reversed(upper[:-1]):
        path = materialize(paths_below(nodes, path), "merkle-upper-path")
    # Each subroot's way to the root belongs to the single last node of its group.
    path = materialize(
        path.select("index", "siblings", "shape", "root").join(top.select("index", "of", "leaf"), "index").select(
            "of.known", "of.name", F.lit(0).cast("long").alias("index"), "siblings", "shape",
            F.col("leaf").alias("subroot"), "root",
        ),
        "merkle-subroot-path",
    )
    for nodes in reversed(stored[1:-1]):
        path = materialize(paths_below(nodes, path), "merkle-path")
    # Where every group is a single leaf there is no level between, and a leaf's array is its own.
    out = proofs(stored[0], path)
    text = lambda c: F.lower(F.hex(c)).alias(c)
    return out.select(
        "doc_id", text("leaf"), text("subroot"), text("root"), "proof_sha256", "n_siblings", text("folded_root"),
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
