"""Cost-balanced packing of documents into fixed-length training sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from homeledger.llm import tokens
from homeledger.session import ship_package

SEQUENCE = 2048
BLOCK_TOKENS = 1 << 20
# Cost of a piece of n tokens in units of one token's linear work: n + QUADRATIC * n^2.
QUADRATIC = 1.0 / 4096

PIECES = (
    "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, "
    "cost double, ids binary"
)


def capacities(total: int, sequence: int) -> np.ndarray:
    """Lengths of the sequences that hold ``total`` tokens: full ones, the rest as powers of two.

    A power of two needs no padding, so the capacities add up to ``total`` exactly.
    """
    rest = total % sequence
    tail = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    return np.array([sequence] * (total // sequence) + tail, dtype=np.int64)


def assign(lengths: np.ndarray, sequence: int, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Places documents of the given lengths: (document, start, length, sequence, offset).

    Every full ``sequence`` tokens of a document fill a sequence of their own. The rests go,
    longest first, to the lowest-cost sequence whose remaining capacity holds them. What then
    fits nowhere whole is cut into the room that is left, again at the lowest cost.
    """
    placed = []
    full = lengths // sequence
    number = 0
    for doc in np.flatnonzero(full):
        for part in range(full[doc]):
            placed.append((int(doc), part * sequence, sequence, number, 0))
            number += 1
    rest = lengths % sequence
    room = capacities(int(rest.sum()), sequence)
    size = room.copy()
    cost = np.zeros(len(room))
    late = []

    def put(doc: int, start: int, length: int, at: int) -> None:
        placed.append((doc, start, length, number + at, int(size[at] - room[at])))
        room[at] -= length
        cost[at] += length + quadratic * length * length

    for doc in np.argsort(-rest, kind="stable"):
        length = int(rest[doc])
        if not length:
            break
        at = int(np.argmin(np.where(room >= length, cost, np.inf)))
        if room[at] >= length:
            put(int(doc), int(full[doc]) * sequence, length, at)
        else:
            late.append(int(doc))
    for doc in late:
        start, left = int(full[doc]) * sequence, int(rest[doc])
        while left:
            at = int(np.argmin(np.where(room > 0, cost, np.inf)))
            length = min(left, int(room[at]))
            put(doc, start, length, at)
            start, left = start + length, left - length
    return placed


def _block(doc_ids: list, ids: list[np.ndarray], first: int, sequence: int, quadratic: float):
    lengths = np.array([len(x) for x in ids], dtype=np.int64)
    placed = assign(lengths, sequence, quadratic)
    cost: dict[int, float] = {}
    for _, _, length, number, _ in placed:
        cost[number] = cost.get(number, 0.0) + length + quadratic * length * length
    columns = [
        pa.array([doc_ids[p[0]] for p in placed], pa.int64()),
        pa.array([p[1] for p in placed], pa.int64()),
        pa.array([p[2] for p in placed], pa.int64()),
        pa.array([int(lengths[p[0]]) for p in placed], pa.int64()),
        pa.array([first + p[3] for p in placed], pa.int64()),
        pa.array([p[4] for p in placed], pa.int64()),
        pa.array([cost[p[3]] for p in placed], pa.float64()),
        pa.array([ids[p[0]][p[1] : p[1] + p[2]].tobytes() for p in placed], pa.binary()),
    ]
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "cost", "ids"]
    return pa.RecordBatch.from_arrays(columns, names=names), len(cost)


def pack(
    docs: DataFrame,
    sequence: int = SEQUENCE,
    quadratic: float = QUADRATIC,
    block_tokens: int = BLOCK_TOKENS,
    vocabulary: str = tokens.VOCABULARY,
) -> DataFrame:
    """Packs all documents into sequences of at most ``sequence`` tokens (a power of two).

    One row per piece: ``doc_id, start, length`` (the piece's ids within its document),
    ``doc_tokens, sequence_id, offset`` (its place in the sequence, gapless from 0), ``cost``
    (of the whole sequence) and ``ids`` (little-endian unsigned 32-bit).

    A sequence's cost is the sum of ``n + quadratic * n^2`` over its pieces of n tokens, as
    attention stays within a document. Blocks of about ``block_tokens`` tokens of a scan task
    are packed on their own: no shuffle, memory bounded by the block (or by one document, if
    that is longer), and a lost task packs the same pieces again. Each block fills its
    sequences completely, the last ones being powers of two.

    Documents of equal length are taken in the order of the scan, sequences of equal cost in that of their opening.

    A null or empty text is a document of one token, the closing id. Repeated rows are packed
    once each, a null ``doc_id`` stays null, an empty table gives no rows, other columns are
    not read.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        doc_ids, ids, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                doc_ids.append(doc_id)
                ids.append(tokens.document_ids(text.as_py(), vocabulary))
                size += len(ids[-1])
                if size >= block_tokens:
                    out, used = _block(doc_ids, ids, first, sequence, quadratic)
                    yield out
                    first += used
                    doc_ids, ids, size = [], [], 0
        if ids:
            yield _block(doc_ids, ids, first, sequence, quadratic)[0]

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(
        run, PIECES
    )
