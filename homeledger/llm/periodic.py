"""Periodic runs of words: segments split at rare words until stable, then scanned lag by lag."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from homeledger.session import ship_package

MIN_LENGTH = 24  # words of a run, at least
MIN_PERIODS = 3  # and at least so many periods
SLICE_BYTES = 4 << 20  # texts worked on together; a longer text is a slice of its own
PIECE = 1 << 20  # places compared at a time
PROBES = 8

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
SCHEMA = f"doc_id long, n_words long, runs {RUNS}, strongest struct<start: bigint, length: bigint, period: bigint>, collapsed string"

Run = tuple[int, int, int]  # start, length, period


def split_rare(words: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Places of the words that may lie in a run; ``parts`` numbers the texts, ascending.

    All words of a run occur ``MIN_PERIODS`` times in it. A word that occurs less often in its
    segment is in none and splits it; the pieces are segments again, until none splits. Pieces
    shorter than a run go. Only segments that have lost a word are counted again.
    """
    at, segment, done = np.arange(len(words)), parts, []
    while len(at):
        key = segment * (int(words.max()) + 1) + words[at]
        _, back, count = np.unique(key, return_inverse=True, return_counts=True)
        frequent = count[back] >= MIN_PERIODS
        split = np.zeros(int(segment.max()) + 1, bool)
        split[segment[~frequent]] = True
        again = split[segment]
        done.append(at[~again])
        at, segment = at[frequent & again], segment[frequent & again]
        if len(at):
            new = np.r_[True, (np.diff(at) != 1) | (np.diff(segment) != 0)]
            segment = np.cumsum(new) - 1
            long = np.bincount(segment)[segment] >= MIN_LENGTH
            at, segment = at[long], segment[long]
    return np.sort(np.concatenate(done)) if done else at


def _extent(x: np.ndarray, i: int, q: int, first: int, last: int) -> tuple[int, int]:
    """The places ``[s, e)`` around ``i`` whose words equal those ``q`` later, within ``[first, last)``."""
    s, e, step = i, i, 64
    while True:
        stop = min(e + step, last - q)
        off = np.flatnonzero(x[e:stop] != x[e + q : stop + q])
        e = e + int(off[0]) if len(off) else stop
        if len(off) or stop == last - q:
            break
        step *= 2
    step = 64
    while s > first:
        start = max(first, s - step)
        off = np.flatnonzero(x[start:s] != x[start + q : s + q])
        if len(off):
            s = start + int(off[-1]) + 1
            break
        s, step = start, step * 2
    return s, e


def lag_scan(x: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[Run]:
    """All runs of segments that lie one after the other in ``x``, the longest first.

    ``start`` and ``end`` give each place its segment. A run of period q has 2q or more places
    whose word comes again q later, so two neighbouring multiples of q are among them:
    only those are looked at, for all lags n log n places, and what passes some probes between
    them is extended word by word. Two multiples inside a run of a smaller period are left out, as whatever
    run lies there has that period; equal stretches count once, with the smallest lag.
    """
    sizes = end - start
    reach = np.zeros(len(x), np.int64)  # the furthest end of the runs found over a place
    found: dict[tuple[int, int], int] = {}
    longest = int(sizes[0]) // MIN_PERIODS if len(x) else 0
    low = 1
    while low <= longest:
        lags = np.arange(low, min(2 * low, longest + 1))
        # Places in segments long enough for the lag: a prefix.
        inside = len(x) - np.searchsorted(sizes[::-1], MIN_PERIODS * lags)
        many = -(-inside // lags)
        before = np.r_[0, np.cumsum(many)]
        candidates = []
        for t in range(0, int(before[-1]), PIECE):
            turn = np.arange(t, min(t + PIECE, int(before[-1])))
            which = np.searchsorted(before, turn, "right") - 1
            q = lags[which]
            i = (turn - before[which]) * q
            fits = i + 2 * q < end[i]
            i, q = i[fits], q[fits]
            fits = (x[i] == x[i + q]) & (x[i + q] == x[i + 2 * q]) & (reach[i] < i + 2 * q)
            i, q = i[fits], q[fits]
            for probe in range(1, PROBES):
                if not len(i):
                    break
                j = i + q * probe // PROBES
                fits = x[j] == x[j + q]
                i, q = i[fits], q[fits]
            candidates.append((q, i))
        q_all = np.concatenate([q for q, _ in candidates])
        i_all = np.concatenate([i for _, i in candidates])
        for q in np.unique(q_all).tolist():
            places, k = i_all[q_all == q], 0
            while k < len(places):
                i = int(places[k])
                if reach[i] >= i + 2 * q:
                    k += 1
                    continue
                s, e = _extent(x, i, q, int(start[i]), int(end[i]))
                if e - s + q >= max(MIN_LENGTH, MIN_PERIODS * q) and (s, e + q) not in found:
                    found[s, e + q] = q
                    reach[s : e + q] = np.maximum(reach[s : e + q], e + q)
                k = max(k + 1, int(np.searchsorted(places, e)))
        low *= 2
    return [(s, e - s, q) for (s, e), q in found.items()]


def find_runs(texts: list[list[bytes]]) -> list[list[Run]]:
    """The runs of every text, given as its words, by start, then period; all texts in one go."""
    words, sizes = [], []
    for text in texts:
        number: dict[bytes, int] = {}
        base = len(words)  # texts share no numbers
        words += [base + number.setdefault(w, len(number)) for w in text]
        sizes.append(len(text))
    out: list[list[Run]] = [[] for _ in texts]
    x = np.array(words, dtype=np.int64)
    first = np.cumsum([0, *sizes])[:-1]
    # The first count needs no sort: the numbers are a text's own.
    parts = np.repeat(np.arange(len(texts)), sizes)
    at = split_rare(x, parts) if len(x) else x
    if not len(at):
        return out
    new = np.r_[True, (np.diff(at) != 1) | (np.diff(parts[at]) != 0)]
    edges = np.r_[np.flatnonzero(new), len(at)]
    order = np.argsort(edges[:-1] - edges[1:], kind="stable")  # longest segment first
    lengths = np.diff(edges)[order]
    ends = np.cumsum(lengths)
    starts = ends - lengths
    place = np.repeat(edges[:-1][order] - starts, lengths) + np.arange(len(at))
    origin = at[place]
    runs = lag_scan(x[origin], np.repeat(starts, lengths), np.repeat(ends, lengths))
    for s, length, q in runs:
        text = int(parts[origin[s]])
        out[text].append((int(origin[s] - first[text]), length, q))
    for rows in out:
        rows.sort(key=lambda r: (r[0], r[2]))
    return out


def collapse(words: list[bytes], runs: list[Run]) -> str:
    """The text, words joined by a space, with every run cut down to its first period."""
    if not runs:
        return b" ".join(words).decode("utf-8", "replace")
    keep = np.ones(len(words), bool)
    for s, length, q in runs:
        keep[s + q : s + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep)]).decode("utf-8", "replace")


def _rows(doc_ids: list, texts: list[list[bytes]]) -> Iterator[dict]:
    for doc_id, words, runs in zip(doc_ids, texts, find_runs(texts)):
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        named = [dict(zip(("start", "length", "period"), r)) for r in runs]
        yield {
            "doc_id": doc_id, "n_words": len(words), "runs": named,
            "strongest": best and dict(zip(("start", "length", "period"), best)), "collapsed": collapse(words, runs),
        }


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Runs of every document: ``doc_id, n_words, runs, strongest, collapsed``; one pass, no shuffle.

    Words are what stands between ASCII white space. A run is a stretch of at least
    ``MIN_LENGTH`` words and ``MIN_PERIODS`` periods whose words equal those one (smallest) period
    later, and that no neighbouring word continues. ``runs`` has them by start, then period;
    ``strongest`` is the one with the most periods (ties: smallest start, then period; null without
    a run); ``collapsed`` keeps of each run its first period.

    A null text has no words and collapses to the empty text; so do empty and blank ones. Very
    long texts are worked on whole, one at a time. Repeated rows give a row each, an empty table none, a
    null id stays null. Only ``doc_id`` and ``text`` are read.
    """
    ship_package(docs.sparkSession)
    struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(struct)), ("strongest", struct),
        ("collapsed", pa.string()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, size = [], [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                value = text.as_py() or b""
                if ids and size + len(value) > SLICE_BYTES:
                    yield pa.RecordBatch.from_pylist(list(_rows(ids, texts)), schema)
                    ids, texts, size = [], [], 0
                ids.append(doc_id.as_py())
                texts.append(value.split())
                size += len(value)
            if ids:
                yield pa.RecordBatch.from_pylist(list(_rows(ids, texts)), schema)

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")
    ).mapInArrow(run, SCHEMA)
