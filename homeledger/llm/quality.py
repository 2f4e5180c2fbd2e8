"""Quality scores: kernel ridge regression on random Fourier features of document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from homeledger.session import materialize, ship_package

STATISTICS = (
    "log_words", "log_chars", "mean_word", "symbol_share", "upper_share", "digit_share", "punctuation_share",
    "space_share", "non_ascii_share", "distinct_words", "repeated_next", "distinct_lines", "words_per_line",
    "pipe_share", "exclamation_share",
)
FEATURES = 128
BANDWIDTH = 3.0
RIDGE = 1e-3
BINS = 512
SEED = 7
CALIBRATION_SHARE = 4  # one training row in so many is held back for the calibration

_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_CLASSES = np.zeros((256, 7))
_CLASSES[list(b"#*$%&|<>{}[]\\^~=@_/"), 0] = 1
_CLASSES[65:91, 1] = 1
_CLASSES[48:58, 2] = 1
_CLASSES[list(b".,;:?!'\"()-"), 3] = 1
_CLASSES[[32, *range(9, 14)], 4] = 1
_CLASSES[128:, 5] = 1
_CLASSES[ord("|"), 6] = 1


def statistics(text: bytes | None) -> list[float]:
    """The figures named in ``STATISTICS`` of a whole text as UTF-8; zeros for no text."""
    if not text:
        return [0.0] * len(STATISTICS)
    words = text.split()
    bytes_ = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    symbol, upper, digit, point, space, non_ascii, pipe = bytes_ @ _CLASSES / len(text)
    lines = [line for line in text.split(b"\n") if line.strip()]
    count = max(1, len(words))
    return [
        np.log1p(len(words)),
        np.log1p(len(text)),
        (len(text) - space * len(text)) / count,
        symbol, upper, digit, point, space, non_ascii,
        len(set(words)) / count,
        sum(map(bytes.__eq__, words, words[1:])) / count,
        len(set(lines)) / max(1, len(lines)),
        np.log1p(len(words) / max(1, len(lines))),
        pipe,
        bytes_[33] / count,
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, x``: one array of statistics per document, in one pass over the texts."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"]
            )

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")
    ).mapInArrow(run, "doc_id long, x array<double>")


@dataclass
class Model:
    """Scaling of the statistics, the random features, ridge weights and the calibration steps."""

    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def transform(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features of standardised statistics, and a constant."""
        z = np.clip((x - self.mean) / self.scale, -8.0, 8.0) @ self.omega + self.phase
        return np.hstack([np.sqrt(2.0 / len(self.phase)) * np.cos(z), np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.transform(x) @ self.weights, self.knots, self.levels)


def isotonic(position: np.ndarray, positive: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators over bins in order: block centres and non-decreasing shares."""
    blocks: list[list[float]] = []
    for p, y, n in zip(position, positive, count):
        blocks.append([p * n, y, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 2], b[:, 1] / b[:, 2]


def _summed(rows: DataFrame, run, columns: str) -> DataFrame:
    """Sums the arrays ``(part, values)`` that each task makes of its rows, element by element."""
    cells = rows.mapInArrow(run, columns).select("part", F.posexplode("values").alias("i", "v"))
    return cells.groupBy("part", "i").agg(F.sum("v").alias("v"))


def fit(train: DataFrame, features: int = FEATURES, bandwidth: float = BANDWIDTH, ridge: float = RIDGE) -> Model:
    """Learns from ``train (x, y, calibrate)``, all rows of it (an action per step).

    Means and spreads of the statistics, the normal equations and the counts per score bin
    are summed in the tasks and then across them; only those sums, of a fixed size, reach the
    driver. Rows with ``calibrate`` set the isotonic calibration, the others the weights. No rows give
    a score of 0.5 to everything.
    """
    spark = train.sparkSession
    ship_package(spark)
    size = len(STATISTICS)
    figures = train.agg(
        F.array(*[F.avg(F.col("x")[i]) for i in range(size)]).alias("mean"),
        F.array(*[F.stddev_pop(F.col("x")[i]) for i in range(size)]).alias("spread"),
    ).first()
    rng = np.random.default_rng(SEED)
    mean = np.array([v or 0.0 for v in figures.mean], dtype=float)
    spread = np.array([v or 0.0 for v in figures.spread], dtype=float)
    model = Model(
        mean,
        np.where(spread > 1e-9, spread, 1.0),
        rng.normal(size=(size, features)) / bandwidth,
        rng.uniform(0, 2 * np.pi, features),
        np.zeros(features + 1),
        np.array([0.0]),
        np.array([0.5]),
    )
    given = spark.sparkContext.broadcast(model)

    def matrix(column: pa.Array) -> np.ndarray:
        return np.array(column.to_pylist(), dtype=float).reshape(len(column), size)

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, moment = np.zeros((features + 1, features + 1)), np.zeros(features + 1)
        for batch in batches:
            z = given.value.transform(matrix(batch.column(0)))
            gram += z.T @ z
            moment += z.T @ batch.column(1).to_numpy(zero_copy_only=False)
        values = [*gram, moment]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(values)), pa.int32()), pa.array(values, pa.list_(pa.float64()))],
            names=["part", "values"],
        )

    sums = np.zeros((features + 2, features + 1))
    fitted = train.filter(~F.col("calibrate")).select("x", F.col("y").cast("double"))
    for row in _summed(fitted, equations, "part int, values array<double>").collect():
        sums[row.part, row.i] = row.v
    gram, moment = sums[:-1], sums[-1]
    rows = gram[-1, -1]
    if not rows:
        return model
    model.weights = np.linalg.solve(gram + ridge * rows * np.eye(features + 1), moment)
    given = spark.sparkContext.broadcast(model)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((3, BINS))
        for batch in batches:
            raw = given.value.transform(matrix(batch.column(0))) @ given.value.weights
            at = np.clip(((raw + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for i, v in enumerate((raw, y, np.ones(len(y)))):
                out[i] += np.bincount(at, v, BINS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(3), pa.int32()), pa.array(list(out), pa.list_(pa.float64()))], names=["part", "values"]
        )

    out = np.zeros((3, BINS))
    held = train.filter("calibrate").select("x", F.col("y").cast("double"))
    for row in _summed(held, bins, "part int, values array<double>").collect():
        out[row.part, row.i] = row.v
    used = out[2] > 0
    if used.any():
        # A share of one half on either side keeps empty ends away from 0 and 1.
        total, good, count = out[:, used]
        model.knots, model.levels = isotonic(total / count, good + 0.5, count + 1.0)
    return model


def scores(stats: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every row of ``stats (doc_id, x)``; one pass, no shuffle."""
    given = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), dtype=float).reshape(batch.num_rows, len(STATISTICS))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(given.value.score(x))], names=["doc_id", "score"]
            )

    return stats.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, Model]:
    """``doc_id, score`` of every document, learned from ``labels (doc_id, quality)``.

    Only statistics of the text enter the score. Labels that are null, or whose id is null or
    not in ``docs``, teach nothing; several labels of a document count as several rows. A null
    or empty text has statistics of zero and is scored like any other. The statistics are
    stored once and serve the fit and the scores.
    """
    stats = materialize(document_statistics(docs), "quality-statistics")
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATION_SHARE)) == 0
    train = (
        stats.join(given.filter(F.col("y").isNotNull()), "doc_id").select("x", "y", held.alias("calibrate"))
    )
    model = fit(materialize(train, "quality-training"))
    return scores(stats, model), model
