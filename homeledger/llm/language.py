"""Language identification: sparse multinomial logistic regression on character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from homeledger.session import materialize, ship_package

ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
SAMPLE_ROWS = 6000  # labelled rows the classifier is fitted on, shared evenly by the languages
CALIBRATION_SHARE = 5  # one sampled row in so many sets the temperature instead
EPOCHS = 3
SEED = 17
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.001
UNDETERMINED = "und"
LETTER = re.compile(r"[^\W\d_]")
_PRIME = np.uint32(2654435761)


def grams(text: str) -> np.ndarray:
    """Buckets of all character n-grams of a lower-cased text with a space at either end."""
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype="<u4").copy()
    out = []
    with np.errstate(over="ignore"):
        for n in ORDERS:
            h = np.full(max(0, len(code) - n + 1), n, dtype=np.uint32)
            for at in range(n):
                h *= _PRIME
                h ^= code[at : at + len(h)]
            out.append((h * _PRIME) >> np.uint32(16))
    return np.concatenate(out)


@dataclass
class Model:
    """Languages, idf-scaled weights per bucket and language, biases and the temperature."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not LETTER.search(text):
            return UNDETERMINED, 0.0
        seen = grams(text)
        total = np.zeros(len(self.languages))
        for at in range(0, len(seen), 1 << 16):  # the rows looked up at once stay few
            total += self.weights[seen[at : at + (1 << 16)]].sum(axis=0)
        p = softmax((total * (SCALE / len(seen)) + self.bias) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


# Term frequencies are shares of a text's n-grams times this.
SCALE = 100.0


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def document_frequencies(texts: DataFrame) -> DataFrame:
    """``bucket, df`` over all rows of ``texts (text)``; each task adds up its own rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                flags = np.zeros(BUCKETS, bool)
                flags[grams(text.as_py() or "")] = True
                df += flags
                docs += 1
        seen = np.flatnonzero(df)
        # The number of documents travels as bucket -1.
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[-1, seen]), pa.array(np.r_[docs, df[seen]])], names=["bucket", "n"]
        )

    counts = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    return counts.groupBy("bucket").agg(F.sum("n").alias("df"))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Follow-the-regularised-leader with elastic net over sparse rows ``(buckets, values, class)``.

    The last weight row is the bias. Rows come in the given order, the same in every epoch.
    """
    z = np.zeros((BUCKETS + 1, classes))
    n = np.zeros((BUCKETS + 1, classes))

    def weights(at):
        zs, ns = z[at], n[at]
        w = -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2)
        return np.where(np.abs(zs) <= L1, 0.0, w), ns

    for _ in range(EPOCHS):
        for at, value, label in rows:
            at, value = np.r_[at, BUCKETS], np.r_[value, 1.0]
            w, ns = weights(at)
            error = softmax(value @ w)
            error[label] -= 1.0
            g = value[:, None] * error
            step = (np.sqrt(ns + g * g) - np.sqrt(ns)) / ALPHA
            z[at] += g - step * w
            n[at] = ns + g * g
    final, _ = weights(np.arange(BUCKETS + 1))
    return final[:BUCKETS], final[BUCKETS]


def calibrate(logits: np.ndarray, labels: np.ndarray) -> float:
    """Temperature of least log loss, by golden-section search on its logarithm; 1 without rows."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t))
        return -float(np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean())

    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        if loss(a) <= loss(b):
            high = b
        else:
            low = a
    return float(np.exp((low + high) / 2))


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learns from ``labelled (text, lang)`` (an action per step).

    Document frequencies cover all labelled rows. The weights are fitted in one task on a
    sample of at most ``sample_rows`` rows, as many of each language, drawn at random with a
    fixed seed; that bound keeps the task and the model small whatever the table's size. Rows
    whose text or lang is null, or that have no letter, are not learned from. No rows give a model without
    languages, which finds every text undetermined.
    """
    spark = labelled.sparkSession
    ship_package(spark)
    labelled = labelled.select(
        F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    ).filter(F.col("text").rlike(r"\p{L}") & F.col("lang").isNotNull())
    counts = document_frequencies(labelled).collect()  # at most one row per bucket
    df = np.zeros(BUCKETS + 1)
    for row in counts:
        df[row.bucket] = row.df
    docs = df[-1]
    # At most one row per language; beyond sample_rows languages the rarest are not learned.
    sizes = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(sample_rows).collect()
    languages = [r.lang for r in sizes]
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0)
    idf = np.log((1.0 + docs) / (1.0 + df[:BUCKETS])) + 1.0
    share = max(1, sample_rows // len(languages))
    # A seeded draw leaves little more than a share of each language before anything is shuffled.
    rate = F.create_map(*[F.lit(x) for r in sizes for x in (r.lang, min(1.0, 1.2 * share / r["count"]))])
    drawn = labelled.withColumn("u", F.rand(SEED)).filter(F.col("u") < F.element_at(rate, F.col("lang")))
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("u"))
    sample = materialize(drawn.withColumn("turn", turn).filter(F.col("turn") <= share), "language-sample")
    number = {lang: i for i, lang in enumerate(sorted(languages))}
    given = spark.sparkContext.broadcast((idf, number))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale, labels = given.value
        rows, held = [], []
        for batch in batches:
            for text, lang, turn in zip(*(c.to_pylist() for c in batch.columns)):
                at, count = np.unique(grams(text), return_counts=True)
                value = count * (SCALE / count.sum()) * scale[at]
                row = (at.astype(np.int32), value.astype(np.float32), labels[lang])
                (held if turn % CALIBRATION_SHARE == 0 else rows).append(row)
        weights, bias = train(rows, len(labels))
        logits = np.array([value @ weights[at] + bias for at, value, _ in held]).reshape(len(held), len(labels))
        heat = calibrate(logits, np.array([label for *_, label in held], dtype=np.int64))
        used = np.flatnonzero(np.abs(weights).sum(axis=1))
        scaled = np.vstack([weights[used] * scale[used, None], bias, np.full(len(bias), heat)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[used, -1, -2]), pa.array(list(scaled), pa.list_(pa.float64()))], names=["bucket", "w"]
        )

    fitted = (
        sample.orderBy("turn", "lang").coalesce(1).select("text", "lang", "turn")
        .mapInArrow(run, "bucket long, w array<double>")
    )
    weights = np.zeros((BUCKETS, len(number)), np.float32)
    bias, heat = np.zeros(len(number)), 1.0
    for row in fitted.collect():  # at most one row per bucket
        if row.bucket == -1:
            bias = np.array(row.w)
        elif row.bucket == -2:
            heat = row.w[0]
        else:
            weights[row.bucket] = row.w
    return Model(sorted(number), weights, bias, heat)


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``row`` (a struct of the columns ``keep``), ``lang_pred`` and ``score`` of every document.

    The score, 0 to 1, is the calibrated probability of the predicted language. A null text, or one
    without a letter, gives ``und`` and 0. Of equally likely languages the first by name is taken. Repeated rows give a row each. One pass, no shuffle;
    the model's size is fixed by the number of buckets and languages.
    """
    spark: SparkSession = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        found = [shared.value.predict(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays(
            [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
            names=["lang_pred", "score"],
        )

    # Only the text crosses into Python. Marked as not deterministic, so that a filter on the result
    # is not pushed below it, where it would be worked out once more.
    judge = F.arrow_udf(run, "lang_pred string, score double").asNondeterministic()
    row = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")
    judged = docs.select(row, judge(F.col("text").cast("string")).alias("found"))
    return judged.select("row", "found.lang_pred", "found.score")
