import random

import numpy as np
import pytest
from conftest import DOCUMENTS
from pyspark.sql import functions as F

from homeledger.llm import language, quality
from homeledger.llm.text import documents, fold

DATA = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    docs = documents(spark, DATA)
    model = language.fit(docs.filter(fold("doc_id", 3) != 1))
    held = docs.filter(fold("doc_id", 3) == 1)
    rows = language.predict(held, model, ["doc_id", "lang"]).collect()
    assert np.mean([r.row.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    share = np.count_nonzero(model.weights) / model.weights.size
    assert share < 0.5  # the elastic net leaves most weights at zero


def test_language_edges(spark, edge, edge_rows, empty):
    model = language.fit(edge)
    assert model.languages == ["en"]
    out = language.predict(edge, model, edge.columns)
    rows = {r.row.doc_id: r for r in out.collect() if r.row.doc_id is not None}
    assert out.count() == len(edge_rows) and out.select("row.*").columns == edge.columns
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (0, 1, 2, 11, 13))
    assert rows[3].lang_pred == "en"
    nothing = language.fit(empty)
    assert nothing.languages == []
    assert {r.lang_pred for r in language.predict(edge, nothing, ["doc_id"]).collect()} == {"und"}
    assert language.predict(empty, model, ["doc_id"]).count() == 0


def test_sample_is_bounded_and_even(spark):
    rows = [(i, f"word{i} here", "aa" if i % 10 else "bb", "s", 0) for i in range(3000)]
    model = language.fit(spark.createDataFrame(rows, DOCUMENTS), sample_rows=100)
    assert model.languages == ["aa", "bb"]


def test_temperature():
    rng = np.random.default_rng(3)
    logits = rng.normal(size=(4000, 3)) * 2
    p = language.softmax(logits)
    labels = np.array([rng.choice(3, p=row) for row in p])
    assert language.calibrate(logits * 5, labels) == pytest.approx(5, rel=0.15)
    assert language.calibrate(np.zeros((0, 3)), np.zeros(0, int)) == 1.0


def test_isotonic():
    x, y = quality.isotonic(np.array([0.0, 1, 2, 3]), np.array([1.0, 0, 3, 2]), np.array([2.0, 2, 4, 2]))
    assert (np.diff(y) >= 0).all() and y.tolist() == [0.25, 0.75, 1.0] and x.tolist() == [0.5, 2.0, 3.0]


def test_fourier_features_approximate_the_kernel():
    rng = np.random.default_rng(1)
    size = len(quality.STATISTICS)
    model = quality.Model(np.zeros(size), np.ones(size), rng.normal(size=(size, 4000)) / 3.0, rng.uniform(0, 2 * np.pi, 4000), None, None, None)
    x = rng.normal(size=(20, size))
    z = model.transform(x)[:, :-1]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * 9.0))
    assert np.abs(z @ z.T - want).max() < 0.1


def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    scored, _ = quality.quality_scores(documents(spark, DATA), labels.filter(fold("doc_id", 5) != 0))
    rows = scored.join(labels, "doc_id").filter(fold("doc_id", 5) == 0).collect()
    good = [r.score for r in rows if r.quality == 1]
    bad = [r.score for r in rows if r.quality == 0]
    assert np.mean([a > b for a in good for b in bad]) > 0.95


def test_normal_equations_equal_one_process(spark):
    rng = random.Random(1)
    rows = [([rng.random() for _ in quality.STATISTICS], float(rng.random() < 0.5), i % 4 == 0) for i in range(300)]
    model = quality.fit(spark.createDataFrame(rows, "x array<double>, y double, calibrate boolean").repartition(5))
    x = np.array([r[0] for r in rows if not r[2]])
    y = np.array([r[1] for r in rows if not r[2]])
    z = model.transform(x)
    want = np.linalg.solve(z.T @ z + quality.RIDGE * len(x) * np.eye(z.shape[1]), z.T @ y)
    assert np.allclose(model.weights, want)


def test_quality_edges(spark, edge, edge_rows, empty):
    labels = spark.createDataFrame([(7, 1), (7, 0), (3, 1), (1, 0), (None, 1), (2, None), (9999, 1)], "doc_id long, quality int")
    scored, _ = quality.quality_scores(edge, labels.select("*", F.lit(1).alias("x")))
    rows = scored.collect()
    assert len(rows) == len(edge_rows) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.quality_scores(edge, labels.limit(0))[0].collect()} == {0.5}
    assert quality.quality_scores(empty, labels)[0].count() == 0
