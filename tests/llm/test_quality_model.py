"""Ordinal quality model: slow scorer, numeric gradient, falling loss, and accuracy on documents it was not fitted on."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparktile.llm.quality_ordinal import BITS, SIZE, fit_quality, fit_rows, grade_quality, score_texts, text_measures, text_rows
from sparktile.llm.queries import as_records

TEXTS = [
    "the plain sentence goes on and says a thing", "", "A", "BUY NOW!!! $$$ ###", "ж" * 50, "one two three\none two three\none two three", " \t\n",
    "the quick brown fox " * 400, "1234 5678 90", "Mixed Case and 7 numbers, some commas; more.", "||| *** ||| ***", "a b c d e f g",
]


def features(texts):
    hashed = {i: (np.array(at), np.array(x, dtype=float)) for i, at, x in text_rows(texts)}
    none = (np.zeros(0, int), np.zeros(0))
    return [hashed.get(i, none) for i in range(len(texts))], np.array([text_measures(t) for t in texts])


def frame(texts, grades):
    sparse, dense = features(texts)
    return pd.DataFrame({
        "grade": grades, "at": [a.astype("<i4").tobytes() for a, _ in sparse], "x": [x.astype("<f4").tobytes() for _, x in sparse],
        "extra": [d.astype("<f4").tobytes() for d in dense],
    })


def tails(texts, weights, thresholds, scale):
    """P(grade > k), one text and one n-gram at a time."""
    out = []
    for (at, x), dense in zip(*features(texts)):
        score = sum(weights[b] * scale[b] * v for b, v in zip(at, x)) + sum(dense * (weights * scale)[1 << BITS :])
        out.append([1 / (1 + np.exp(-(score - t))) for t in thresholds])
    return np.array(out)


def loss(texts, y, weights, thresholds, scale, penalty):
    """Weighted negative log-likelihood, every grade with the same weight in all, and half the squared weights."""
    p = np.hstack([np.ones((len(y), 1)), tails(texts, weights, thresholds, scale), np.zeros((len(y), 1))])
    share = np.array([1 / list(y).count(k) for k in y])
    return -(share / share.sum() * np.log([p[i, k] - p[i, k + 1] for i, k in enumerate(y)])).sum() + penalty / 2 * (weights**2).sum()


@pytest.fixture(scope="module")
def graded():
    return [i % 3 for i in range(len(TEXTS))]


def test_scores_equal_a_slow_scorer(graded):
    model = fit_rows(frame(TEXTS, graded), 60, 1e-3)
    got = score_texts(model, TEXTS)
    want = tails(TEXTS, model.weights, model.thresholds, model.scale)
    assert got.shape == want.shape and np.abs(got - want).max() < 1e-5
    assert (np.diff(model.thresholds) > 0).all()


def test_first_step_follows_the_numeric_gradient(graded):
    """The first step of the fit goes 0.05 against the sign of every partial derivative."""
    model = fit_rows(frame(TEXTS, graded), 1, 1e-4)
    start, eps, checked = np.zeros(SIZE), 1e-5, 0
    used = sorted({b for at, _ in features(TEXTS)[0] for b in at[:3]})[:12] + list(range(1 << BITS, SIZE))
    for c in used:
        up, down = start.copy(), start.copy()
        up[c], down[c] = eps, -eps
        slope = (loss(TEXTS, graded, up, [0, 1], model.scale, 1e-4) - loss(TEXTS, graded, down, [0, 1], model.scale, 1e-4)) / (2 * eps)
        if abs(slope) > 1e-5:
            assert model.weights[c] == pytest.approx(-0.05 * np.sign(slope), abs=1e-3)
            checked += 1
    assert checked > 6
    first = loss(TEXTS, graded, start, [eps, 1 + eps], model.scale, 0) - loss(TEXTS, graded, start, [-eps, 1 - eps], model.scale, 0)
    gap = loss(TEXTS, graded, start, [0, np.exp(eps)], model.scale, 0) - loss(TEXTS, graded, start, [0, np.exp(-eps)], model.scale, 0)
    assert model.thresholds[0] == pytest.approx(-0.05 * np.sign(first), abs=1e-3)
    assert np.log(model.thresholds[1] - model.thresholds[0]) == pytest.approx(-0.05 * np.sign(gap), abs=1e-3)


def test_loss_falls_with_the_steps(graded):
    values = []
    for steps in (1, 20, 100, 200):
        model = fit_rows(frame(TEXTS, graded), steps, 1e-4)
        values.append(loss(TEXTS, graded, model.weights, model.thresholds, model.scale, 1e-4))
    assert values == sorted(values, reverse=True) and values[-1] < 0.8 * values[0]


def test_documents_that_were_not_fitted_on(spark):
    folder = "/root/testdata/sf0.1"
    docs = as_records(spark.read.parquet(f"{folder}/documents.parquet"))
    labels = spark.read.parquet(f"{folder}/labels.parquet").select(F.col("doc_id").alias("source_id"), "quality")
    seen = (F.crc32(F.col("source_id").cast("string").cast("binary")) % 3) != 0
    model = fit_quality(docs, labels.where(seen).select("source_id", F.col("quality").cast("int").alias("grade")))
    graded = grade_quality(docs, model).join(labels.where(~seen), "source_id").select("quality", "kept", "tail_probability").collect()
    good, bad = ([r for r in graded if r.quality == q] for q in (1, 0))
    assert len(good) > 100 and len(bad) > 20
    assert sum(r.kept for r in good) / len(good) > 0.95 and sum(r.kept for r in bad) / len(bad) < 0.2
    pairs = [(g.tail_probability > b.tail_probability) + 0.5 * (g.tail_probability == b.tail_probability) for g in good for b in bad]
    assert sum(pairs) / len(pairs) > 0.95  # measured: 0.965, with 28 of 190 low documents kept and 1 of 1,165 good ones lost
