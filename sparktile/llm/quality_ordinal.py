"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Records are texts keyed by ``source_id`` with an integer ``grade`` (0 is worst) for fitting.  The project's records carry no
ratings, so the operator stays general.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import groups, labelled_sample, ngram_buckets

BITS = 13
ORDERS = (2, 3)
EXTRA = 6  # dense text measures after the hashed part
SIZE = (1 << BITS) + EXTRA
SYMBOLS = frozenset(map(ord, "#*$%&|<>!?{}[]=_~^@\\/"))


@dataclass(frozen=True)
class OrdinalModel:
    """P(grade > k) = sigmoid(x . weights - thresholds[k]); ``grades`` are the rating values in order."""

    grades: tuple[int, ...]
    weights: np.ndarray
    thresholds: np.ndarray
    scale: np.ndarray


def _folded(points: np.ndarray) -> np.ndarray:
    """Coarse alphabet: letters keep identity, digits read as 0; case stays, since shouting is a sign of low quality."""
    return np.where((points >= 48) & (points <= 57), np.uint32(48), points)


def text_measures(text: str) -> list[float]:
    """Repetition and shape in [0, 1]: zlib ratio, distinct words, distinct lines, upper case, symbols, evidence."""
    raw = text.encode("utf-8", "surrogatepass")
    words, lines = raw.split(), raw.split(b"\n")
    if not words:
        return [0.0] * EXTRA
    # a deflate window sees repetition within 32 KiB, so one chunk after another keeps memory flat
    packed = sum(len(zlib.compress(raw[i : i + (1 << 16)], 1)) for i in range(0, len(raw), 1 << 16))
    upper = len(text) - len(text.translate(_NO_UPPER))
    marks = len(text) - len(text.translate(_NO_SYMBOLS))
    return [
        min(1.0, packed / len(raw)), len(set(words)) / len(words), len(set(lines)) / len(lines), upper / len(text),
        min(1.0, marks / len(words)), 1.0 / (1.0 + len(words)),
    ]


_NO_UPPER = {c: None for c in range(0x110000) if chr(c).isupper()}
_NO_SYMBOLS = {c: None for c in SYMBOLS}


def text_rows(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(text number, buckets, relative frequencies) of the hashed part, used for fitting."""
    for i, text in enumerate(texts):
        counts = np.zeros(1 << BITS)
        for points, _, _, skip in groups([text]):
            for order in ORDERS:
                h = ngram_buckets(_folded(points), order, BITS)[~skip]
                counts += np.bincount(h, minlength=counts.size)
        used = np.flatnonzero(counts)
        yield i, used, counts[used] / max(1.0, counts.sum())


def fit_quality(records: DataFrame, ratings: DataFrame, rows_per_grade: int = 1500, steps: int = 200, penalty: float = 1e-4) -> OrdinalModel:
    """Action: fits on about ``rows_per_grade`` rows of each grade of (source_id, grade), chosen by a hash.

    Features are computed on Spark; the driver gets at most grades x rows_per_grade sparse rows of at most 2**13 + 6 values and
    runs ``steps`` of a full-batch adaptive gradient on the cumulative logit likelihood.  Each grade weighs the same.  Null
    text counts as empty, null grades are not used; without two grades the model is neutral.
    """
    sample = labelled_sample(records, ratings.select("source_id", F.col("grade").cast("int").alias("grade")), "grade", rows_per_grade)

    def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, grades = batch["text"].tolist(), batch["grade"].tolist()
            for i, used, freq in text_rows(texts):
                yield pd.DataFrame({
                    "grade": [int(grades[i])], "at": [used.astype("<i4").tobytes()], "x": [freq.astype("<f4").tobytes()],
                    "extra": [np.array(text_measures(texts[i]), dtype="<f4").tobytes()],
                })

    rows = sample.select("text", "grade").mapInPandas(featurise, "grade int, at binary, x binary, extra binary").toPandas()
    return fit_rows(rows, steps, penalty)


def fit_rows(rows: pd.DataFrame, steps: int, penalty: float) -> OrdinalModel:
    grades = tuple(sorted(set(rows["grade"])))
    levels = len(grades) - 1
    if levels < 1:
        return OrdinalModel(grades, np.zeros(SIZE), np.zeros(0), np.ones(SIZE))
    # a fixed order of rows makes sums, and so the model, repeatable
    rows = rows.sort_values(["grade", "at", "x", "extra"], kind="stable")
    y = np.searchsorted(grades, rows["grade"].to_numpy())
    at = [np.frombuffer(b, dtype="<i4") for b in rows["at"]]
    xs = [np.frombuffer(b, dtype="<f4") for b in rows["x"]]
    owner = np.repeat(np.arange(len(at)), [a.size for a in at])
    column, value = np.concatenate(at), np.concatenate(xs).astype(np.float64)
    dense = np.vstack([np.frombuffer(b, dtype="<f4") for b in rows["extra"]]).astype(np.float64)
    hashed = 1 << BITS
    # frequencies are tiny and uneven: each column is scaled by its root mean square
    square = np.concatenate([np.bincount(column, value**2, minlength=hashed), (dense**2).sum(axis=0)]) / len(at)
    scale = 1.0 / np.maximum(np.sqrt(square), 1e-4)
    scale[:hashed] *= 0.1  # the hashed part is one signal among the measures, spread over many columns
    value, dense = value * scale[column], dense * scale[hashed:]
    weight = (1.0 / np.bincount(y))[y]
    weight /= weight.sum()
    above = (y[:, None] > np.arange(levels)).astype(np.float64)
    w, first, gaps = np.zeros(SIZE), 0.0, np.zeros(levels - 1)
    params = np.concatenate([w, [first], gaps])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        w = params[:SIZE]
        # ordered thresholds: a first one and positive gaps
        thresholds = params[SIZE] + np.concatenate([[0.0], np.cumsum(np.exp(params[SIZE + 1 :]))])
        score = np.bincount(owner, value * w[column], minlength=len(at)) + dense @ w[hashed:]
        p = 1.0 / (1.0 + np.exp(-np.clip(score[:, None] - thresholds, -30, 30)))
        # P(y = k) = p[k-1] - p[k]; derivative of its log in the score and in each threshold
        padded = np.hstack([np.ones((len(at), 1)), p, np.zeros((len(at), 1))])
        rows_i = np.arange(len(at))
        hi, lo = padded[rows_i, y], padded[rows_i, y + 1]
        likely = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / likely, lo * (1 - lo) / likely
        g_score = -weight * (d_hi - d_lo)
        g_threshold = np.zeros(levels)
        np.add.at(g_threshold, np.maximum(y - 1, 0), np.where(y > 0, weight * d_hi, 0.0))
        np.add.at(g_threshold, np.minimum(y, levels - 1), np.where(y < levels, -weight * d_lo, 0.0))
        grad = np.concatenate([
            np.bincount(column, value * g_score[owner], minlength=hashed) + penalty * w[:hashed], dense.T @ g_score + penalty * w[hashed:],
            [g_threshold.sum()], np.cumsum(g_threshold[::-1])[::-1][1:] * np.exp(params[SIZE + 1 :]),
        ])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        params = params - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    thresholds = params[SIZE] + np.concatenate([[0.0], np.cumsum(np.exp(params[SIZE + 1 :]))])
    return OrdinalModel(grades, params[:SIZE], thresholds, scale)


def score_texts(model: OrdinalModel, texts: list[str]) -> np.ndarray:
    """P(grade > k) for each text and threshold."""
    hashed = (model.weights * model.scale)[: 1 << BITS]
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    for points, owner, starts, skip in groups(texts):
        folded = _folded(points)
        for order in ORDERS:
            w = hashed[ngram_buckets(folded, order, BITS)]
            w[skip] = 0.0
            np.add.at(total, owner, np.add.reduceat(w, starts))
        np.add.at(count, owner, len(ORDERS) * np.add.reduceat((~skip).astype(np.float64), starts))
    extra = np.array([text_measures(t) for t in texts]).reshape(len(texts), EXTRA)
    score = total / np.maximum(count, 1.0) + extra @ (model.weights * model.scale)[1 << BITS :]
    return 1.0 / (1.0 + np.exp(-np.clip(score[:, None] - model.thresholds, -30, 30)))


def grade_quality(records: DataFrame, model: OrdinalModel, keep_grade: int = 1, keep_probability: float = 0.5) -> DataFrame:
    """(source_id, text) to ``expected_grade``, ``tail_probability`` = P(grade >= keep_grade) and ``kept``.

    Method: cumulative-link regression with one weight vector over hashed character n-grams and text measures, shared by all
    ordered thresholds.  The weights (2**13 + 6 numbers) are broadcast; scoring is one pass without a shuffle.

    Null text scores as empty text.  A neutral model (fewer than two grades seen) keeps everything, with expected grade
    null and tail probability 1.  Null ids and repeated rows are scored like others; other columns are ignored.
    """
    graded = records.select("source_id", grade_column(records, model, keep_grade, keep_probability)(F.col("text")).alias("g"))
    return graded.select("source_id", "g.expected_grade", "g.tail_probability", "g.kept")


def grade_column(records: DataFrame, model: OrdinalModel, keep_grade: int = 1, keep_probability: float = 0.5):
    """Vectorised function of a text column giving struct(expected_grade, tail_probability, kept), to filter rows in place."""
    shared = records.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("expected_grade double, tail_probability double, kept boolean")
    def grade(texts: pd.Series) -> pd.DataFrame:
        model, n = shared.value, len(texts)
        if len(model.grades) < 2:
            return pd.DataFrame({"expected_grade": pd.Series([None] * n, dtype=float), "tail_probability": [1.0] * n, "kept": [True] * n})
        above = score_texts(model, [t if isinstance(t, str) else "" for t in texts])
        steps = np.diff(np.array(model.grades, dtype=float))
        k = int(np.searchsorted(model.grades, keep_grade))
        tail = np.ones(n) if k == 0 else np.zeros(n) if k > above.shape[1] else above[:, k - 1]
        return pd.DataFrame({"expected_grade": model.grades[0] + above @ steps, "tail_probability": tail, "kept": tail >= keep_probability})

    return grade
