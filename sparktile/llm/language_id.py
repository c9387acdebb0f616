"""Language identification: multinomial naive Bayes over hashed character n-grams.

Records are texts that accompany images, keyed by ``source_id``; the project itself has no text table, so any table with
``source_id`` and ``text`` (and ``lang`` for fitting) serves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import class_counts, groups, ngram_buckets, sample_rows

ORDERS = (1, 2, 3)
BITS = 16
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    """``log_probs[bucket, k]`` of language ``langs[k]``; the last row is 0 and stands for n-grams that do not count."""

    langs: tuple[str, ...]
    log_probs: np.ndarray
    priors: np.ndarray


@cache
def letter_table() -> np.ndarray:
    return np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), dtype=bool)


def _grams(points: np.ndarray, skip: np.ndarray) -> Iterator[np.ndarray]:
    """Buckets per order; everything but letters reads as a blank, and blank n-grams get the neutral row."""
    letters = np.where(letter_table()[points], points, np.uint32(32))
    for order in ORDERS:
        h = ngram_buckets(letters, order, BITS)
        blank = letters == 32
        for k in range(1, order):
            blank = blank & np.concatenate([letters[k:] == 32, np.ones(min(k, letters.size), dtype=bool)])[: letters.size]
        h[blank | skip] = 1 << BITS
        yield h


def fit_language_model(records: DataFrame, rows_per_language: int = 4000, alpha: float = 0.1) -> LanguageModel:
    """Action: counts n-gram buckets of (source_id, text, lang) by language; rows with a null lang or text are not used.

    At most about ``rows_per_language`` rows of each language are counted, chosen by a hash; the prior is the language's share of all
    usable rows.  Any number of languages fits; the matrix has 262 KB for each.  Counts are summed on Spark and
    the table of languages x 2**16 buckets is bounded, so the driver may hold it.
    """
    usable = records.select("source_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    every = class_counts(usable, "lang")
    sample = sample_rows(usable, "lang", rows_per_language, counts=every)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, part in batch.groupby("lang"):
                total = totals.setdefault(lang, np.zeros((1 << BITS) + 1, dtype=np.int64))
                for points, _, _, skip in groups([t.lower() for t in part["text"]]):
                    for h in _grams(points, skip):
                        total += np.bincount(h, minlength=total.size)
        for lang, total in totals.items():
            used = np.flatnonzero(total[:-1])
            yield pd.DataFrame({"lang": lang, "bucket": used, "n": total[used]})

    counted = sample.select("text", "lang").mapInPandas(count, "lang string, bucket long, n long")
    sums = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    sizes = dict(every.join(sample.select("lang").distinct(), F.col("class") == F.col("lang"), "left_semi").select("class", "n").collect())
    langs = tuple(sorted(sizes))
    table = np.zeros(((1 << BITS) + 1, len(langs)), dtype=np.float32)
    where = {name: k for k, name in enumerate(langs)}
    table[sums["bucket"].to_numpy(dtype=np.int64), sums["lang"].map(where).to_numpy(dtype=np.int64)] = sums["n"].to_numpy()
    seen = table[:-1]  # the last row is neutral
    seen += np.float32(alpha)
    totals = np.log(seen.sum(axis=0, dtype=np.float64)).astype(np.float32)
    np.log(seen, out=seen)
    seen -= totals
    rows = np.array([sizes[x] for x in langs], dtype=float)
    return LanguageModel(langs, table, np.log(rows / rows.sum()) if len(langs) else rows)


def score_texts(model: LanguageModel, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and posterior probability per text."""
    known = [t.lower() if isinstance(t, str) else "" for t in texts]
    totals = np.zeros((len(known), max(1, len(model.langs))))
    letters = np.zeros(len(known), dtype=bool)
    for points, owner, starts, skip in groups(known):
        np.logical_or.at(letters, owner, np.logical_or.reduceat(letter_table()[points], starts))
        if model.langs:
            for h in _grams(points, skip):
                np.add.at(totals, owner, np.add.reduceat(model.log_probs[h], starts, axis=0, dtype=np.float64))
    if not model.langs:
        return [UNKNOWN] * len(known), np.zeros(len(known))
    logits = totals + model.priors
    logits -= logits.max(axis=1, keepdims=True)
    best = logits.argmax(axis=1)
    score = 1.0 / np.exp(logits).sum(axis=1)
    return [model.langs[k] if seen else UNKNOWN for k, seen in zip(best, letters)], np.where(letters, score, 0.0)


def identify_language(records: DataFrame, model: LanguageModel) -> DataFrame:
    """(source_id, text) to (source_id, lang_pred, score), one row per record.

    Method: the log-probability matrix (bounded: languages x 65,537) is broadcast; batches are scored in numpy by gathering the
    rows of the n-grams that occur and adding them up per text.  No shuffle.

    Null text, or text without a letter, is ``und`` with score 0; equal scores take the first language by name; a model
    without languages says ``und``.  Null ids and repeated rows are scored like others; other columns are ignored.
    """
    shared = records.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([
        T.StructField("source_id", records.schema["source_id"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
    ])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            langs, scores = score_texts(shared.value, batch["text"].tolist())
            yield pd.DataFrame({"source_id": batch["source_id"], "lang_pred": langs, "score": scores})

    return records.select("source_id", "text").mapInPandas(score, schema)
