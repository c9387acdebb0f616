"""Texts as numpy arrays: batches of whole texts laid end to end, and hashed n-grams over them.

Shared by the text models.  A batch is cut into groups of about ``CHARS_AT_ONCE`` code points so that memory does not follow
the number of rows; a longer text forms a group of its own and is read in slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package

CHARS_AT_ONCE = 1 << 20
GAP = 2  # blanks after each slice, so that n-grams of up to three characters do not run into the next


def text_session(spark: SparkSession) -> SparkSession:
    """Ship the package and keep Arrow batches small: a thousand texts or 16 MB, so that long texts do not pile up in workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return ship_package(spark)


def class_counts(rows: DataFrame, strata: str) -> DataFrame:
    """(class, n): rows of each value of ``strata`` that is not null, written so that a join knows the table's size."""
    path = scratch_path(rows.sparkSession, "class-counts")
    rows.where(F.col(strata).isNotNull()).groupBy(F.col(strata).alias("class")).agg(F.count("*").alias("n")).write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def sample_rows(rows: DataFrame, strata: str, most: int, keys: tuple[str, ...] = ("source_id", "text"), counts: DataFrame | None = None) -> DataFrame:
    """About ``most`` rows of each value of ``strata`` (all, if it has fewer), chosen by a hash of ``keys``; null values are left out.

    A documented bound for fitting a model; the choice depends on the rows alone.  The shares are a table that the rows are
    joined to, with any number of classes: Spark broadcasts it if its size allows.
    """
    counts = class_counts(rows, strata) if counts is None else counts
    unit = F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = rows.join(counts, F.col(strata) == F.col("class")).where(unit < F.least(F.lit(1.0), F.lit(float(most)) / F.col("n")))
    return drawn.select(*[rows[c] for c in rows.columns])


def labelled_sample(records: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(source_id, text, label) for about ``most`` ids of each label value, written once for the passes of a fit.

    The ids are drawn from the narrow ``labels`` (source_id, label) before any text is read: at most classes x ``most`` rows,
    give or take chance, whatever the input; that bounded table is broadcast to the texts, so these are not shuffled.  Of rows
    that share a drawn id, the text with the smallest hash stands for all, picked per task first.  Null ids and null labels are
    not used; null text is empty.
    """
    spark = records.sparkSession
    drawn_path, path = scratch_path(spark, "drawn-labels"), scratch_path(spark, "labelled-sample")
    ids = labels.select("source_id", label).where(F.col("source_id").isNotNull() & F.col(label).isNotNull()).distinct()
    sample_rows(ids, label, most, ("source_id",)).write.parquet(drawn_path)
    drawn = F.broadcast(spark.read.parquet(drawn_path))
    texts = records.select("source_id", F.coalesce("text", F.lit("")).alias("text"))
    smallest = F.min(F.struct(F.xxhash64("text"), "text")).getField("text").alias("text")
    texts.join(drawn, "source_id").groupBy("source_id", label).agg(smallest).select("source_id", "text", label).write.parquet(path)
    return spark.read.parquet(path)


def groups(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(code points, owner, start, skip) per group: slice k belongs to text owner[k] and starts at start[k].

    ``skip`` marks places at which no n-gram may start: the blanks after a slice, and the overlap at the end of every slice
    that is not a text's last.
    """
    parts: list[str] = []
    owner: list[int] = []
    cut: list[bool] = []
    size = 0

    def flush():
        lengths = np.array([len(p) + GAP for p in parts])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        points = np.frombuffer((" " * GAP).join([*parts, ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        skip = np.zeros(points.size, dtype=bool)
        for s, n, c in zip(starts, lengths, cut):
            skip[s + n - (2 * GAP if c else GAP) : s + n] = True
        return points, np.array(owner), starts, skip

    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text)), CHARS_AT_ONCE):
            more = at + CHARS_AT_ONCE < len(text)
            part = text[at : at + CHARS_AT_ONCE + (GAP if more else 0)]
            parts.append(part)
            owner.append(i)
            cut.append(more)
            size += len(part)
            if size >= CHARS_AT_ONCE:
                yield flush()
                parts, owner, cut, size = [], [], [], 0
    if parts:
        yield flush()


def ngram_buckets(points: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each place (the last ones read blanks)."""
    padded = np.concatenate([points, np.full(order - 1, 32, dtype="<u4")]) if order > 1 else points
    h = np.full(points.size, 0x9E3779B9 * order & 0xFFFFFFFF, dtype=np.uint32)
    for k in range(order):
        h = (h ^ padded[k : k + points.size]) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
    h *= np.uint32(0xC2B2AE35)
    return h >> np.uint32(32 - bits)

