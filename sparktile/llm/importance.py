"""Target-distribution importance resampling: array-scored weights and a distributed quickselect.

Image records are drawn so that what is written on or about them looks like a target set: features are the class names of an
image's annotations (an array column, one item an annotation), or the words of a text that accompanies it.  Each feature falls
into a hashed bucket; a bucket's gain compares its share in the target with its share in the records.  A record's weight is the
sum of its gains, and weight plus a Gumbel draw from its id gives a sample without replacement when the highest scores are taken.

The k-th best score is found without a sort: random pivot keys cut the range, one aggregate counts keys between and at the
pivots, and only the range that holds the k-th key is looked at again.  The winners alone are sorted and ranked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ranking import ordered_index
from ..session import scratch_path
from .decontamination import words_of

BUCKETS = 10_000
SLICE = 1 << 20
PIVOTS = 15
# A-Z are folded and these separate words, as in decontamination
_GAPS = frozenset(c for c in range(128) if not chr(c).isalnum())


def _slices(text: str) -> Iterator[list[bytes]]:
    """A text's words, a bounded number at a time."""
    at = 0
    while at < len(text):
        end = at + SLICE
        while end < len(text) and ord(text[end]) not in _GAPS:
            end += 1
        yield words_of(text[at:end])
        at = end


def feature_buckets(value, buckets: int, longest: int) -> tuple[int, np.ndarray]:
    """(number of words, bucket of every run of 1 to ``longest`` consecutive words) of a text or of an array's items."""
    if value is None:
        return 0, np.zeros(0, dtype=np.int64)
    lists = _slices(value) if isinstance(value, str) else [[str(x).encode("utf-8", "surrogatepass") for x in value if x is not None]]
    n, codes, carried = 0, [], []
    for words in lists:
        n += len(words)
        codes.append(np.fromiter(map(crc32, words), dtype=np.int64, count=len(words)))
        joined = carried + words
        for size in range(2, longest + 1):
            # runs that end in this slice; those that ended before are counted
            first = max(0, len(carried) - size + 1)
            runs = zip(*[joined[first + k :] for k in range(size)])
            codes.append(np.array([crc32(b" ".join(r)) for r in runs], dtype=np.int64))
        carried = joined[len(joined) - longest + 1 :] if longest > 1 else []
    return n, np.concatenate([np.zeros(0, np.int64), *codes]) % buckets


def bucket_counts(records: DataFrame, features: str, buckets: int, longest: int) -> DataFrame:
    """(bucket, n) over all records: one array a task, then at most ``buckets`` sums."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for value in batch.column("value"):
                total += np.bincount(feature_buckets(value.as_py(), buckets, longest)[1], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int64)), pa.array(total[held])], names=["bucket", "n"])

    values = records.select(F.col(features).alias("value"))
    return values.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(records: DataFrame, target: DataFrame, features: str, target_features: str, buckets: int, longest: int) -> np.ndarray:
    """Action: floor(1000 * ln(((t + 1) / (T + buckets)) / ((s + 1) / (S + buckets)))) per bucket, an array of ``buckets`` integers.

    The two count tables that the driver reads have ``buckets`` rows at most.
    """
    dense = []
    for frame, column in ((records, features), (target, target_features)):
        counts = np.zeros(buckets)
        for row in bucket_counts(frame, column, buckets, longest).collect():
            counts[row.bucket] = row.n
        dense.append(counts)
    s, t = dense
    return np.floor(1000 * np.log(((t + 1) * (s.sum() + buckets)) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def gumbel(source_id: Column, seed: int) -> Column:
    """floor(-1000 * ln(-ln(u))) with u from the first 32 bits of sha256('seed:id'); a null id counts as ''."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(source_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _bounded(key: Column, names: list[str], types: dict, low, high) -> Column:
    inside = F.lit(True)
    if low is not None:
        inside = inside & (F.col(names[0]) >= low[0]) & (key > literal(low, names, types))
    if high is not None:
        inside = inside & (F.col(names[0]) <= high[0]) & (key < literal(high, names, types))
    return inside


def literal(values, names: list[str], types: dict) -> Column:
    return F.struct(*[F.lit(v).cast(types[n]).alias(n) for n, v in zip(names, values)])


def kth_key(keyed: DataFrame, names: list[str], k: int, seed: int = 0, pivots: int = PIVOTS) -> tuple | None:
    """Action: the ``k``-th smallest key (from 1; columns ``names`` in order, the first one never null), None if there are fewer.

    Each round draws ``pivots`` keys of the range by a seeded hash and counts, in one aggregate with map-side sums, the keys
    between and at them: exact three-way partitions.  A round leaves about 1 / ``pivots`` of the range, and a key at a pivot
    ends or leaves it, so any number of equal keys ends too.  The driver sees the pivots and 2 * ``pivots`` + 1 counts.
    """
    types = {n: keyed.schema[n].dataType for n in names}
    key = F.struct(*names)
    low = high = None
    before, turn = 0, 0
    while True:
        inside = keyed.select(*names).where(_bounded(key, names, types, low, high))
        drawn = inside.orderBy(F.xxhash64(*names, F.lit(seed + turn))).limit(pivots)
        chosen = [tuple(r) for r in drawn.distinct().orderBy(*names).collect()]
        if not chosen:
            return None
        places = [literal(p, names, types) for p in chosen]
        place = sum(((key >= p).cast("int") + (key > p).cast("int") for p in places), F.lit(0))
        counts = dict(inside.groupBy(place.alias("place")).count().collect())
        for at in range(2 * len(chosen) + 1):
            if before + counts.get(at, 0) >= k:
                break
            before += counts.get(at, 0)
        else:
            return None
        if at % 2:
            return chosen[at // 2]
        low = chosen[at // 2 - 1] if at else low
        high = chosen[at // 2] if at // 2 < len(chosen) else high
        turn += 1


def resample(
    records: DataFrame, target: DataFrame, features: str = "labels", target_features: str | None = None, percent: int = 10, least: int = 20,
    buckets: int = BUCKETS, longest: int = 1, seed: int = 2024,
) -> DataFrame:
    """(source_id, ``features``) and a target with ``target_features`` to one row a record: ``source_id``, ``n_features``,
    ``weight``, ``score`` and ``rank``.

    ``features`` is an array of class names (each item one word, as it is) or a text (A-Z folded, words of letters, digits and
    characters beyond ASCII).  Of the records with at least ``least`` words, ``percent`` of a hundred (rounded down) with the
    highest scores are drawn and ranked from 1; ties go to the smaller source_id, null last.  ``rank`` is null for the others.

    Action: counts, scores and the selection run while the frame is built; scores are written under ``spark.checkpoint.dir``.
    No shuffle holds texts, and the array of gains has ``buckets`` numbers.

    A null or empty value has no features and weight 0; null items are left out.  Rows that share an id have the same draw but
    each their own weight; wholly equal rows are interchangeable, and as many of them are drawn as fit the number.  An empty
    target gives weights that prefer rare features; no records give no rows.  Other columns are ignored.
    """
    spark = records.sparkSession
    gains = spark.sparkContext.broadcast(bucket_gains(records, target, features, target_features or features, buckets, longest))
    schema = T.StructType([records.schema["source_id"], *[T.StructField(n, T.LongType()) for n in ("tie", "n_words", "n_features", "weight")]])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column("value"):
                n, places = feature_buckets(value.as_py(), buckets, longest)
                out.append((n, places.size, int(gains.value[places].sum())))
            columns = [pa.array(c, type=pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column("source_id"), batch.column("tie"), *columns], names=schema.names)

    rows = records.select("source_id", F.xxhash64(features).alias("tie"), F.col(features).alias("value"))
    path = scratch_path(spark, "importance-scores")
    score = (F.col("weight") + gumbel(F.col("source_id"), seed)).cast("long")
    rows.mapInArrow(weigh, schema).withColumn("score", score).write.parquet(path)
    scored = spark.read.parquet(path).withColumns({"worse": -F.col("score"), "absent": F.col("source_id").isNull().cast("int")})
    names = ["worse", "absent", "source_id", "tie"]
    may_win = F.col("n_words") >= least
    k = math.floor(percent * scored.where(may_win).count() / 100)
    last = kth_key(scored.where(may_win), names, k, seed) if k else None
    out = ["source_id", "n_features", "weight", "score"]
    if last is None:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    wins = may_win & (F.struct(*names) <= literal(last, names, {n: scored.schema[n].dataType for n in names}))
    ranked = ordered_index(scored.where(wins), names, "before")
    place = F.when(F.col("before") < k, F.col("before") + 1).cast("long")  # rows equal to the last one may be one too many
    return scored.where(~wins).select(*out, F.lit(None).cast("long").alias("rank")).unionByName(ranked.select(*out, place.alias("rank")))
