"""MinHash near-duplicates by a signature-coordinate inverted join.

Records are texts keyed by ``source_id``.  The project's image records have no text; captions or reports beside them, or any
other (source_id, text) table, serve.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from .decontamination import sieve
from .graph import connected_components

COORDINATES = 48
SPREAD = 4.9  # standard deviations below the expected number of agreeing coordinates at which a pair is given up
BYTES_AT_ONCE = 1 << 20

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_K = [np.uint64(k) for k in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """p**j and p**-j modulo 2**64 for j < n."""
    if _powers[0].size < n:
        for k, base in enumerate((_P, _P_INVERSE)):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def _coordinates(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240131)
    return rng.integers(0, 1 << 63, n, dtype=np.uint64), rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[str | None], shingle: int) -> Iterator[list[np.ndarray]]:
    """Per text the sorted distinct 64-bit hashes of its shingles, a group of texts at a time; whole texts, vectorised.

    A-Z folds to lower case and blanks are U+0020 and U+0009-U+000D, both on UTF-8 bytes.  A word's hash is a difference of
    prefix sums of a polynomial over the group's bytes.
    """
    group: list[bytes] = []
    size = 0
    for text in texts:
        raw = text.encode("utf-8", "surrogatepass").lower() if text else b""
        if group and size + len(raw) > BYTES_AT_ONCE:
            yield _group_sets(group, shingle)
            group, size = [], 0
        group.append(raw)
        size += len(raw) + 1
    if group:
        yield _group_sets(group, shingle)


def _group_sets(group: list[bytes], shingle: int) -> list[np.ndarray]:
    data = np.frombuffer(b" ".join(group) + b" ", dtype=np.uint8)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.diff(np.concatenate([[0], solid.astype(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _power_tables(data.size)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, dtype=np.uint64)])
    word = (sums[last] - sums[first]) * inverse[first]
    word ^= word >> np.uint64(31)
    word = (word + (last - first).astype(np.uint64)) * _K[0]
    word ^= word >> np.uint64(29)
    # words of text d are those from at[d] to at[d + 1]
    ends = np.cumsum([len(g) + 1 for g in group])
    at = np.concatenate([[0], np.searchsorted(first, ends)])

    def chain(length: int) -> np.ndarray:
        n = word.size - length + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        x = np.full(n, np.uint64(length * int(_K[1]) % (1 << 64)))
        for k in range(length):
            x = (x ^ word[k : k + n]) * _K[1]
            x ^= x >> np.uint64(32)
            x = (x + np.uint64(k + 1)) * _K[2]
            x ^= x >> np.uint64(29)
        return x

    full = chain(shingle)
    short = {n: chain(n) for n in range(1, shingle)}
    out = []
    for a, b in zip(at, at[1:]):
        n = b - a
        if n >= shingle:
            out.append(np.unique(full[a : b - shingle + 1]))
        else:
            out.append(short[n][a : a + 1] if n else np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], coordinates: int = COORDINATES) -> np.ndarray:
    """Row per non-empty set: the minimum of each coordinate's hash, with the coordinate's number in the low bits."""
    xor, mul = _coordinates(coordinates)
    full = [s for s in sets if s.size]
    out = np.zeros((len(full), coordinates), dtype=np.int64)
    if full:
        values = np.concatenate(full)
        starts = np.concatenate([[0], np.cumsum([s.size for s in full])[:-1]])
        low = np.uint64(255)
        for k in range(coordinates):
            least = np.minimum.reduceat((values ^ xor[k]) * mul[k], starts)
            out[:, k] = ((least & ~low) | np.uint64(k)).view(np.int64)
    return out


def sketch(records: DataFrame, shingle: int, coordinates: int) -> DataFrame:
    """(source_id, n_shingles, set_key, signature); set_key is a 128-bit digest of the whole set, null for an empty one."""
    schema = T.StructType([
        T.StructField("source_id", records.schema["source_id"].dataType), T.StructField("n_shingles", T.LongType()),
        T.StructField("set_key", T.BinaryType()), T.StructField("signature", T.ArrayType(T.LongType())),
    ])

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = 0
            for sets in shingle_sets(batch["text"].tolist(), shingle):
                rows = iter(signatures(sets, coordinates))
                yield pd.DataFrame({
                    "source_id": batch["source_id"].iloc[at : at + len(sets)].reset_index(drop=True), "n_shingles": [s.size for s in sets],
                    "set_key": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if s.size else None for s in sets],
                    "signature": pd.Series([next(rows) if s.size else None for s in sets], dtype=object),
                })
                at += len(sets)

    return records.select("source_id", "text").mapInPandas(make, schema)


def full_sets(records: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(class_no, shingles) for the classes in ``wanted`` (class_no, set_key), from the texts again.

    Rows whose digest cannot be wanted are left out by a flag table of fixed size before anything is shuffled.
    """
    from zlib import crc32

    shared = records.sparkSession.sparkContext.broadcast(sieve(wanted.select(F.hex("set_key").alias("term"))))
    mask = (1 << 22) - 1

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[bytes] = set()
        for batch in batches:
            for sets in shingle_sets(batch["text"].tolist(), shingle):
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                take = []
                for i, k in enumerate(keys):
                    if sets[i].size and k not in seen and shared.value[crc32(k.hex().upper().encode()) & mask]:
                        take.append(i)
                        if len(seen) < 100_000:  # copies within a task need to be sent once only
                            seen.add(k)
                if take:
                    yield pd.DataFrame({"set_key": [keys[i] for i in take], "shingles": [sets[i].view(np.int64) for i in take]})

    sets = records.select("text").mapInPandas(make, "set_key binary, shingles array<bigint>")
    return wanted.join(sets, "set_key").groupBy("class_no").agg(F.first("shingles").alias("shingles"))


def positional_pairs(members: DataFrame, percent: int) -> DataFrame:
    """(class_no, component, shingles) to the pairs (a, b) of different components that may reach the similarity.

    Exact prefix and position rules on the full sets: in the order of frequency, a linked pair shares one of the first
    n - ceil(n * percent / 100) + 1 shingles of both, and what is left behind that place must hold the rest of the overlap.
    A text with many shingles of its own has them in front, so it pairs with nothing, however large its list is.
    """
    each = members.select("class_no", "component", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    df = each.groupBy("s").agg(F.count(F.lit(1)).alias("df"))
    ordered = each.join(df, "s").groupBy("class_no").agg(
        F.first("component").alias("component"), F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "s"))).alias("ts")
    )
    front = F.slice("ts", F.lit(1), F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1)
    posted = ordered.select("class_no", "component", "n", F.posexplode(front).alias("k", "t")).where("t.df > 1")
    left = posted.select(F.col("t.s").alias("s"), F.col("class_no").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"), F.col("k").alias("ka"))
    right = posted.select(F.col("t.s").alias("s"), F.col("class_no").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("k").alias("kb"))
    room = F.least(F.col("na") - F.col("ka"), F.col("nb") - F.col("kb")) * (100 + percent) >= percent * (F.col("na") + F.col("nb"))
    rule = (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & room
    return left.join(right, (left["s"] == right["s"]) & rule).select("a", "b").distinct()


def near_duplicates(
    records: DataFrame, shingle: int = 5, percent: int = 80, coordinates: int = COORDINATES, matches: int | None = None,
) -> DataFrame:
    """(source_id, text) to one row per record: ``n_shingles``, ``component_id``, ``n_links`` and ``kept``.

    Texts are linked when 100 * |intersection| >= ``percent`` * |union| of their distinct word shingles; component_id is the
    smallest source_id that can be reached.

    Method: signature-coordinate inverted join.  Texts with equal shingle sets form one class.  A class is posted under its
    (coordinate, minimum) pairs; pairs that one class only holds are skipped; the others are put in order of frequency and a
    class is posted under the rarest ``coordinates - matches + 1`` only (two classes that agree on ``matches`` coordinates must
    meet there, so frequent passages rarely pair anything).  Lists merge around leaders: every member meets three leaders of its
    list; agreeing coordinates are counted, pairs below ``matches`` dropped, and the rest confirmed on the full sets.  Members that
    a component already joins are skipped; only members of one list in different components meet in a second merge, under
    prefix and position rules on their full sets, so no group is expanded into all its pairs.

    Links between classes agreeing on fewer coordinates than ``matches`` are lost; the default lies 4.9 standard deviations below
    the expected number at ``percent`` (28 of 48 at 85, 24 at 80), about one link in a million right at the threshold and fewer
    above.  Shingles are compared by 64-bit hashes.

    Texts without words have no shingles and link with nothing: their component is their own id.  Fewer words than a shingle
    make one shingle of all.  Null ids: a class takes the smallest id that is not null; null if there is none, and such rows are
    kept only without a component id of others.  Rows that share an id share its verdict.  Other columns are ignored.
    ``n_links`` counts the confirmed links of the record's class.
    """
    spark = records.sparkSession
    if matches is None:
        share = percent / 100
        matches = max(1, int(coordinates * share - SPREAD * math.sqrt(coordinates * share * (1 - share))))
    keep = lambda frame, name: (frame.write.parquet(p := scratch_path(spark, name)), spark.read.parquet(p))[1]
    sketches = keep(sketch(records, shingle, coordinates), "sketches")
    classes = keep(
        sketches.where(F.col("set_key").isNotNull()).groupBy("set_key")
        .agg(F.min("source_id").alias("rep"), F.min("n_shingles").alias("n"), F.first("signature").alias("signature"))
        .withColumn("class_no", F.monotonically_increasing_id()),
        "classes",
    )
    posts = classes.select("class_no", F.explode("signature").alias("token"))
    shared = posts.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    frequent = posts.join(shared, "token").groupBy("class_no").agg(F.collect_list(F.struct("df", "token")).alias("ts")).where(F.size("ts") >= matches)
    prefix = keep(
        frequent.select(
            "class_no", F.aggregate("ts", F.lit(0.0), lambda a, t: a + F.log(t["df"].cast("double"))).alias("centre"),
            F.explode(F.slice(F.array_sort("ts"), F.lit(1), F.size("ts") - (matches - 1))).alias("t"),
        ).select(F.col("t.token").alias("token"), "class_no", "centre"),
        "prefixes",
    )
    leaders = prefix.groupBy("token").agg(
        F.max(F.struct("centre", "class_no")).getField("class_no").alias("l0"), F.min("class_no").alias("l1"), F.max("class_no").alias("l2")
    ).where("l1 < l2")
    led = prefix.select("token", "class_no").join(leaders, "token").select("class_no", F.explode(F.array_distinct(F.array("l0", "l1", "l2"))).alias("other"))
    first = led.where("class_no <> other").select(F.least("class_no", "other").alias("a"), F.greatest("class_no", "other").alias("b")).distinct()

    def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Pairs whose full sets are similar enough."""
        both = pairs.join(sets.select(F.col("class_no").alias("a"), F.col("shingles").alias("xa")), "a").join(
            sets.select(F.col("class_no").alias("b"), F.col("shingles").alias("xb")), "b"
        )
        common = F.size(F.array_intersect("xa", "xb"))
        sized = both.select("a", "b", common.alias("i"), (F.size("xa") + F.size("xb") - common).alias("u"))
        return keep(sized.where(100 * F.col("i") >= percent * F.col("u")).select("a", "b"), "links")

    def sets_of(wanted: DataFrame) -> DataFrame:
        return keep(full_sets(records, wanted.join(classes.select("class_no", "set_key"), "class_no"), shingle), "shingle-sets")

    sig = classes.select("class_no", "signature", "n")
    side = lambda c: sig.select(F.col("class_no").alias(c), F.col("signature").alias(f"s{c}"), F.col("n").alias(f"n{c}"))
    agree = F.size(F.array_intersect("sa", "sb")) >= matches
    fits = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    close = keep(first.join(side("a"), "a").join(side("b"), "b").where(fits & agree).select("a", "b"), "close-pairs")
    links = linked(close, sets_of(close.select(F.explode(F.array("a", "b")).alias("class_no")).distinct()))
    joined = connected_components(links)
    # members of one list that are still apart: what a leader could not tell
    placed = prefix.select("token", "class_no").join(joined.select(F.col("node").alias("class_no"), "component"), "class_no", "left").select(
        "token", "class_no", F.coalesce("component", "class_no").alias("component")
    )
    apart = placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
    loose = keep(placed.join(apart, "token").select("class_no", "component").distinct(), "loose")
    if not loose.isEmpty():
        sets = sets_of(loose.select("class_no"))
        second = keep(positional_pairs(sets.join(loose, "class_no"), percent), "second-pairs")
        if not second.isEmpty():
            links = keep(links.union(linked(second, sets)).distinct(), "all-links")
            joined = connected_components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("class_no")).groupBy("class_no").agg(F.count(F.lit(1)).alias("n_links"))
    member = (
        classes.select("class_no", "set_key", "rep").join(joined.withColumnRenamed("node", "class_no"), "class_no", "left")
        .join(degree, "class_no", "left").withColumn("component", F.coalesce("component", "class_no"))
    )
    smallest = member.groupBy("component").agg(F.min("rep").alias("component_id"))
    table = keep(member.join(smallest, "component").select("set_key", "component_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "members")
    found = sketches.select("source_id", "n_shingles", "set_key").join(table, "set_key", "left")
    component = F.when(F.col("set_key").isNull(), F.col("source_id")).otherwise(F.col("component_id"))
    return found.select(
        "source_id", "n_shingles", component.alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.col("source_id").eqNullSafe(component).alias("kept"),
    )
