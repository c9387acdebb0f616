"""Benchmark decontamination: a distributed positional inverted index of training tokens.

Records are texts keyed by ``source_id``; test items are (item_id, text).  The project has no benchmark records, so the
operator stays general.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from ..session import scratch_path

WINDOW = 10
SIEVE_BITS = 22
PAIR_BITS = 24
# bytes of words stay (A-Z folded to lower case); all others separate
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def word_codes(words: list[bytes]) -> np.ndarray:
    """crc32 of each word."""
    return np.fromiter(map(zlib.crc32, words), dtype=np.int64, count=len(words))


def word_array(text: Column) -> Column:
    """The same words in built-in functions, for the test items."""
    folded = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(folded, SPLIT), lambda w: w != "")


def test_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, text) to (item_id, at, words): ``window`` consecutive words, or all words of a shorter item."""
    ws = items.select("item_id", word_array(F.col("text")).alias("all")).where(F.size("all") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("all") - window, F.lit(0)))
    return ws.select("item_id", F.explode(starts).alias("at"), "all").select("item_id", "at", F.slice("all", F.col("at") + 1, F.lit(window)).alias("words"))


def sieve(terms: DataFrame, bits: int = SIEVE_BITS) -> bytes:
    """A table of 2**bits flags, set for the hashes of ``term``: of fixed size, whatever the number of terms."""
    flags = bytearray(1 << bits)
    slots = terms.select((F.crc32(F.col("term").cast("binary")) % (1 << bits)).cast("int").alias("s")).distinct()
    for row in slots.toLocalIterator():
        flags[row[0]] = 1
    return bytes(flags)


def term_counts(records: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): occurrences of each test term in all records, 0 if there is none. Counts are summed per task first."""
    shared = records.sparkSession.sparkContext.broadcast(sieve(terms))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flags, mask, totals = np.frombuffer(shared.value, np.uint8), (1 << SIEVE_BITS) - 1, Counter()
        for batch in batches:
            for text in batch["text"]:
                words = words_of(text)
                totals.update([words[i] for i in np.flatnonzero(flags[word_codes(words) & mask]).tolist()])
        if totals:
            yield pd.DataFrame({"term": [w.decode("utf-8", "replace") for w in totals], "n": list(totals.values())})

    sums = records.select("text").mapInPandas(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return terms.join(sums, "term", "left").select("term", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def least_table(led: DataFrame) -> bytes:
    """2**SIEVE_BITS bytes by hash of a posted term: 0 if there is none, else the smallest ``need`` of its windows."""
    least = bytearray(1 << SIEVE_BITS)
    slots = led.groupBy((F.crc32(F.col("term").cast("binary")) % (1 << SIEVE_BITS)).cast("int").alias("s")).agg(F.min("need").alias("need"))
    for row in slots.toLocalIterator():
        least[row[0]] = min(255, max(1, row[1]))
    return bytes(least)


def build_index(records: DataFrame, led: DataFrame, reach: int, path: str) -> DataFrame:
    """Action: writes the positional index of ``led`` (term, words, need) over (source_id, row_key, text): one row a record.

    ``postings`` holds (term, position, before, around): the words within ``reach`` of the position travel with it, so other
    terms' lists are intersected at their offset without reading these (possibly very long) lists.  A place is posted if at least
    ``need`` different words around it stand in a window that its term leads; two tables of fixed size tell, and their
    collisions only post more.
    """
    context = records.sparkSession.sparkContext
    together = led.select("term", F.explode(F.array_distinct("words")).alias("other")).select(F.concat_ws(" ", "term", "other").alias("term"))
    shared = context.broadcast((least_table(led), sieve(together, PAIR_BITS)))
    posting = T.StructType([
        T.StructField("term", T.StringType()), T.StructField("position", T.LongType()), T.StructField("before", T.IntegerType()),
        T.StructField("around", T.ArrayType(T.StringType())),
    ])
    schema = T.StructType([
        T.StructField("source_id", records.schema["source_id"].dataType), T.StructField("row_key", T.LongType()), T.StructField("n_words", T.LongType()),
        T.StructField("postings", T.ArrayType(posting)),
    ])

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (least, pairs), mask, pair_mask, crc32 = shared.value, (1 << SIEVE_BITS) - 1, (1 << PAIR_BITS) - 1, zlib.crc32
        table = np.frombuffer(least, np.uint8)
        for batch in batches:
            sizes, lists = [], []
            for text in batch["text"]:
                words, posted = words_of(text), []
                codes = word_codes(words)
                needs = table[codes & mask]
                led = np.flatnonzero(needs)
                for i, need, code in zip(led.tolist(), needs[led].tolist(), codes[led].tolist()):
                    w = words[i]
                    around, code = words[max(0, i - reach) : i + reach + 1], crc32(b" ", code)
                    if need > 1 and sum([pairs[crc32(x, code) & pair_mask] for x in set(around)]) < need:
                        continue
                    posted.append({
                        "term": w.decode("utf-8", "replace"), "position": i, "before": min(i, reach), "around": [x.decode("utf-8", "replace") for x in around],
                    })
                lists.append(posted)
                sizes.append(len(words))
            yield pd.DataFrame({"source_id": batch["source_id"], "row_key": batch["row_key"], "n_words": sizes, "postings": lists})

    records.select("source_id", "row_key", "text").mapInPandas(post, schema).write.parquet(path)
    return records.sparkSession.read.parquet(path)


def find_contamination(records: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 2, near_share: float = 0.8) -> DataFrame:
    """(source_id, text) and (item_id, text) to one row per record: ``n_words``, ``n_hit`` (words inside an exact window),
    ``item_ids`` (sorted array of items with exact windows), ``near_items`` (items with proximity matches only) and ``contaminated``.

    Method: positional inverted index.  (1) Count the test terms over all records.  (2) Each window is led by as many of its
    rarest places as a proximity match cannot miss all (three of ten at 0.8); leading terms are posted, each posting with the words
    around it, and the index is written under ``spark.checkpoint.dir``.  (3) Windows meet postings in a join on the leading
    term; the lists of the other terms are intersected at their offsets.  All offsets equal: exact phrase.  At least
    ``near_share`` of the terms within ``slop`` words of their place, wherever the window is laid: proximity match.  The test side
    enters tasks as tables of fixed size (2**22 and 2**24) only; the join itself is a shuffle join with skew handling, or a
    broadcast if the measured size allows.

    Null texts have no words.  Rows that share source_id and text get equal results; rows with one source_id and different
    texts are told apart; null ids are kept.  Null item ids count as an item named null, left out of ``item_ids``.  Items
    without words never match; an empty table on either side gives rows without hits or no rows.  Other columns are ignored.
    """
    spark = records.sparkSession
    rows = records.select("source_id", "text").withColumn("row_key", F.xxhash64("source_id", "text"))
    windows_path = scratch_path(spark, "test-windows")
    test_windows(items, window).withColumn("window_id", F.xxhash64("item_id", "at", "words")).write.parquet(windows_path)
    windows = spark.read.parquet(windows_path)
    placed = windows.select("window_id", F.posexplode("words").alias("offset", "term"))
    counts = term_counts(rows, placed.select("term").distinct())
    rarest = F.sort_array(F.collect_list(F.struct("n", "term", "offset")))
    # of so many places one is among any ``near_share`` of the window; terms that no record has cannot be met
    fewest = F.ceil(near_share * F.size("places")).cast("int")
    posted = F.least(F.size("places") - fewest + 1, F.size("places"))
    lead = (
        placed.join(counts, "term").groupBy("window_id").agg(rarest.alias("places"))
        .select("window_id", (F.size("places") - fewest).alias("spare"), F.explode(F.slice("places", 1, posted)).alias("lead")).where(F.col("lead.n") > 0)
    )
    led_path = scratch_path(spark, "test-leads")
    (
        windows.dropDuplicates(["window_id"]).join(lead, "window_id")
        .select(
            "item_id", "at", "words", F.col("lead.term").alias("term"), F.col("lead.offset").alias("offset"),
            (F.size(F.array_distinct("words")) - F.col("spare")).alias("need"),
        ).write.parquet(led_path)
    )
    led = spark.read.parquet(led_path)
    index = build_index(rows, led, window - 1 + 2 * slop, scratch_path(spark, "token-index"))
    postings = index.where(F.size("postings") > 0).select("row_key", F.explode("postings").alias("p")).select("row_key", "p.*")
    met = postings.join(led, "term").where(F.size(F.array_intersect("around", "words")) >= F.col("need"))
    first = F.col("before") - F.col("offset")  # place in ``around`` at which the window would start
    exact = (first >= 0) & (F.slice("around", F.greatest(first, F.lit(0)) + 1, F.size("words")) == F.col("words"))

    def near_at(shift):
        at = first + shift
        held = F.transform("words", lambda w, j: F.array_contains(F.slice("around", F.greatest(at + j - slop, F.lit(0)) + 1, F.greatest(F.least(F.lit(2 * slop + 1), at + j + slop + 1), F.lit(0))), w))
        return F.size(F.filter(held, lambda x: x)) >= near_share * F.size("words")

    # the posted term may itself be up to ``slop`` words off its place
    near = F.when(exact, F.lit(True)).otherwise(F.exists(F.array(*map(F.lit, sorted(range(-slop, slop + 1), key=abs))), near_at))
    judged = met.select(
        "row_key", "item_id", (F.col("position") - F.col("offset")).alias("start"), F.size("words").alias("length"), exact.alias("exact"),
        near.alias("near"),
    ).where(F.col("exact") | F.col("near"))
    spans = judged.where("exact").groupBy("row_key", "start").agg(F.max("length").alias("length"))
    reach = Window.partitionBy("row_key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    hit = (
        spans.withColumn("end", F.col("start") + F.col("length")).withColumn("covered", F.coalesce(F.max("end").over(reach), F.lit(0)))
        .groupBy("row_key").agg(F.sum(F.greatest(F.col("end") - F.greatest("start", "covered"), F.lit(0))).alias("n_hit"))
    )
    per_item = judged.groupBy("row_key", "item_id").agg(F.max("exact").alias("exact"))
    named = per_item.groupBy("row_key").agg(
        F.sort_array(F.collect_list(F.when(F.col("exact"), F.col("item_id").cast("string")))).alias("item_ids"),
        F.sort_array(F.collect_list(F.when(~F.col("exact"), F.col("item_id").cast("string")))).alias("near_items"),
    )
    none = F.array().cast("array<string>")
    found = hit.join(named, "row_key", "full")
    return index.select("source_id", "row_key", "n_words").join(found, "row_key", "left").select(
        "source_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("near_items", none).alias("near_items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
