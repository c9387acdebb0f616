"""Mixing batches to target weights with hash thresholds, without a sort.

A batch is the export folder an image record comes from; its size may be a number of tiles, foreground pixels or words.
The operator takes any (source_id, batch, size) records of the project, texts included.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import scratch_path

WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS = 60
LEVEL_BITS = 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(key: Column) -> Column:
    """60 bits of the md5 of the key's text: the same in every engine, independent of partitioning. Null keys hash as ''."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def batch_targets(sizes: DataFrame, weights: Sequence[float], share: float = 1.0, most: float = 3.0) -> DataFrame:
    """(batch, batch_size) to (batch, batch_size, weight, target): one row a batch.

    Batches in code-point order, null last, take ``weights`` in turn.  Targets share ``share`` of all sizes by weight; a
    target stops at ``most`` times its batch's size and the excess is shared again by weight until none is above.  That end
    point has a closed form: in ascending order of cap / weight, batches are capped while the level that the rest would get
    exceeds their ratio.  The window over batches has one row for each distinct batch.
    """
    by_name = Window.orderBy(F.col("batch").asc_nulls_last())
    given = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("weight", F.element_at(given, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", F.col("batch").asc_nulls_last())
    levels = (
        ranked.withColumn("cap", most * F.col("batch_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("budget", share * F.sum("batch_size").over(everything))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.col("budget") - F.col("cap_before")) / F.col("weight_left"))
    )
    # the first batch in this order that is not above its cap sets the level of all that follow
    free = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)
    return levels.withColumn("free", free).select(
        "batch", "batch_size", "weight",
        F.when(F.col("free").isNull() | (F.col("ratio") < F.col("free.ratio")), F.col("cap")).otherwise(F.col("weight") * F.col("free.level")).alias("target"),
    )


def nested_thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """(batch, size, hash) and (batch, rest) to (batch, threshold): rows with hash <= threshold sum to about ``rest``.

    Each level sums sizes by batch and bucket of the hash, takes the buckets that fit whole, and looks again only into the
    bucket on the boundary, ``LEVEL_BITS`` at a time, down to single hash values.  The rows of the last value go in when that
    comes nearer to the budget.  Every level is one aggregation with map-side sums; no rows are sorted or moved.  The state
    between levels has one row a batch and is written out, so that plans do not nest.
    """
    spark = sized.sparkSession
    state = budgets.select("batch", F.lit(0).cast("long").alias("prefix"), F.col("rest").alias("left"))
    for used in range(0, HASH_BITS, LEVEL_BITS):
        shift = HASH_BITS - used
        inside = sized if used == 0 else sized.join(
            state.select(F.col("batch").alias("b"), F.col("prefix").alias("p")),
            F.col("batch").eqNullSafe(F.col("b")) & (F.shiftright("hash", shift) == F.col("p")),
        )
        bucket = F.shiftright("hash", shift - LEVEL_BITS)
        sums = inside.groupBy("batch", bucket.alias("bucket")).agg(F.sum("size").alias("s"))
        running = Window.partitionBy("batch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        totals = sums.withColumn("upto", F.sum("s").over(running))
        keyed = totals.join(state.select(F.col("batch").alias("b"), "prefix", "left"), F.col("batch").eqNullSafe(F.col("b")))
        over = keyed.where(F.col("upto") > F.col("left"))
        edge = over.groupBy("batch").agg(F.min(F.struct("bucket", "s", "upto", "left")).alias("e"))
        found = edge.select(
            F.col("batch").alias("eb"), F.col("e.bucket").alias("eprefix"), (F.col("e.left") - (F.col("e.upto") - F.col("e.s"))).alias("eleft"), F.col("e.s").alias("es")
        )
        last = used + LEVEL_BITS == HASH_BITS
        base = state.join(found, F.col("batch").eqNullSafe(F.col("eb")), "left")
        # no bucket is over the budget: everything below the end of the prefix goes in
        top = F.shiftleft(F.col("prefix") + 1, LEVEL_BITS) - 1 if used else F.lit((1 << LEVEL_BITS) - 1).cast("long")
        state = base.select(
            "batch",
            F.when(F.col("eprefix").isNull(), top)
            .when(F.lit(last), F.col("eprefix") - F.when(2 * F.col("eleft") >= F.col("es"), 0).otherwise(1))
            .otherwise(F.col("eprefix")).alias("prefix"),
            F.coalesce("eleft", F.lit(float("inf"))).alias("left"),
        )
        path = scratch_path(spark, f"mixing-level-{used}")
        state.write.parquet(path)
        state = spark.read.parquet(path)
    return state.select("batch", F.col("prefix").alias("threshold"))


def mixing_plan(records: DataFrame, weights: Sequence[float], share: float = 1.0, most: float = 3.0) -> DataFrame:
    """(source_id, batch, size) to one row a batch: batch, batch_size, target, whole (copies for all), threshold (one more up to it).

    Writes the narrow columns and the plan under ``spark.checkpoint.dir``.
    """
    spark = records.sparkSession
    keep = lambda frame, name: (frame.write.parquet(p := scratch_path(spark, name)), spark.read.parquet(p))[1]
    sized = keep(records.select("batch", counted(F.col("size")).alias("size"), unit_hash(F.col("source_id")).alias("hash")), "mixing-sizes")
    sizes = sized.groupBy("batch").agg(F.sum("size").alias("batch_size"))
    ratio = F.col("target") / F.when(F.col("batch_size") > 0, F.col("batch_size"))
    targets = keep(
        batch_targets(sizes, weights, share, most)
        .withColumn("whole", F.coalesce(F.floor(ratio), F.lit(0)))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("batch_size")),
        "mixing-targets",
    )
    # a target of whole times its batch leaves nothing for one more, not even for rows of size 0
    thresholds = nested_thresholds(sized, targets).select(F.col("batch").alias("tb"), "threshold")
    one_more = F.when(F.col("rest") > 0, F.col("threshold")).otherwise(F.lit(-1)).cast("long").alias("threshold")
    return keep(
        targets.join(thresholds, F.col("batch").eqNullSafe(F.col("tb"))).select("batch", "batch_size", "target", "whole", one_more), "mixing-plan"
    )


def counted(size: Column) -> Column:
    return F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0)).cast("long")


def with_copies(records: DataFrame, plan: DataFrame) -> DataFrame:
    """``records`` (source_id, batch and any columns) with the plan's batch_size and target and the row's ``copies``."""
    by_batch = plan.select(F.col("batch").alias("plan_batch"), "batch_size", "target", "whole", "threshold")
    copies = (F.col("whole") + F.when(unit_hash(F.col("source_id")) <= F.col("threshold"), 1).otherwise(0)).cast("long")
    joined = records.join(by_batch, F.col("batch").eqNullSafe(F.col("plan_batch")))
    return joined.withColumn("copies", copies).drop("plan_batch", "whole", "threshold")


def mix_batches(records: DataFrame, weights: Sequence[float], share: float = 1.0, most: float = 3.0) -> DataFrame:
    """(source_id, batch, size) to the same rows with ``batch_size``, ``target``, ``copies`` and ``taken`` = copies * size.

    Method: hash-threshold histograms.  A target that is k whole times its batch and a rest gives every row k copies; one more
    goes to rows whose hash is at most the batch's threshold, found by nested histograms.  The choice depends on ids alone, so
    reruns and other partitionings agree, and rows that share an id share their copies.

    The plan has one row a batch; Spark broadcasts it to the rows when its measured size allows and otherwise joins with skew
    handling.

    Null batch is a batch of its own, last in order; null or negative size counts as 0; null ids share one hash.  Empty input
    gives no rows.  A row never gets more than ceil(``most``) copies.  Other columns are ignored.
    """
    rows = records.select("source_id", "batch", counted(F.col("size")).alias("size"))
    return with_copies(rows, mixing_plan(rows, weights, share, most)).select(
        "source_id", "batch", "size", "batch_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )
