"""Exact consecutive row numbers over a whole table without a single-task window.

Rows are first laid into ordered buckets, each bucket is numbered on its own, and the (few)
bucket sizes become offsets. No task sees more than one bucket. ``ranged_index`` does so lazily;
``ordered_index`` writes a checkpoint first, for inputs that should be evaluated once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir

HEX_DIGITS = 3  # default: 16**3 = 4096 hash buckets
RANGE_DIGITS = 12  # default: 2**12 = 4096 ranges
FAN_OUT = 4  # ways of a step of the search for a range


def _offsets(counts: DataFrame) -> DataFrame:
    """Bucket sizes (one row per bucket, a fixed bound) to starting offsets."""
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))


def shuffled_index(df: DataFrame, keys: list[str], seed: int | str, name: str = "idx", digits: int = HEX_DIGITS) -> DataFrame:
    """0-based position of each row in the order of md5(seed:keys); ``keys`` must be unique.

    The order depends on seed and keys alone, so retries and repartitioning do not change it. ``digits`` sets the number
    of buckets, 16**digits: one task sorts rows / 16**digits rows, and the offsets have 16**digits rows (5 for 10**11 rows).
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    keyed = df.withColumn("_digest", digest).withColumn("_bucket", F.substring("_digest", 1, digits))
    offsets = _offsets(keyed.groupBy("_bucket").agg(F.count("*").alias("_n")))
    inside = Window.partitionBy("_bucket").orderBy("_digest", *keys)
    return (
        keyed.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, "_bucket")
        .withColumn(name, F.col("_base") + F.col("_rn") - 1)
        .drop("_digest", "_bucket", "_rn", "_base")
    )


def ordered_index(df: DataFrame, order: list[str], name: str = "idx") -> DataFrame:
    """0-based position of each row in the order of ``order``; ``order`` must be unique.

    The range-sorted rows are checkpointed to shared storage so that sizes and positions
    come from one and the same layout, even when an executor is lost in between.
    """
    shared_dir(df.sparkSession)
    laid = df.sort(*order).withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    laid = laid.withColumn("_bucket", F.shiftright("_at", 33))
    offsets = _offsets(laid.groupBy("_bucket").agg(F.count("*").alias("_n")))
    return (
        laid.join(F.broadcast(offsets), "_bucket")
        .withColumn(name, F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_at", "_bucket", "_base")
    )


def ranged_index(df: DataFrame, order: list[str], name: str = "idx", digits: int = RANGE_DIGITS) -> DataFrame:
    """0-based position of each row in the order of ``order`` (ascending, nulls first); ``order`` must be unique.

    Lazy: no job runs while the plan is built and nothing is written. One aggregation draws at most 2**digits keys, one of each
    bucket of hashed keys; in order they cut the table into ranges. A second aggregation counts the ranges, and rows are numbered
    inside theirs. Keys alone decide the range of a row, so retries and repartitioning do not change positions. One task sorts
    about rows / 2**digits rows; the draws and the counts have at most 2**digits + 1 rows (the bound of what is broadcast). The
    input is evaluated three times: write it to a table first where that is dear.
    """
    key = F.struct(*order)
    width = 1 << digits
    draws = df.groupBy(F.pmod(F.xxhash64(*order), F.lit(width)).alias("_h")).agg(F.min_by(key, F.xxhash64(F.lit(1), *order)).alias("_c"))
    cuts = draws.agg(F.array_sort(F.collect_list("_c"))).scalar()
    laid = df.withColumns({"_cuts": cuts, "_bucket": F.lit(0)})
    for part in (FAN_OUT**level for level in range(digits // 2, -1, -1)):
        # search for the number of smaller cuts, in generated code; get() gives null beyond the last
        smaller = lambda n: F.get("_cuts", F.col("_bucket") + (n * part - 1)) < key  # noqa: B023, E731
        jump = F.when(smaller(FAN_OUT - 1), (FAN_OUT - 1) * part)
        for n in range(FAN_OUT - 2, 0, -1):
            jump = jump.when(smaller(n), n * part)
        laid = laid.withColumn("_bucket", F.col("_bucket") + jump.otherwise(0))
    laid = laid.drop("_cuts")
    offsets = _offsets(laid.groupBy("_bucket").agg(F.count("*").alias("_n")))
    inside = Window.partitionBy("_bucket").orderBy(*order)
    return (
        laid.withColumn("_rn", F.row_number().over(inside))
        .join(F.broadcast(offsets), "_bucket")
        .withColumn(name, F.col("_base") + F.col("_rn") - 1)
        .drop("_bucket", "_rn", "_base")
    )
