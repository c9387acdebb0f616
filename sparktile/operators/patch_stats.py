"""Distribution of foreground over candidate tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tiling import foreground_count, foreground_count_packed


def foreground_distribution(images, patch_size, stride, mask_threshold=127, pixels=None) -> DataFrame:
    """fg of every candidate tile, unfiltered; long when ``pixels`` is given, else from packed masks."""
    if pixels is None:
        return foreground_count_packed(images, patch_size, stride, mask_threshold)
    return foreground_count(pixels, images, patch_size, stride, mask_threshold)


def patch_stats(fg: DataFrame, min_fg: int) -> DataFrame:
    kept = F.count_if(F.col("fg") >= min_fg)
    return fg.agg(
        F.count("*").alias("total"),
        kept.alias("kept"),
        (F.count("*") - kept).alias("discarded"),
        F.count_if(F.col("fg") == 0).alias("empty"),
        F.min("fg").alias("min_fg"),
        F.max("fg").alias("max_fg"),
        F.avg("fg").alias("mean_fg"),
    )


def fg_histogram(fg: DataFrame, bin_width: int = 25, cap: int = 1000) -> DataFrame:
    """Counts per bin of ``bin_width``; the last bin holds everything from ``cap`` on. Empty bins are kept."""
    last = cap // bin_width
    spark = fg.sparkSession
    bins = spark.range(last + 1).select(F.col("id").cast("int").alias("bin"), F.lit(0).cast("long").alias("n"))
    seen = fg.select(
        F.least(F.floor(F.col("fg") / F.lit(bin_width)), F.lit(last)).cast("int").alias("bin"), F.lit(1).cast("long").alias("n")
    )
    return (
        bins.unionByName(seen).groupBy("bin").agg(F.sum("n").alias("tiles"))
        .select("bin", (F.col("bin") * bin_width).alias("bin_start"), "tiles")
    )
