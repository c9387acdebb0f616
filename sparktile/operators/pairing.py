"""Pair image files with mask files by stem."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import extension, file_name, stem

# Raster extensions accepted as images.
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".tif", ".tiff")


def with_names(paths: DataFrame) -> DataFrame:
    """Add source_id (file name) and stem to a frame with a ``path`` column."""
    named = paths.withColumn("source_id", file_name(F.col("path")))
    return named.withColumn("stem", stem(F.col("source_id")))


def select_images(paths: DataFrame, exts=IMAGE_EXTENSIONS) -> DataFrame:
    wanted = [e.lower() for e in exts]
    return with_names(paths.where(extension(file_name(F.col("path"))).isin(wanted)))


def dedupe_stems(files: DataFrame) -> DataFrame:
    """One file per stem: the last path in sort order."""
    return files.groupBy("stem").agg(F.max("path").alias("path"))


def pair_images_masks(images: DataFrame, masks: DataFrame) -> DataFrame:
    """stem, source_id, image_path, mask_path; both sides are unique by stem, so no key is hot."""
    i = dedupe_stems(images).withColumnRenamed("path", "image_path")
    m = dedupe_stems(masks).withColumnRenamed("path", "mask_path")
    return i.join(m, "stem").select("stem", file_name(F.col("image_path")).alias("source_id"), "image_path", "mask_path")


def missing_masks(images: DataFrame, masks: DataFrame) -> DataFrame:
    """Image stems without a mask."""
    return images.select("stem").distinct().join(masks.select("stem"), "stem", "left_anti")


def missing_images(images: DataFrame, masks: DataFrame) -> DataFrame:
    """Mask stems without an image."""
    return missing_masks(masks, images)


def pair_diagnostics(images: DataFrame, masks: DataFrame) -> DataFrame:
    """One row of counts from a single aggregation over both listings."""
    sides = images.select("stem", F.lit(1).alias("i"), F.lit(0).alias("m")).unionByName(
        masks.select("stem", F.lit(0).alias("i"), F.lit(1).alias("m"))
    )
    per_stem = sides.groupBy("stem").agg(F.max("i").alias("i"), F.max("m").alias("m"))
    return per_stem.agg(
        F.count_if((F.col("i") == 1) & (F.col("m") == 1)).alias("pairs"),
        F.count_if((F.col("i") == 1) & (F.col("m") == 0)).alias("missing_masks"),
        F.count_if((F.col("i") == 0) & (F.col("m") == 1)).alias("missing_images"),
    )
