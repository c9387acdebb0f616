"""Dice and IoU per sample, per batch and per full image."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.pixels import sigmoid
from .scoring import cut_blocks

SMOOTH = 1e-6  # fixed value: default smoothing of Dice and IoU


def dice_of(inter: Column, pred: Column, target: Column, smooth: float = SMOOTH) -> Column:
    return (2.0 * inter + smooth) / (pred + target + smooth)


def iou_of(inter: Column, pred: Column, target: Column, smooth: float = SMOOTH) -> Column:
    return (inter + smooth) / (pred + target - inter + smooth)


def overlap_sums(df: DataFrame, sample: list[str], pred: Column, target: Column) -> DataFrame:
    """Per sample: inter, pred, target; map-side partial sums, so no sample is gathered whole."""
    p, t = pred.cast("double"), target.cast("double")
    return df.groupBy(*sample).agg(
        F.sum(p * t).alias("inter"), F.sum(p).alias("pred"), F.sum(t).alias("target")
    )


def sample_scores(sums: DataFrame, smooth: float = SMOOTH) -> DataFrame:
    """Add dice and iou to per-sample sums. A sample empty on both sides scores 1."""
    args = (F.col("inter"), F.col("pred"), F.col("target"), smooth)
    return sums.withColumn("dice", dice_of(*args)).withColumn("iou", iou_of(*args))


def mean_scores(scored: DataFrame) -> DataFrame:
    """Mean over samples; 0 when there are none."""
    return scored.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("dice", "iou")], F.count("*").alias("samples"))


def dice(df: DataFrame, sample: list[str], pred: Column, target: Column, smooth: float = SMOOTH) -> DataFrame:
    return mean_scores(sample_scores(overlap_sums(df, sample, pred, target), smooth)).select("dice")


def iou(df: DataFrame, sample: list[str], pred: Column, target: Column, smooth: float = SMOOTH) -> DataFrame:
    return mean_scores(sample_scores(overlap_sums(df, sample, pred, target), smooth)).select("iou")


def dice_iou_from_logits(df: DataFrame, sample: list[str], logit: Column, target: Column, threshold: float = 0.5, smooth: float = SMOOTH) -> DataFrame:
    """Per-sample dice and iou with predictions sigmoid(logit) >= threshold."""
    return sample_scores(overlap_sums(df, sample, sigmoid(logit) >= threshold, target), smooth)


def dice_iou_packed(tiles: DataFrame, sample: list[str], logits: str = "logits", mask: str = "mask", threshold: float = 0.5, smooth: float = SMOOTH) -> DataFrame:
    """The same per packed tile: ``logits`` array<float or double>, ``mask`` 0/1 bytes. One narrow Arrow pass, no shuffle."""
    @pandas_udf("inter double, pred double, target double")
    def sums(z: pd.Series, m: pd.Series) -> pd.DataFrame:
        out = []
        for scores, truth in zip(z, m):
            hit, t = 1.0 / (1.0 + np.exp(-np.asarray(scores, np.float64))) >= threshold, np.frombuffer(truth, np.uint8) > 0
            out.append(((hit & t).sum(), hit.sum(), t.sum()))
        return pd.DataFrame(out, columns=["inter", "pred", "target"], dtype="float64")

    return sample_scores(tiles.select(*sample, sums(logits, mask).alias("s")).select(*sample, "s.*"), smooth)


def epoch_metric(per_tile: DataFrame, batch_col: str = "batch", metrics=("dice", "iou")) -> DataFrame:
    """Mean of batch means (a short last batch weighs as much as a full one) next to the plain tile mean."""
    per_batch = per_tile.groupBy(batch_col).agg(
        *[F.avg(m).alias(m) for m in metrics], *[F.sum(m).alias(f"_{m}") for m in metrics], F.count("*").alias("_n")
    )
    return per_batch.agg(
        *[F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in metrics],
        *[F.coalesce(F.sum(f"_{m}") / F.sum("_n"), F.lit(0.0)).alias(f"{m}_per_tile") for m in metrics],
        F.count("*").alias("batches"),
    )


def image_metrics(stitched: DataFrame, masks: DataFrame, threshold: float = 0.5, mask_threshold: int = 127) -> DataFrame:
    """Dice and IoU per full image from stitched pixels (prob) and mask pixels (m).

    Both sides enter one aggregation on the pixel key, which shuffles each once and never joins.
    """
    keys = ["source_id", "y", "x"]
    sides = stitched.select(*keys, "prob", F.lit(None).cast("int").alias("m")).unionByName(
        masks.select(*keys, F.lit(None).cast("double").alias("prob"), F.col("m").cast("int").alias("m"))
    )
    pixels = sides.groupBy(*keys).agg(F.max("prob").alias("prob"), F.max("m").alias("m"))
    sums = overlap_sums(
        pixels, ["source_id"], F.coalesce(F.col("prob") >= threshold, F.lit(False)), F.coalesce(F.col("m") > mask_threshold, F.lit(False))
    )
    return sample_scores(sums)


def image_metrics_packed(blocks: DataFrame, images: DataFrame, threshold: float = 0.5, mask_threshold: int = 127, block: int = 256, seen: str | None = None) -> DataFrame:
    """The same from stitched blocks and packed masks; ``seen`` names a binary (HW) of the images that is 0 where pixels do not count.

    Masks are cut along the same block lattice and joined block by block (one row per side and
    key); each pair yields three partial sums, which are added per image.
    """
    truth = cut_blocks(images, ["mask", *([seen] if seen else [])], block)

    @pandas_udf("inter double, pred double, target double")
    def sums(prob: pd.Series, mask: pd.Series, valid: pd.Series) -> pd.DataFrame:
        out = []
        for p, m, v in zip(prob, mask, valid):
            t = np.frombuffer(m, np.uint8) > mask_threshold
            hit = np.zeros(t.size, bool) if p is None else np.frombuffer(p, np.float32) >= np.float32(threshold)
            if seen:
                counted = np.frombuffer(v, np.uint8) > 0
                t, hit = t & counted, hit & counted
            out.append(((hit & t).sum(), hit.sum(), t.sum()))
        return pd.DataFrame(out, columns=["inter", "pred", "target"], dtype="float64")

    both = truth.join(blocks.select("source_id", "by", "bx", "prob"), ["source_id", "by", "bx"], "left")
    parts = both.select("source_id", sums("prob", "mask", seen or "mask").alias("s")).select("source_id", "s.*")
    total = parts.groupBy("source_id").agg(*[F.sum(c).alias(c) for c in ("inter", "pred", "target")])
    return sample_scores(total)
