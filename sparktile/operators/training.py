"""Gradient training of a pixel model over packed tiles: all folds in one pass per step, rates by plateau, one log row per epoch.

The model is a logistic regression on a pixel's normalised colours, trained as a network is: mini-batches of tiles in a seeded
order, a learning rate that falls on plateaus of the monitored metric, the best epoch kept.  What a step needs from the cluster
is one sum per fold; each task adds up its tiles first, so a job returns a few numbers per task whatever the pixels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from . import runs
from .metrics import SMOOTH
from .transforms import MEAN, STD

LOG = (
    "run string, fold int, epoch int, lr double, train_loss double, val_loss double, val_dice_per_patch double, val_iou_per_patch double, "
    "val_dice_per_image double, val_iou_per_image double"
)


@dataclass
class Plateau:
    """Rate of one fold: multiplied by ``factor`` after more than ``patience`` epochs without a relative improvement of ``threshold``."""

    lr: float
    mode: str = "max"
    factor: float = 0.5
    patience: int = 10
    min_lr: float = 0.0
    threshold: float = 1e-4
    best: float | None = field(default=None)
    bad: int = 0

    def step(self, value: float | None) -> None:
        if value is None:
            return
        if self.best is None or (value > self.best * (1 + self.threshold) if self.mode == "max" else value < self.best * (1 - self.threshold)):
            self.best, self.bad = value, 0
            return
        self.bad += 1
        if self.bad > self.patience:
            self.lr, self.bad = max(self.lr * self.factor, self.min_lr), 0


def pixel_rows(image: bytes) -> np.ndarray:
    """Normalised colours and a one, per pixel."""
    rgb = (np.frombuffer(image, np.uint8).reshape(-1, 3) / 255.0 - np.array(MEAN)) / np.array(STD)
    return np.concatenate([rgb, np.ones((len(rgb), 1))], 1)


def _margin_loss(z: np.ndarray, y: np.ndarray) -> float:
    return float((np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z)))).sum())


def gradient_sums(tiles: DataFrame, weights: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, float, int]]:
    """Action: fold -> (gradient, loss, pixels), summed over the tiles (image, mask, ``folds``) that train it.

    One narrow pass gives a row per task and fold; a second level adds them up.
    """

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {f: [np.zeros(4), 0.0, 0] for f in weights}
        for pdf in frames:
            for image, mask, folds in zip(pdf.image, pdf["mask"], pdf.folds):
                x, y = pixel_rows(image), np.frombuffer(mask, np.uint8).astype(float)
                for f in folds:
                    z = x @ weights[f]
                    s = sums[f]
                    s[0] += x.T @ (1.0 / (1.0 + np.exp(-z)) - y)
                    s[1] += _margin_loss(z, y)
                    s[2] += len(y)
        yield pd.DataFrame([(f, *g, loss, n) for f, (g, loss, n) in sums.items() if n], columns=["fold", "g0", "g1", "g2", "g3", "loss", "n"])

    parts = tiles.select("image", "mask", "folds").mapInPandas(work, "fold int, g0 double, g1 double, g2 double, g3 double, loss double, n long")
    total = parts.groupBy("fold").agg(*[F.sum(c).alias(c) for c in ("g0", "g1", "g2", "g3", "loss", "n")])
    return {r.fold: (np.array([r.g0, r.g1, r.g2, r.g3]), r.loss, r.n) for r in total.collect()}


def judge_tiles(tiles: DataFrame, weights: dict[int, np.ndarray], threshold: float = 0.5) -> dict[int, dict]:
    """Action: fold -> val_loss, Dice and IoU per tile and per image, over the tiles that validate it.

    Per-tile counts are the only rows that are shuffled; the images' scores come from their tiles' sums.
    """

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for key, image, mask, folds in zip(pdf.source_id, pdf.image, pdf["mask"], pdf.folds):
                x, y = pixel_rows(image), np.frombuffer(mask, np.uint8).astype(float)
                for f in folds:
                    z = x @ weights[f]
                    p = 1.0 / (1.0 + np.exp(-z)) >= threshold
                    out.append((key, f, float((p * y).sum()), float(p.sum()), float(y.sum()), _margin_loss(z, y), len(y)))
            yield pd.DataFrame(out, columns=["source_id", "fold", "inter", "pred", "target", "loss", "n"])

    kind = tiles.schema["source_id"].dataType.simpleString()
    per_tile = tiles.select("source_id", "image", "mask", "folds").mapInPandas(
        work, f"source_id {kind}, fold int, inter double, pred double, target double, loss double, n long"
    )
    inter, total = F.col("inter"), F.col("pred") + F.col("target")
    dice, iou = (2 * inter + SMOOTH) / (total + SMOOTH), (inter + SMOOTH) / (total - inter + SMOOTH)
    per_image = per_tile.groupBy("fold", "source_id").agg(
        F.sum(dice).alias("dice_sum"), F.sum(iou).alias("iou_sum"), F.count("*").alias("tiles"),
        *[F.sum(c).alias(c) for c in ("inter", "pred", "target", "loss", "n")],
    )
    scored = per_image.groupBy("fold").agg(
        (F.sum("loss") / F.sum("n")).alias("val_loss"), (F.sum("dice_sum") / F.sum("tiles")).alias("val_dice_per_patch"),
        (F.sum("iou_sum") / F.sum("tiles")).alias("val_iou_per_patch"), F.avg(dice).alias("val_dice_per_image"), F.avg(iou).alias("val_iou_per_image"),
    )
    return {r.fold: r.asDict() for r in scored.collect()}


def train_tiles(
    tiles: DataFrame, splits: DataFrame, epochs: int, lr: float = 0.5, steps: int = 1, seed: int = 42, monitor: str = "val_dice_per_patch", mode: str = "max",
    patience: int = 10, factor: float = 0.5, min_lr: float = 0.0, weight_decay: float = 0.0, threshold: float = 0.5, run: str = "train",
) -> tuple[dict[int, np.ndarray], DataFrame]:
    """Action: (best weights per fold, the log with a row per fold and epoch) from packed tiles and (fold, source_id, role).

    Roles ride on the tiles as arrays of folds, so each step reads a tile once for all folds it trains. An epoch has ``steps``
    mini-batches, dealt by a hash of seed, epoch and tile, that follow one another; each is one job that returns a sum per fold.
    ``train_loss`` is the mean over an epoch's steps, each before its update; ``lr`` is the rate the epoch ran with. The tiles
    are stored once under ``spark.checkpoint.dir``. A fold without validation tiles has null metrics and keeps its last weights;
    one without training tiles keeps its zero weights.
    """
    runs.check_mode(mode)
    spark = tiles.sparkSession
    roles = splits.groupBy("source_id").agg(*[
        F.array_sort(F.collect_set(F.when(F.col("role") == r, F.col("fold")))).alias(f"_{r}") for r in ("train", "val")
    ])
    path = scratch_path(spark, "train-tiles")
    tiles.select("source_id", "y0", "x0", "image", "mask").join(roles, "source_id").write.parquet(path)
    stored = spark.read.parquet(path)
    train, val = (stored.where(F.size(f"_{r}") > 0).withColumn("folds", F.col(f"_{r}")) for r in ("train", "val"))
    folds = sorted(r.fold for r in splits.select("fold").distinct().collect())
    weights, best = {f: np.zeros(4) for f in folds}, {f: (None, np.zeros(4)) for f in folds}
    rates, log = {f: Plateau(lr, mode, factor, patience, min_lr) for f in folds}, []
    for epoch in range(1, epochs + 1):
        losses, pixels, used = dict.fromkeys(folds, 0.0), dict.fromkeys(folds, 0), {f: rates[f].lr for f in folds}
        for step in range(steps):
            dealt = F.pmod(F.xxhash64(F.lit(f"{seed}:{epoch}"), "source_id", "y0", "x0"), F.lit(steps)) == step
            for f, (gradient, loss, n) in gradient_sums(train.where(dealt) if steps > 1 else train, weights).items():
                weights[f] = weights[f] - used[f] * (gradient / n + weight_decay * weights[f])
                losses[f] += loss
                pixels[f] += n
        scores = judge_tiles(val, weights, threshold)
        for f in folds:
            got = scores.get(f, {})
            row = {"run": run, "fold": f, "epoch": epoch, "lr": used[f], "train_loss": losses[f] / pixels[f] if pixels[f] else None}
            row |= {c.split()[0]: got.get(c.split()[0]) for c in LOG.split(", ")[5:]}
            log.append(row)
            value, top = row[monitor], best[f][0]
            if value is None or top is None or (value > top if mode == "max" else value < top):
                best[f] = (value, weights[f])
            rates[f].step(value)
    return {f: w for f, (_, w) in best.items()}, spark.createDataFrame([tuple(r.values()) for r in log], LOG)


def apply_model(weights: np.ndarray):
    """A trained model for ``score_blocks`` and ``score_tiles``: CHW tensors to logits."""
    w = np.asarray(weights, float)

    def model(batch):
        return np.tensordot(w[:3], np.asarray(batch, float), ([0], [1]))[:, None] + w[3]

    return model


def ridge_cv(pixels: DataFrame, folds: DataFrame, features: list[str], label: str, penalties: list[float]) -> DataFrame:
    """penalty, fold, mse: ridge regression of ``label`` (standardised by nothing, intercept free of penalty) with each image fold held
    out in turn.

    One pass for any number of folds and penalties: the sums of products of each fold are aggregated once, a fold's fit uses
    the total less its own, and its error follows from its own sums. The driver solves one small system per fold and penalty.
    Null labels or features leave a pixel out; a fold without pixels has no row.
    """
    columns = [*features, label]
    full = pixels.join(folds, "source_id").where(F.expr(" and ".join(f"`{c}` is not null" for c in columns)))
    names = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    value = [F.col(c).cast("double") for c in columns]
    sums = full.groupBy("fold").agg(
        F.count("*").alias("n"), *[F.sum(v).alias(f"s{i}") for i, v in enumerate(value)], *[F.sum(value[i] * value[j]).alias(f"p{i}_{j}") for i, j in names]
    ).collect()
    d = len(features)

    def moments(r) -> np.ndarray:
        m = np.zeros((d + 2, d + 2))  # intercept first, label last
        m[0, 0] = r["n"]
        for i in range(d + 1):
            m[0, i + 1] = m[i + 1, 0] = r[f"s{i}"]
        for i, j in names:
            m[i + 1, j + 1] = m[j + 1, i + 1] = r[f"p{i}_{j}"]
        return m

    each = {r["fold"]: moments(r) for r in sums}
    total, rows = sum(each.values(), np.zeros((d + 2, d + 2))), []
    for penalty in penalties:
        for fold, own in sorted(each.items(), key=lambda kv: (kv[0] is None, kv[0] or 0)):
            rest = total - own
            free = np.diag([0.0] + [penalty * rest[0, 0]] * d)
            beta = np.append(np.linalg.lstsq(rest[:-1, :-1] + free, rest[:-1, -1], rcond=None)[0], -1.0)
            rows.append((float(penalty), fold, max(0.0, float(beta @ own @ beta)) / float(own[0, 0])))
    return pixels.sparkSession.createDataFrame(rows, f"penalty double, fold {folds.schema['fold'].dataType.simpleString()}, mse double")


__all__ = ["Plateau", "train_tiles", "gradient_sums", "judge_tiles", "apply_model", "ridge_cv"]
