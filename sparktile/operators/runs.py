"""Analytics over experiment logs: one row per (run, fold, epoch) with metric columns."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scans import best_before
from . import plateau

FOLD = ["run", "fold"]
# Metric names of older logs and what they are called now.
LEGACY_NAMES = {
    "train_dice": "train_dice_per_patch",
    "train_iou": "train_iou_per_patch",
    "val_dice": "val_dice_per_patch",
    "val_iou": "val_iou_per_patch",
}
LEADING = ["run", "fold", "epoch", "lr"]


def check_mode(mode: str) -> None:
    if mode not in ("max", "min"):
        raise ValueError(f"mode must be max or min, got {mode!r}")


def epoch_rows(*logs: DataFrame) -> DataFrame:
    """All folds in one log; metrics a fold lacks are null. Key columns lead, metrics keep first-seen order."""
    merged = logs[0]
    for log in logs[1:]:
        merged = merged.unionByName(log, allowMissingColumns=True)
    lead = [c for c in LEADING if c in merged.columns]
    return merged.select(*lead, *[c for c in merged.columns if c not in lead])


def rename_legacy_metrics(log: DataFrame) -> DataFrame:
    return log.withColumnsRenamed(LEGACY_NAMES)


def running_best(log: DataFrame, metric: str, mode: str = "max") -> DataFrame:
    """Add is_best: strictly better than every earlier epoch of the fold."""
    check_mode(mode)
    seen = best_before(log, FOLD, "epoch", metric, mode, "_best")
    better = F.col(metric) > F.col("_best") if mode == "max" else F.col(metric) < F.col("_best")
    return seen.withColumn("is_best", F.coalesce(better, F.col(metric).isNotNull() & F.col("_best").isNull())).drop("_best")


def best_epoch(log: DataFrame, metric: str, mode: str = "max") -> DataFrame:
    """The whole best row per fold; ties go to the earliest epoch. An aggregate with partial results, no sort.

    A fold whose metric is null throughout stays, with nulls.
    """
    check_mode(mode)
    row = F.struct(*[c for c in log.columns if c not in FOLD])
    rank = F.struct(F.col(metric), -F.col("epoch")) if mode == "max" else F.struct(F.col(metric), F.col("epoch"))
    rank = F.when(F.col(metric).isNotNull(), rank)
    pick = F.max_by(row, rank) if mode == "max" else F.min_by(row, rank)
    return log.groupBy(*FOLD).agg(pick.alias("b")).select(*FOLD, "b.*")


def latest_metric(log: DataFrame, *metrics: str) -> DataFrame:
    """Per fold the last non-null value of each metric."""
    return log.groupBy(*FOLD).agg(*[
        F.max_by(m, F.when(F.col(m).isNotNull(), F.col("epoch"))).alias(m) for m in metrics
    ])


def fold_results(log: DataFrame, metric: str, mode: str, fold_counts: DataFrame | None = None, latest: list[str] | None = None) -> DataFrame:
    """Best row per fold; ``latest`` metrics are overridden by their last value, ``fold_counts`` joined on (run, fold), or on fold if it has
    no run column."""
    latest = [m for m in (latest or ["val_dice_per_image", "val_iou_per_image"]) if m in log.columns]
    best = best_epoch(log, metric, mode).drop(*latest).withColumnRenamed("epoch", "best_epoch")
    out = best
    if latest:
        last = latest_metric(log, *latest).withColumnsRenamed({"run": "_run", "fold": "_fold"})
        out = best.join(last, F.col("run").eqNullSafe(F.col("_run")) & F.col("fold").eqNullSafe(F.col("_fold"))).drop("_run", "_fold")
    if fold_counts is None:
        return out
    keys = [k for k in FOLD if k in fold_counts.columns]
    counts = fold_counts.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])  # a null fold is a fold
    return out.join(counts, same, "left").drop(*[f"_{k}" for k in keys])


def _stats(metrics: list[str]):
    return [e for m in metrics for e in (F.avg(m).alias(f"mean_{m}"), F.stddev_pop(m).alias(f"std_{m}"))]


def cv_stats(folds: DataFrame, metrics: list[str]) -> DataFrame:
    """Per run mean_/std_ of each metric over its folds: population deviation, nulls skipped, null if all are."""
    return folds.groupBy("run").agg(*_stats(metrics))


def at_interval(log: DataFrame, n: int, enabled: bool = True) -> DataFrame:
    """Epochs at which full-image validation runs."""
    return log.where(F.lit(enabled) & (F.col("epoch") % max(1, int(n)) == 0))


def long_scalars(log: DataFrame) -> DataFrame:
    """run, fold, step, tag, value: one row per non-null metric."""
    metrics = [c for c in log.columns if c not in ("run", "fold", "epoch")]
    wide = log.select("run", "fold", F.col("epoch").alias("step"), *[F.col(m).cast("double").alias(m) for m in metrics])
    return wide.unpivot(["run", "fold", "step"], metrics, "tag", "value").where(F.col("value").isNotNull())


def plateau_trace(
    log: DataFrame, metric: str, mode: str = "max", factor: float = 0.5, patience: int = 5, min_lr: float = 1e-6,
    lr0: float = 1e-4, threshold: float = 1e-4, eps: float = 1e-8, step: int = plateau.STEP,
) -> DataFrame:
    """run, fold, epoch, lr (during the epoch), bad (epochs without improvement after it), reduced.

    An epoch improves when it beats the best accepted value by the relative ``threshold``. After
    more than ``patience`` epochs without improvement the rate is multiplied by ``factor``, not
    below ``min_lr``, and the count restarts; steps smaller than ``eps`` are not taken. Epochs with
    a null metric are not steps and give no row. A fold is cut into blocks of ``step`` epochs that
    are worked on side by side, see ``plateau``; only one row a block is read in order.
    """
    check_mode(mode)
    if not 0 <= factor < 1:
        raise ValueError("factor must be at least 0 and below 1")
    rows = log.where(F.col(metric).isNotNull()).select("run", "fold", "epoch", F.col(metric).cast("double").alias("metric"))
    return plateau.trace(rows, mode == "max", factor, patience, min_lr, lr0, threshold, eps, step)


def cv_summary(folds: DataFrame, metrics: list[str], num_images: int | None = None, images: DataFrame | None = None) -> DataFrame:
    """One row per run: means, deviations, image count and the array of fold rows (one struct per fold).

    The image count is ``num_images``, or counted from ``images`` (one row an image).
    """
    row = F.struct("fold", *[c for c in folds.columns if c not in FOLD])
    out = folds.groupBy("run").agg(*_stats(metrics), F.array_sort(F.collect_list(row)).alias("folds"))
    if images is None:
        return out.withColumn("num_original_images", F.lit(num_images).cast("long"))
    return out.withColumn("num_original_images", images.agg(F.count("*")).scalar())
