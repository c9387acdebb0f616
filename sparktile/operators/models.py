"""Fit pixel classifiers per split with Spark ML and judge them with the segmentation metrics."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from . import metrics, runs, stencil


def neighbourhood(pixels: DataFrame, bands: list[str], sample: list[str], y: str = "y", x: str = "x") -> DataFrame:
    """Add <band>_max and <band>_min over each pixel's neighbours, as extra features.

    Windows run on single lines, so that a huge image is not one task's work, and all bands share them.
    """
    return stencil.soft_extremes(pixels, bands, sample, y, x)


def default_estimator(features: list[str], label: str, max_iter: int = 20, reg: float = 0.0) -> Pipeline:
    """Assembled features and a logistic regression, whose objective is the binary cross-entropy."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=features, outputCol="features"),
        LogisticRegression(featuresCol="features", labelCol=label, maxIter=max_iter, regParam=reg),
    ])


def with_logit(scored: DataFrame) -> DataFrame:
    """Add z, the margin of the positive class."""
    return scored.withColumn("z", vector_to_array("rawPrediction")[1])


def judge(scored: DataFrame, sample: list[str], label: str, threshold: float = 0.5) -> DataFrame:
    """One row: loss (mean cross-entropy over pixels), dice and iou (means over samples).

    Per-sample sums serve all three, so the scored pixels are aggregated once.
    """
    z, t = F.col("z"), F.col(label).cast("double")
    p = (1.0 / (1.0 + F.exp(-z)) >= threshold).cast("double")
    sums = scored.groupBy(*sample).agg(
        F.sum(p * t).alias("inter"), F.sum(p).alias("pred"), F.sum(t).alias("target"),
        F.sum(F.greatest(z, F.lit(0.0)) - z * t + F.log1p(F.exp(-F.abs(z)))).alias("bce"), F.count("*").alias("n"),
    )
    return metrics.sample_scores(sums).agg(
        (F.sum("bce") / F.sum("n")).alias("loss"), F.avg("dice").alias("dice"), F.avg("iou").alias("iou")
    )


def fit_pixel_model(
    pixels: DataFrame, splits: DataFrame, features: list[str], label: str, settings: list[dict] | None = None,
    sample: list[str] | None = None, monitor: str = "val_dice_per_image", mode: str = "max", run: str = "fit", threshold: float = 0.5,
) -> tuple[dict, DataFrame]:
    """Fit every setting on the train pixels of every fold, score the val pixels, keep the best.

    ``settings`` are keyword sets for ``default_estimator`` (one per epoch number). Returns the
    best model per fold and the metric log. Each fit is a distributed job; the loop covers
    folds and settings only. The pixels, their features and the roles of their image in all folds are
    written once under ``spark.checkpoint.dir``; every fit reads them from there and shuffles none.
    """
    runs.check_mode(mode)
    spark, sample = pixels.sparkSession, sample or ["source_id"]
    stored = scratch_path(spark, "fit-pixels")
    roles = splits.groupBy("source_id").agg(F.collect_list(F.struct("fold", "role")).alias("_roles"))
    pixels.join(roles, "source_id").write.parquet(stored)
    pixels = spark.read.parquet(stored)

    def of(fold, role):
        here = F.filter("_roles", lambda r: (r["fold"] == fold) & (r["role"] == role))
        return pixels.withColumn("_here", F.explode(here)).drop("_here", "_roles")

    settings = settings or [{}]
    folds = sorted(r.fold for r in splits.select("fold").distinct().collect())
    best, rows = {}, []
    for fold in folds:
        train, val = of(fold, "train"), of(fold, "val")
        top = -math.inf if mode == "max" else math.inf
        for epoch, setting in enumerate(settings, 1):
            model = default_estimator(features, label, **setting).fit(train)
            got = judge(with_logit(model.transform(val)), sample, label, threshold).first()
            row = {
                "run": run, "fold": fold, "epoch": epoch, "train_loss": float(model.stages[-1].summary.objectiveHistory[-1]),
                "val_loss": got.loss, "val_dice_per_image": got.dice, "val_iou_per_image": got.iou,
            }
            rows.append(row)
            if row[monitor] is not None and (row[monitor] > top if mode == "max" else row[monitor] < top):
                top, best[fold] = row[monitor], model
    schema = "run string, fold int, epoch int, train_loss double, val_loss double, val_dice_per_image double, val_iou_per_image double"
    return best, spark.createDataFrame(rows, schema)


def grouped_cv(pixels: DataFrame, folds: DataFrame, features: list[str], label: str, grid: dict[str, list], max_iter: int = 20):
    """Cross-validated grid search whose folds are whole images. Returns the fitted CrossValidatorModel.

    ``folds`` is (source_id, fold) with folds numbered from 0; ``grid`` maps parameters of the
    logistic regression to values.
    """
    estimator = default_estimator(features, label, max_iter)
    regression = estimator.getStages()[-1]
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(regression.getParam(name), values)
    n = folds.agg(F.max("fold")).first()[0] + 1
    search = CrossValidator(
        estimator=estimator, estimatorParamMaps=builder.build(), numFolds=n, foldCol="fold", parallelism=2,
        evaluator=BinaryClassificationEvaluator(labelCol=label),
    )
    return search.fit(pixels.join(folds, "source_id"))


def search_results(model) -> DataFrame:
    """One row per grid point: params, score."""
    from pyspark.sql import SparkSession

    rows = [
        (", ".join(f"{p.name}={v}" for p, v in sorted(m.items(), key=lambda e: e[0].name)), float(s))
        for m, s in zip(model.getEstimatorParamMaps(), model.avgMetrics)
    ]
    return SparkSession.active().createDataFrame(rows, "params string, score double")


def loss_history(model) -> DataFrame:
    """iteration, loss of a fitted pipeline's regression, iteration 0 being the start."""
    from pyspark.sql import SparkSession

    history = [(i, float(v)) for i, v in enumerate(model.stages[-1].summary.objectiveHistory)]
    return SparkSession.active().createDataFrame(history, "iteration int, loss double")
