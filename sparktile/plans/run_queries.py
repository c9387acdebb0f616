"""Queries over the experiment log derived from the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import runs
from ..session import scratch_path
from ..sources import sinks
from ..sources import tables as t
from .catalog import query

METRIC = "val_dice_per_patch"
LOG = f"WITH {t.LOG_SQL}"


@query("q_metric_log", LOG + " SELECT * FROM metric_log")
def q_metric_log(spark, d):
    return t.metric_log(spark, d)


@query("q_epoch_rows", LOG + """ SELECT run, fold, epoch, CASE WHEN fold<>2 THEN train_loss END AS train_loss, val_dice_per_patch,
 CASE WHEN fold=2 THEN val_dice_per_image END AS val_dice_per_image FROM metric_log""")
def q_epoch_rows(spark, d):
    """Folds logged with different columns."""
    log = t.metric_log(spark, d)
    parts = [log.where("fold <> 2").drop("val_dice_per_image"), log.where("fold = 2").drop("train_loss")]
    return runs.epoch_rows(*parts)


def _running(cmp, agg, metric):
    return LOG + f""", w AS (SELECT *, {agg}({metric}) OVER (PARTITION BY run, fold ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM metric_log)
SELECT run, fold, epoch, b IS NULL OR {metric} {cmp} b AS is_best FROM w"""


@query("q_running_best", _running(">", "max", METRIC))
def q_running_best(spark, d):
    return runs.running_best(t.metric_log(spark, d), METRIC).select("run", "fold", "epoch", "is_best")


@query("q_running_best_min", _running("<", "min", "train_loss"))
def q_running_best_min(spark, d):
    return runs.running_best(t.metric_log(spark, d), "train_loss", "min").select("run", "fold", "epoch", "is_best")


def _best(metric, order):
    return LOG + f" SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY run, fold ORDER BY {metric} {order}, epoch) AS rn FROM metric_log) WHERE rn=1"


@query("q_best_epoch", _best(METRIC, "DESC"))
def q_best_epoch(spark, d):
    return runs.best_epoch(t.metric_log(spark, d), METRIC)


@query("q_best_epoch_min", _best("train_loss", "ASC"))
def q_best_epoch_min(spark, d):
    return runs.best_epoch(t.metric_log(spark, d), "train_loss", "min")


@query("q_latest_metric", LOG + " SELECT run, fold, arg_max(val_dice_per_image, epoch) FILTER (WHERE val_dice_per_image IS NOT NULL) AS val_dice_per_image FROM metric_log GROUP BY 1,2")
def q_latest_metric(spark, d):
    return runs.latest_metric(t.metric_log(spark, d), "val_dice_per_image")


FOLDS = LOG + f""", b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run, fold ORDER BY {METRIC} DESC, epoch) AS rn FROM metric_log) WHERE rn=1),
l AS (SELECT run, fold, arg_max(val_dice_per_image, epoch) FILTER (WHERE val_dice_per_image IS NOT NULL) AS last FROM metric_log GROUP BY 1,2),
folds AS (SELECT b.run, b.fold, b.epoch AS best_epoch, b.train_loss, b.val_dice_per_patch, l.last AS val_dice_per_image FROM b JOIN l USING (run, fold))"""


def _folds(spark, d):
    return runs.fold_results(t.metric_log(spark, d), METRIC, "max")


@query("q_fold_results", FOLDS + ", n AS (SELECT run, fold, CAST(count(*) AS BIGINT) AS epochs FROM metric_log GROUP BY 1,2) SELECT folds.*, n.epochs FROM folds JOIN n USING (run, fold)")
def q_fold_results(spark, d):
    log = t.metric_log(spark, d)
    return runs.fold_results(log, METRIC, "max", log.groupBy("run", "fold").agg(F.count("*").alias("epochs")))


STATS = """round(avg(val_dice_per_patch),6) AS mean_val_dice_per_patch, round(stddev_pop(val_dice_per_patch),6) AS std_val_dice_per_patch,
 round(avg(val_dice_per_image),6) AS mean_val_dice_per_image, round(stddev_pop(val_dice_per_image),6) AS std_val_dice_per_image"""
METRICS = [METRIC, "val_dice_per_image"]


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in df.columns if c.startswith(("mean_", "std_"))})


@query("q_cv_stats", FOLDS + f" SELECT run, {STATS} FROM folds GROUP BY run")
def q_cv_stats(spark, d):
    return _rounded(runs.cv_stats(_folds(spark, d), METRICS))


@query("q_cv_summary", FOLDS + f""" SELECT run, {STATS}, CAST(count(*) AS INTEGER) AS n_folds, (SELECT CAST(count(DISTINCT vec_id//16) AS BIGINT) FROM embeddings) AS num_original_images,
 CAST(sum(best_epoch*fold) AS BIGINT) AS fold_check FROM folds GROUP BY run""")
def q_cv_summary(spark, d):
    s = _rounded(runs.cv_summary(_folds(spark, d), METRICS, images=t.px_images(spark, d)))
    check = F.aggregate("folds", F.lit(0).cast("long"), lambda acc, f: acc + f["best_epoch"] * f["fold"])
    return s.select("*", F.size("folds").alias("n_folds"), check.alias("fold_check")).drop("folds")


@query("q_legacy_names", LOG + " SELECT run, fold, epoch, val_dice_per_patch FROM metric_log")
def q_legacy_names(spark, d):
    old = t.metric_log(spark, d).withColumnRenamed(METRIC, "val_dice")
    return runs.rename_legacy_metrics(old).select("run", "fold", "epoch", METRIC)


@query("q_interval", LOG + " SELECT run, fold, epoch FROM metric_log WHERE epoch%10=0")
def q_interval(spark, d):
    return runs.at_interval(t.metric_log(spark, d), 10).select("run", "fold", "epoch")


@query("q_scalars", LOG + """ SELECT run, fold, epoch AS step, 'train_loss' AS tag, train_loss AS value FROM metric_log
 UNION ALL SELECT run, fold, epoch, 'val_dice_per_patch', val_dice_per_patch FROM metric_log
 UNION ALL SELECT run, fold, epoch, 'val_dice_per_image', val_dice_per_image FROM metric_log WHERE val_dice_per_image IS NOT NULL""")
def q_scalars(spark, d):
    return runs.long_scalars(t.metric_log(spark, d))


@query("q_metrics_csv", LOG + " SELECT run, fold, epoch, train_loss, val_dice_per_patch, val_dice_per_image FROM metric_log")
def q_metrics_csv(spark, d):
    """The log through the CSV sink and back, empty fields included."""
    path = scratch_path(spark, "csv")
    sinks.write_metrics_csv(runs.epoch_rows(t.metric_log(spark, d)), path)
    types = "run string, fold int, epoch int, train_loss double, val_dice_per_patch double, val_dice_per_image double"
    return spark.read.schema(types).option("header", True).csv(path)


@query("q_summary_json", FOLDS + f" SELECT run, {STATS}, fold, best_epoch FROM folds JOIN (SELECT run, {STATS} FROM folds GROUP BY run) USING (run)".replace(f"SELECT run, {STATS}, fold", "SELECT run, mean_val_dice_per_patch, std_val_dice_per_patch, mean_val_dice_per_image, std_val_dice_per_image, fold", 1))
def q_summary_json(spark, d):
    """The summary through the JSON sink and back, one row per entry of its fold array."""
    path = scratch_path(spark, "json")
    summary = _rounded(runs.cv_summary(_folds(spark, d), METRICS))
    sinks.write_summary_json(summary, path)
    back = spark.read.schema(summary.schema).json(path)
    stats = [f"{s}_{m}" for m in METRICS for s in ("mean", "std")]
    return back.select("run", *stats, F.inline("folds")).select("run", *stats, "fold", "best_epoch")


PLATEAU = LOG.replace("WITH", "WITH RECURSIVE") + """,
s AS (SELECT run, fold, epoch, train_loss AS v, row_number() OVER (PARTITION BY run, fold ORDER BY epoch) AS n FROM metric_log),
r AS (SELECT run, fold, epoch, n, v AS best, 0 AS bad, 0.01::DOUBLE AS lr, 0.01::DOUBLE AS nxt, false AS reduced FROM s WHERE n=1
 UNION ALL SELECT s.run, s.fold, s.epoch, s.n, CASE WHEN better THEN s.v ELSE best END,
  CASE WHEN better THEN 0 WHEN bad+1>2 THEN 0 ELSE bad+1 END, nxt,
  CASE WHEN NOT better AND bad+1>2 AND nxt-greatest(nxt*0.5::DOUBLE,0.002::DOUBLE)>1e-8::DOUBLE THEN greatest(nxt*0.5::DOUBLE,0.002::DOUBLE) ELSE nxt END,
  NOT better AND bad+1>2 AND nxt-greatest(nxt*0.5::DOUBLE,0.002::DOUBLE)>1e-8::DOUBLE
 FROM (SELECT r.*, s.v AS sv, s.v < r.best*(1-1e-4::DOUBLE) AS better FROM r JOIN s ON s.run=r.run AND s.fold=r.fold AND s.n=r.n+1) r
  JOIN s ON s.run=r.run AND s.fold=r.fold AND s.n=r.n+1)
SELECT run, fold, epoch, lr, CAST(bad AS INTEGER) AS bad, reduced FROM r"""


@query("q_plateau", PLATEAU)
def q_plateau(spark, d):
    return runs.plateau_trace(t.metric_log(spark, d), "train_loss", "min", factor=0.5, patience=2, min_lr=0.002, lr0=0.01)


@query("q_plateau_blocks", PLATEAU)
def q_plateau_blocks(spark, d):
    """The same in blocks of seven epochs, so that every fold is worked on by several tasks."""
    return runs.plateau_trace(t.metric_log(spark, d), "train_loss", "min", factor=0.5, patience=2, min_lr=0.002, lr0=0.01, step=7)
