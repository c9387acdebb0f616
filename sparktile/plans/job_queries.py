"""Queries that go through files, user models and Spark ML."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.pixels import luma
from ..operators import models, scoring, splits, tiling, training, transforms
from ..session import scratch_path
from ..sources import files, headers, sinks
from ..sources import tables as t
from . import jobs
from .catalog import query
from .tile_queries import P, PX_GRID, S, STATS, fg_sql
from .transform_queries import RGB, packed_tiles, upscaled_sql


def make_step_model():
    """A model whose logit is exact in single precision: +-2 by the red channel, plus a ramp over the tile.

    Like a network it sees normalised tensors and answers with a dict.
    """
    bar = (140 / 255 - transforms.MEAN[0]) / transforms.STD[0]
    ramp = ((np.arange(P) - 8) / 8).astype(np.float32)

    def model(batch):
        return {"out": (np.where(batch[:, 0] > bar, 2.0, -2.0) + ramp).astype(np.float32)[:, None]}

    return model


MODEL_SQL = "1/(1+exp(-(CASE WHEN r > 140 THEN 2.0 ELSE -2.0 END + (dx-8)/8.0)))"
SCORED = RGB + f", sc AS (SELECT *, CAST({MODEL_SQL} AS FLOAT)::DOUBLE AS prob FROM c)"


@query("q_score_tiles", f"WITH {SCORED} SELECT source_id, y0, x0, dy, dx, round(prob,6) AS prob FROM sc")
def q_score_tiles(spark, d):
    samples = transforms.eval_transform(packed_tiles(spark, d))
    scores = scoring.unpack_scores(scoring.score_tiles(samples, make_step_model, P))
    return scores.select("source_id", "y0", "x0", "dy", "dx", F.round("prob", 6).alias("prob"))


@query("q_resize_scores", upscaled_sql(SCORED, "CAST(sum(f.w*n.prob) AS FLOAT)::DOUBLE AS prob", "sc") + " SELECT source_id, y0, x0, dy, dx, round(prob,6) AS prob FROM i")
def q_resize_scores(spark, d):
    """Score maps grown to twice the side."""
    samples = transforms.eval_transform(packed_tiles(spark, d))
    wide = scoring.resize_scores(scoring.score_tiles(samples, make_step_model, P), 2 * P)
    long = scoring.unpack_scores(wide.withColumn("patch_size", F.lit(2 * P)))
    return long.select("source_id", "y0", "x0", "dy", "dx", F.round("prob", 6).alias("prob"))


def _png_folder(spark, d, column, kind, prefix="px "):
    """The images as PNG files in shared storage; names hold a space, as real ones do."""
    packed = t.px_packed(spark, d).withColumn("stem", F.concat(F.lit(prefix), "source_id"))
    path = scratch_path(spark, "png")
    sinks.write_rasters(packed, path, kind, column=column, suffix="")
    return path


def _id(name):
    return F.regexp_extract(name, r"(\d+)\.png$", 1).cast("long")


@query("q_raster_roundtrip", f"WITH {t.PX_SQL} SELECT source_id, width, height, y, x, {t.RGB_SQL}, m FROM px")
def q_raster_roundtrip(spark, d):
    """PNG files written, read back through the image source, paired and unpacked."""
    pairs = files.load_pairs(spark, _png_folder(spark, d, "image", "overlay"), _png_folder(spark, d, "mask", "mask"))
    pixels = tiling.unpack_images(pairs.withColumn("source_id", _id(F.col("source_id"))))
    # files are whole rasters: places without a pixel are left out again
    return pixels.join(t.px_missing(spark, d), ["source_id", "y", "x"], "left_anti").select(*pixels.columns)


@query("q_image_records", f"WITH {t.IMAGES_SQL} SELECT 'px '||source_id||'.png' AS source_id, 'px '||source_id AS stem, width, height FROM images")
def q_image_records(spark, d):
    path = _png_folder(spark, d, "image", "overlay")
    listed = files.list_images(spark, path).select("source_id", "stem")
    return files.image_records(listed, headers.read_headers(spark, path))


@query("q_decode_gray", f"""WITH {t.PX_SQL} SELECT source_id, CAST(sum((19595*m + 38470*(255-m) + 7471*((m*7)%256) + 32768)//65536) AS BIGINT) AS total FROM px GROUP BY 1""")
def q_decode_gray(spark, d):
    """Colour files read as grey."""
    grey = files.decode_gray(files.read_images(spark, _png_folder(spark, d, "image", "overlay")))
    pixels = tiling.unpack_images(grey.withColumn("source_id", _id(F.col("source_id"))))
    return pixels.groupBy("source_id").agg(F.sum("m").alias("total"))


@query("q_luma", f"WITH {t.PX_SQL} SELECT source_id, y, x, CAST((19595*m + 38470*(255-m) + 7471*((m*7)%256) + 32768)//65536 AS INTEGER) AS l FROM px")
def q_luma(spark, d):
    return t.with_rgb(t.px(spark, d)).select("source_id", "y", "x", luma(F.col("r"), F.col("g"), F.col("b")).alias("l"))


CFG = dict(patch_size=P, stride=S, min_fg=128, block=24)


@query("q_analyze_files", fg_sql(127) + STATS.format(128))
def q_analyze_files(spark, d):
    """The analysis job over image and mask folders."""
    stats, _, _ = jobs.analyze_patches(
        spark, _png_folder(spark, d, "image", "overlay"), _png_folder(spark, d, "mask", "mask"), jobs.Config(**CFG)
    )
    return stats.withColumn("mean_fg", F.round("mean_fg", 6))


@query("q_segment_images", f"""WITH {SCORED}, st AS (SELECT source_id, y0+dy AS y, x0+dx AS x, CAST(avg(prob) AS FLOAT)::DOUBLE AS prob, any_value(r) AS r, any_value(g) AS g, any_value(b) AS b
  FROM sc JOIN images USING (source_id) WHERE y0+dy < height AND x0+dx < width GROUP BY 1,2,3)
SELECT source_id, CAST(count(*) AS BIGINT) AS pixels, CAST(sum(CAST(prob>=0.5 AS INTEGER)) AS BIGINT) AS fg, round(avg(prob),5) AS mean_prob,
 CAST(sum(CASE WHEN prob>=0.5 THEN r//2 + least(255, g//2+128) + b//2 ELSE r+g+b END) AS BIGINT) AS overlay FROM st GROUP BY 1""")
def q_segment_images(spark, d):
    """Inference from a folder of PNG files to masks and overlays."""
    blocks = jobs.segment_images(spark, _png_folder(spark, d, "image", "overlay"), make_step_model, jobs.Config(**CFG))


    @pandas_udf("pixels long, fg long, total double, overlay long")
    def sums(prob: pd.Series, mask: pd.Series, overlay: pd.Series) -> pd.DataFrame:
        p = prob.map(lambda b: np.frombuffer(b, np.float32).astype(float))
        return pd.DataFrame({
            "pixels": p.map(len), "fg": mask.map(lambda b: int((np.frombuffer(b, np.uint8) == 255).sum())),
            "total": p.map(np.sum), "overlay": overlay.map(lambda b: int(np.frombuffer(b, np.uint8).sum(dtype=np.int64))),
        })

    per = blocks.select(_id(F.col("source_id")).alias("source_id"), sums("prob", "mask", "overlay").alias("s")).select("source_id", "s.*")
    return per.groupBy("source_id").agg(
        F.sum("pixels").alias("pixels"), F.sum("fg").alias("fg"), F.round(F.sum("total") / F.sum("pixels"), 5).alias("mean_prob"),
        F.sum("overlay").alias("overlay"),
    )


# --- model fitting --------------------------------------------------------------------------------

FEATURES = ["r", "b", "z"]


def _training(spark, d):
    pixels = t.with_rgb(t.px(spark, d)).withColumn("label", (F.col("m") > 127).cast("double"))
    groups = splits.distinct_groups(t.px_images(spark, d))
    noisy = pixels.withColumns({"r": F.col("r") % 16, "z": F.col("z").cast("double")})
    return noisy.select("source_id", "y", "x", "width", "height", *FEATURES, "label"), groups


@query("q_fit_pixel_model")
def q_fit_pixel_model(spark, d):
    """Two settings on two folds; the result is the metric log."""
    pixels, groups = _training(spark, d)
    _, log = models.fit_pixel_model(
        pixels, splits.kfold_splits(groups, 2), FEATURES, "label", [{"max_iter": 5}, {"max_iter": 5, "reg": 0.1}]
    )
    return log


@query("q_grouped_cv")
def q_grouped_cv(spark, d):
    pixels, groups = _training(spark, d)
    model = models.grouped_cv(pixels, splits.assign_folds(groups, 2), FEATURES, "label", {"regParam": [0.0, 0.1]}, max_iter=5)
    return models.search_results(model)


def _epoch_sql(k: int, lr: float) -> str:
    """Step and scores of epoch k: w{k} from w{k-1}, then the sums over validation tiles."""
    z = lambda w: f"({w}.a0*x0_+{w}.a1*x1_+{w}.a2*x2_+{w}.a3)"
    loss = lambda z: f"(greatest({z}, 0.0) - {z}*t + ln(1+exp(-abs({z}))))"
    p = f"(1/(1+exp(-{z('w')})) - t)"
    step = ", ".join(f"any_value(w.a{i}) - {lr}::DOUBLE*avg({p}{f'*x{i}_' if i < 3 else ''}) AS a{i}" for i in range(4))
    return f"""w{k} AS MATERIALIZED (SELECT f.fold, {step}, avg({loss(z('w'))}) AS train_loss FROM f JOIN w{k - 1} w USING (fold) WHERE role='train' GROUP BY f.fold),
s{k} AS (SELECT f.fold, source_id, y0, x0, sum(CAST({z('w')} >= 0 AS INTEGER)*t) AS i, sum(CAST({z('w')} >= 0 AS INTEGER)) + sum(t) AS u, sum({loss(z('w'))}) AS l, count(*) AS n
  FROM f JOIN w{k} w USING (fold) WHERE role='val' GROUP BY f.fold, source_id, y0, x0),
i{k} AS (SELECT fold, source_id, sum((2*i+1e-6)/(u+1e-6)) AS d, count(*) AS tiles, sum(i) AS i, sum(u) AS u, sum(l) AS l, sum(n) AS n FROM s{k} GROUP BY 1,2)"""


def _log_sql(k: int, lr: float) -> str:
    return f"""SELECT i.fold, CAST({k} AS INTEGER) AS epoch, {lr}::DOUBLE AS lr, round(any_value(train_loss), 6) AS train_loss, round(sum(l)/sum(n), 6) AS val_loss,
  round(sum(d)/sum(tiles), 6) AS val_dice_per_patch, round(avg((2*i+1e-6)/(u+1e-6)), 6) AS val_dice_per_image FROM i{k} i JOIN w{k} USING (fold) GROUP BY i.fold"""


_NORMAL = ", ".join(f"({c}/255.0::DOUBLE - {m})/{s}::DOUBLE AS x{i}_" for i, (c, m, s) in enumerate(zip("rgb", transforms.MEAN, transforms.STD)))


@query("q_train_tiles", f"""WITH {RGB}, k AS (SELECT source_id, CAST((row_number() OVER (ORDER BY md5('42:'||source_id)) - 1)%2 AS INTEGER) AS own FROM images),
f AS MATERIALIZED (SELECT CAST(n AS INTEGER) AS fold, CASE WHEN n=own THEN 'val' ELSE 'train' END AS role, source_id, y0, x0, t, {_NORMAL} FROM c JOIN k USING (source_id), range(2) r(n)),
w0 AS (SELECT DISTINCT fold, 0.0::DOUBLE AS a0, 0.0::DOUBLE AS a1, 0.0::DOUBLE AS a2, 0.0::DOUBLE AS a3 FROM f),
{_epoch_sql(1, 0.5)}, {_epoch_sql(2, 0.5)} {_log_sql(1, 0.5)} UNION ALL {_log_sql(2, 0.5)}""")
def q_train_tiles(spark, d):
    """Two epochs on two folds of images: the log with its rates, losses and metrics per tile and per image."""
    roles = splits.kfold_splits(splits.distinct_groups(t.px_images(spark, d)), 2)
    _, log = training.train_tiles(packed_tiles(spark, d), roles, 2, 0.5)
    return log.select("fold", "epoch", "lr", *[F.round(c, 6).alias(c) for c in ("train_loss", "val_loss", "val_dice_per_patch", "val_dice_per_image")])


@query("q_ridge_cv", f"""WITH {t.PX_SQL}, k AS (SELECT source_id, CAST((row_number() OVER (ORDER BY md5('42:'||source_id)) - 1)%3 AS INTEGER) AS fold FROM images),
o AS (SELECT fold, count(*)::DOUBLE AS n, sum(z) AS sx, sum(m::DOUBLE) AS sy, sum(z*z) AS xx, sum(z*m) AS xy, sum(m::DOUBLE*m) AS yy FROM px JOIN k USING (source_id) GROUP BY fold),
r AS (SELECT o.*, sum(n) OVER () - n AS rn, sum(sx) OVER () - sx AS rsx, sum(sy) OVER () - sy AS rsy, sum(xx) OVER () - xx AS rxx, sum(xy) OVER () - xy AS rxy FROM o),
b AS (SELECT *, (rn*rxy - rsx*rsy)/(rn*(rxx + penalty*rn) - rsx*rsx) AS b1 FROM r, (VALUES (0.0::DOUBLE), (0.1::DOUBLE), (5.0::DOUBLE)) v(penalty)),
e AS (SELECT *, (rsy - b1*rsx)/rn AS b0 FROM b)
SELECT penalty, fold, round((yy - 2*b1*xy - 2*b0*sy + b1*b1*xx + 2*b0*b1*sx + b0*b0*n)/n, 4) AS mse FROM e""")
def q_ridge_cv(spark, d):
    """Held-out errors of a ridge regression for three penalties on three folds of images, from one pass."""
    folds = splits.assign_folds(splits.distinct_groups(t.px_images(spark, d)), 3)
    scores = training.ridge_cv(t.px(spark, d), folds.select("source_id", F.col("fold").cast("int").alias("fold")), ["z"], "m", [0.0, 0.1, 5.0])
    return scores.withColumn("mse", F.round("mse", 4))


@query("q_loss_history")
def q_loss_history(spark, d):
    pixels, _ = _training(spark, d)
    near = models.neighbourhood(pixels, ["z"], ["source_id"])
    return models.loss_history(models.default_estimator([*FEATURES, "z_max", "z_min"], "label", 5).fit(near))


@query("q_loss_start", f"""WITH {t.PX_SQL}, s AS (SELECT avg(CAST(m>127 AS INTEGER)) AS p FROM px)
SELECT CAST(0 AS INTEGER) AS iteration, round(-(p*ln(p) + (1-p)*ln(1-p)), 5) AS loss FROM s""")
def q_loss_start(spark, d):
    """The fit starts from the share of the classes, so its first loss is their entropy."""
    pixels, _ = _training(spark, d)
    history = models.loss_history(models.default_estimator(FEATURES, "label", 2).fit(pixels))
    return history.where("iteration = 0").withColumn("loss", F.round("loss", 5))


@query("q_neighbourhood", f"""WITH {t.PX_SQL}, n AS (SELECT a.source_id, a.y, a.x, max(b.m) AS hi,
  min(CASE WHEN a.y=b.y OR a.x=b.x THEN b.m END) AS lo FROM px a JOIN px b ON b.source_id=a.source_id AND abs(b.y-a.y)<=1 AND abs(b.x-a.x)<=1 GROUP BY 1,2,3)
SELECT source_id, y, x, hi AS m_max, lo AS m_min FROM n""")
def q_neighbourhood(spark, d):
    """Features from each pixel's neighbours."""
    near = models.neighbourhood(t.px(spark, d).select("source_id", "y", "x", "m"), ["m"], ["source_id"])
    return near.select("source_id", "y", "x", "m_max", "m_min")


FOLDER_ROWS = 100_000  # images and annotations of an export folder, so that a document stays far below the size of a row


def has_file(image_id):
    """Which images of the exports come with a file."""
    return F.floor(image_id / 2) % 10 == 0


def _coco_folder(spark, d):
    """The annotated orders as export folders <batch>--<k> of bounded size: one document each, beside it the files of its images
    in ten."""
    root = scratch_path(spark, "coco")
    images = t.coco_images(spark, d)
    folders = 1 + (images.count() + t.coco_polygons(spark, d).count()) // FOLDER_ROWS
    images = images.withColumn("batch", F.concat("batch", F.lit("--"), F.pmod(F.xxhash64("file_name"), F.lit(folders)).cast("string")))
    shapes = t.coco_polygons(spark, d).join(images.select("image_id", "batch"), "image_id")
    listed = images.groupBy("batch").agg(
        F.array_sort(F.collect_list(F.struct(F.col("image_id").alias("id"), "file_name", "width", "height"))).alias("images"),
        F.collect_set(F.when(has_file(F.col("image_id")), F.col("file_name"))).alias("files"),
    )
    drawn = shapes.groupBy("batch").agg(
        F.collect_list(F.struct("image_id", "category_id", F.col("polygons").alias("segmentation"))).alias("annotations")
    )
    categories = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(n).alias("name")) for i, n in ((1, "old"), (2, "hypha"), (1, "Inoculum"))])
    docs = listed.join(drawn, "batch", "left").withColumn("annotations", F.coalesce("annotations", F.array()))
    docs = docs.select("batch", F.to_json(F.struct(categories.alias("categories"), "images", "annotations")).alias("doc"), "files")
    folder = sinks.task_folder(spark, root)

    def write(frames):
        from pyarrow import fs as pafs

        for pdf in frames:
            for batch, doc, names in zip(pdf.batch, pdf.doc, pdf.files):
                store, base = pafs.FileSystem.from_uri(folder)
                for below in ("annotations", "images/default"):
                    store.create_dir(f"{base}/{batch}/{below}", recursive=True)
                sinks.put_file(f"{folder}/{batch}/annotations", "instances_default.json", doc.encode())
                for name in ["extra.jpg", *names]:
                    sinks.put_file(f"{folder}/{batch}/images/default", name, name.encode())
            yield pd.DataFrame({"n": [len(pdf)]})

    docs.mapInPandas(write, "n long").agg(F.sum("n")).collect()
    return root


@query("q_coco_export", f"""WITH {t.COCO_SQL}, s AS (SELECT image_id, CAST(count(*) AS BIGINT) AS fg, CAST(sum(y*64+x) AS BIGINT) AS moment FROM coco_fg GROUP BY 1)
SELECT batch, image_id, coalesce(fg, 0) AS fg, coalesce(moment, 0) AS moment FROM coco_images LEFT JOIN s USING (image_id)""")
def q_coco_export(spark, d):
    """Export documents written, read back, typed and painted: the label export up to its rasters."""
    masks = jobs.export_masks(*jobs.stored_exports(spark, _coco_folder(spark, d)))

    @pandas_udf("fg long, moment long")
    def sums(mask: pd.Series) -> pd.DataFrame:
        at = [np.flatnonzero(np.frombuffer(m, np.uint8)) for m in mask]
        return pd.DataFrame({"fg": [len(a) for a in at], "moment": [int(a.sum()) for a in at]})

    batch = F.regexp_replace("batch", r"--\d+$", "").alias("batch")
    return masks.select(batch, "image_id", sums("mask").alias("s")).select("batch", "image_id", "s.*")


@query("q_coco_to_masks", f"""WITH {t.COCO_SQL}, u AS (SELECT batch, file_name, max(image_id) AS image_id FROM coco_images GROUP BY 1,2),
s AS (SELECT image_id, CAST(count(*) AS BIGINT) AS fg, CAST(sum(y*64+x) AS BIGINT) AS moment FROM coco_fg GROUP BY 1),
w AS (SELECT batch, file_name, image_id FROM u WHERE image_id//2 % 10 = 0)
SELECT 'mask' AS kind, batch||'_'||replace(file_name, '.jpg', '.png') AS name, coalesce(fg, 0) AS fg, coalesce(moment, 0) AS moment FROM w LEFT JOIN s USING (image_id)
UNION ALL SELECT 'image', batch||'_'||file_name, CAST(length(file_name) AS BIGINT), CAST(-1 AS BIGINT) FROM w
UNION ALL SELECT 'image', batch||'_extra.jpg', CAST(9 AS BIGINT), CAST(-1 AS BIGINT) FROM (SELECT DISTINCT batch FROM coco_images)""")
def q_coco_to_masks(spark, d):
    """The whole label export, and what is then in its two folders: masks by their foreground, copies by their length."""
    out = scratch_path(spark, "coco-out")
    jobs.coco_to_masks(spark, _coco_folder(spark, d), out)

    @pandas_udf("fg long, moment long")
    def sums(data: pd.Series) -> pd.DataFrame:
        at = [np.flatnonzero(np.frombuffer(m, np.uint8)) for m in data]
        return pd.DataFrame({"fg": [len(a) for a in at], "moment": [int(a.sum()) for a in at]})

    plain = lambda c: F.regexp_replace(c, r"--\d+_", "_").alias("name")
    masks = files.read_images(spark, f"{out}/masks").select(F.lit("mask").alias("kind"), plain("source_id"), sums("data").alias("s"))
    copies = files.list_masks(spark, f"{out}/images").select(F.lit("image").alias("kind"), plain("source_id"), F.col("length").alias("fg"), F.lit(-1).cast("long").alias("moment"))
    return masks.select("kind", "name", "s.*").unionByName(copies.distinct())


@query("q_fold_errors", """WITH n AS (SELECT count(DISTINCT vec_id//16) AS have FROM embeddings), a(n_splits) AS (VALUES (0), (1), (2), (5), (1000000))
SELECT CAST(n_splits AS INTEGER) AS n_splits, CASE WHEN n_splits < 2 THEN 'n_splits must be at least 2'
 WHEN have < n_splits THEN n_splits||' folds need at least as many groups, found '||have ELSE 'ok' END AS verdict FROM a, n""")
def q_fold_errors(spark, d):
    """What the checks of grouped folds say about the images of the table."""
    groups = splits.distinct_groups(t.px_images(spark, d))

    def verdict(n):
        try:
            splits.check_folds(groups, n)
            return "ok"
        except ValueError as e:
            return str(e)

    return spark.createDataFrame([(n, verdict(n)) for n in (0, 1, 2, 5, 1_000_000)], "n_splits int, verdict string")
