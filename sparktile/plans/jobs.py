"""End-to-end jobs composed of the operators."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import stem
from ..operators import annotations as ann
from ..operators import blocks, patch_stats, scoring, splits, tiling, transforms
from ..operators.pairing import IMAGE_EXTENSIONS, pair_diagnostics
from ..session import scratch_path
from ..sources import coco, committed, files, sinks


@dataclass
class Config:
    """Parameters shared by the jobs. ``stride`` None means patch_size - overlap."""

    patch_size: int = 512
    overlap: int = 128
    stride: int | None = 384
    filter_empty: bool = True
    mask_threshold: int = 127
    min_fg: int = 1
    image_size: int | None = None
    image_extensions: tuple = IMAGE_EXTENSIONS
    augmentations: dict = field(default_factory=dict)
    threshold: float = 0.5
    batch_size: int = 8
    block: int = scoring.BLOCK
    split_mode: str = "train_val"  # or kfold
    val_ids: tuple = ()
    n_splits: int = 5
    shuffle_groups: bool = True
    random_state: int = 42
    save_probabilities: bool = False

    @property
    def step(self) -> int:
        return self.stride or self.patch_size - self.overlap


def analyze_patches(spark: SparkSession, images_dir: str, masks_dir: str, cfg: Config) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stats, histogram, diagnostics) of the foreground over all candidate tiles of a dataset."""
    diagnostics = pair_diagnostics(files.list_images(spark, images_dir, cfg.image_extensions), files.list_masks(spark, masks_dir))
    if not diagnostics.first().pairs:
        raise ValueError("no matching image and mask found")
    pairs = files.load_pairs(spark, images_dir, masks_dir, cfg.image_extensions)
    fg = patch_stats.foreground_distribution(pairs, cfg.patch_size, cfg.step, cfg.mask_threshold)
    return patch_stats.patch_stats(fg, cfg.min_fg), patch_stats.fg_histogram(fg), diagnostics


def make_splits(records: DataFrame, cfg: Config) -> DataFrame:
    """fold, source_id, role by the configured mode."""
    groups = splits.distinct_groups(records)
    if cfg.split_mode == "kfold":
        return splits.kfold_splits(groups, cfg.n_splits, cfg.shuffle_groups, cfg.random_state)
    if cfg.split_mode == "train_val":
        return splits.manual_split(groups, list(cfg.val_ids))
    raise ValueError(f"unknown split mode {cfg.split_mode!r}; use train_val or kfold")


def prepare_samples(pairs: DataFrame, roles: DataFrame, cfg: Config, seed: int = 42, epoch: int = 0) -> tuple[DataFrame, DataFrame]:
    """(train, val) samples of all folds at once: tile key, tensor, mask and ``folds``, the array of
    folds in which the sample plays that role.

    Roles meet the image rows, before cutting, and ride along as an array: no tile payload is
    shuffled or repeated per fold, and an image with very many tiles is no hot join key. One
    fold's training set is ``train.where(array_contains(folds, f))``.
    """
    least = cfg.min_fg if cfg.filter_empty else 0
    per_image = roles.groupBy("source_id").agg(*[
        F.array_sort(F.collect_set(F.when(F.col("role") == r, F.col("fold")))).alias(r) for r in ("train", "val")
    ])
    known = pairs.join(per_image, "source_id")

    def tiles(role):
        mine = known.where(F.size(role) > 0).withColumn("folds", F.col(role))
        return tiling.cut_tiles(mine, cfg.patch_size, cfg.step, cfg.mask_threshold, least, carry=("folds",))

    return (
        transforms.augment_tiles(tiles("train"), cfg.augmentations, seed, epoch, cfg.image_size, ("folds",)),
        transforms.eval_transform(tiles("val"), cfg.augmentations, cfg.image_size, ("folds",)),
    )


def segment(images: DataFrame, make_predict, cfg: Config) -> DataFrame:
    """Score packed RGB images and return stitched, rendered blocks: prob, mask, overlay."""
    return segment_blocks(blocks.block_images(images.select("source_id", "width", "height", "image"), cfg.block), make_predict, cfg)


def segment_blocks(table: DataFrame, make_predict, cfg: Config) -> DataFrame:
    """The same from a block table, for images of any size: no task or row holds an image.

    The table is read twice, for scores and for colours; write it before if it is costly to make.
    """
    prepare = transforms.eval_kernel(cfg.augmentations, cfg.image_size)
    return blocks.score_blocks(
        table, make_predict, cfg.patch_size, cfg.step, prepare, cfg.image_size or cfg.patch_size, cfg.batch_size, cfg.threshold, cfg.block
    )


def segment_images(spark: SparkSession, path: str, make_predict, cfg: Config) -> DataFrame:
    """Batch inference over an image file or a folder of images; see ``segment`` for the result."""
    files.require_rows(files.list_images(spark, path, cfg.image_extensions), "input images")
    images = files.read_images(spark, path, exts=None if files.is_file(spark, path) else cfg.image_extensions)
    stored = scratch_path(spark, "image-blocks")  # files are decoded once
    blocks.block_images(files.decode_rgb(images).select("source_id", "width", "height", "image"), cfg.block).write.parquet(stored)
    return segment_blocks(spark.read.parquet(stored), make_predict, cfg)


def write_segmentation(table: DataFrame, out: str, save_probabilities: bool = False) -> int:
    """<stem>_mask.png, <stem>_overlay.png and optionally <stem>_prob.png per image; the number of images.

    The blocks are stored once in shared storage, so the model runs once; files are put together from lines of blocks, so no
    row or task holds an image, and appear together when all are written. Of images with one stem the last by name is written,
    as if files were written in that order.
    """
    spark = table.sparkSession
    stored = scratch_path(spark, "blocks")
    table.write.parquet(stored)
    kept = spark.read.parquet(stored)
    last = kept.groupBy(stem(F.col("source_id")).alias("stem")).agg(F.max("source_id").alias("source_id"))
    named = kept.join(last, "source_id")
    committed.write_block_rasters(named, out, ("mask", "overlay", *(("prob",) if save_probabilities else ())))
    return last.count()


def export_masks(images: DataFrame, annotations: DataFrame, categories: DataFrame, ignore=ann.IGNORED) -> DataFrame:
    """Packed masks of every listed image: batch, image_id, width, height, mask, stem."""
    key = ["batch", "image_id"]
    classed = ann.annotation_classes(annotations, categories, ignore, ["batch"])
    # frames that are parsed as they are read look as small as the index of their ranges: images must not be broadcast for that
    size = images.select(*key, "width", "height").hint("merge")
    typed = coco.typed_segmentation(classed.select(*key, "ign", "segmentation")).join(size, key)
    raster = typed.withColumn("height", F.coalesce(F.get("size", F.lit(0)), "height")).withColumn(
        "width", F.coalesce(F.get("size", F.lit(1)), "width")
    )
    keep = [*key, "ign"]
    spans = ann.shape_spans(raster, keep, packed=True)
    painted = ann.paint_masks(size, ann.compose_mask(spans, key), key)
    names = images.select(*key, stem(F.col("file_name")).alias("stem")).hint("merge")
    return painted.join(names, key)


def _stored(frame: DataFrame, label: str) -> DataFrame:
    frame.write.parquet(path := scratch_path(frame.sparkSession, label))
    return frame.sparkSession.read.parquet(path)


def stored_exports(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Action: what ``read_coco_exports`` reads, stored, so that documents are parsed once."""
    images, annotations, categories = (_stored(f, "coco") for f in coco.read_coco_exports(spark, root))
    return images, annotations, categories


def coco_to_masks(spark: SparkSession, root: str, out: str, ignore=ann.IGNORED, prefix: int | None = None) -> dict:
    """Turn all exports under ``root`` into <out>/images and <out>/masks, replacing both folders.

    ``prefix`` limits the batch part of written names to so many characters; files of batches that then share a name are
    replaced by the last batch's. Returns counts: masks, images, blank (listed without annotations), skipped (masks without
    image file), collided (masks and files lost to an equal name).
    """
    # documents are parsed once, masks painted once
    images, annotations, categories = stored_exports(spark, root)
    have = _stored(coco.image_files(spark, root), "coco-files")
    complete = images.select("batch").distinct()
    have = have.join(complete, "batch", "left_semi")
    # of two entries with one stem in a batch the later one in the document stays
    unique = _stored(images.withColumn("stem", stem(F.col("file_name"))).groupBy("batch", "stem").agg(
        F.max_by(F.struct("image_id", "file_name", "width", "height"), "pos").alias("i")
    ).select("batch", "i.*"), "coco-unique")

    masks = export_masks(unique, annotations, categories, ignore)
    kept = ann.restrict_to_images(masks, have, ("batch", "stem"))
    wanted = ann.restrict_to_images(ann.with_stem(unique, "file_name"), have, ("batch", "stem"))
    stems = ann.prefix_names(wanted.select("batch", "image_id", "stem"), "batch", "stem", prefix)
    named = stems.select("batch", "image_id", F.concat("out_name", F.lit(".png")).alias("out_name"))
    pngs = kept.withColumn("content", sinks.encoded("mask")(F.col("mask"), F.col("height"), F.col("width")))
    committed.write_files(pngs.join(named, ["batch", "image_id"]), f"{out}/masks", replace=True)

    files_named = _stored(ann.prefix_names(have, "batch", "name", prefix).select("path", "out_name", "collided"), "coco-names")
    copies = files.with_content(files.spread_files(files_named.drop("collided")))
    committed.write_files(copies.where("octet_length(content) > 0"), f"{out}/images", replace=True)  # empty files are not copied

    blank = ann.annotations_by_image(unique, annotations, ("batch", "image_id")).where("n_ann = 0").count()
    skipped = ann.restrict_to_images(ann.with_stem(unique, "file_name"), have, ("batch", "stem"), missing=True).count()
    lost = stems.select("collided").unionByName(files_named.select("collided")).agg(F.sum("collided")).first()[0] or 0
    return {"masks": stems.count(), "images": files_named.count(), "blank": blank, "skipped": skipped, "collided": lost}
