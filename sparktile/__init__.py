"""Tiled raster and segmentation data on Spark DataFrames."""

from .functions import (
    binarize_mask,
    covering_origins,
    luma,
    overlay_rgb,
    prob_to_u8,
    sigmoid,
    stem,
    threshold_mask,
    tile_positions,
)
from .operators.block_stencils import block_values, cldice_blocks, evaluate_losses_blocks, stencil_blocks, value_pixels
from .operators.blocks import block_images, block_pixels, cut_block_tiles, halo_blocks, score_blocks
from .operators.annotations import (
    annotation_classes,
    annotations_by_image,
    compose_mask,
    mask_coverage,
    mask_pixels,
    paint_masks,
    polygon_spans,
    prefix_names,
    restrict_to_images,
    rle_spans,
)
from .operators.losses import (
    bce,
    bce_dice,
    bce_dice_cldice,
    cldice_score,
    evaluate_losses,
    evaluate_losses_packed,
    hard_cldice,
    soft_cldice,
    soft_dice_loss,
    tversky,
    tversky_soft_cldice,
)
from .operators.metrics import dice, dice_iou_from_logits, epoch_metric, image_metrics, image_metrics_packed, iou
from .operators.models import fit_pixel_model, grouped_cv, loss_history
from .operators.pairing import dedupe_stems, missing_images, missing_masks, pair_diagnostics, pair_images_masks
from .operators.patch_stats import fg_histogram, foreground_distribution, patch_stats
from .operators.runs import (
    at_interval,
    best_epoch,
    cv_stats,
    cv_summary,
    epoch_rows,
    fold_results,
    latest_metric,
    long_scalars,
    plateau_trace,
    rename_legacy_metrics,
    running_best,
)
from .operators.scoring import clip_valid, render, render_blocks, resize_scores, score_tiles, stitch, stitch_packed
from .operators.splits import (
    apply_split,
    assign_folds,
    distinct_groups,
    fold_summary,
    kfold_splits,
    manual_split,
    shuffle_groups,
)
from .operators.stencil import soft_dilate, soft_erode, soft_open, soft_skeleton
from .operators.tiling import (
    batches,
    build_tiles,
    crop_pad,
    cut_tiles,
    debug_grid,
    filter_empty_tiles,
    foreground_count,
    foreground_count_packed,
    tile_grid,
    tile_samples,
    unpack_images,
    unpack_tiles,
)
from .operators.training import apply_model, ridge_cv, train_tiles
from .operators.transforms import (
    affine,
    augment_tiles,
    brightness_contrast,
    clahe,
    clahe_long,
    defocus,
    eval_transform,
    gamma,
    gauss_noise,
    gaussian_blur,
    hflip,
    normalize,
    one_of,
    resize,
    rot90,
    scale_unit,
    to_chw,
    vflip,
)
from .plans.jobs import Config, analyze_patches, coco_to_masks, prepare_samples, segment_blocks, segment_images, write_segmentation
from .session import get_spark
from .sources.coco import read_coco_exports
from .sources.committed import write_block_rasters, write_files
from .sources.files import decode_gray, decode_rgb, image_records, list_images, list_masks, load_pairs, read_images
from .sources.headers import read_headers
from .sources.sinks import write_metrics_csv, write_rasters, write_summary_json

__all__ = [name for name in dir() if not name.startswith("_")]
