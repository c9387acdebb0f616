"""Time the headline queries: BENCH_SF_DIR (default sf0.1) on local[BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "q_tile_grid", "q_tile_foreground", "q_tile_foreground_packed", "q_patch_stats", "q_patch_histogram", "q_crop_pad",
    "q_tile_samples", "q_batches_shuffled", "q_pairs", "q_pair_diagnostics", "q_kfold_expand", "q_fold_summary",
    "q_coco_polygon", "q_coco_rle", "q_coco_painted", "q_coco_prefix", "q_hflip", "q_gauss_blur", "q_augment",
    "q_eval_transform", "q_score_tiles", "q_stitch", "q_stitch_packed", "q_overlay", "q_dice_iou_patch",
    "q_dice_iou_image", "q_dice_iou_image_packed", "q_skeleton", "q_evaluate_losses", "q_evaluate_losses_packed",
    "q_dice_iou_patch_packed", "q_skeleton_packed", "q_best_epoch", "q_running_best", "q_plateau", "q_cv_summary", "q_segment_images",
]


def main() -> None:
    from sparktile.plans import QUERIES
    from sparktile.session import get_spark

    spark = get_spark("bench", f"local[{CPUS}]", spark__sql__shuffle__partitions=CPUS, spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    # one untimed query starts the JVM code paths and the Python workers
    QUERIES["q_tile_foreground_packed"](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
