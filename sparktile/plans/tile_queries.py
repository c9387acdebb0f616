"""Queries over tile grids, foreground statistics, file pairing and splits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions import binarize_mask
from ..functions import stem as stem_of
from ..functions.table_functions import register_table_functions
from ..operators import blocks, pairing, patch_stats, splits, tiling
from ..sources import tables as t
from .catalog import query

P, S = 16, 12  # patch and stride on the 32x32 images
BIG_P, BIG_S = 64, 48  # on the part-sized images
BLOCK = 13  # lattice side of the block tables: tiles cross two blocks and more on each axis


def positions_sql(length: str, p: int, s: int) -> str:
    """DuckDB list of tile origins."""
    return (
        f"CASE WHEN {length} <= {p} THEN [0] ELSE list_distinct("
        f"list_concat(range(0, {length}-{p}+1, {s}), [{length}-{p}])) END"
    )


def grid_sql(images: str, p: int, s: int) -> str:
    return f"""
ys AS (SELECT source_id, width, height, CAST(unnest({positions_sql('height', p, s)}) AS INTEGER) AS y0 FROM {images}),
grid AS (SELECT source_id, width, height, y0, CAST(unnest({positions_sql('width', p, s)}) AS INTEGER) AS x0 FROM ys)"""


PX_GRID = t.PX_SQL + "," + grid_sql("images", P, S)


def fg_sql(thr: int) -> str:
    return f"""WITH {PX_GRID},
fg AS (
  SELECT g.source_id, g.y0, g.x0, CAST(count(*) FILTER (WHERE p.m > {thr}) AS BIGINT) AS fg
  FROM grid g JOIN px p ON p.source_id=g.source_id AND p.y >= g.y0 AND p.y < g.y0+{P} AND p.x >= g.x0 AND p.x < g.x0+{P}
  GROUP BY 1,2,3)"""


def _fg(spark, d, thr=127):
    return tiling.foreground_count(t.px(spark, d), t.px_images(spark, d), P, S, thr)


@query("q_tile_grid", f"WITH {t.DIMS_SQL},{grid_sql('dims', BIG_P, BIG_S)} SELECT source_id, y0, x0 FROM grid")
def q_tile_grid(spark, d):
    return tiling.tile_grid(t.dims(spark, d), BIG_P, BIG_S).select("source_id", "y0", "x0")


@query("q_tile_grid_overlap", f"WITH {t.DIMS_SQL},{grid_sql('dims', BIG_P, BIG_S)} SELECT source_id, CAST(count(*) AS BIGINT) AS tiles FROM grid GROUP BY 1")
def q_tile_grid_overlap(spark, d):
    return tiling.tile_grid(t.dims(spark, d), BIG_P, overlap=BIG_P - BIG_S).groupBy("source_id").agg(F.count("*").alias("tiles"))


@query("q_tile_grid_lateral", f"""WITH {t.DIMS_SQL},{grid_sql('dims', BIG_P, BIG_S)}
SELECT source_id, y0, x0, least(y0+{BIG_P},height)-1 AS y1, least(x0+{BIG_P},width)-1 AS x1 FROM grid""")
def q_tile_grid_lateral(spark, d):
    """The grid from SQL, by the table function, with the last row and column of every tile."""
    text = f"SELECT source_id, y0, x0, y1, x1 FROM {{images}}, LATERAL tile_positions(width, height, {BIG_P}, {BIG_S}, corners => true)"
    return register_table_functions(spark).sql(text, images=t.dims(spark, d))


@query("q_debug_grid", f"""WITH {t.DIMS_SQL},
c AS (SELECT source_id, width, height, unnest(range(0, height, {BIG_P})) AS y0 FROM dims),
d AS (SELECT source_id, width, height, y0, unnest(range(0, width, {BIG_P})) AS x0 FROM c)
SELECT source_id, CAST(x0 AS INTEGER) AS x0, CAST(y0 AS INTEGER) AS y0,
  CAST(least(x0+{BIG_P - 1}, width-1) AS INTEGER) AS x1, CAST(least(y0+{BIG_P - 1}, height-1) AS INTEGER) AS y1,
  CAST(row_number() OVER (PARTITION BY source_id ORDER BY y0, x0) AS INTEGER) AS cell FROM d""")
def q_debug_grid(spark, d):
    return tiling.debug_grid(t.dims(spark, d), BIG_P)


@query("q_tile_foreground", fg_sql(127) + " SELECT source_id, y0, x0, fg FROM fg")
def q_tile_foreground(spark, d):
    return _fg(spark, d).select("source_id", "y0", "x0", "fg")


@query("q_tile_foreground_packed", fg_sql(127) + " SELECT source_id, y0, x0, fg FROM fg")
def q_tile_foreground_packed(spark, d):
    return tiling.foreground_count_packed(t.px_packed(spark, d), P, S).select("source_id", "y0", "x0", "fg")


@query("q_tile_filter", fg_sql(127) + " SELECT source_id, y0, x0, fg FROM fg WHERE fg >= 128")
def q_tile_filter(spark, d):
    tiles = tiling.build_tiles(t.px_images(spark, d), t.px(spark, d), P, S, min_fg=128)
    return tiles.select("source_id", "y0", "x0", "fg")


@query("q_tile_filter_sparse", fg_sql(180) + " SELECT source_id, y0, x0, fg FROM fg WHERE fg >= 2")
def q_tile_filter_sparse(spark, d):
    tiles = tiling.build_tiles(t.px_images(spark, d), t.px(spark, d), P, S, mask_threshold=180, min_fg=2)
    return tiles.select("source_id", "y0", "x0", "fg")


STATS = """ SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE fg>={0}) AS BIGINT) AS kept,
 CAST(count(*) FILTER (WHERE fg<{0}) AS BIGINT) AS discarded, CAST(count(*) FILTER (WHERE fg=0) AS BIGINT) AS empty,
 min(fg) AS min_fg, max(fg) AS max_fg, round(avg(fg),6) AS mean_fg FROM fg"""


@query("q_patch_stats", fg_sql(127) + STATS.format(128))
def q_patch_stats(spark, d):
    return patch_stats.patch_stats(_fg(spark, d), 128).withColumn("mean_fg", F.round("mean_fg", 6))


@query("q_patch_stats_sparse", fg_sql(180) + STATS.format(2))
def q_patch_stats_sparse(spark, d):
    packed = patch_stats.foreground_distribution(t.px_packed(spark, d), P, S, 180)
    return patch_stats.patch_stats(packed, 2).withColumn("mean_fg", F.round("mean_fg", 6))


@query("q_patch_histogram", fg_sql(127) + """ SELECT CAST(b AS INTEGER) AS bin, CAST(b*25 AS INTEGER) AS bin_start,
 CAST(count(fg) AS BIGINT) AS tiles FROM range(41) r(b) LEFT JOIN fg ON least(fg//25, 40)=b GROUP BY b""")
def q_patch_histogram(spark, d):
    return patch_stats.fg_histogram(_fg(spark, d))


@query("q_crop_pad", f"""WITH {PX_GRID}, side AS (SELECT CAST(i AS INTEGER) AS i FROM range({P}) r(i))
SELECT g.source_id, g.y0, g.x0, a.i AS dy, b.i AS dx, coalesce(p.m, 0) AS m
FROM grid g, side a, side b LEFT JOIN px p ON p.source_id=g.source_id AND p.y=g.y0+a.i AND p.x=g.x0+b.i""")
def q_crop_pad(spark, d):
    tiles = tiling.crop_pad(t.px(spark, d), t.px_images(spark, d), P, S, ["m"])
    return tiles.select("source_id", "y0", "x0", "dy", "dx", "m")


@query("q_tile_samples", f"""{fg_sql(127)},
side AS (SELECT CAST(i AS INTEGER) AS i FROM range({P}) r(i)),
cells AS (SELECT f.source_id, f.y0, f.x0, a.i AS dy, b.i AS dx, coalesce(p.m,0) AS m, p.m IS NULL AS pad
  FROM (SELECT * FROM fg WHERE fg >= 128) f, side a, side b
  LEFT JOIN px p ON p.source_id=f.source_id AND p.y=f.y0+a.i AND p.x=f.x0+b.i)
SELECT source_id, y0, x0, CAST({P} AS INTEGER) AS patch_size,
  CAST(sum(CASE WHEN m>127 THEN dy*{P}+dx ELSE 0 END) AS BIGINT) AS mask_moment,
  CAST(sum(CASE WHEN pad THEN 0 ELSE (m+2*(255-m)+3*((m*7)%256))*(dy*{P}+dx) END) AS BIGINT) AS image_moment
FROM cells GROUP BY 1,2,3""")
def q_tile_samples(spark, d):
    """Payload tiles of the filtered manifest, checked through position-weighted sums of their bytes."""

    @pandas_udf("mask_moment long, image_moment long")
    def moments(image: pd.Series, mask: pd.Series) -> pd.DataFrame:
        at = np.arange(P * P)
        m = np.stack([np.frombuffer(b, np.uint8) for b in mask]).astype(np.int64)
        i = np.stack([np.frombuffer(b, np.uint8) for b in image]).astype(np.int64).reshape(-1, P * P, 3)
        return pd.DataFrame({"mask_moment": m @ at, "image_moment": (i @ np.array([1, 2, 3])) @ at})

    manifest = tiling.filter_empty_tiles(_fg(spark, d), 128)
    tiles = blocks.cut_block_tiles(blocks.block_pixels(t.with_rgb(t.px(spark, d)), BLOCK), P, S, BLOCK, manifest=manifest)
    return tiles.withColumn("v", moments("image", "mask")).select("source_id", "y0", "x0", "patch_size", "v.*")


@query("q_binarize", f"WITH {t.PX_SQL} SELECT source_id, y, x, CAST(m > 140 AS INTEGER) AS t FROM px")
def q_binarize(spark, d):
    return t.px(spark, d).select("source_id", "y", "x", binarize_mask(F.col("m"), 140).cast("int").alias("t"))


BATCH = """ SELECT source_id, y0, x0, CAST(row_number() OVER (ORDER BY {order}) - 1 AS BIGINT) AS idx,
 CAST((row_number() OVER (ORDER BY {order}) - 1)//4 AS BIGINT) AS batch FROM grid"""


@query("q_batches_ordered", f"WITH {PX_GRID}" + BATCH.format(order="source_id, y0, x0"))
def q_batches_ordered(spark, d):
    tiles = tiling.tile_grid(t.px_images(spark, d), P, S)
    return tiling.batches(tiles, 4, shuffle=False).select("source_id", "y0", "x0", "idx", "batch")


@query("q_batches_shuffled", f"WITH {PX_GRID}" + BATCH.format(order="md5('7:3:'||source_id||':'||y0||':'||x0)"))
def q_batches_shuffled(spark, d):
    tiles = tiling.tile_grid(t.px_images(spark, d), P, S)
    return tiling.batches(tiles, 4, shuffle=True, seed=7, epoch=3).select("source_id", "y0", "x0", "idx", "batch")


# --- pairing ------------------------------------------------------------------------------------


def _files(spark, d):
    return pairing.select_images(t.image_paths(spark, d)), pairing.with_names(t.mask_paths(spark, d))


@query("q_list_images", f"WITH {t.FILES_SQL} SELECT path, source_id, stem FROM image_files")
def q_list_images(spark, d):
    return _files(spark, d)[0]


@query("q_dedupe_stems", f"WITH {t.FILES_SQL} SELECT stem, mask_path AS path FROM mask_map")
def q_dedupe_stems(spark, d):
    return pairing.dedupe_stems(_files(spark, d)[1])


@query("q_pairs", f"WITH {t.FILES_SQL} SELECT stem, split_part(image_path,'/',2) AS source_id, image_path, mask_path FROM image_map JOIN mask_map USING (stem)")
def q_pairs(spark, d):
    return pairing.pair_images_masks(*_files(spark, d))


@query("q_missing_masks", f"WITH {t.FILES_SQL} SELECT stem FROM image_map EXCEPT SELECT stem FROM mask_map")
def q_missing_masks(spark, d):
    return pairing.missing_masks(*_files(spark, d))


@query("q_missing_images", f"WITH {t.FILES_SQL} SELECT stem FROM mask_map EXCEPT SELECT stem FROM image_map")
def q_missing_images(spark, d):
    return pairing.missing_images(*_files(spark, d))


@query("q_pair_diagnostics", f"""WITH {t.FILES_SQL} SELECT CAST(count(i.stem) FILTER (WHERE m.stem IS NOT NULL) AS BIGINT) AS pairs,
 CAST(count(*) FILTER (WHERE m.stem IS NULL) AS BIGINT) AS missing_masks, CAST(count(*) FILTER (WHERE i.stem IS NULL) AS BIGINT) AS missing_images
 FROM image_map i FULL OUTER JOIN mask_map m ON i.stem=m.stem""")
def q_pair_diagnostics(spark, d):
    return pairing.pair_diagnostics(*_files(spark, d))


# --- splits -------------------------------------------------------------------------------------

N = 5
PAIR_SQL = f"{t.FILES_SQL}, pairs AS (SELECT stem, split_part(image_path,'/',2) AS source_id FROM image_map JOIN mask_map USING (stem))"
FOLD_SQL = PAIR_SQL + """, folds AS (SELECT source_id, CAST((row_number() OVER (ORDER BY {order}) - 1)%5 AS INTEGER) AS fold FROM pairs)"""
HASHED = "md5('42:'||source_id)"


def _groups(spark, d):
    return splits.distinct_groups(pairing.pair_images_masks(*_files(spark, d)))


@query("q_distinct_groups", f"WITH {t.COCO_SQL} SELECT image_id AS source_id, min(x0) AS ord FROM coco_ann GROUP BY 1")
def q_distinct_groups(spark, d):
    return splits.distinct_groups(t.coco_rectangles(spark, d), "image_id", "x0")


@query("q_kfold", "WITH " + FOLD_SQL.format(order=HASHED) + " SELECT source_id, fold FROM folds")
def q_kfold(spark, d):
    return splits.assign_folds(_groups(spark, d), N)


@query("q_kfold_input_order", "WITH " + FOLD_SQL.format(order="source_id") + " SELECT source_id, fold FROM folds")
def q_kfold_input_order(spark, d):
    return splits.assign_folds(_groups(spark, d), N, shuffle=False)


@query("q_kfold_expand", "WITH " + FOLD_SQL.format(order=HASHED) + """ SELECT CAST(n AS INTEGER) AS fold, source_id,
 CASE WHEN n=fold THEN 'val' ELSE 'train' END AS role FROM folds, range(5) r(n)""")
def q_kfold_expand(spark, d):
    return splits.kfold_splits(_groups(spark, d), N)


@query("q_manual_split", f"""WITH {PAIR_SQL}, want AS (
  SELECT CASE WHEN quality=1 THEN 'doc_'||doc_id ELSE 'doc_'||doc_id||'.JPG' END AS val_id FROM labels)
SELECT CAST(0 AS INTEGER) AS fold, source_id,
 CASE WHEN EXISTS (SELECT 1 FROM want w WHERE w.val_id=p.source_id OR w.val_id=p.stem) THEN 'val' ELSE 'train' END AS role
FROM pairs p""")
def q_manual_split(spark, d):
    """Validation ids of all labels, by stem for good ones and by file name for the others; what names no group is told by ``unknown_ids``."""
    groups = _groups(spark, d)
    doc = F.concat(F.lit("doc_"), "doc_id")
    want = t.table(spark, d, "labels").select(F.when(F.col("quality") == 1, doc).otherwise(F.concat(doc, F.lit(".JPG"))).alias("val_id"))
    unknown = splits.unknown_ids(groups, want)
    return splits.manual_split(groups, want.join(unknown, "val_id", "left_anti"))


@query("q_unknown_ids", f"""WITH {PAIR_SQL}, want AS (
  SELECT CASE WHEN quality=1 THEN 'doc_'||doc_id ELSE 'doc_'||doc_id||'.JPG' END AS val_id FROM labels)
SELECT val_id FROM want w WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE w.val_id=p.source_id OR w.val_id=p.stem)""")
def q_unknown_ids(spark, d):
    """Every validation id of all labels that names no group."""
    doc = F.concat(F.lit("doc_"), "doc_id")
    want = t.table(spark, d, "labels").select(F.when(F.col("quality") == 1, doc).otherwise(F.concat(doc, F.lit(".JPG"))).alias("val_id"))
    return splits.unknown_ids(_groups(spark, d), want)


@query("q_fold_summary", f"""{fg_sql(127)},
folds AS (SELECT source_id, (row_number() OVER (ORDER BY md5('42:'||source_id)) - 1)%3 AS own FROM images),
s AS (SELECT n AS fold, source_id, n=own AS val FROM folds, range(3) r(n)),
k AS (SELECT source_id, count(*) AS tiles FROM fg WHERE fg >= 128 GROUP BY 1)
SELECT CAST(fold AS INTEGER) AS fold, CAST(count(*) FILTER (WHERE NOT val) AS BIGINT) AS train_images, CAST(count(*) FILTER (WHERE val) AS BIGINT) AS val_images,
 CAST(coalesce(sum(tiles) FILTER (WHERE NOT val),0) AS BIGINT) AS train_tiles, CAST(coalesce(sum(tiles) FILTER (WHERE val),0) AS BIGINT) AS val_tiles
FROM s LEFT JOIN k USING (source_id) GROUP BY fold""")
def q_fold_summary(spark, d):
    groups = splits.distinct_groups(t.px_images(spark, d))
    kept = tiling.filter_empty_tiles(_fg(spark, d), 128)
    return splits.fold_summary(kept, splits.kfold_splits(groups, 3))


@query("q_apply_split", f"""WITH {PX_GRID},
folds AS (SELECT source_id, (row_number() OVER (ORDER BY md5('42:'||source_id)) - 1)%3 AS own FROM images)
SELECT CAST(n AS INTEGER) AS fold, source_id, y0, x0, CASE WHEN n=own THEN 'val' ELSE 'train' END AS role
FROM grid JOIN folds USING (source_id), range(3) r(n)""")
def q_apply_split(spark, d):
    images = t.px_images(spark, d)
    roles = splits.kfold_splits(splits.distinct_groups(images), 3)
    return tiling.tile_grid(splits.apply_split(images, roles), P, S).select("fold", "source_id", "y0", "x0", "role")
