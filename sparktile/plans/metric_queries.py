"""Queries over stitching, metrics, losses and stencils."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType

from ..functions import sigmoid, threshold_mask
from ..operators import block_stencils, losses, metrics, scoring, stencil, tiling
from ..sources import tables as t
from .catalog import query
from .tile_queries import P, PX_GRID, S

SAMPLE = ["source_id", "y0", "x0"]


def logit():
    return F.col("z")


def byte():
    return F.col("m")


def truth():
    return (byte() > 127).cast("double")


CELLS = f"""{PX_GRID}, side AS (SELECT CAST(i AS INTEGER) AS i FROM range({P}) r(i)),
cells AS (SELECT g.source_id, g.y0, g.x0, g.width, g.height, a.i AS dy, b.i AS dx, coalesce(p.z, 0.0) AS z, coalesce(p.m, 0) AS m
  FROM grid g, side a, side b LEFT JOIN px p ON p.source_id=g.source_id AND p.y=g.y0+a.i AND p.x=g.x0+b.i),
sc AS (SELECT *, 1.0/(1.0+exp(-(z + (dx-7.5)*0.1))) AS tp, 1.0/(1.0+exp(-z)) AS p, CAST(m>127 AS INTEGER)::DOUBLE AS t FROM cells)"""


def cells(spark, d):
    """Dense 16x16 tiles with logits z and mask bytes m."""
    return tiling.crop_pad(t.px(spark, d), t.px_images(spark, d), P, S, ["z", "m"])


def tile_scores(spark, d):
    """Tile-dependent probabilities, so that overlapping tiles disagree and averaging matters."""
    return cells(spark, d).withColumn("prob", sigmoid(logit() + (F.col("dx") - 7.5) * 0.1))


# --- stitching ----------------------------------------------------------------------------------

STITCHED = CELLS + """,
st AS (SELECT source_id, y0+dy AS y, x0+dx AS x, avg(tp) AS prob, count(*) AS tiles FROM sc
  WHERE y0+dy < height AND x0+dx < width GROUP BY 1,2,3)"""


@query("q_sigmoid_threshold", f"WITH {t.PX_SQL} SELECT source_id, y, x, round(1/(1+exp(-z)),6) AS prob, CASE WHEN 1/(1+exp(-z)) >= 0.5 THEN 255 ELSE 0 END AS mask FROM px")
def q_sigmoid_threshold(spark, d):
    p = sigmoid(logit())
    return t.px(spark, d).select("source_id", "y", "x", F.round(p, 6).alias("prob"), threshold_mask(p).alias("mask"))


@query("q_clip_valid", f"WITH {CELLS} SELECT source_id, y0, x0, CAST(count(*) AS BIGINT) AS pixels FROM cells WHERE y0+dy<height AND x0+dx<width GROUP BY 1,2,3")
def q_clip_valid(spark, d):
    return scoring.clip_valid(cells(spark, d)).groupBy(*SAMPLE).agg(F.count("*").alias("pixels"))


@query("q_stitch", f"WITH {STITCHED} SELECT source_id, y, x, round(prob,6) AS prob, CAST(tiles AS BIGINT) AS tiles FROM st")
def q_stitch(spark, d):
    s = scoring.stitch(tile_scores(spark, d), t.px_images(spark, d), P, S)
    return s.withColumn("prob", F.round("prob", 6))


def packed_scores(spark, d):
    """The long score tiles packed to one float array per tile (256 values), in steps of 1/1024
    so that single precision and the averages over 1, 2 or 4 tiles are exact."""
    at = F.struct(F.col("dy"), F.col("dx"), (F.floor(F.col("prob") * 1024) / F.lit(1024.0)).cast("float").alias("prob"))
    tiles = tile_scores(spark, d).groupBy("source_id", "width", "height", "y0", "x0").agg(
        F.array_sort(F.collect_list(at)).alias("c")
    ).withColumn("c", tiling.once_per_place(F.col("c"), ["dy", "dx"]))
    return tiles.select("source_id", "width", "height", "y0", "x0", F.lit(P).alias("patch_size"), F.col("c.prob").alias("prob"))


STEPPED = STITCHED.replace("avg(tp)", "avg(floor(tp*1024)/1024)")


@query("q_stitch_packed", f"WITH {STEPPED} SELECT source_id, y, x, prob FROM st")
def q_stitch_packed(spark, d):
    blocks = scoring.stitch_packed(packed_scores(spark, d), t.px_images(spark, d), block=24)
    return scoring.unpack_blocks(blocks)


@query("q_stitch_gaps", f"""WITH {t.PX_SQL}, st AS (SELECT source_id, y, x, CASE WHEN y%12 < 8 AND x%12 < 8 OR y>=height-8 AND x%12<8
   OR x>=width-8 AND y%12<8 OR y>=height-8 AND x>=width-8 THEN 1/(1+exp(-z)) ELSE 0 END AS prob FROM px)
 SELECT source_id, y, x, round(prob, 6) AS prob FROM st""")
def q_stitch_gaps(spark, d):
    """Stride 12 over patches of 8 leaves uncovered pixels, which score 0."""
    images = t.px_images(spark, d)
    tiles = tiling.crop_pad(t.px(spark, d), images, 8, 12, ["z"]).withColumn("prob", sigmoid(logit()))
    stitched = scoring.stitch(tiles, images, 8, 12).join(t.px_missing(spark, d), ["source_id", "y", "x"], "left_anti")
    return stitched.select("source_id", "y", "x", F.round("prob", 6).alias("prob"))


RENDER = f"""WITH {STITCHED}, a AS (SELECT s.*, {t.RGB_SQL}, CASE WHEN prob>=0.5 THEN 255 ELSE 0 END AS mask FROM st s JOIN px USING (source_id,y,x))"""


def _rendered(spark, d):
    s = scoring.stitch(tile_scores(spark, d), t.px_images(spark, d), P, S)
    return scoring.render(s.join(t.with_rgb(t.px(spark, d)), ["source_id", "y", "x"]))


@query("q_overlay", RENDER + """ SELECT source_id, y, x, mask,
 CAST(CASE WHEN mask>127 THEN floor(r*0.5) ELSE r END AS INTEGER) AS o_r, CAST(CASE WHEN mask>127 THEN least(255, floor(g*0.5+128)) ELSE g END AS INTEGER) AS o_g,
 CAST(CASE WHEN mask>127 THEN floor(b*0.5) ELSE b END AS INTEGER) AS o_b FROM a""")
def q_overlay(spark, d):
    return _rendered(spark, d).select("source_id", "y", "x", "mask", "o_r", "o_g", "o_b")


@query("q_prob_raster", RENDER + " SELECT source_id, y, x, CAST(floor(prob*255) AS INTEGER) AS prob_u8 FROM a")
def q_prob_raster(spark, d):
    return _rendered(spark, d).select("source_id", "y", "x", "prob_u8")


# --- metrics ------------------------------------------------------------------------------------

TILE_SUMS = CELLS + """,
sums AS (SELECT source_id, y0, x0, sum(CASE WHEN p>=0.5 THEN t ELSE 0 END) AS i, sum(CASE WHEN p>=0.5 THEN 1 ELSE 0 END) AS pp, sum(t) AS tt FROM sc GROUP BY 1,2,3),
scored AS (SELECT source_id, y0, x0, (2*i+1e-6)/(pp+tt+1e-6) AS dice, (i+1e-6)/(pp+tt-i+1e-6) AS iou FROM sums)"""


def _scored(spark, d):
    return metrics.dice_iou_from_logits(cells(spark, d), SAMPLE, logit(), truth())


@query("q_dice_iou_patch", f"WITH {TILE_SUMS} SELECT source_id, y0, x0, round(dice,6) AS dice, round(iou,6) AS iou FROM scored")
def q_dice_iou_patch(spark, d):
    return _scored(spark, d).select(*SAMPLE, F.round("dice", 6).alias("dice"), F.round("iou", 6).alias("iou"))


@query("q_dice_masks", f"WITH {t.PX_SQL}, s AS (SELECT source_id, sum(CAST(m>127 AND z>0 AS INTEGER)) AS i, sum(CAST(z>0 AS INTEGER)) AS p, sum(CAST(m>127 AS INTEGER)) AS t FROM px GROUP BY 1) SELECT round(avg((2*i+1)/(p+t+1)),6) AS dice FROM s")
def q_dice_masks(spark, d):
    return metrics.dice(t.px(spark, d), ["source_id"], logit() > 0, byte() > 127, smooth=1.0).select(F.round("dice", 6).alias("dice"))


@query("q_iou_masks", f"WITH {t.PX_SQL}, s AS (SELECT source_id, sum(CAST(m>127 AND z>0 AS INTEGER)) AS i, sum(CAST(z>0 AS INTEGER)) AS p, sum(CAST(m>127 AS INTEGER)) AS t FROM px GROUP BY 1) SELECT round(avg((i+1e-6)/(p+t-i+1e-6)),6) AS iou FROM s")
def q_iou_masks(spark, d):
    return metrics.iou(t.px(spark, d), ["source_id"], logit() > 0, byte() > 127).select(F.round("iou", 6).alias("iou"))


@query("q_batch_mean", f"""WITH {TILE_SUMS}, b AS (SELECT *, (row_number() OVER (ORDER BY source_id,y0,x0)-1)//16 AS batch FROM scored),
 m AS (SELECT avg(dice) AS dice, avg(iou) AS iou FROM b GROUP BY batch)
 SELECT round((SELECT avg(dice) FROM m),6) AS dice, round((SELECT avg(iou) FROM m),6) AS iou, round(avg(dice),6) AS dice_per_tile, round(avg(iou),6) AS iou_per_tile,
 (SELECT CAST(count(*) AS BIGINT) FROM m) AS batches FROM b""")
def q_batch_mean(spark, d):
    in_batches = tiling.batches(_scored(spark, d), 16, shuffle=False)
    m = metrics.epoch_metric(in_batches)
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns if c != "batches"], "batches")


IMAGE_SCORES = f"""WITH {STITCHED}, s AS (SELECT source_id, sum(CAST(prob>=0.5 AND m>127 AS INTEGER)) AS i, sum(CAST(prob>=0.5 AS INTEGER)) AS p, sum(CAST(m>127 AS INTEGER)) AS t
 FROM st JOIN px USING (source_id,y,x) GROUP BY 1)
 SELECT source_id, round((2*i+1e-6)/(p+t+1e-6),6) AS dice, round((i+1e-6)/(p+t-i+1e-6),6) AS iou FROM s"""


@query("q_dice_iou_image", IMAGE_SCORES)
def q_dice_iou_image(spark, d):
    s = scoring.stitch(tile_scores(spark, d), t.px_images(spark, d), P, S)
    s = s.join(t.px_missing(spark, d), ["source_id", "y", "x"], "left_anti")
    scored = metrics.image_metrics(s, t.px(spark, d))
    return scored.select("source_id", F.round("dice", 6).alias("dice"), F.round("iou", 6).alias("iou"))


@query("q_dice_iou_image_packed", IMAGE_SCORES.replace("avg(tp)", "avg(floor(tp*1024)/1024)"))
def q_dice_iou_image_packed(spark, d):
    packed = t.px_packed(spark, d, seen=True)
    blocks = scoring.stitch_packed(packed_scores(spark, d), packed, block=24)
    scored = metrics.image_metrics_packed(blocks, packed, block=24, seen="seen")
    return scored.select("source_id", F.round("dice", 6).alias("dice"), F.round("iou", 6).alias("iou"))


@query("q_image_mean", IMAGE_SCORES.replace("SELECT source_id, round", ", sc2 AS (SELECT source_id, round", 1) + ") SELECT round(avg(dice),5) AS dice, round(avg(iou),5) AS iou, CAST(count(*) AS BIGINT) AS samples FROM sc2")
def q_image_mean(spark, d):
    m = metrics.mean_scores(q_dice_iou_image(spark, d))
    return m.select(F.round("dice", 5).alias("dice"), F.round("iou", 5).alias("iou"), "samples")


# --- stencils -----------------------------------------------------------------------------------


def erode_sql(src, v, out, name):
    return f"""{name} AS (SELECT *, least(min({v}) OVER (PARTITION BY source_id,y0,x0,dx ORDER BY dy ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING),
  min({v}) OVER (PARTITION BY source_id,y0,x0,dy ORDER BY dx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) AS {out} FROM {src})"""


def dilate_sql(src, v, out, name):
    return f"""{name}_r AS (SELECT *, max({v}) OVER (PARTITION BY source_id,y0,x0,dy ORDER BY dx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS {out}_r FROM {src}),
{name} AS (SELECT *, max({out}_r) OVER (PARTITION BY source_id,y0,x0,dx ORDER BY dy ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS {out} FROM {name}_r)"""


def skeleton_sql(src, v, out, name, iterations):
    parts, cur, mask = [], src, v
    for k in range(iterations):
        parts.append(erode_sql(cur, mask, f"{out}_e{k}", f"{name}_e{k}"))
        parts.append(dilate_sql(f"{name}_e{k}", f"{out}_e{k}", f"{out}_o{k}", f"{name}_o{k}"))
        delta = f"greatest(0, {mask} - {out}_o{k})"
        grow = delta if k == 0 else f"{out}_s{k - 1} + greatest(0, {delta} - {out}_s{k - 1}*{delta})"
        parts.append(f"{name}_s{k} AS (SELECT *, {grow} AS {out}_s{k} FROM {name}_o{k})")
        cur, mask = f"{name}_s{k}", f"{out}_e{k}"
    parts.append(f"{name} AS (SELECT *, {out}_s{iterations - 1} AS {out} FROM {cur})")
    return ", ".join(parts)


TILE_PX = SAMPLE + ["dy", "dx"]


@query("q_erode", f"WITH {CELLS}, {erode_sql('sc', 'p', 'v', 'e')} SELECT source_id,y0,x0,dy,dx,round(v,6) AS v FROM e")
def q_erode(spark, d):
    e = stencil.soft_erode(cells(spark, d).withColumn("p", sigmoid(logit())), "p", SAMPLE, "v", "dy", "dx", colocate=True)
    return e.select(*TILE_PX, F.round("v", 6).alias("v"))


@query("q_dilate", f"WITH {CELLS}, {dilate_sql('sc', 'p', 'v', 'e')} SELECT source_id,y0,x0,dy,dx,round(v,6) AS v FROM e")
def q_dilate(spark, d):
    e = stencil.soft_dilate(cells(spark, d).withColumn("p", sigmoid(logit())), "p", SAMPLE, "v", "dy", "dx", colocate=True)
    return e.select(*TILE_PX, F.round("v", 6).alias("v"))


@query("q_open", f"WITH {CELLS}, {erode_sql('sc', 'p', 'w', 'e')}, {dilate_sql('e', 'w', 'v', 'f')} SELECT source_id,y0,x0,dy,dx,round(v,6) AS v FROM f")
def q_open(spark, d):
    e = stencil.soft_open(cells(spark, d).withColumn("p", sigmoid(logit())), "p", SAMPLE, "v", "dy", "dx", colocate=True)
    return e.select(*TILE_PX, F.round("v", 6).alias("v"))


@query("q_skeleton", f"WITH {CELLS}, {skeleton_sql('sc', 'p', 'v', 'k', 3)} SELECT source_id,y0,x0,dy,dx,round(v,6) AS v FROM k")
def q_skeleton(spark, d):
    e = stencil.soft_skeleton(cells(spark, d).withColumn("p", sigmoid(logit())), "p", SAMPLE, 3, "v", y="dy", x="dx", colocate=True)
    return e.select(*TILE_PX, F.round("v", 6).alias("v"))


# --- losses -------------------------------------------------------------------------------------

BCE = "sum(greatest(z,0)-z*t+ln(1+exp(-abs(z))))/count(*)"


def cl_sql(pred, iterations, tag=""):
    """Skeletons of prediction and target, then the centreline loss in {tag}cl."""
    a, b = f"{tag}a", f"{tag}b"
    return (
        f"{tag}src AS (SELECT *, {pred} AS q FROM sc), {skeleton_sql(f'{tag}src', 'q', 'sq', a, iterations)}, {skeleton_sql(a, 't', 'stt', b, iterations)}, "
        f"{tag}r AS (SELECT (sum(sq*t)+1)/(sum(sq)+1) AS u, (sum(stt*q)+1)/(sum(stt)+1) AS v FROM {b} GROUP BY source_id,y0,x0), "
        f"{tag}cl AS (SELECT 1-avg((2*u*v+1)/(u+v+1)) AS l FROM {tag}r)"
    )


SOFT = "per AS (SELECT sum(p) AS p, sum(t) AS t, sum(p*t) AS i FROM sc GROUP BY source_id,y0,x0)"
DICE = "(SELECT 1-avg((2*i+1e-6)/(p+t+1e-6)) FROM per)"
TV = "(SELECT 1-avg((i+1e-6)/(i+{a}*(p-i)+{b}*(t-i)+1e-6)) FROM per)"
TV_DEFAULT = TV.format(a=0.3, b=0.7)
HARD = "CAST(p>=0.5 AS INTEGER)::DOUBLE"


def _loss(spark, d, fn, **params):
    return fn(cells(spark, d), SAMPLE, logit(), truth(), **params).select("loss", F.round("value", 6).alias("value"))


@query("q_bce", f"WITH {CELLS} SELECT 'bce' AS loss, round({BCE},6) AS value FROM sc")
def q_bce(spark, d):
    return _loss(spark, d, losses.bce)


@query("q_soft_dice", f"WITH {CELLS}, {SOFT} SELECT 'soft_dice' AS loss, round({DICE},6) AS value")
def q_soft_dice(spark, d):
    return _loss(spark, d, losses.soft_dice_loss)


@query("q_bce_dice", f"WITH {CELLS}, {SOFT} SELECT 'bce_dice' AS loss, round(0.4*(SELECT {BCE} FROM sc)+0.5*{DICE},6) AS value")
def q_bce_dice(spark, d):
    return _loss(spark, d, losses.bce_dice, bce_weight=0.4, smooth=10.0)


@query("q_tversky", f"WITH {CELLS}, {SOFT} SELECT 'tversky' AS loss, round({TV.format(a=0.2, b=0.8)},6) AS value")
def q_tversky(spark, d):
    return _loss(spark, d, losses.tversky, alpha=0.2, beta=0.8)


@query("q_soft_cldice", f"WITH {CELLS}, {cl_sql('p', 3)} SELECT 'soft_cldice' AS loss, round(l,6) AS value FROM cl")
def q_soft_cldice(spark, d):
    return _loss(spark, d, losses.soft_cldice)


@query("q_hard_cldice", f"WITH {CELLS}, {cl_sql(HARD, 3)} SELECT 'cldice' AS loss, round(l,6) AS value FROM cl")
def q_hard_cldice(spark, d):
    return _loss(spark, d, losses.hard_cldice)


@query("q_cldice_score", f"WITH {CELLS}, {cl_sql(HARD, 2)} SELECT round(1-l,6) AS cldice FROM cl")
def q_cldice_score(spark, d):
    per = losses.cldice_score(cells(spark, d), SAMPLE, logit(), truth(), iterations=2, threshold=0.5)
    return per.agg(F.round(F.avg("cldice"), 6).alias("cldice"))


@query("q_bce_dice_cldice", f"WITH {CELLS}, {SOFT}, {cl_sql('p', 5)} SELECT 'bce_dice_cldice' AS loss, round(0.3*(SELECT {BCE} FROM sc)+0.6*{DICE}+0.1*(SELECT l FROM cl),6) AS value")
def q_bce_dice_cldice(spark, d):
    return _loss(spark, d, losses.bce_dice_cldice)


@query("q_tversky_soft_cldice", f"WITH {CELLS}, {SOFT}, {cl_sql('p', 3)} SELECT 'tversky_soft_cldice' AS loss, round(0.7*{TV_DEFAULT}+0.3*(SELECT l FROM cl),6) AS value")
def q_tversky_soft_cldice(spark, d):
    return _loss(spark, d, losses.tversky_soft_cldice)


EVERY = f"""WITH {CELLS}, {SOFT}, {cl_sql('p', 3)}, {cl_sql(HARD, 3, 'h')}, bce AS (SELECT {BCE} AS v FROM sc),
 bd AS (SELECT {DICE} AS v), tv AS (SELECT {TV_DEFAULT} AS v)
SELECT 'bce_with_logits' AS loss, round(v,6) AS value FROM bce
UNION ALL SELECT 'bce_dice', round(0.5*bce.v+0.5*bd.v,6) FROM bce, bd
UNION ALL SELECT 'tversky', round(v,6) FROM tv
UNION ALL SELECT 'Soft_CLDice', round(l,6) FROM cl
UNION ALL SELECT 'cldice', round(l,6) FROM hcl
UNION ALL SELECT 'tversky_softcldice', round(0.7*tv.v+0.3*cl.l,6) FROM tv, cl
UNION ALL SELECT 'bcedicecldice', round(0.3*bce.v+0.6*bd.v+0.1*cl.l,6) FROM bce, bd, cl"""
SPECS = [
    "bce_with_logits", "bce_dice", "tversky", "Soft_CLDice", "cldice", "tversky_softcldice",
    {"name": "bcedicecldice", "iterations": 3},
]


@query("q_evaluate_losses", EVERY)
def q_evaluate_losses(spark, d):
    return losses.evaluate_losses(cells(spark, d), SPECS, SAMPLE, logit(), truth()).select("loss", F.round("value", 6).alias("value"))


@pandas_udf(BinaryType())
def pack_truth(values: pd.Series) -> pd.Series:
    return values.map(lambda m: (np.asarray(m) > 127).astype(np.uint8).tobytes())


def packed_logits(spark, d):
    """The dense tiles as one row each: logits array<double> and mask 0/1 bytes."""
    at = F.struct("dy", "dx", "z", "m")
    tiles = cells(spark, d).groupBy(*SAMPLE).agg(F.array_sort(F.collect_list(at)).alias("c"))
    tiles = tiles.withColumn("c", tiling.once_per_place(F.col("c"), ["dy", "dx"]))
    return tiles.select(*SAMPLE, F.col("c.z").alias("logits"), pack_truth("c.m").alias("mask"))


@query("q_evaluate_losses_packed", EVERY)
def q_evaluate_losses_packed(spark, d):
    return losses.evaluate_losses_packed(packed_logits(spark, d), SPECS, SAMPLE).select("loss", F.round("value", 6).alias("value"))


@query("q_dice_iou_patch_packed", f"WITH {TILE_SUMS} SELECT source_id, y0, x0, round(dice,6) AS dice, round(iou,6) AS iou FROM scored")
def q_dice_iou_patch_packed(spark, d):
    scored = metrics.dice_iou_packed(packed_logits(spark, d), SAMPLE)
    return scored.select(*SAMPLE, F.round("dice", 6).alias("dice"), F.round("iou", 6).alias("iou"))


def _stencil_packed(spark, d, what):
    tiles = packed_logits(spark, d).withColumn("p", F.transform("logits", sigmoid))
    done = stencil.stencil_packed(tiles, "p", what, "v")
    cell = done.select(*SAMPLE, F.posexplode("v").alias("i", "v"))
    side = F.lit(P)
    return cell.select(*SAMPLE, F.floor(F.col("i") / side).cast("int").alias("dy"), (F.col("i") % side).cast("int").alias("dx"), F.round("v", 6).alias("v"))


@query("q_erode_packed", f"WITH {CELLS}, {erode_sql('sc', 'p', 'v', 'e')} SELECT source_id,y0,x0,dy,dx,round(v,6) AS v FROM e")
def q_erode_packed(spark, d):
    return _stencil_packed(spark, d, "erode")


@query("q_dilate_packed", f"WITH {CELLS}, {dilate_sql('sc', 'p', 'v', 'e')} SELECT source_id,y0,x0,dy,dx,round(v,6) AS v FROM e")
def q_dilate_packed(spark, d):
    return _stencil_packed(spark, d, "dilate")


@query("q_open_packed", f"WITH {CELLS}, {erode_sql('sc', 'p', 'w', 'e')}, {dilate_sql('e', 'w', 'v', 'f')} SELECT source_id,y0,x0,dy,dx,round(v,6) AS v FROM f")
def q_open_packed(spark, d):
    return _stencil_packed(spark, d, "open")


@query("q_skeleton_packed", f"WITH {CELLS}, {skeleton_sql('sc', 'p', 'v', 'k', 3)} SELECT source_id,y0,x0,dy,dx,round(v,6) AS v FROM k")
def q_skeleton_packed(spark, d):
    return _stencil_packed(spark, d, "skeleton")


# --- whole images on blocks ---------------------------------------------------------------------

SIDE = 12  # of a block: the 32x32 images have nine, margins reach over one and two of them
WHOLE = f"{t.PX_SQL}, sc AS (SELECT source_id, 0 AS y0, 0 AS x0, y AS dy, x AS dx, z, 1.0/(1.0+exp(-z)) AS p, CAST(m>127 AS INTEGER)::DOUBLE AS t FROM px)"


def image_blocks(spark, d):
    """Plane table of the whole images: logits z, probabilities p, mask t."""
    values = t.px(spark, d).withColumns({"p": sigmoid(logit()), "t": truth()})
    return block_stencils.block_values(values, ["z", "p", "t"], SIDE)


@query("q_block_losses", EVERY.replace(CELLS, WHOLE))
def q_block_losses(spark, d):
    """All losses with whole images as samples, from blocks that trade margins."""
    found = block_stencils.evaluate_losses_blocks(image_blocks(spark, d), SPECS, block=SIDE)
    return found.select("loss", F.round("value", 6).alias("value"))


@query("q_block_cldice", f"""WITH {WHOLE}, src AS (SELECT *, {HARD} AS q FROM sc), {skeleton_sql('src', 'q', 'sq', 'a', 5)}, {skeleton_sql('a', 't', 'stt', 'b', 5)},
r AS (SELECT source_id, (sum(sq*t)+1)/(sum(sq)+1) AS u, (sum(stt*q)+1)/(sum(stt)+1) AS v FROM b GROUP BY 1)
SELECT source_id, round((2*u*v+1)/(u+v+1),6) AS cldice FROM r""")
def q_block_cldice(spark, d):
    """Centreline Dice of every whole image, five iterations: margins of six pixels."""
    found = block_stencils.cldice_blocks(image_blocks(spark, d), iterations=5, threshold=0.5, block=SIDE)
    return found.select("source_id", F.round("cldice", 6).alias("cldice"))


def _block_stencil(spark, d, what):
    done = block_stencils.stencil_blocks(image_blocks(spark, d), "p", what, "v", 3, SIDE)
    return block_stencils.value_pixels(done, ["v"], SIDE).select("source_id", "y", "x", F.round("v", 6).alias("v"))


def _whole_sql(ctes, name):
    return f"WITH {WHOLE}, {ctes} SELECT source_id, dy AS y, dx AS x, round(v,6) AS v FROM {name}"


@query("q_block_erode", _whole_sql(erode_sql("sc", "p", "v", "e"), "e"))
def q_block_erode(spark, d):
    return _block_stencil(spark, d, "erode")


@query("q_block_dilate", _whole_sql(dilate_sql("sc", "p", "v", "e"), "e"))
def q_block_dilate(spark, d):
    return _block_stencil(spark, d, "dilate")


@query("q_block_open", _whole_sql(erode_sql("sc", "p", "w", "e") + ", " + dilate_sql("e", "w", "v", "f"), "f"))
def q_block_open(spark, d):
    return _block_stencil(spark, d, "open")


@query("q_block_skeleton", _whole_sql(skeleton_sql("sc", "p", "v", "k", 3), "k"))
def q_block_skeleton(spark, d):
    return _block_stencil(spark, d, "skeleton")
