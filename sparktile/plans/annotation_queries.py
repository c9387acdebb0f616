"""Queries that turn rectangles, polygons and run lengths of whole order tables into masks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..operators import annotations as a
from ..operators.kernels import write_many_counts
from ..sources import tables as t
from .catalog import query


def classes(spark, anns):
    return a.annotation_classes(anns, t.coco_categories(spark))


def polygon_mask(spark, d):
    return a.compose_mask(a.polygon_spans(classes(spark, t.coco_polygons(spark, d)), ["image_id", "ign"], packed=True))


COVERAGE = f"""WITH {t.COCO_SQL}, area AS (SELECT image_id, count(*) AS fg FROM coco_fg GROUP BY 1)
SELECT image_id, CAST(coalesce(fg,0) AS BIGINT) AS fg FROM coco_images LEFT JOIN area USING (image_id)"""


@query("q_coco_classes", f"""WITH {t.COCO_SQL} SELECT CASE category_id WHEN 1 THEN 'Inoculum' WHEN 2 THEN 'hypha' ELSE '' END AS category,
 category_id=1 AS ign, CAST(count(*) AS BIGINT) AS n FROM coco_ann GROUP BY ALL""")
def q_coco_classes(spark, d):
    return classes(spark, t.coco_rectangles(spark, d)).groupBy("category", "ign").agg(F.count("*").alias("n"))


@query("q_coco_by_image", f"WITH {t.COCO_SQL} SELECT i.image_id, CAST(count(a.image_id) AS BIGINT) AS n_ann FROM coco_images i LEFT JOIN coco_ann a USING (image_id) GROUP BY 1")
def q_coco_by_image(spark, d):
    return a.annotations_by_image(t.coco_images(spark, d), t.coco_rectangles(spark, d)).select("image_id", "n_ann")


@query("q_coco_polygon", COVERAGE)
def q_coco_polygon(spark, d):
    return a.mask_coverage(t.coco_images(spark, d), polygon_mask(spark, d)).select("image_id", "fg")


@query("q_coco_mask", f"WITH {t.COCO_SQL} SELECT y, x, CAST(count(*) AS BIGINT) AS images, CAST(sum(image_id) AS BIGINT) AS ids FROM coco_fg GROUP BY 1,2")
def q_coco_mask(spark, d):
    """Every mask pixel of every image, folded per position."""
    px = a.mask_pixels(polygon_mask(spark, d))
    return px.groupBy("y", "x").agg(F.count("*").alias("images"), F.sum("image_id").alias("ids"))


@query("q_coco_rle", COVERAGE)
def q_coco_rle(spark, d):
    spans = a.rle_spans(classes(spark, t.coco_runs(spark, d)), ["image_id", "ign"], packed=True)
    return a.mask_coverage(t.coco_images(spark, d), a.compose_mask(spans)).select("image_id", "fg")


def _write_counts(counts) -> str:
    """Fixture: compressed text of run lengths, the inverse of what the decoder reads."""
    out = []
    for i, c in enumerate(counts):
        v = int(c) - (int(counts[i - 2]) if i > 2 else 0)
        more = True
        while more:
            bits, v = v & 31, v >> 5
            more = not (v == 0 and not bits & 16 or v == -1 and bits & 16)
            out.append(chr(48 + (bits | (32 if more else 0))))
    return "".join(out)


@query("q_coco_rle_text", COVERAGE)
def q_coco_rle_text(spark, d):
    @pandas_udf("string")
    def write(counts: pd.Series) -> pd.Series:
        return pd.Series(write_many_counts(np.concatenate([np.zeros(0, np.int64), *counts]), counts.map(len).to_numpy(np.int64)), index=counts.index)

    runs = t.coco_runs(spark, d).withColumn("counts_text", write("counts")).drop("counts")
    spans = a.rle_spans(classes(spark, runs), ["image_id", "ign"], packed=True)
    return a.mask_coverage(t.coco_images(spark, d), a.compose_mask(spans)).select("image_id", "fg")


@query("q_coco_painted", f"""WITH {t.COCO_SQL}, s AS (SELECT image_id, sum(y*64+x) AS moment FROM coco_fg GROUP BY 1)
SELECT image_id, CAST(coalesce(moment,0) AS BIGINT) AS moment FROM coco_images LEFT JOIN s USING (image_id)""")
def q_coco_painted(spark, d):
    """Rasters of all images, each reduced to the sum of its foreground positions."""
    @pandas_udf("long")
    def moment(mask: pd.Series) -> pd.Series:
        return mask.map(lambda b: int(np.flatnonzero(np.frombuffer(b, np.uint8)).sum()))

    painted = a.paint_masks(t.coco_images(spark, d), polygon_mask(spark, d))
    return painted.select("image_id", moment("mask").alias("moment"))


@query("q_coco_blank", f"""WITH {t.COCO_SQL} SELECT CAST(count(*) AS BIGINT) AS images, CAST(count(*) FILTER (WHERE NOT EXISTS
 (SELECT 1 FROM coco_ann a WHERE a.image_id=i.image_id)) AS BIGINT) AS skipped, CAST(count(*) FILTER (WHERE NOT EXISTS
 (SELECT 1 FROM coco_fg f WHERE f.image_id=i.image_id)) AS BIGINT) AS blank FROM coco_images i""")
def q_coco_blank(spark, d):
    per = a.mask_coverage(a.annotations_by_image(t.coco_images(spark, d), t.coco_rectangles(spark, d)), polygon_mask(spark, d))
    return per.agg(
        F.count("*").alias("images"), F.count_if(F.col("n_ann") == 0).alias("skipped"), F.count_if(F.col("fg") == 0).alias("blank")
    )


PREFIX = f"""WITH {t.COCO_SQL}, n AS (SELECT batch, file_name, substr(batch,1,5)||'_'||file_name AS out_name FROM coco_images)
SELECT out_name, max(batch) AS batch, CAST(count(*) - 1 AS BIGINT) AS collided FROM n GROUP BY 1"""


@query("q_coco_prefix", PREFIX)
def q_coco_prefix(spark, d):
    """Five characters of the batch: which batch each name ends with, and how many rows it cost."""
    return a.prefix_names(t.coco_images(spark, d), "batch", "file_name", 5).select("out_name", "batch", "collided")


@query("q_prefix_collisions", f"""WITH {t.COCO_SQL}, n AS (SELECT batch||'_'||file_name AS out_name FROM coco_images)
SELECT out_name, CAST(count(*) - 1 AS BIGINT) AS collided FROM n GROUP BY 1 HAVING count(*) > 1""")
def q_prefix_collisions(spark, d):
    """Whole batch names collide only where a batch lists one name twice."""
    return a.prefix_names(t.coco_images(spark, d), "batch", "file_name").where("collided > 0").select("out_name", "collided")


def _existing(missing):
    op = "NOT IN" if missing else "IN"
    return f"""WITH {t.COCO_SQL}, m AS (SELECT image_id, regexp_replace(file_name,'\\.[^.]+$','') AS stem FROM coco_images),
 f AS (SELECT 'img_'||(o_orderkey//2) AS stem FROM orders WHERE o_orderstatus='F') SELECT image_id, stem FROM m WHERE stem {op} (SELECT stem FROM f)"""


def _restricted(spark, d, missing):
    masks = a.with_stem(t.coco_images(spark, d), "file_name").select("image_id", "stem")
    o = t.table(spark, d, "orders").where("o_orderstatus = 'F'")
    files = a.with_stem(o.select(F.concat(F.lit("img_"), F.expr("o_orderkey div 2"), F.lit(".png")).alias("name")), "name")
    return a.restrict_to_images(masks, files, missing=missing)


@query("q_coco_existing", _existing(False))
def q_coco_existing(spark, d):
    return _restricted(spark, d, False)


@query("q_coco_absent", _existing(True))
def q_coco_absent(spark, d):
    return _restricted(spark, d, True)


@query("q_coco_planes", f"""WITH {t.COCO_SQL}, area AS (SELECT image_id, count(*) AS fg FROM coco_fg GROUP BY 1)
SELECT image_id, CAST(coalesce(fg,0) AS BIGINT) AS fg FROM coco_images LEFT JOIN area USING (image_id)""")
def q_coco_planes(spark, d):
    """Two run-length planes per annotation, its rectangle and its upper half again: the union is the rectangle."""
    spans = a.rle_spans(classes(spark, t.coco_runs(spark, d, halves=True)), ["image_id", "ign"], packed=True)
    return a.mask_coverage(t.coco_images(spark, d), a.compose_mask(spans)).select("image_id", "fg")
