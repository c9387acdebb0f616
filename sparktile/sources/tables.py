"""Raster, file-listing, annotation and log views over the TPC-H-like driver tables.

Each view covers its whole table. The DuckDB text next to a view defines the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tiling import missing_pixels, once_per_place, whole_pixels

CANVAS = 64  # side of every annotated image


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Share the rows over all shuffle partitions, for views that expand each row."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


# --- pixels: 16 embedding vectors make one 32x32 image of 8x8 blocks -------------------------

IMAGES_SQL = """
images AS (
  SELECT vec_id // 16 AS source_id,
         CAST(max(8*(vec_id%4)) + 8 AS INTEGER) AS width,
         CAST(max(8*((vec_id%16)//4)) + 8 AS INTEGER) AS height
  FROM embeddings GROUP BY 1)"""

PX_SQL = IMAGES_SQL + """,
px AS (
  SELECT p.source_id, p.y, p.x, p.z, p.m, i.width, i.height
  FROM (SELECT vec_id//16 AS source_id,
               CAST(8*((vec_id%16)//4) + i//8 AS INTEGER) AS y,
               CAST(8*(vec_id%4) + i%8 AS INTEGER) AS x,
               12*CAST(embedding[i+1] AS DOUBLE) AS z,
               least(255, greatest(0, CAST(floor(128+120*(CAST(embedding[i+1] AS DOUBLE)
                   + CAST(embedding[(i+1)%64+1] AS DOUBLE))) AS INTEGER))) AS m
        FROM (SELECT vec_id, embedding, unnest(range(64)) AS i FROM embeddings)) p
  JOIN images i USING (source_id))"""


def px_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id")
    return v.groupBy(F.expr("vec_id div 16").alias("source_id")).agg(
        (F.max(8 * (F.col("vec_id") % 4)) + 8).cast("int").alias("width"),
        (F.max(8 * F.expr("(vec_id % 16) div 4")) + 8).cast("int").alias("height"),
    )


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long pixels: source_id, y, x, z (logit), m (mask byte), width, height."""
    e = spread(table(spark, sf_dir, "embeddings"))
    wide = e.join(px_images(spark, sf_dir), F.expr("vec_id div 16") == F.col("source_id"))
    cells = wide.select("source_id", "width", "height", "vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    return cells.select(
        "source_id",
        F.expr("cast(8*((vec_id%16) div 4) + i div 8 as int)").alias("y"),
        F.expr("cast(8*(vec_id%4) + i%8 as int)").alias("x"),
        F.expr("12*cast(embedding[i] as double)").alias("z"),
        F.expr(
            "least(255, greatest(0, cast(floor(128+120*(cast(embedding[i] as double)"
            "+cast(embedding[(i+1)%64] as double))) as int)))"
        ).alias("m"),
        "width",
        "height",
    )


RGB_SQL = "m AS r, 255-m AS g, (m*7)%256 AS b"


def with_rgb(pixels: DataFrame) -> DataFrame:
    m = F.col("m")
    return pixels.select("*", m.alias("r"), (255 - m).alias("g"), ((m * 7) % 256).alias("b"))


def px_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the images that no vector covers: source_id, y, x."""
    return missing_pixels(px(spark, sf_dir), px_images(spark, sf_dir)).select("source_id", "y", "x")


def px_packed(spark: SparkSession, sf_dir: str, grey: bool = False, seen: bool = False) -> DataFrame:
    """The same images as one row each: image binary (HWC RGB) and mask binary (HW).

    A group holds the at most 1024 pixels of one 32x32 image. Places without a pixel (the last image may lack vectors) are
    0 in all bands; of pixels of one place the smallest counts. With ``seen`` a binary (HW) of that name is 255 where there is a pixel.
    """
    p = with_rgb(px(spark, sf_dir))
    if grey:
        p = p.withColumns({"r": F.col("m"), "g": F.col("m"), "b": F.col("m")})
    p = whole_pixels(p.withColumn("seen", F.lit(255)), px_images(spark, sf_dir), ["r", "g", "b", "m", "seen"])
    planes = ["m", *["seen"] * seen]

    def byte(c):
        return F.lpad(F.hex(F.col(c).cast("long")), 2, "0")

    rows = p.groupBy("source_id", "width", "height", "y").agg(
        F.array_sort(F.collect_list(F.struct("x", F.concat(byte("r"), byte("g"), byte("b")).alias("rgb"), *[byte(c).alias(c) for c in planes]))).alias("cells")
    ).withColumn("cells", once_per_place(F.col("cells"), ["x"])).select(
        "source_id", "width", "height", "y",
        F.array_join(F.col("cells.rgb"), "").alias("rgb"),
        *[F.array_join(F.col(f"cells.{c}"), "").alias(c) for c in planes],
    )
    return rows.groupBy("source_id", "width", "height").agg(
        F.array_sort(F.collect_list(F.struct("y", "rgb", *planes))).alias("rows")
    ).select(
        "source_id", "width", "height",
        F.unhex(F.array_join(F.col("rows.rgb"), "")).alias("image"),
        *[F.unhex(F.array_join(F.col(f"rows.{c}"), "")).alias("mask" if c == "m" else c) for c in planes],
    )


# --- image sizes ------------------------------------------------------------------------------

DIMS_SQL = """
dims AS (SELECT p_partkey AS source_id, 40+p_size*7 AS width,
                40+CAST(p_partkey%97 AS INTEGER) AS height FROM part)"""


def dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("source_id"),
        (40 + F.col("p_size") * 7).alias("width"),
        (40 + (F.col("p_partkey") % 97).cast("int")).alias("height"),
    )


# --- file listings ----------------------------------------------------------------------------

FILES_SQL = """
all_images AS (
  SELECT 'img/doc_' || doc_id || list_extract(['.png','.JPG','.tif','.tiff','.bmp'], CAST(doc_id%5 AS INTEGER)+1) AS path
  FROM documents
  UNION ALL SELECT 'img/doc_' || doc_id || list_extract(['.png','.JPG','.tif','.tiff','.bmp'], CAST((doc_id+1)%5 AS INTEGER)+1) FROM documents WHERE lang = 'en'),
image_files AS (
  SELECT path, split_part(path,'/',2) AS source_id, regexp_replace(split_part(path,'/',2),'\\.[^.]+$','') AS stem
  FROM all_images WHERE lower(regexp_extract(path,'\\.[^.]+$')) IN ('.png','.jpg','.jpeg','.tif','.tiff')),
mask_files AS (
  SELECT path, split_part(path,'/',2) AS source_id, regexp_replace(split_part(path,'/',2),'\\.[^.]+$','') AS stem
  FROM (SELECT 'msk/' || CASE WHEN toxic=1 THEN 'lost_' ELSE 'doc_' END || doc_id || '.png' AS path FROM labels
        UNION ALL SELECT 'msk/doc_' || doc_id || '.TIF' FROM labels WHERE quality=0)),
image_map AS (SELECT stem, max(path) AS image_path FROM image_files GROUP BY stem),
mask_map AS (SELECT stem, max(path) AS mask_path FROM mask_files GROUP BY stem)"""


def image_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One image per document in five formats; English documents have a second file of the same stem."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    exts = F.array(*map(F.lit, [".png", ".JPG", ".tif", ".tiff", ".bmp"]))
    first, second = (F.element_at(exts, ((F.col("doc_id") + k) % 5 + 1).cast("int")) for k in (0, 1))
    twin = F.when(F.col("lang") == "en", F.array(first, second)).otherwise(F.array(first))
    return d.select("doc_id", F.explode(twin).alias("ext")).select(F.concat(F.lit("img/doc_"), "doc_id", "ext").alias("path"))


def mask_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mask per label, renamed to an orphan where toxic; low quality ones have a second file."""
    l = table(spark, sf_dir, "labels")
    first = F.concat(F.lit("msk/"), F.when(F.col("toxic") == 1, "lost_").otherwise("doc_"), "doc_id", F.lit(".png"))
    second = F.concat(F.lit("msk/doc_"), "doc_id", F.lit(".TIF"))
    return l.select(F.explode(F.when(F.col("quality") == 0, F.array(first, second)).otherwise(F.array(first))).alias("path"))


# --- annotations: every line item is a rectangle on its order's 64x64 image --------------------

COCO_SQL = """
coco_ann AS (
  SELECT l_orderkey AS image_id,
         CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 99 END AS category_id,
         CAST(l_partkey%40 AS INTEGER) AS x0, CAST(l_suppkey%40 AS INTEGER) AS y0,
         4+CAST(l_quantity AS INTEGER)%12 AS w, l_returnflag
  FROM lineitem),
coco_images AS (
  SELECT o_orderkey AS image_id, 'img_' || (o_orderkey//2) || '.jpg' AS file_name, 64 AS width, 64 AS height,
         ['alpha_run','beta_run','gamma_run','delta_run','alphabet'][CAST(substr(o_orderpriority,1,1) AS INTEGER)] AS batch
  FROM orders),
coco_px AS (
  SELECT DISTINCT image_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, ign FROM (
    SELECT image_id, l_returnflag='R' AS ign, x0, y0, w, unnest(range(w+1)) AS dy FROM coco_ann) r,
    LATERAL (SELECT r.y0+r.dy AS y), LATERAL (SELECT unnest(range(r.x0, r.x0+r.w+1)) AS x)
  WHERE y < 64 AND x < 64),
coco_fg AS (
  SELECT image_id, y, x FROM coco_px WHERE NOT ign
  EXCEPT SELECT image_id, y, x FROM coco_px WHERE ign)"""


def coco_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two orders share a file name; the batch comes from the order priority."""
    batches = F.array(*map(F.lit, ["alpha_run", "beta_run", "gamma_run", "delta_run", "alphabet"]))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("image_id"),
        F.concat(F.lit("img_"), F.expr("o_orderkey div 2"), F.lit(".jpg")).alias("file_name"),
        F.lit(CANVAS).alias("width"),
        F.lit(CANVAS).alias("height"),
        F.element_at(batches, F.substring("o_orderpriority", 1, 1).cast("int")).alias("batch"),
    )


def coco_categories(spark: SparkSession) -> DataFrame:
    """Category 99 of the annotations is deliberately not listed."""
    return spark.createDataFrame([(1, "old"), (2, "hypha"), (1, "Inoculum")], "id int, name string").withColumn(
        "pos", F.monotonically_increasing_id()
    )


def coco_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = spread(table(spark, sf_dir, "lineitem"))
    return l.select(
        F.col("l_orderkey").alias("image_id"),
        F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 2).otherwise(99).alias("category_id"),
        (F.col("l_partkey") % 40).cast("int").alias("x0"),
        (F.col("l_suppkey") % 40).cast("int").alias("y0"),
        (4 + F.col("l_quantity").cast("int") % 12).alias("w"),
    )


def coco_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations with polygon segmentations, joined to nothing: every canvas is 64x64."""
    x0, y0, w = (F.col(c).cast("double") for c in ("x0", "y0", "w"))
    ring = F.array(x0, y0, x0 + w, y0, x0 + w, y0 + w, x0, y0 + w)
    return coco_rectangles(spark, sf_dir).select(
        "image_id", "category_id", F.lit(CANVAS).alias("width"), F.lit(CANVAS).alias("height"),
        F.array(ring).alias("polygons"),
    )


def coco_runs(spark: SparkSession, sf_dir: str, halves: bool = False) -> DataFrame:
    """The same rectangles, clipped, as column-major alternating run lengths; with ``halves`` the upper half of each, too."""
    r = coco_rectangles(spark, sf_dir)
    r = r.withColumn("h", F.least(F.col("y0") + F.col("w"), F.lit(63)) - F.col("y0") + 1).withColumn(
        "n", F.least(F.col("x0") + F.col("w"), F.lit(63)) - F.col("x0") + 1
    )
    if halves:
        r = r.withColumn("h", F.explode(F.array(F.col("h"), F.floor(F.col("h") / 2).cast("int"))))
    lead = F.col("x0") * 64 + F.col("y0")
    tail = 64 * 64 - lead - F.col("h") - (F.col("n") - 1) * 64
    counts = F.concat(
        F.array(lead),
        F.flatten(F.array_repeat(F.array(F.col("h"), 64 - F.col("h")), F.col("n") - 1)),
        F.array(F.col("h"), tail),
    )
    return r.select(
        "image_id", "category_id", F.lit(CANVAS).alias("width"), F.lit(CANVAS).alias("height"),
        counts.cast("array<long>").alias("counts"),
    )


# --- experiment log ---------------------------------------------------------------------------

LOG_SQL = """
metric_log AS (
  SELECT 'events' AS run, CAST(user_id%5 AS INTEGER) AS fold, CAST(day(ts) AS INTEGER) AS epoch,
         round(avg(value),6) AS train_loss,
         round(count(DISTINCT user_id)/30.0,6) AS val_dice_per_patch,
         CASE WHEN day(ts)%10=0 THEN round(count(DISTINCT user_id)/30.0,6) END AS val_dice_per_image
  FROM events GROUP BY user_id%5, day(ts))"""


def metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    users = F.round(F.count_distinct("user_id") / F.lit(30.0), 6)
    return (
        e.groupBy((F.col("user_id") % 5).cast("int").alias("fold"), F.dayofmonth("ts").alias("epoch"))
        .agg(F.round(F.avg("value"), 6).alias("train_loss"), users.alias("val_dice_per_patch"))
        .select(
            F.lit("events").alias("run"), "fold", "epoch", "train_loss", "val_dice_per_patch",
            F.when(F.col("epoch") % 10 == 0, F.col("val_dice_per_patch")).alias("val_dice_per_image"),
        )
    )
