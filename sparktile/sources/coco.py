"""COCO exports: one JSON document per batch folder, read by byte ranges, with an image folder beside it."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import file_name, stem
from .files import hadoop_path, refuse_hidden
from .json_ranges import MOST_TASKS, RANGE_BYTES, array_elements, json_documents, range_index
from .sinks import open_store

LISTED_AT_ONCE = 10_000
FOLDERS_OF_A_TASK = 16

# Where an export keeps its document and its images.
DOCUMENT, IMAGES = "annotations/instances_default.json", "images/default"

# segmentation is a list of rings or a run-length object, so it is read as text and typed later
ARRAYS = {
    "images": "id long, file_name string, width int, height int",
    "annotations": "image_id long, category_id long, segmentation string",
    "categories": "id long, name string",
}


def _batch(path, below: str):
    return F.regexp_extract(path, rf"([^/]+)/{below}", 1)


def image_files(spark: SparkSession, root: str) -> DataFrame:
    """batch, path, name, stem of every file in the exports' image folders; the driver names the folders, tasks list them."""
    refuse_hidden(spark, f"{root}/*/{IMAGES}")
    store, where = hadoop_path(spark, f"{root}/*/{IMAGES}")
    folders = [(s.getPath().toString(),) for s in (store.globStatus(where) or ()) if s.isDirectory()]
    if not folders:
        raise ValueError(f"{root} has no folder */{IMAGES}")

    def names(batches):
        from pyarrow import fs as pafs

        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                store, base = open_store(folder)
                found = [i.base_name for i in store.get_file_info(pafs.FileSelector(base)) if i.type == pafs.FileType.File]
                for at in range(0, len(found), LISTED_AT_ONCE):
                    part = [n for n in found[at : at + LISTED_AT_ONCE] if not n.startswith((".", "_"))]
                    yield pa.RecordBatch.from_pydict({"path": pa.array([f"{folder}/{n}" for n in part], pa.string())})

    # a task per folder, or for some of them where there are very many
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = spark.createDataFrame(folders, "folder string").repartition(min(len(folders), max(least, len(folders) // FOLDERS_OF_A_TASK), MOST_TASKS))
    files = dealt.mapInArrow(names, "path string")
    name = file_name(F.col("path"))
    return files.select(_batch(F.col("path"), IMAGES).alias("batch"), "path", name.alias("name"), stem(name).alias("stem"))


def read_coco_exports(spark: SparkSession, root: str, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, annotations, categories) of all complete exports, each with a ``batch`` column; ``pos`` orders a document's list.

    Action: one pass sums up the documents' byte ranges (``range_bytes`` each); the frames are lazy, and each reads only the ranges
    that hold its list, in as many tasks as there are ranges, whatever the number of documents.
    """
    have = image_files(spark, root).select("batch").distinct()
    docs = json_documents(spark, f"{root}/*/{DOCUMENT}")
    complete = docs.join(have, _batch(F.col("path"), DOCUMENT) == F.col("batch"), "left_semi")
    index = range_index(complete, list(ARRAYS), range_bytes)

    def rows(name: str) -> DataFrame:
        parsed = array_elements(index, name).withColumn("e", F.from_json("text", ARRAYS[name]))
        return parsed.select(_batch(F.col("path"), DOCUMENT).alias("batch"), "pos", "e.*")

    images = rows("images").withColumnRenamed("id", "image_id")
    annotations = rows("annotations").drop("pos")
    categories = rows("categories").select("batch", "id", "name", "pos")
    return images, annotations, categories


def incomplete_exports(spark: SparkSession, root: str) -> DataFrame:
    """Batches with a document but no image file, or the reverse: batch, missing."""
    docs = spark.read.format("binaryFile").load(f"{root}/*/{DOCUMENT}").select(_batch(F.col("path"), DOCUMENT).alias("batch")).distinct()
    have = image_files(spark, root).select("batch").distinct()
    return docs.join(have, "batch", "left_anti").withColumn("missing", F.lit("images")).unionByName(
        have.join(docs, "batch", "left_anti").withColumn("missing", F.lit("annotations"))
    )


def typed_segmentation(annotations: DataFrame) -> DataFrame:
    """Replace segmentation text by polygons, counts, counts_text and size (height, width), null where not of that kind."""
    text = F.trim("segmentation")
    rings = F.when(text.startswith("["), F.from_json(text, "array<array<double>>"))
    rle = F.when(text.startswith("{"), F.from_json(text, "counts string, size array<int>"))
    counts = rle["counts"]
    listed = F.trim(counts).startswith("[")
    return annotations.select(
        *[c for c in annotations.columns if c != "segmentation"],
        rings.alias("polygons"),
        F.when(listed, F.from_json(counts, "array<long>")).alias("counts"),
        F.when(~listed, counts).alias("counts_text"),
        rle["size"].alias("size"),
    )
