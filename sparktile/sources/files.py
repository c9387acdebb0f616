"""Image and mask folders: listings, headers and decoded rasters."""

from __future__ import annotations

import os
import struct
import zlib
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.paths import file_name, stem
from ..functions.pixels import LUMA_SHIFT, LUMA_WEIGHTS
from ..operators.kernels import PNG_LOOK, is_plain_png, png_pixels
from ..operators.pairing import IMAGE_EXTENSIONS, pair_images_masks, select_images, with_names
from ..session import scratch_path


def hadoop_path(spark: SparkSession, path: str):
    """(file system, qualified path) as the cluster sees it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(p)


def is_file(spark: SparkSession, path: str) -> bool:
    fs, where = hadoop_path(spark, path)
    return fs.exists(where) and fs.getFileStatus(where).isFile()


# What Spark and Hadoop write beside data.
MARKERS = ("_SUCCESS", "_temporary", "_spark_metadata")


def refuse_hidden(spark: SparkSession, folder: str) -> None:
    """Fail if files under ``folder`` (a path or pattern) have names that start with a dot or an underscore.

    Spark's file sources leave such names out without a word, which would change pairs; only those names are listed here.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(folder.rstrip("/") + "/[._]*")
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    _refuse(folder, sorted(s.getPath().getName() for s in (found or ())))


def _refuse(folder: str, hidden: list[str]) -> None:
    lost = [n for n in hidden if n not in MARKERS and not n.endswith(".crc")]
    if lost:
        raise ValueError(f"{folder} has names that file sources hide; rename them: {', '.join(lost)}")


# Beyond MANY files tasks list and open the files of a folder: Spark's file sources keep a kilobyte per file in the driver and open
# few small files a task.
MANY = 20_000
MOST_OTHERS = 20_000  # files whose paths the driver hands to the image source
FILES_OF_A_TASK, BYTES_OF_A_TASK, MOST_TASKS = 2_000, 64 << 20, 10_000
SCHEMES = ("file", "hdfs", "s3", "s3a", "s3n")  # stores that tasks open without Spark


def _listed(spark: SparkSession, path: str) -> DataFrame | None:
    """path, name, length, modificationTime of the entries of a folder of very many files, listed by one task and stored; ``hidden``
    marks those that file sources leave out. None for any other path, which is left to Spark's sources."""
    fs, where = hadoop_path(spark, path)
    uri = where.toUri()
    if uri.getScheme() not in SCHEMES or any(c in path for c in "*?[]{}\\") or not fs.exists(where) or is_file(spark, path):
        return None
    if uri.getScheme() == "file":
        with os.scandir(uri.getPath()) as entries:
            n = sum(1 for _ in islice(entries, MANY + 1))
    else:
        n = fs.getContentSummary(where).getFileCount()
    if n <= MANY:
        return None
    folder = where.toString().rstrip("/")

    def entries_of(batches):
        from pyarrow import fs as pafs

        from sparktile.sources.sinks import open_store

        for _ in batches:
            store, base = open_store(folder)
            found = store.get_file_info(pafs.FileSelector(base))
            for at in range(0, len(found), 10_000):
                part = found[at : at + 10_000]
                names = [i.base_name for i in part]
                yield pa.RecordBatch.from_pydict({
                    "path": pa.array([f"{folder}/{n}" for n in names], pa.string()),
                    "name": pa.array(names, pa.string()),
                    "length": pa.array([i.size or 0 for i in part], pa.int64()),
                    "modified": pa.array([(i.mtime_ns or 0) // 1_000_000 for i in part], pa.int64()),
                    "below": pa.array([i.type != pafs.FileType.File for i in part], pa.bool_()),
                })

    label = scratch_path(spark, "listing")
    found = spark.range(0, 1, 1, 1).mapInArrow(entries_of, "path string, name string, length long, modified long, below boolean")
    found.write.parquet(label)
    stored = spark.read.parquet(label)
    if not stored.where("below and name like '%=%'").isEmpty():
        return None  # Spark reads such folders as partitions
    hidden = F.col("name").startswith(".") | F.col("name").startswith("_")
    files = stored.withColumn("hidden", hidden).where(~F.col("below") | F.col("hidden"))
    return files.select("path", "name", "length", F.timestamp_millis("modified").alias("modificationTime"), F.col("hidden"))


def _seen(listed: DataFrame) -> DataFrame:
    """The entries that Spark's file sources show: they leave out empty files, too."""
    return listed.where(~F.col("hidden") & ~F.col("name").endswith("._COPYING_") & (F.col("length") > 0)).drop("hidden")


def spread_files(files: DataFrame, length: str | None = None) -> DataFrame:
    """Rows of files over tasks by their number and, if there is one, the column of their length; the rows are small, files are not."""
    rows, size = files.agg(F.count("*"), F.coalesce(F.sum(length) if length else F.lit(0), F.lit(0))).first()
    least = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = max(least, rows // FILES_OF_A_TASK, size // BYTES_OF_A_TASK)
    return files.repartition(min(MOST_TASKS, max(1, min(rows, wanted))))


def with_content(files: DataFrame) -> DataFrame:
    """Rows of files (``path``) with their ``content``, each opened by a task; no folder is listed."""
    kind = files.select("*", F.lit(b"").alias("content")).schema

    def read(batches):
        from sparktile.sources.sinks import open_store

        for batch in batches:
            at, held, size = 0, [], 0
            for i, path in enumerate(batch.column("path").to_pylist()):
                store, place = open_store(path)
                with store.open_input_file(place) as file:
                    held.append(file.read())
                size += len(held[-1])
                if size >= BYTES_OF_A_TASK // 2 or i + 1 == batch.num_rows:
                    yield batch.slice(at, len(held)).append_column("content", pa.array(held, pa.binary()))
                    at, held, size = i + 1, [], 0

    return files.mapInArrow(read, kind)


def list_masks(spark: SparkSession, path: str) -> DataFrame:
    """Every file of a folder: path, length, modificationTime, source_id, stem. Contents are not read.

    Fails on names that start with a dot or an underscore, which Spark's file sources hide. A folder of very many files is listed
    by a task, and the list stored.
    """
    listed = _listed(spark, path)
    if listed is None:
        refuse_hidden(spark, path)
        files = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    else:
        _refuse(path, sorted(r["name"] for r in listed.where("hidden").select("name").collect()))
        files = _seen(listed).select("path", "length", "modificationTime")
    return with_names(files)


def list_images(spark: SparkSession, path: str, exts=IMAGE_EXTENSIONS) -> DataFrame:
    """Files with an image extension; a path to one file stands for itself, whatever its extension."""
    files = list_masks(spark, path)
    return files if is_file(spark, path) else select_images(files, exts)


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no {what} found")
    return df


def extension_glob(exts) -> str:
    """File-name pattern for extensions in any case, which the reader applies before it opens a file."""
    each = ["*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in exts]
    return "{" + ",".join(each) + "}"


def read_images(spark: SparkSession, path: str, drop_invalid: bool = False, exts=None) -> DataFrame:
    """Decoded rasters: source_id, stem, width, height, channels, data (BGR or grey bytes).

    A file that does not decode has width and height -1, or is left out with ``drop_invalid``. With ``exts`` only files
    with these extensions are opened.

    Of a folder of very many files plain PNGs (8-bit grey or RGB) are listed, opened and decoded by tasks; their first bytes are
    looked at when this is called. Other files go through Spark's image source.
    """
    listed = _listed(spark, path)
    if listed is None:
        return _image_source(spark, path, drop_invalid, exts)
    files = _seen(listed)
    if exts is not None and len(exts):
        files = files.where(F.lower("name").rlike("(?:" + "|".join(rf"\Q{e.lower()}\E" for e in exts) + ")$"))
    looked = scratch_path(spark, "looked-at")
    spread_files(files.select("path", "name", "length"), "length").mapInArrow(_look, "path string, name string, length long, plain boolean").write.parquet(looked)
    files = spark.read.parquet(looked)
    rest = [r["path"] for r in files.where("not plain").select("path").limit(MOST_OTHERS + 1).collect()]
    if len(rest) > MOST_OTHERS:
        return _image_source(spark, path, drop_invalid, exts)
    decoded = spread_files(files.where("plain").select("path", "name", "length"), "length").mapInArrow(_decode_plain, _DECODED)
    if drop_invalid:
        decoded = decoded.where("width > 0")
    decoded = decoded.withColumn("stem", stem(F.col("source_id"))).select("source_id", "stem", "width", "height", "channels", "data")
    if not rest:
        return decoded
    others = ["".join("\\" + c if c in "*?[]{}\\" else c for c in p) for p in rest]
    return decoded.unionByName(_image_source(spark, others, drop_invalid, None))


_DECODED = "source_id string, width int, height int, channels int, data binary"


def _look(batches):
    from sparktile.sources.sinks import open_store

    for batch in batches:
        plain = []
        for path in batch.column("path").to_pylist():
            store, place = open_store(path)
            with store.open_input_file(place) as file:
                plain.append(is_plain_png(file.read(PNG_LOOK)))
        yield batch.append_column("plain", pa.array(plain, pa.bool_()))


def _decode_plain(batches):
    from sparktile.sources.sinks import open_store

    for batch in batches:
        rows, size = [], 0
        for path, name in zip(batch.column("path").to_pylist(), batch.column("name").to_pylist()):
            store, place = open_store(path)
            with store.open_input_file(place) as file:
                body = file.read()
            try:
                a = png_pixels(body)
                rows.append((name, a.shape[1], a.shape[0], a.shape[2], a[..., ::-1].tobytes()))
                size += a.size
            except (ValueError, struct.error, zlib.error):
                rows.append((name, -1, -1, -1, b""))  # as Spark's image source says it
            if size >= BYTES_OF_A_TASK // 2:
                yield _rasters(rows)
                rows, size = [], 0
        if rows:
            yield _rasters(rows)


def _rasters(rows: list[tuple]) -> pa.RecordBatch:
    name, width, height, channels, data = zip(*rows)
    sizes = [pa.array(v, pa.int32()) for v in (width, height, channels)]
    return pa.RecordBatch.from_arrays([pa.array(name, pa.string()), *sizes, pa.array(data, pa.binary())], names=["source_id", "width", "height", "channels", "data"])


def _image_source(spark: SparkSession, path: str | list[str], drop_invalid: bool, exts) -> DataFrame:
    reader = spark.read.format("image").option("dropInvalid", str(drop_invalid).lower())
    raw = (reader.option("pathGlobFilter", extension_glob(exts)) if exts else reader).load(path).select("image.*")
    # origin is a URI: undo its percent escapes, in which a plus sign stands for itself
    name = file_name(F.url_decode(F.replace("origin", F.lit("+"), F.lit("%2B"))))
    return raw.select(
        name.alias("source_id"), stem(name).alias("stem"), "width", "height", F.col("nChannels").alias("channels"), "data"
    )


def readable(images: DataFrame, drop_invalid: bool = False) -> DataFrame:
    """Leave out files that did not decode, or make the job fail with the name of one."""
    if drop_invalid:
        return images.where(F.col("width") > 0)
    bad = F.raise_error(F.concat(F.lit("unreadable image "), "source_id")).cast("int")
    return images.withColumn("width", F.when(F.col("width") > 0, F.col("width")).otherwise(bad))


def _planes(data, h, w, channels):
    return np.frombuffer(data, np.uint8).reshape(h, w, channels)


def decode_rgb(images: DataFrame, drop_invalid: bool = False) -> DataFrame:
    """Replace data by ``image``: HWC RGB bytes. Grey is repeated, alpha dropped."""

    @pandas_udf("binary")
    def rgb(data: pd.Series, h: pd.Series, w: pd.Series, c: pd.Series) -> pd.Series:
        def one(d, h, w, c):
            a = _planes(d, h, w, c)
            a = np.repeat(a, 3, 2) if c == 1 else a[..., 2::-1]
            return np.ascontiguousarray(a).tobytes()

        return pd.Series([one(*v) for v in zip(data, h, w, c)])

    return readable(images, drop_invalid).withColumn("image", rgb("data", "height", "width", "channels")).drop("data", "channels")


def decode_gray(images: DataFrame, drop_invalid: bool = False) -> DataFrame:
    """Replace data by ``mask``: HW bytes. Colours are reduced to luma."""

    @pandas_udf("binary")
    def grey(data: pd.Series, h: pd.Series, w: pd.Series, c: pd.Series) -> pd.Series:
        def one(d, h, w, c):
            a = _planes(d, h, w, c)
            if c == 1:
                return a.tobytes()
            luma = (a[..., 2::-1].astype(np.int64) @ np.array(LUMA_WEIGHTS) + (1 << (LUMA_SHIFT - 1))) >> LUMA_SHIFT
            return luma.astype(np.uint8).tobytes()

        return pd.Series([one(*v) for v in zip(data, h, w, c)])

    return readable(images, drop_invalid).withColumn("mask", grey("data", "height", "width", "channels")).drop("data", "channels")


def image_records(pairs: DataFrame, images: DataFrame, drop_invalid: bool = False) -> DataFrame:
    """pairs with the width and height of the image (not of the mask); only dimensions are shuffled.

    Unreadable images raise when the frame is evaluated, unless ``drop_invalid`` leaves them out.
    """
    return readable(pairs.join(images.select("source_id", "width", "height"), "source_id"), drop_invalid)


def load_pairs(spark: SparkSession, images_dir: str, masks_dir: str, exts=IMAGE_EXTENSIONS, drop_invalid: bool = False) -> DataFrame:
    """Matched pairs with payload: source_id, stem, width, height, image, mask.

    Mask and image must agree in size and be readable. Listings are paired first, by name alone, so a payload without a
    partner never enters the one shuffle in which both payloads meet on the stem. Write the result to Parquet once and
    let every later job start from there.
    """
    pairs = pair_images_masks(list_images(spark, images_dir, exts), list_masks(spark, masks_dir))
    wanted = pairs.select("source_id")
    partners = pairs.select(file_name(F.col("mask_path")).alias("source_id"))
    images = read_images(spark, images_dir, exts=exts).join(wanted, "source_id", "left_semi")
    masks = read_images(spark, masks_dir).join(partners, "source_id", "left_semi")
    # decoding comes after the join, so files without a partner are neither converted nor checked
    swap = {"width": "mask_width", "height": "mask_height", "channels": "mask_channels", "data": "mask_data", "source_id": "mask_id"}
    both = images.join(masks.withColumnsRenamed(swap), "stem")
    both = decode_rgb(both, drop_invalid).withColumnsRenamed(
        {"width": "image_width", "height": "image_height", "source_id": "image_id"}
    ).withColumnsRenamed({v: k for k, v in swap.items()})
    both = decode_gray(both, drop_invalid).withColumnsRenamed(
        {"width": "mask_width", "height": "mask_height", "source_id": "mask_id"}
    ).withColumnsRenamed({"image_width": "width", "image_height": "height", "image_id": "source_id"})
    same = (F.col("width") == F.col("mask_width")) & (F.col("height") == F.col("mask_height"))
    bad = F.raise_error(F.concat(F.lit("image and mask differ in size: "), "source_id"))
    return both.withColumn("width", F.when(same, F.col("width")).otherwise(bad.cast("int"))).select(
        "source_id", "stem", "width", "height", "image", "mask"
    )
