"""Raster files, metric tables and run summaries."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.kernels import png_bytes
from .files import hadoop_path

KINDS = ("mask", "overlay", "prob")


def replace_folder(spark: SparkSession, path: str) -> None:
    """Make ``path`` an empty folder."""
    fs, where = hadoop_path(spark, path)
    if fs.exists(where):
        fs.delete(where, True)
    fs.mkdirs(where)


def store_uri(spark: SparkSession, path: str) -> str:
    """``path`` as a URI that pyarrow.fs opens inside tasks."""
    uri = hadoop_path(spark, path)[1].toUri().toString()
    scheme, rest = uri.split(":", 1)
    if scheme == "file":
        return "file://" + "/" + rest.lstrip("/")
    return ("s3" if scheme in ("s3a", "s3n") else scheme) + ":" + rest


def open_store(path: str):
    """(file system, path in it) inside a task, for a path as Spark lists it."""
    from pyarrow import fs as pafs

    scheme, _, rest = path.partition(":")
    if scheme in ("", "file") or path.startswith("/"):
        return pafs.LocalFileSystem(), "/" + (rest if scheme == "file" else path).lstrip("/")
    return pafs.FileSystem.from_uri(("s3" if scheme in ("s3a", "s3n") else scheme) + ":" + rest)


def task_folder(spark: SparkSession, path: str) -> str:
    """The folder, made if need be, as a URI that pyarrow.fs opens inside tasks."""
    fs, where = hadoop_path(spark, path)
    fs.mkdirs(where)
    return store_uri(spark, path)


def put_file(folder: str, name: str, body: bytes) -> None:
    """Write under a private name, then rename: a repeated or speculative task does no harm."""
    from pyarrow import fs as pafs

    store, base = pafs.FileSystem.from_uri(folder)
    part = f"{base}/.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as out:
        out.write(body)
    store.move(part, f"{base}/{name}")


def _encode(body: bytes, h: int, w: int, kind: str) -> bytes:
    if kind == "prob":
        return png_bytes(np.floor(np.frombuffer(body, np.float32).reshape(h, w).astype(float) * 255.0))
    shape = (h, w) if kind == "mask" else (h, w, 3)
    return png_bytes(np.frombuffer(body, np.uint8).reshape(shape))


def encoded(kind: str):
    """A function of columns (bytes, height, width) that gives a PNG."""

    @F.pandas_udf("binary")
    def encode(body: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
        return pd.Series([_encode(b, h, w, kind) for b, h, w in zip(body, height, width)])

    return encode


def write_rasters(df: DataFrame, path: str, kind: str = "mask", column: str | None = None, suffix: str | None = None, name: str = "stem") -> int:
    """Write one PNG per row as <name><suffix>.png and return how many.

    ``column`` (``kind`` by default) holds HW bytes for mask, HWC bytes for overlay and HW
    float32 bytes for prob, which is truncated to 255 * p.
    """
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    folder, ending = task_folder(df.sparkSession, path), f"_{kind}.png" if suffix is None else f"{suffix}.png"

    def write(frames):
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                put_file(folder, r.name + ending, _encode(r.body, r.height, r.width, kind))
            yield pd.DataFrame({"n": [len(pdf)]})

    rows = df.select(F.col(name).alias("name"), "height", "width", F.col(column or kind).alias("body"))
    return int(rows.mapInPandas(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n)


def copy_files(files: DataFrame, path: str, name: str = "out_name") -> int:
    """Copy ``content`` bytes to <path>/<name>, one file per row."""
    folder = task_folder(files.sparkSession, path)

    def write(frames):
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                put_file(folder, r.name, r.content)
            yield pd.DataFrame({"n": [len(pdf)]})

    rows = files.select(F.col(name).alias("name"), "content")
    return int(rows.mapInPandas(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n)


def write_metrics_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; null becomes an empty field. Merge logs with ``epoch_rows`` first."""
    df.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_summary_json(df: DataFrame, path: str) -> None:
    """Nested rows as JSON; nulls are kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
