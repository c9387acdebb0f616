"""Annotations to masks by interval algebra.

Shapes become inclusive row spans (image key, y, x_start, x_end). A mask is the union of kept
spans minus the union of ignored spans, found by a sweep over span edges, many images at a time.
Spans travel as bytes, one row per image and band of lines of a batch; edges are summed per position
as they arrive, so a task never holds more than one band's width + 1 of them per line, however many annotations overlap.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf
from pyspark.sql.pandas.types import to_arrow_type as _arrow

from ..functions.paths import stem
from .kernels import flat_ring_spans, flat_run_spans, read_many_counts

# Fixed value: category left out of masks unless others are named.
IGNORED = ("inoculum",)
SPAN = ("y", "x_start", "x_end")
BAND = 64  # lines of an image whose spans meet in one group
PIECE = 1_024  # spans of one row at most
AT_ONCE = 200_000  # spans that are swept together
PAINTED_AT_ONCE = 4_000_000  # pixels that are painted together


def category_names(categories: DataFrame, keys=("id",)) -> DataFrame:
    """id (and batch) to name; of equal ids the one latest in ``pos`` order counts."""
    return categories.groupBy(*keys).agg(F.max_by("name", "pos").alias("name"))


def annotation_classes(annotations: DataFrame, categories: DataFrame, ignore=IGNORED, batch: list[str] | None = None) -> DataFrame:
    """Add category (empty when unknown) and ign. An empty ignore list falls back to the default."""
    dropped = [c.lower() for c in (ignore or IGNORED)]
    batch = batch or []
    names = category_names(categories, (*batch, "id")).select(*batch, F.col("id").alias("category_id"), F.col("name").alias("category"))
    named = annotations.join(names, [*batch, "category_id"], "left")
    named = named.withColumn("category", F.coalesce("category", F.lit("")))
    return named.withColumn("ign", F.lower("category").isin(dropped))


def annotations_by_image(images: DataFrame, annotations: DataFrame, keys=("image_id",)) -> DataFrame:
    """Images with their number of annotations, 0 included; counted before the join."""
    counts = annotations.groupBy(*keys).agg(F.count("*").alias("n_ann"))
    return images.join(counts, list(keys), "left").withColumn("n_ann", F.coalesce("n_ann", F.lit(0).cast("long")))


def _as_spans(annotations: DataFrame, keep: list[str], find, packed: bool) -> DataFrame:
    """``keep`` and the spans y, x_start, x_end that ``find`` has for an Arrow batch of annotations: owner, y, x_start, x_end."""

    def spell(batches):
        for batch in batches:
            who, *spans = find(batch)
            kept = pa.RecordBatch.from_arrays([batch.column(c) for c in keep], names=keep).take(pa.array(who, pa.int64()))
            out = pa.RecordBatch.from_arrays([*kept.columns, *[pa.array(v, pa.int32()) for v in spans]], names=[*keep, *SPAN])
            if not packed:
                yield out
            elif out.num_rows:
                out = out.append_column("_band", pa.array(spans[0] // BAND, pa.int32()))
                yield _pieces(out.append_column("_ign", out.column("ign").fill_null(False)), keys, "int32", most)

    keys, most = [c for c in keep if c != "ign"], PIECE
    return annotations.mapInArrow(spell, _as_pieces(annotations, keys) if packed else _with_spans(annotations, keep, {}))


def _as_pieces(df: DataFrame, keys) -> T.StructType:
    fields = (("_band", T.IntegerType()), ("_ign", T.BooleanType()), ("_spans", T.BinaryType()))
    return T.StructType([*[df.schema[c] for c in keys], *[T.StructField(*f) for f in fields]])


def _with_spans(df: DataFrame, keep, kinds: dict) -> T.StructType:
    return T.StructType([*[df.schema[c] for c in keep], *[T.StructField(c, kinds.get(c, T.IntegerType())) for c in SPAN]])


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all lists laid end to end, and how many each has; a null list has none."""
    return _numbers(column.flatten()), _numbers(column.value_lengths().fill_null(0)).astype(np.int64)


def polygon_spans(annotations: DataFrame, keep: list[str], packed: bool = False) -> DataFrame:
    """Spans of ``polygons`` (array of flat x,y rings), each ring filled on its own.

    Rings with fewer than 6 numbers are ignored, an odd last number too. A whole Arrow batch of
    rings is filled at once, linear in its crossings; nothing is shuffled. With ``packed`` (and ``ign`` in ``keep``) the spans of
    a batch come as bytes, as ``compose_mask`` takes them, instead of one row each.
    """

    def find(batch):
        return flat_ring_spans(*_lists(batch.column("_ring")), _numbers(batch.column("_h")), _numbers(batch.column("_w")))

    rings = annotations.select(*keep, F.col("width").alias("_w"), F.col("height").alias("_h"), F.explode("polygons").alias("_ring"))
    return _as_spans(rings.where(F.size("_ring") >= 6), keep, find, packed)


def rle_spans(annotations: DataFrame, keep: list[str], packed: bool = False) -> DataFrame:
    """Spans of column-major run lengths: ``counts`` (array<long>) or ``counts_text`` (compressed).

    ``width`` and ``height`` are those of the run-length raster. One Arrow pass turns annotations into their row spans,
    so neither runs nor pixels are shuffled; its work follows the runs and the row spans, not the pixels. ``packed`` as in
    ``polygon_spans``.
    """

    def find(batch):
        return _run_spans(batch, _numbers(batch.column("_h")), _numbers(batch.column("_w")))

    have = annotations.columns
    counts = F.col("counts") if "counts" in have else F.lit(None).cast("array<long>")
    text = F.col("counts_text") if "counts_text" in have else F.lit(None).cast("string")
    runs = annotations.where(counts.isNotNull() | text.isNotNull())
    runs = runs.select(*keep, F.col("width").alias("_w"), F.col("height").alias("_h"), counts.alias("_counts"), text.alias("_text"))
    return _as_spans(runs, keep, find, packed)


def shape_spans(annotations: DataFrame, keep: list[str], packed: bool = False) -> DataFrame:
    """Spans of annotations that have either ``polygons``, as in ``polygon_spans``, or ``counts`` or ``counts_text``, as in
    ``rle_spans``, from one pass over them."""

    def find(batch):
        h, w = (_numbers(batch.column(c).fill_null(0)).astype(np.int64) for c in ("_h", "_w"))
        flat, size = _lists(batch.column("_ring"))
        rings, runs = np.flatnonzero(size), np.flatnonzero(size == 0)
        who, *spans = flat_ring_spans(flat, size[rings], h[rings], w[rings])
        part = batch.take(pa.array(runs))
        owner, *more = _run_spans(part, h[runs], w[runs])
        return np.concatenate([rings[who], runs[owner]]), *[np.concatenate(v) for v in zip(spans, more)]

    # a filter on the polygons themselves would have them parsed a second time
    rings = F.coalesce("polygons", F.array(F.lit(None).cast(annotations.schema["polygons"].dataType.elementType)))
    rows = annotations.select(
        *keep, F.col("width").alias("_w"), F.col("height").alias("_h"), F.col("counts").alias("_counts"), F.col("counts_text").alias("_text"), F.explode(rings).alias("_ring")
    )
    return _as_spans(rows.where("size(_ring) >= 6 or _counts is not null or _text is not null"), keep, find, packed)


def _run_spans(batch: pa.RecordBatch, h: np.ndarray, w: np.ndarray):
    length, size = _lists(batch.column("_counts"))
    who, *spans = flat_run_spans(length.astype(np.int64), size, h, w)
    texts = np.flatnonzero(_numbers(batch.column("_counts").is_null()))
    if texts.size:
        read = read_many_counts(batch.column("_text").take(pa.array(texts)).to_pylist())
        owner, *more = flat_run_spans(*read, h[texts], w[texts])
        who, spans = np.concatenate([who, texts[owner]]), [np.concatenate(v) for v in zip(spans, more)]
    return who, *spans


def _pieces(batch: pa.RecordBatch, keys: list[str], kind: str, most: int) -> pa.RecordBatch:
    """One row per key, band of lines and ``_ign`` of a batch: its spans as bytes, at most ``most`` of them in a row."""
    y, x_start, x_end = (_numbers(batch.column(c)).astype(kind) for c in SPAN)
    group = _numbers(batch.column("_ign")).astype(np.int64)
    for column in [batch.column("_band"), *[batch.column(k) for k in keys]]:
        codes = _numbers(column.dictionary_encode("encode").indices).astype(np.int64)
        group = np.unique(group * (codes.max(initial=0) + 1) + codes, return_inverse=True)[1]
    order = np.argsort(group, kind="stable")
    group = group[order]
    head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    place = np.arange(group.size) - np.repeat(head, np.diff(np.append(head, group.size)))
    head = np.flatnonzero(place % most == 0)
    flat = np.ascontiguousarray(np.stack([y, x_start, x_end], 1)[order])
    ends = np.append(head, group.size) * flat.strides[0]
    body = pa.Array.from_buffers(pa.binary(), head.size, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat)])
    names = [*keys, "_band", "_ign"]
    kept = pa.RecordBatch.from_arrays([batch.column(c) for c in names], names=names).take(pa.array(order[head]))
    return pa.RecordBatch.from_arrays([*kept.columns, body], names=[*names, "_spans"])


def _edges(group, y, x, d):
    """Edges in order of group, line and place, those of one place added up."""
    lines, places = (int(v.max(initial=0)) + 1 for v in (y, x))
    if min(y.min(initial=0), x.min(initial=0)) >= 0 and (int(group.max(initial=0)) + 1) * lines * places < 1 << 62:
        order = np.argsort((group * lines + y) * places + x, kind="stable")  # one number a place
    else:
        order = np.lexsort((x, y, group))
    group, y, x = group[order], y[order], x[order]
    head = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (y[1:] != y[:-1]) | (x[1:] != x[:-1])]))
    return group[head], y[head], x[head], np.add.reduceat(d[order], head)


def compose_mask(spans: DataFrame, keys=("image_id",)) -> DataFrame:
    """Kept minus ignored (``ign``), as disjoint maximal spans; the order of annotations is irrelevant.

    One number counts both kinds of open spans: kept ones as 1, ignored ones as 2**32, so a
    pixel belongs to the mask exactly where the running sum lies between 1 and 2**32 - 1.

    The spans of a batch travel as bytes, one row per key and band of BAND lines; the one shuffle sorts these rows. What a task
    holds is a piece of them and the summed edges of the band at hand, at most BAND * (width + 1), however many spans overlap.
    """
    keys, ignored, most, at_once = list(keys), 1 << 32, PIECE, AT_ONCE
    kinds = {c: spans.schema[c].dataType if c in spans.columns else T.IntegerType() for c in SPAN}
    kind = "int32" if all(isinstance(k, T.IntegerType) for k in kinds.values()) else "int64"

    def pack(batches):
        for batch in batches:
            if batch.num_rows:
                yield _pieces(batch, keys, kind, most)

    def sweep(batches):
        none = np.zeros(0, np.int64)
        open_key, held = None, (none, none, none)  # the group whose rows may go on, and its edges

        def masks(names: pa.RecordBatch, group, y, x, d):
            state = d.cumsum()  # every line ends at 0
            on = (state >= 1) & (state < ignored)
            turn = on != np.concatenate([[False], on[:-1]])
            start, stop = np.flatnonzero(turn & on), np.flatnonzero(turn & ~on)
            found = [y[start], x[start], x[stop] - 1]
            kept = names.take(pa.array(group[start]))
            return pa.RecordBatch.from_arrays([*kept.columns, *[pa.array(v, _arrow(kinds[c])) for c, v in zip(SPAN, found)]], names=[*keys, *SPAN])

        for batch in batches:
            body = batch.column("_spans")
            size = _numbers(pc.binary_length(body)).astype(np.int64) // (3 * np.dtype(kind).itemsize)
            slices = np.flatnonzero(np.diff(size.cumsum() // at_once, prepend=-1)) if size.size else []
            for at, to in zip(slices, [*slices[1:], size.size]):
                part = batch.slice(at, to - at)
                names = pa.RecordBatch.from_arrays([part.column(k) for k in keys], names=keys)
                first, n = _numbers(part.column("_first")), size[at:to]
                if open_key is None:
                    open_key = names.slice(0, 0)
                # group 0 is the one held over, unless this slice begins a new one
                group = np.repeat(first.cumsum(), n)
                y, x_start, x_end = np.frombuffer(b"".join(part.column("_spans").to_pylist()), kind).astype(np.int64).reshape(-1, 3).T
                d = np.where(np.repeat(_numbers(part.column("_ign")), n), ignored, 1)
                old = np.zeros(held[0].size, np.int64)
                group, y, x, d = _edges(
                    np.concatenate([old, group, group]), np.concatenate([held[0], y, y]),
                    np.concatenate([held[1], x_start, x_end + 1]), np.concatenate([held[2], d, -d]),
                )
                last = group >= first.sum()
                held = y[last], x[last], d[last]
                # row 0 is the key held over; a first slice has none and no group 0
                heads = names.take(pa.array(np.flatnonzero(first)))
                known = pa.Table.from_batches([open_key if open_key.num_rows else names.slice(0, 1), heads]).combine_chunks().to_batches()[0]
                yield masks(known, *(v[~last] for v in (group, y, x, d)))
                open_key = known.slice(known.num_rows - 1, 1)
        if open_key is not None:
            yield masks(open_key, np.zeros(held[0].size, np.int64), *held)

    rows = spans
    if "_spans" not in spans.columns:
        whole = spans.where(" and ".join(f"{c} is not null" for c in SPAN))
        whole = whole.select(*keys, *SPAN, F.expr(f"cast(y div {BAND} as int)").alias("_band"), F.coalesce("ign", F.lit(False)).alias("_ign"))
        rows = whole.mapInArrow(pack, _as_pieces(whole, keys))
    # Spark decides which keys are one; a group's rows follow each other
    group = Window.partitionBy(*keys, "_band").orderBy("_ign")
    rows = rows.withColumn("_first", F.row_number().over(group) == 1)
    return rows.select(*keys, "_ign", "_spans", "_first").mapInArrow(sweep, _with_spans(spans, keys, kinds))


def mask_pixels(spans: DataFrame, keys=("image_id",)) -> DataFrame:
    return spans.select(*keys, "y", F.explode(F.sequence("x_start", "x_end")).alias("x"))


def mask_coverage(images: DataFrame, spans: DataFrame, keys=("image_id",)) -> DataFrame:
    """Foreground pixels per image; images without any keep an all-zero mask."""
    area = spans.groupBy(*keys).agg(F.sum(F.col("x_end") - F.col("x_start") + 1).cast("long").alias("fg"))
    return images.join(area, list(keys), "left").withColumn("fg", F.coalesce("fg", F.lit(0).cast("long")))


def paint_masks(images: DataFrame, spans: DataFrame, keys=("image_id",)) -> DataFrame:
    """keys, width, height, mask (HW bytes 0/255).

    ``spans`` are disjoint (as compose_mask makes them), so the list gathered per image is at most
    half its pixels long: smaller than the raster row it becomes.
    """
    keys = list(keys)

    def drawn(spans: np.ndarray, size: np.ndarray, h: np.ndarray, w: np.ndarray) -> list[bytes]:
        base = np.concatenate([[0], (h * (w + 1)).cumsum()])
        who = np.repeat(np.arange(size.size), size // 3)
        y, x_start, x_end = spans.reshape(-1, 3).T.astype(np.int64)
        line = base[who] + y * (w[who] + 1)
        edge = np.zeros(base[-1] + 1, np.int8)
        np.add.at(edge, line + x_start, 1)
        np.add.at(edge, line + x_end + 1, -1)
        ink = np.cumsum(edge, dtype=np.int8).view(np.uint8) * np.uint8(255)
        return [ink[a:b].reshape(p, q + 1)[:, :q].tobytes() for a, b, p, q in zip(base[:-1], base[1:], h, w)]

    @pandas_udf("binary")
    def paint(flat: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
        empty = np.zeros(0, np.int32)
        lists = [empty if v is None else np.asarray(v) for v in flat]
        size = np.array([v.size for v in lists], np.int64)
        h, w = height.to_numpy(np.int64), width.to_numpy(np.int64)
        out, at = [], 0
        # some images at a time, so that the edges of a large batch stay small
        for to in [*(np.flatnonzero(np.diff((h * (w + 1)).cumsum() // PAINTED_AT_ONCE)) + 1), len(lists)]:
            if to > at:
                out += drawn(np.concatenate(lists[at:to]), size[at:to], h[at:to], w[at:to])
            at = to
        return pd.Series(out, dtype=object)

    per_image = spans.groupBy(*keys).agg(F.flatten(F.collect_list(F.array("y", "x_start", "x_end"))).alias("_spans"))
    return images.join(per_image, keys, "left").select(
        *keys, "width", "height", paint("_spans", "height", "width").alias("mask")
    )


def prefix_names(df: DataFrame, batch_col: str, name_col: str, n: int | None = None) -> DataFrame:
    """Add out_name: the batch, an underscore, the name; and ``collided``, the rows that share this name and were dropped.

    With ``n`` only the first n characters of the batch are used, so names may collide between batches; the last batch stays.
    """
    batch = F.col(batch_col) if n is None else F.substring(batch_col, 1, n)
    named = df.withColumn("out_name", F.concat(batch, F.lit("_"), F.col(name_col)))
    last = named.groupBy("out_name").agg(F.max_by(F.struct(*named.columns), batch_col).alias("r"), (F.count("*") - 1).alias("collided"))
    return last.select("r.*", "collided")


def restrict_to_images(masks: DataFrame, image_files: DataFrame, keys=("stem",), missing: bool = False) -> DataFrame:
    """Masks whose stem exists among the image files, or with ``missing`` those whose stem does not."""
    have = image_files.select(*keys).distinct()
    return masks.join(have, list(keys), "left_anti" if missing else "left_semi")


def with_stem(df: DataFrame, name_col: str) -> DataFrame:
    return df.withColumn("stem", stem(F.col(name_col)))
