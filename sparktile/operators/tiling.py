"""Tile grids, crops, foreground counts and filters.

Long layout: one row per pixel with source_id, y, x, bands, width, height.
Packed layout: one row per image with ``image`` (HWC bytes) and ``mask`` (HW bytes).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.positions import check_geometry, covering_origins, debug_positions, tile_positions
from ..functions.ranking import ranged_index, shuffled_index

TILE_KEY = ["source_id", "y0", "x0"]
ROWS_PER_FRAME = 64  # tiles handed to Arrow at a time


def tile_grid(images: DataFrame, patch_size: int, stride: int | None = None, overlap: int | None = None) -> DataFrame:
    """All tile origins of each image; two generators, no shuffle. Other image columns are kept."""
    step = stride or patch_size - (overlap or 0)
    check_geometry(patch_size, step)
    rows = images.withColumn("y0", F.explode(tile_positions(F.col("height"), patch_size, step)))
    return rows.withColumn("x0", F.explode(tile_positions(F.col("width"), patch_size, step))).withColumn(
        "patch_size", F.lit(patch_size)
    )


def debug_grid(images: DataFrame, patch_size: int) -> DataFrame:
    """Non-overlapping cells with inclusive corners and a 1-based row-major number."""
    cells = images.withColumn("y0", F.explode(debug_positions(F.col("height"), patch_size))).withColumn(
        "x0", F.explode(debug_positions(F.col("width"), patch_size))
    )
    columns = F.floor((F.col("width") + (patch_size - 1)) / F.lit(patch_size))
    return cells.select(
        "source_id", "x0", "y0",
        F.least(F.col("x0") + (patch_size - 1), F.col("width") - 1).alias("x1"),
        F.least(F.col("y0") + (patch_size - 1), F.col("height") - 1).alias("y1"),
        (F.floor(F.col("y0") / F.lit(patch_size)) * columns + F.floor(F.col("x0") / F.lit(patch_size)) + 1)
        .cast("int").alias("cell"),
    )


def tile_pixels(pixels: DataFrame, patch_size: int, stride: int) -> DataFrame:
    """Every pixel once per tile that covers it, with tile-relative dy, dx."""
    hit = pixels.withColumn("y0", F.explode(covering_origins(F.col("y"), F.col("height"), patch_size, stride)))
    hit = hit.withColumn("x0", F.explode(covering_origins(F.col("x"), F.col("width"), patch_size, stride)))
    return hit.withColumn("dy", F.col("y") - F.col("y0")).withColumn("dx", F.col("x") - F.col("x0"))


def padding_pixels(images: DataFrame, patch_size: int, stride: int) -> DataFrame:
    """Positions of a tile that lie beyond its image, generated from the grid alone."""
    cut = tile_grid(images, patch_size, stride).where(
        (F.col("y0") + patch_size > F.col("height")) | (F.col("x0") + patch_size > F.col("width"))
    )
    side = F.sequence(F.lit(0), F.lit(patch_size - 1))
    cells = cut.withColumn("dy", F.explode(side)).withColumn("dx", F.explode(side))
    return cells.where((F.col("y0") + F.col("dy") >= F.col("height")) | (F.col("x0") + F.col("dx") >= F.col("width")))


def missing_pixels(pixels: DataFrame, images: DataFrame) -> DataFrame:
    """Places inside the images at which ``pixels`` has no row: source_id, width, height, y, x.

    A line is held as one bit a pixel, 32 to a number, and the bits are joined before they are shuffled: a 32nd of the pixels.
    """
    bits = 32
    word = F.expr(f"cast(x div {bits} as int)").alias("_word")
    have = pixels.select("source_id", "y", word, F.expr(f"shiftleft(1L, cast(x % {bits} as int))").alias("_have"))
    lines = images.where("width > 0 and height > 0").select("source_id", "width", "height", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
    lines = lines.withColumn("_word", F.explode(F.expr(f"sequence(0, cast((width - 1) div {bits} as int))")))
    size = [F.lit(None).cast(images.schema[c].dataType).alias(c) for c in ("width", "height")]
    both = have.select("source_id", "y", "_word", "_have", *size).unionByName(lines.withColumn("_have", F.lit(0).cast("long")))
    seen = both.groupBy("source_id", "y", "_word").agg(F.bit_or("_have").alias("_have"), F.max("width").alias("width"), F.max("height").alias("height"))
    left = seen.where(F.expr(f"_have <> shiftleft(1L, least({bits}, width - {bits} * _word)) - 1"))
    at = left.withColumn("_bit", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))))
    at = at.withColumn("x", (F.col("_word") * bits + F.col("_bit")).cast("int"))
    return at.where("x < width and (shiftright(_have, _bit) & 1) = 0").select("source_id", "width", "height", "y", "x")


def whole_pixels(pixels: DataFrame, images: DataFrame, bands: list[str]) -> DataFrame:
    """source_id, width, height, y, x and ``bands``: the pixels, and zeros where an image has none."""
    keep = ["source_id", "width", "height", "y", "x"]
    zeros = [F.lit(0).cast(pixels.schema[b].dataType).alias(b) for b in bands]
    return pixels.select(*keep, *bands).unionByName(missing_pixels(pixels, images).select(*keep, *zeros))


def once_per_place(cells: Column, place: list[str]) -> Column:
    """The structs of a sorted array without those whose ``place`` fields equal the struct before: the smallest of each place."""

    def again(cell, i):
        before = F.get(cells, i - 1)
        same = [cell.getField(p) == before.getField(p) for p in place]
        return F.coalesce(reduce(lambda a, b: a & b, same), F.lit(False))

    return F.filter(cells, lambda cell, i: ~again(cell, i))


def crop_pad(pixels: DataFrame, images: DataFrame, patch_size: int, stride: int, bands: list[str]) -> DataFrame:
    """Dense tiles in long form: patch_size**2 rows each, zeros beyond the right and bottom edge and where an image has no pixel."""
    keep = ["source_id", "width", "height", "y0", "x0", "dy", "dx"]
    real = tile_pixels(whole_pixels(pixels, images, bands), patch_size, stride).select(*keep, *bands)
    pads = padding_pixels(images, patch_size, stride).select(
        *keep, *[F.lit(0).cast(pixels.schema[b].dataType).alias(b) for b in bands]
    )
    return real.unionByName(pads)


def foreground_count(
    pixels: DataFrame, images: DataFrame, patch_size: int, stride: int, mask_threshold: int = 127, value: str = "m"
) -> DataFrame:
    """fg per tile of the whole grid, empty tiles included.

    Only foreground pixels are spread to tiles, and the grid enters as zero rows of the same
    aggregation: one shuffle, with map-side sums, and no join.
    """
    hits = tile_pixels(pixels.where(F.col(value) > mask_threshold), patch_size, stride)
    keys = ["source_id", "width", "height", "y0", "x0"]
    ones = hits.select(*keys, F.lit(1).cast("long").alias("fg"))
    zeros = tile_grid(images, patch_size, stride).select(*keys, F.lit(0).cast("long").alias("fg"))
    if mask_threshold < 0:
        pads = padding_pixels(images, patch_size, stride).where(F.lit(0) > mask_threshold)
        ones = ones.unionByName(pads.select(*keys, F.lit(1).cast("long").alias("fg")))
    return (
        ones.unionByName(zeros).groupBy(*keys).agg(F.sum("fg").alias("fg")).withColumn("patch_size", F.lit(patch_size))
    )


def filter_empty_tiles(tiles: DataFrame, min_fg: int = 1) -> DataFrame:
    return tiles.where(F.col("fg") >= min_fg)


def build_tiles(
    images: DataFrame,
    pixels: DataFrame | None,
    patch_size: int,
    stride: int,
    filter_empty: bool = True,
    mask_threshold: int = 127,
    min_fg: int = 1,
) -> DataFrame:
    """Tile manifest. Without the filter no pixel is read."""
    if not filter_empty:
        return tile_grid(images, patch_size, stride)
    counted = foreground_count(pixels, images, patch_size, stride, mask_threshold)
    return filter_empty_tiles(counted, min_fg)


def batches(tiles: DataFrame, batch_size: int, shuffle: bool, seed: int = 42, epoch: int = 0, key=TILE_KEY) -> DataFrame:
    """Add idx and batch: a seeded order that changes with the epoch, or the row-major order.

    Number manifests rather than payloads: the rows are ranked with all their columns.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    if shuffle:
        ranked = shuffled_index(tiles, list(key), f"{seed}:{epoch}")
    else:
        ranked = ranged_index(tiles, list(key))
    return ranked.withColumn("batch", F.floor(F.col("idx") / F.lit(batch_size)).cast("long"))


# --- packed layout ------------------------------------------------------------------------------


def _axis(length: int, patch_size: int, stride: int) -> np.ndarray:
    """Origins along one axis for a single image inside a task."""
    last = length - patch_size
    return np.zeros(1, np.int64) if last <= 0 else np.unique(np.append(np.arange(0, last + 1, stride), last))


def _tile_sums(hits: np.ndarray, ys: np.ndarray, xs: np.ndarray, patch_size: int, threshold: int = 0) -> np.ndarray:
    """Sums of all tiles from one summed-area table: linear in pixels, whatever the overlap."""
    if threshold < 0:  # every byte is above it, and so are the zeros of the padding
        return np.full((len(ys), len(xs)), patch_size * patch_size)
    h, w = hits.shape
    area = np.zeros((h + 1, w + 1), np.int64)
    area[1:, 1:] = hits.cumsum(0, dtype=np.int64).cumsum(1)
    y1, x1 = np.minimum(ys + patch_size, h), np.minimum(xs + patch_size, w)
    return area[np.ix_(y1, x1)] - area[np.ix_(ys, x1)] - area[np.ix_(y1, xs)] + area[np.ix_(ys, xs)]


def _id_type(df: DataFrame) -> str:
    return df.schema["source_id"].dataType.simpleString()


def foreground_count_packed(images: DataFrame, patch_size: int, stride: int, mask_threshold: int = 127) -> DataFrame:
    """Same rows as ``foreground_count`` from packed masks: a narrow pass, no shuffle. Reads only ``mask``."""
    check_geometry(patch_size, stride)

    def scan(frames):
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                ys, xs = _axis(r.height, patch_size, stride), _axis(r.width, patch_size, stride)
                hits = np.frombuffer(r.mask, np.uint8).reshape(r.height, r.width) > mask_threshold
                fg = _tile_sums(hits, ys, xs, patch_size, mask_threshold)
                yield pd.DataFrame({
                    "source_id": r.source_id, "width": r.width, "height": r.height,
                    "y0": np.repeat(ys, len(xs)), "x0": np.tile(xs, len(ys)), "fg": fg.ravel(),
                })

    schema = f"source_id {_id_type(images)}, width int, height int, y0 int, x0 int, fg long"
    counted = images.select("source_id", "width", "height", "mask").mapInPandas(scan, schema)
    return counted.withColumn("patch_size", F.lit(patch_size))


def _crop(plane: np.ndarray, y0: int, x0: int, patch_size: int, fill=0) -> np.ndarray:
    cut = plane[y0 : y0 + patch_size, x0 : x0 + patch_size]
    short = [(0, patch_size - n) for n in cut.shape[:2]] + [(0, 0)] * (cut.ndim - 2)
    return np.pad(cut, short, constant_values=fill)


def cut_tiles(
    images: DataFrame,
    patch_size: int,
    stride: int,
    mask_threshold: int = 127,
    min_fg: int = 0,
    manifest: DataFrame | None = None,
    carry: tuple = (),
) -> DataFrame:
    """Packed tiles with image (RGB bytes) and binarized mask (0/1 bytes); one decode per image.

    ``min_fg`` filters while cutting, so empty tiles never get a payload and nothing shuffles.
    Images without a mask column give all-zero masks. With a ``manifest`` (source_id, y0, x0) only its tiles are cut: the origins travel to the
    image as one array, never the image to its tiles. Such an array has at most one entry per
    tile of one image, far less than the image row it joins. ``carry`` names further (small)
    columns of the image to repeat on its tiles.
    """
    check_geometry(patch_size, stride)
    channels, listed, masked = 3, manifest is not None, "mask" in images.columns

    def cut(frames):
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                image = np.frombuffer(r.image, np.uint8).reshape(r.height, r.width, channels)
                hits = np.zeros(image.shape[:2], bool)
                if masked:
                    hits = np.frombuffer(r.mask, np.uint8).reshape(r.height, r.width) > mask_threshold
                if not listed:
                    ys, xs = _axis(r.height, patch_size, stride), _axis(r.width, patch_size, stride)
                    wanted = [(y, x) for y, row in zip(ys, _tile_sums(hits, ys, xs, patch_size, mask_threshold) >= min_fg) for x in xs[row]]
                else:
                    wanted = sorted((o["y0"], o["x0"]) for o in r.origins)
                for at in range(0, len(wanted), ROWS_PER_FRAME):
                    part = wanted[at : at + ROWS_PER_FRAME]
                    yield pd.DataFrame({
                        "source_id": r.source_id, "width": r.width, "height": r.height,
                        "y0": [y for y, _ in part], "x0": [x for _, x in part], "patch_size": patch_size,
                        "image": [_crop(image, y, x, patch_size).tobytes() for y, x in part],
                        "mask": [_crop(hits, y, x, patch_size, mask_threshold < 0).astype(np.uint8).tobytes() for y, x in part],
                        **{c: [getattr(r, c)] * len(part) for c in carry},
                    })

    source = images.select("source_id", "width", "height", "image", *(["mask"] if masked else []), *carry)
    if listed:
        origins = manifest.groupBy("source_id").agg(F.collect_set(F.struct("y0", "x0")).alias("origins"))
        source = source.join(origins, "source_id")
    schema = (
        f"source_id {_id_type(images)}, width int, height int, y0 int, x0 int, patch_size int, image binary, mask binary"
    ) + "".join(f", {c} {images.schema[c].dataType.simpleString()}" for c in carry)
    return source.mapInPandas(cut, schema)


def tile_samples(tiles: DataFrame, images: DataFrame, patch_size: int, stride: int, mask_threshold: int = 127, transform=None) -> DataFrame:
    """Payload for a tile manifest, optionally passed through a packed transform."""
    cut = cut_tiles(images, patch_size, stride, mask_threshold, manifest=tiles)
    return transform(cut) if transform else cut


def unpack_tiles(tiles: DataFrame) -> DataFrame:
    """Packed tiles to long form: source_id, y0, x0, dy, dx, r, g, b, t (mask byte)."""

    def cells(frames):
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                t = np.frombuffer(r.mask, np.uint8)
                y, x = np.divmod(np.arange(len(t)), int(round(len(t) ** 0.5)))
                rgb = np.frombuffer(r.image, np.uint8).reshape(-1, 3)
                yield pd.DataFrame({
                    "source_id": r.source_id, "y0": r.y0, "x0": r.x0, "dy": y, "dx": x,
                    "r": rgb[:, 0], "g": rgb[:, 1], "b": rgb[:, 2], "t": t,
                })

    schema = f"source_id {_id_type(tiles)}, y0 int, x0 int, dy int, dx int, r int, g int, b int, t int"
    return tiles.select(*TILE_KEY, "image", "mask").mapInPandas(cells, schema)


def unpack_images(images: DataFrame) -> DataFrame:
    """Packed images to long pixels: source_id, width, height, y, x, then r, g, b and m as far as present."""
    have = [c for c in ("image", "mask") if c in images.columns]

    def pixels(frames):
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                band = max(1, 1_000_000 // r.width)  # rows of one frame
                for top in range(0, r.height, band):
                    n = min(band, r.height - top)
                    part = slice(top * r.width, (top + n) * r.width)
                    out = {
                        "source_id": r.source_id, "width": r.width, "height": r.height,
                        "y": np.repeat(np.arange(top, top + n), r.width), "x": np.tile(np.arange(r.width), n),
                    }
                    if "image" in have:
                        rgb = np.frombuffer(r.image, np.uint8).reshape(-1, 3)[part]
                        out |= {c: rgb[:, k] for k, c in enumerate("rgb")}
                    if "mask" in have:
                        out["m"] = np.frombuffer(r.mask, np.uint8)[part]
                    yield pd.DataFrame(out)

    bands = ", r int, g int, b int" * ("image" in have) + ", m int" * ("mask" in have)
    schema = f"source_id {_id_type(images)}, width int, height int, y int, x int{bands}"
    return images.select("source_id", "width", "height", *have).mapInPandas(pixels, schema)
