"""Rasters as lattice blocks: tiles, scores and masks of images that fit no single row or task.

A block table has one row per cell of a ``block`` x ``block`` lattice: source_id, width, height, by, bx and the bytes of
``image`` (HWC RGB) and/or ``mask`` (HW).  No operator here gathers an image: a tile belongs to the block that holds its
origin, blocks borrow the margin their tiles need from the blocks beyond, and scores travel to the blocks they fall on as sums.
Memory follows the block and patch size alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.positions import check_geometry
from .kernels import resize_plane
from .scoring import BLOCK, BLOCK_KEY, cut_blocks
from .tiling import ROWS_PER_FRAME, _crop, _tile_sums

BANDS = {"image": 3, "mask": 1}
SIZE = "width int, height int, by int, bx int"


def _kind(df: DataFrame) -> str:
    return df.schema["source_id"].dataType.simpleString()


def _layers(df: DataFrame) -> list[str]:
    return [c for c in BANDS if c in df.columns]


def block_images(images: DataFrame, block: int = BLOCK) -> DataFrame:
    """Packed images (image and/or mask) to a block table, without a shuffle. Write it once where images are used again."""
    sizes = images.select("source_id", "width", "height", *_layers(images))
    return cut_blocks(sizes, _layers(images), block, keep=("width", "height"))


def block_pixels(pixels: DataFrame, block: int = BLOCK) -> DataFrame:
    """Long pixels (r, g, b and/or m) to a block table; a group is one block."""
    bands = [c for c in ("r", "g", "b", "m") if c in pixels.columns]
    kind = _kind(pixels)
    layers = (["image"] if "r" in bands else []) + (["mask"] if "m" in bands else [])

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        h, w = min(block, first.height - first.by * block), min(block, first.width - first.bx * block)
        out = {c: [first[c]] for c in ("source_id", "width", "height", "by", "bx")}
        at = ((pdf.y - first.by * block) * w + pdf.x - first.bx * block).to_numpy()
        for layer, columns in (("image", ["r", "g", "b"]), ("mask", ["m"])):
            if layer in layers:
                whole = np.zeros((h * w, len(columns)), np.uint8)
                whole[at] = pdf[columns].to_numpy()
                out[layer] = [whole.tobytes()]
        return pd.DataFrame(out)

    placed = pixels.select(
        "source_id", "width", "height", "y", "x", *bands, F.expr(f"cast(y div {block} as int)").alias("by"), F.expr(f"cast(x div {block} as int)").alias("bx")
    )
    return placed.groupBy(*BLOCK_KEY).applyInPandas(fill, f"source_id {kind}, {SIZE}" + "".join(f", {c} binary" for c in layers))


def _end(at: int, length: int, block: int, halo: int) -> int:
    """Where block ``at`` with its margin ends on an axis."""
    return min(length, at * block + block + halo)


def halo_blocks(blocks: DataFrame, halo: int, block: int = BLOCK) -> DataFrame:
    """The same table with blocks that reach ``halo`` pixels further down and right, as far as the image goes.

    One shuffle on the block: besides itself a block sends only the strips its upper and left neighbours need, (1 + halo /
    block)**2 of its bytes in all; a group is one block with its margin.
    """
    layers, kind = _layers(blocks), _kind(blocks)
    reach = -(-halo // block)

    def lend(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                y, x = r.by * block, r.bx * block
                h, w = min(block, r.height - y), min(block, r.width - x)
                planes = {c: np.frombuffer(getattr(r, c), np.uint8).reshape(h, w, BANDS[c]) for c in layers}
                out = []
                for by in range(max(0, r.by - reach), r.by + 1):
                    for bx in range(max(0, r.bx - reach), r.bx + 1):
                        ph, pw = min(h, _end(by, r.height, block, halo) - y), min(w, _end(bx, r.width, block, halo) - x)
                        if ph > 0 and pw > 0:
                            out.append((r.source_id, r.width, r.height, by, bx, y, x, ph, pw, *[p[:ph, :pw].tobytes() for p in planes.values()]))
                yield pd.DataFrame(out, columns=["source_id", "width", "height", "by", "bx", "fy", "fx", "fh", "fw", *layers])

    def join(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        first = rows[0]
        y, x = first["by"] * block, first["bx"] * block
        h, w = _end(first["by"], first["height"], block, halo) - y, _end(first["bx"], first["width"], block, halo) - x
        out = {c: [first[c]] for c in ("source_id", "width", "height", "by", "bx")}
        for c in layers:
            whole = np.zeros((h, w, BANDS[c]), np.uint8)
            for r in rows:
                at = np.s_[r["fy"] - y : r["fy"] - y + r["fh"], r["fx"] - x : r["fx"] - x + r["fw"]]
                whole[at] = np.frombuffer(r[c], np.uint8).reshape(r["fh"], r["fw"], BANDS[c])
            out[c] = [whole.tobytes()]
        return pa.table(out, pa.schema([group.schema.field(c) for c in out]))

    bytes_of = "".join(f", {c} binary" for c in layers)
    pieces = blocks.select("source_id", "width", "height", "by", "bx", *layers).mapInPandas(
        lend, f"source_id {kind}, {SIZE}, fy int, fx int, fh int, fw int{bytes_of}"
    )
    return pieces.groupBy(*BLOCK_KEY).applyInArrow(join, f"source_id {kind}, {SIZE}{bytes_of}")


def owned_origins(at: int, length: int, patch_size: int, stride: int, block: int) -> np.ndarray:
    """Tile origins of an axis that lie in block ``at``: multiples of the stride and the one flush with the end."""
    last, low = length - patch_size, at * block
    if last <= 0:
        return np.zeros(1 if at == 0 else 0, np.int64)
    high = min(low + block - 1, last)
    regular = np.arange(-(-low // stride) * stride, high + 1, stride)
    return np.append(regular, last) if low <= last <= high and last % stride else regular


def coverage(length: int, patch_size: int, stride: int, low: int, high: int) -> np.ndarray:
    """How many tiles of an axis cover each place from ``low`` up to ``high``."""
    place, last = np.arange(low, high), length - patch_size
    if last <= 0:
        return np.ones(high - low, np.int64)
    n = np.minimum(place, last) // stride - np.maximum(-(-(place - patch_size + 1) // stride), 0) + 1
    return np.maximum(n, 0) + ((place >= last) if last % stride else 0)


def _planes(r, layers, block: int, halo: int) -> dict[str, np.ndarray]:
    h, w = _end(r.by, r.height, block, halo) - r.by * block, _end(r.bx, r.width, block, halo) - r.bx * block
    return {c: np.frombuffer(getattr(r, c), np.uint8).reshape((h, w, 3) if c == "image" else (h, w)) for c in layers}


def cut_block_tiles(
    blocks: DataFrame, patch_size: int, stride: int, block: int = BLOCK, mask_threshold: int = 127, min_fg: int = 0, manifest: DataFrame | None = None
) -> DataFrame:
    """The tiles of ``cut_tiles`` from a block table: each block cuts the tiles whose origin it holds.

    With ``min_fg`` tiles are counted on the mask and empty ones get no payload. With a ``manifest`` (source_id, y0, x0) only
    its tiles are cut; its origins meet the block, at most one entry a tile of one block. Without an image layer the image is
    left out; without a mask it is all zero.
    """
    check_geometry(patch_size, stride)
    halo, layers, kind, listed = patch_size - 1, _layers(blocks), _kind(blocks), manifest is not None
    near = halo_blocks(blocks, halo, block)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                planes, y, x = _planes(r, layers, block, halo), r.by * block, r.bx * block
                shape = next(iter(planes.values())).shape[:2]
                hits = planes["mask"] > mask_threshold if "mask" in planes else np.zeros(shape, bool)
                if listed:
                    wanted = sorted((o["y0"], o["x0"]) for o in r.origins)
                else:
                    ys, xs = (owned_origins(at, n, patch_size, stride, block) for at, n in ((r.by, r.height), (r.bx, r.width)))
                    if not (len(ys) and len(xs)):
                        continue
                    enough = _tile_sums(hits, ys - y, xs - x, patch_size, mask_threshold) >= min_fg
                    wanted = [(a, b) for a, row in zip(ys, enough) for b in xs[row]]
                for i in range(0, len(wanted), ROWS_PER_FRAME):
                    part = wanted[i : i + ROWS_PER_FRAME]
                    out = {"source_id": r.source_id, "width": r.width, "height": r.height, "y0": [a for a, _ in part], "x0": [b for _, b in part], "patch_size": patch_size}
                    if "image" in planes:
                        out["image"] = [_crop(planes["image"], a - y, b - x, patch_size).tobytes() for a, b in part]
                    out["mask"] = [_crop(hits, a - y, b - x, patch_size, mask_threshold < 0).astype(np.uint8).tobytes() for a, b in part]
                    yield pd.DataFrame(out)

    if listed:
        owner = manifest.select("source_id", "y0", "x0", *[F.expr(f"cast({c}0 div {block} as int)").alias(f"b{c}") for c in "yx"])
        near = near.join(owner.groupBy(*BLOCK_KEY).agg(F.collect_set(F.struct("y0", "x0")).alias("origins")), BLOCK_KEY)
    image = ", image binary" if "image" in layers else ""
    return near.mapInPandas(cut, f"source_id {kind}, width int, height int, y0 int, x0 int, patch_size int{image}, mask binary")


_models: dict = {}


def score_blocks(
    blocks: DataFrame, make_predict, patch_size: int, stride: int, prepare, side: int | None = None, batch_size: int = 64, threshold: float = 0.5, block: int = BLOCK
) -> DataFrame:
    """Run a model over all tiles of a block table; one row per block: source_id, width, height, by, bx, y, x, h, w, prob
    (row-major float32 bytes), mask (0/255) and overlay.

    ``make_predict()`` is called once per Python worker; see ``score_tiles`` for what it returns. ``prepare`` turns a tile (HWC
    bytes) into the model's CHW floats of side ``side``. Tiles are cut, scored and summed in one pass over blocks with their
    margin, and overlaps inside a block are added before anything moves: the second and last shuffle carries sums, not tiles,
    together with the block's own colours. How many tiles cover a pixel follows from the geometry; pixels that none covers
    score 0.
    """
    check_geometry(patch_size, stride)
    halo, kind, token, side = patch_size - 1, _kind(blocks), uuid.uuid4().hex, side or patch_size
    piece_columns = ["source_id", "width", "height", "by", "bx", "sy", "sx", "fy", "fx", "fh", "fw", "piece"]

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if token not in _models:
            _models.clear()
            _models[token] = make_predict()
        model = _models[token]
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                image, y, x = _planes(r, ["image"], block, halo)["image"], r.by * block, r.bx * block
                ys, xs = (owned_origins(at, n, patch_size, stride, block) for at, n in ((r.by, r.height), (r.bx, r.width)))
                tiles = [(a - y, b - x) for a in ys for b in xs]
                if not tiles:
                    continue
                total = np.zeros(image.shape[:2])
                for i in range(0, len(tiles), batch_size):
                    part = tiles[i : i + batch_size]
                    batch = np.stack([prepare(_crop(image, a, b, patch_size)).reshape(3, side, side) for a, b in part])
                    logits = model(batch)
                    logits = np.asarray(logits["out"] if isinstance(logits, dict) else logits, np.float64).reshape(len(part), side, side)
                    for (a, b), p in zip(part, (1.0 / (1.0 + np.exp(-logits))).astype(np.float32)):
                        if side != patch_size:
                            p = resize_plane(p.astype(np.float64), patch_size).astype(np.float32)
                        cut = total[a : a + patch_size, b : b + patch_size]
                        cut += p[: cut.shape[0], : cut.shape[1]]
                out = []
                bottom, right = min(ys[-1] + patch_size, r.height), min(xs[-1] + patch_size, r.width)
                for by in range(r.by, (bottom - 1) // block + 1):
                    for bx in range(r.bx, (right - 1) // block + 1):
                        y0, x0, y1, x1 = by * block, bx * block, min(bottom, by * block + block), min(right, bx * block + block)
                        body = total[y0 - y : y1 - y, x0 - x : x1 - x].tobytes()
                        out.append((r.source_id, r.width, r.height, by, bx, r.by, r.bx, y0, x0, y1 - y0, x1 - x0, body))
                yield pd.DataFrame(out, columns=piece_columns)

    def merge(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        first = rows[0]
        y, x = first["by"] * block, first["bx"] * block
        h, w = min(block, first["height"] - y), min(block, first["width"] - x)
        total, rgb = np.zeros((h, w)), None
        for r in sorted(rows, key=lambda r: (r["sy"], r["sx"])):
            if r["image"] is not None:
                rgb = np.frombuffer(r["image"], np.uint8).reshape(h * w, 3)
                continue
            at = np.s_[r["fy"] - y : r["fy"] - y + r["fh"], r["fx"] - x : r["fx"] - x + r["fw"]]
            total[at] += np.frombuffer(r["piece"], np.float64).reshape(r["fh"], r["fw"])
        tiles = np.outer(coverage(first["height"], patch_size, stride, y, y + h), coverage(first["width"], patch_size, stride, x, x + w))
        prob = (total / np.maximum(tiles, 1)).astype(np.float32)
        hit = prob.ravel() >= np.float32(threshold)
        tinted = np.minimum(rgb // 2 + np.array([0, 128, 0]), 255)
        out = {c: [first[c]] for c in ("source_id", "width", "height", "by", "bx")} | {"y": [y], "x": [x], "h": [h], "w": [w], "prob": [prob.tobytes()]}
        out |= {"mask": [(hit * 255).astype(np.uint8).tobytes()], "overlay": [np.where(hit[:, None], tinted, rgb).astype(np.uint8).tobytes()]}
        types = {"source_id": group.schema.field("source_id").type} | {c: pa.binary() for c in ("prob", "mask", "overlay")}
        return pa.table(out, pa.schema([pa.field(c, types.get(c, pa.int32())) for c in out]))

    near = halo_blocks(blocks.select("source_id", "width", "height", "by", "bx", "image"), halo, block)
    sums = near.mapInPandas(score, f"source_id {kind}, {SIZE}, sy int, sx int, fy int, fx int, fh int, fw int, piece binary")
    zero = F.lit(-1)
    own = blocks.select("source_id", "width", "height", "by", "bx", *[zero.alias(c) for c in ("sy", "sx", "fy", "fx", "fh", "fw")], F.lit(None).cast("binary").alias("piece"), "image")
    both = sums.withColumn("image", F.lit(None).cast("binary")).unionByName(own)
    return both.groupBy(*BLOCK_KEY).applyInArrow(merge, f"source_id {kind}, {SIZE}, y int, x int, h int, w int, prob binary, mask binary, overlay binary")
