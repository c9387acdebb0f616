"""Score tiles with a user model, average overlaps, render masks."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions.pixels import overlay_rgb, prob_to_u8, sigmoid, threshold_mask
from ..functions.positions import covering_origins
from .kernels import resize_plane

BLOCK = 256  # side of an output block in packed stitching
BLOCK_KEY = ["source_id", "by", "bx"]


def score_tiles(tiles: DataFrame, make_predict, side: int, batch_size: int = 64, apply_sigmoid: bool = True) -> DataFrame:
    """Add ``prob`` (array<float>) by running a model over ``tensor`` (CHW floats of side ``side``).

    ``make_predict()`` is called once per Python worker and returns a function from an
    (N, 3, side, side) array to logits, or to a dict whose ``out`` entry holds them.
    """

    def load():
        model = make_predict()

        def run(batch):
            out = model(batch)
            out = out["out"] if isinstance(out, dict) else out
            flat = np.asarray(out, np.float64).reshape(len(batch), -1)
            return (1.0 / (1.0 + np.exp(-flat)) if apply_sigmoid else flat).astype(np.float32)

        return run

    predict = predict_batch_udf(
        load, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size, input_tensor_shapes=[[3, side, side]]
    )
    return tiles.withColumn("prob", predict("tensor")).drop("tensor")


def resize_scores(scores: DataFrame, patch_size: int) -> DataFrame:
    """Bring square score maps to patch_size (bilinear, half-pixel centres); maps of that size pass through."""

    @pandas_udf("array<float>")
    def fit(prob: pd.Series) -> pd.Series:
        def one(p):
            side = int(round(len(p) ** 0.5))
            if side == patch_size:
                return p
            return resize_plane(np.asarray(p, np.float64).reshape(side, side), patch_size).astype(np.float32).ravel()

        return prob.map(one)

    full = patch_size * patch_size
    return scores.withColumn("prob", F.when(F.size("prob") == full, F.col("prob")).otherwise(fit("prob")))


def unpack_scores(scores: DataFrame) -> DataFrame:
    """Packed score tiles to long form: one row per tile pixel with dy, dx, prob."""
    cells = scores.select("source_id", "width", "height", "y0", "x0", "patch_size", F.posexplode("prob").alias("_at", "prob"))
    return (
        cells.withColumn("dy", F.expr("cast(_at div patch_size as int)"))
        .withColumn("dx", F.expr("cast(_at % patch_size as int)"))
        .withColumn("prob", F.col("prob").cast("double"))
        .drop("_at", "patch_size")
    )


def clip_valid(scores: DataFrame) -> DataFrame:
    """Drop the padding of long score rows and add image coordinates y, x."""
    placed = scores.withColumn("y", F.col("y0") + F.col("dy")).withColumn("x", F.col("x0") + F.col("dx"))
    return placed.where((F.col("y") < F.col("height")) & (F.col("x") < F.col("width")))


def _gap_pixels(images: DataFrame, patch_size: int, stride: int) -> DataFrame:
    """Pixels that no tile covers; exist only when the stride exceeds the patch."""
    rows = images.select("source_id", "width", "height", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
    cells = rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    bare_y = F.size(covering_origins(F.col("y"), F.col("height"), patch_size, stride)) == 0
    bare_x = F.size(covering_origins(F.col("x"), F.col("width"), patch_size, stride)) == 0
    return cells.where(bare_y | bare_x)


def stitch(scores: DataFrame, images: DataFrame, patch_size: int, stride: int) -> DataFrame:
    """Mean probability per pixel over the covering tiles (long form).

    Map-side combine folds the overlaps before the one shuffle. Uncovered pixels, possible
    only for stride > patch_size, score 0 and are generated rather than joined.
    """
    total = clip_valid(scores).groupBy("source_id", "y", "x").agg(
        F.sum("prob").alias("_s"), F.count("*").alias("tiles")
    ).select("source_id", "y", "x", (F.col("_s") / F.col("tiles")).alias("prob"), "tiles")
    if stride > patch_size:
        gaps = _gap_pixels(images, patch_size, stride)
        total = total.unionByName(gaps.select(
            "source_id", "y", "x", F.lit(0.0).alias("prob"), F.lit(0).cast("long").alias("tiles")
        ))
    return total


def _fragments(frames, block):
    """Cut the valid part of each score tile along the block lattice."""
    for pdf in frames:
        out = []
        for r in pdf.itertuples(index=False):
            prob = np.asarray(r.prob, np.float32).reshape(r.patch_size, r.patch_size)
            y1, x1 = min(r.y0 + r.patch_size, r.height), min(r.x0 + r.patch_size, r.width)
            for by in range(r.y0 // block, (y1 - 1) // block + 1):
                for bx in range(r.x0 // block, (x1 - 1) // block + 1):
                    fy0, fy1 = max(r.y0, by * block), min(y1, (by + 1) * block)
                    fx0, fx1 = max(r.x0, bx * block), min(x1, (bx + 1) * block)
                    piece = prob[fy0 - r.y0 : fy1 - r.y0, fx0 - r.x0 : fx1 - r.x0]
                    out.append((r.source_id, r.width, r.height, by, bx, r.y0, r.x0, fy0, fx0, fy1 - fy0, fx1 - fx0, piece.tobytes()))
        yield pd.DataFrame(out, columns=["source_id", "width", "height", "by", "bx", "y0", "x0", "fy", "fx", "fh", "fw", "piece"])


def _average(frag: dict, block: int) -> tuple[np.ndarray, int, int]:
    """Overlap average of the fragments of one block, summed in (y0, x0) order."""
    y, x = int(frag["by"][0]) * block, int(frag["bx"][0]) * block
    h, w = min(block, int(frag["height"][0]) - y), min(block, int(frag["width"][0]) - x)
    total, count = np.zeros((h, w)), np.zeros((h, w))
    for i in np.lexsort((frag["x0"], frag["y0"])):
        fy, fx, fh, fw = (int(frag[c][i]) for c in ("fy", "fx", "fh", "fw"))
        at = np.s_[fy - y : fy - y + fh, fx - x : fx - x + fw]
        total[at] += np.frombuffer(frag["piece"][i], np.float32).reshape(fh, fw)
        count[at] += 1
    return total / np.maximum(count, 1), y, x


def stitch_packed(scores: DataFrame, images: DataFrame, block: int = BLOCK, patch_size: int | None = None, stride: int | None = None) -> DataFrame:
    """One row per output block: source_id, by, bx, y, x, h, w, prob (row-major float32 bytes).

    Fragments shuffle on (source_id, block), so a group holds at most the tiles that touch one
    block and a huge image spreads over many tasks. Pass patch_size and stride when the stride
    exceeds the patch: whole blocks may then lack tiles and are added as zeros.
    """
    kind = scores.schema["source_id"].dataType.simpleString()
    pieces = scores.select("source_id", "width", "height", "y0", "x0", "patch_size", "prob").mapInPandas(
        lambda frames: _fragments(frames, block),
        f"source_id {kind}, width int, height int, by int, bx int, y0 int, x0 int, fy int, fx int, fh int, fw int, piece binary",
    )
    if patch_size and stride and stride > patch_size:
        lattice = images.withColumn("by", F.explode(F.expr(f"sequence(0, cast((height-1) div {block} as int))")))
        lattice = lattice.withColumn("bx", F.explode(F.expr(f"sequence(0, cast((width-1) div {block} as int))")))
        zero = F.lit(0)
        pieces = pieces.unionByName(lattice.select(
            "source_id", "width", "height", "by", "bx", zero.alias("y0"), zero.alias("x0"),
            (F.col("by") * block).alias("fy"), (F.col("bx") * block).alias("fx"), zero.alias("fh"), zero.alias("fw"),
            F.lit(b"").alias("piece"),
        ))

    def merge(group: pa.Table) -> pa.Table:
        frag = {c: group.column(c).to_pylist() if c in ("source_id", "piece") else group.column(c).to_numpy() for c in group.column_names}
        mean, y, x = _average(frag, block)
        one = {c: [frag[c][0]] for c in ("source_id", "width", "height", "by", "bx")}
        one |= {"y": [y], "x": [x], "h": [mean.shape[0]], "w": [mean.shape[1]], "prob": [mean.astype(np.float32).tobytes()]}
        ints = [pa.field(c, pa.int32()) for c in ("width", "height", "by", "bx", "y", "x", "h", "w")]
        return pa.table(one, pa.schema([pa.field("source_id", group.schema.field("source_id").type), *ints, pa.field("prob", pa.binary())]))

    return pieces.groupBy(*BLOCK_KEY).applyInArrow(
        merge, f"source_id {kind}, width int, height int, by int, bx int, y int, x int, h int, w int, prob binary"
    )


def unpack_blocks(blocks: DataFrame) -> DataFrame:
    """Stitched blocks to long pixels: source_id, y, x, prob."""

    @pandas_udf("array<float>")
    def floats(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: np.frombuffer(b, np.float32))

    cells = blocks.select("source_id", "y", "x", "w", F.posexplode(floats("prob")).alias("_at", "prob"))
    return cells.select(
        "source_id",
        F.expr("cast(y + _at div w as int)").alias("y"),
        F.expr("cast(x + _at % w as int)").alias("x"),
        F.col("prob").cast("double").alias("prob"),
    )


def cut_blocks(images: DataFrame, columns: list[str], block: int = BLOCK, keep: tuple = ()) -> DataFrame:
    """Cut packed rasters (image HWC or mask HW bytes) along the block lattice, without a shuffle; ``keep`` repeats columns of the image."""
    kind = images.schema["source_id"].dataType.simpleString()
    columns = list(columns)

    def cut(frames):
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                planes = {c: np.frombuffer(getattr(r, c), np.uint8).reshape(r.height, r.width, -1) for c in columns}
                at = [(by, bx) for by in range(-(-r.height // block)) for bx in range(-(-r.width // block))]
                for i in range(0, len(at), 64):
                    part = at[i : i + 64]
                    yield pd.DataFrame({
                        "source_id": r.source_id, **{c: getattr(r, c) for c in keep}, "by": [a for a, _ in part], "bx": [b for _, b in part],
                        **{c: [p[a * block : (a + 1) * block, b * block : (b + 1) * block].tobytes() for a, b in part] for c, p in planes.items()},
                    })

    schema = f"source_id {kind}, " + "".join(f"{c} {images.schema[c].dataType.simpleString()}, " for c in keep)
    schema += "by int, bx int, " + ", ".join(f"{c} binary" for c in columns)
    return images.select("source_id", "width", "height", *columns).mapInPandas(cut, schema)


def render_blocks(blocks: DataFrame, images: DataFrame, threshold: float = 0.5, block: int = BLOCK) -> DataFrame:
    """Add mask (HW bytes 0/255) and overlay (HWC bytes) to stitched blocks.

    The original colours are cut along the same lattice and meet their block one to one.
    """

    @pandas_udf("mask binary, overlay binary")
    def paint(prob: pd.Series, image: pd.Series) -> pd.DataFrame:
        out = []
        for p, i in zip(prob, image):
            hit = np.frombuffer(p, np.float32) >= np.float32(threshold)
            rgb = np.frombuffer(i, np.uint8).reshape(-1, 3)
            tinted = np.minimum(rgb // 2 + np.array([0, 128, 0]), 255)
            out.append(((hit * 255).astype(np.uint8).tobytes(), np.where(hit[:, None], tinted, rgb).astype(np.uint8).tobytes()))
        return pd.DataFrame(out, columns=["mask", "overlay"])

    colours = cut_blocks(images, ["image"], block)
    both = blocks.join(colours, BLOCK_KEY).withColumn("_r", paint("prob", "image"))
    return both.select(*blocks.columns, "_r.mask", "_r.overlay")


def assemble(blocks: DataFrame) -> DataFrame:
    """Whole rasters from blocks, for files that hold one image each: source_id, width, height, prob, mask, overlay.

    A group is exactly one output file.
    """
    kind = blocks.schema["source_id"].dataType.simpleString()
    layers = {"prob": (np.float32, 1), "mask": (np.uint8, 1), "overlay": (np.uint8, 3)}

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        out = {"source_id": [first.source_id], "width": [first.width], "height": [first.height]}
        for name, (dtype, c) in layers.items():
            whole = np.zeros((first.height, first.width, c), dtype)
            for r in pdf.itertuples(index=False):
                whole[r.y : r.y + r.h, r.x : r.x + r.w] = np.frombuffer(getattr(r, name), dtype).reshape(r.h, r.w, c)
            out[name] = [whole.tobytes()]
        return pd.DataFrame(out)

    wanted = blocks.select("source_id", "width", "height", "y", "x", "h", "w", *layers)
    return wanted.groupBy("source_id").applyInPandas(
        join, f"source_id {kind}, width int, height int, prob binary, mask binary, overlay binary"
    )


def render(pixels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Add mask, overlay (o_r, o_g, o_b) and prob_u8 to long pixels with prob, r, g, b."""
    masked = pixels.withColumn("mask", threshold_mask(F.col("prob"), threshold))
    o_r, o_g, o_b = overlay_rgb(F.col("r"), F.col("g"), F.col("b"), F.col("mask"))
    return masked.select("*", o_r.alias("o_r"), o_g.alias("o_g"), o_b.alias("o_b"), prob_to_u8(F.col("prob")).alias("prob_u8"))


__all__ = [
    "score_tiles", "resize_scores", "unpack_scores", "clip_valid", "stitch", "stitch_packed", "unpack_blocks",
    "render", "cut_blocks", "render_blocks", "assemble", "sigmoid",
]
