"""Block tables: tiles, margins and segmentation equal to whole images, whatever the lattice, and bounded by it."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparktile.operators import blocks, tiling, transforms
from sparktile.plans import jobs
from sparktile.plans.job_queries import make_step_model

SIZES = {"a": (40, 57), "b": (16, 16), "c": (9, 70), "d": (33, 12), "e": (1, 1)}


def raster(name, c):
    h, w = SIZES[name]
    return np.random.default_rng(sum(map(ord, name)) + c).integers(0, 256, (h, w, c), dtype=np.uint8)


@pytest.fixture(scope="module")
def images(spark):
    rows = [(n, w, h, raster(n, 3).tobytes(), raster(n, 1).tobytes()) for n, (h, w) in SIZES.items()]
    return spark.createDataFrame(rows, "source_id string, width int, height int, image binary, mask binary").cache()


def as_set(df, columns):
    return sorted(tuple(bytes(v) if isinstance(v, (bytearray, bytes)) else v for v in r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("length", [1, 5, 16, 17, 40, 57])
@pytest.mark.parametrize("patch,stride", [(16, 12), (16, 16), (5, 3), (8, 11), (64, 64)])
def test_owned_origins_and_coverage(length, patch, stride):
    want = tiling._axis(length, patch, stride)
    for block in (3, 13, 16, 100):
        got = [blocks.owned_origins(k, length, patch, stride, block) for k in range(-(-length // block))]
        assert np.concatenate(got).tolist() == want.tolist()
        assert all(((g // block) == k).all() for k, g in enumerate(got))
    covered = [int(((want <= p) & (p < want + patch)).sum()) for p in range(length)]
    assert blocks.coverage(length, patch, stride, 0, length).tolist() == covered
    assert blocks.coverage(length, patch, stride, length // 2, length).tolist() == covered[length // 2 :]


@pytest.mark.parametrize("block,halo", [(13, 15), (8, 20), (64, 3), (16, 0)])
def test_margins_are_the_image(spark, images, block, halo):
    table = blocks.block_images(images, block)
    for r in blocks.halo_blocks(table.repartition(7), halo, block).collect():
        y, x = r.by * block, r.bx * block
        for c, bands in (("image", 3), ("mask", 1)):
            want = raster(r.source_id, bands)[y : y + block + halo, x : x + block + halo]
            assert bytes(r[c]) == want.tobytes()


@pytest.mark.parametrize("block", [7, 13, 64])
@pytest.mark.parametrize("patch,stride,least,bar", [(16, 12, 0, 127), (16, 16, 130, 127), (5, 3, 12, 100), (8, 11, 1, 250), (16, 12, 1, -1)])
def test_tiles_equal_those_of_whole_images(spark, images, block, patch, stride, least, bar):
    columns = ["source_id", "width", "height", "y0", "x0", "patch_size", "image", "mask"]
    want = as_set(tiling.cut_tiles(images, patch, stride, bar, least), columns)
    got = blocks.cut_block_tiles(blocks.block_images(images, block), patch, stride, block, bar, least)
    assert as_set(got, columns) == want
    listed = tiling.cut_tiles(images, patch, stride, bar, least).select("source_id", "y0", "x0").where("(y0 + x0) % 2 = 0")
    again = blocks.cut_block_tiles(blocks.block_images(images, block), patch, stride, block, bar, manifest=listed)
    assert as_set(again, columns) == as_set(tiling.tile_samples(listed, images, patch, stride, bar), columns)


def test_blocks_of_pixels(spark, images):
    via = blocks.block_pixels(tiling.unpack_images(images), 13)
    columns = ["source_id", "width", "height", "by", "bx", "image", "mask"]
    assert as_set(via, columns) == as_set(blocks.block_images(images, 13), columns)
    assert blocks.block_images(images.where("false"), 13).count() == 0


def whole_image(image, patch, stride, make, threshold):
    """The same inference as loops over one array."""
    h, w = image.shape[:2]
    total, count, model, prepare = np.zeros((h, w)), np.zeros((h, w)), make(), transforms.eval_kernel()
    for y in tiling._axis(h, patch, stride):
        for x in tiling._axis(w, patch, stride):
            logits = model(prepare(tiling._crop(image, y, x, patch)).reshape(1, 3, patch, patch))["out"].astype(float).reshape(patch, patch)
            p, cut = (1 / (1 + np.exp(-logits))).astype(np.float32), np.s_[y : min(y + patch, h), x : min(x + patch, w)]
            total[cut] += p[: min(patch, h - y), : min(patch, w - x)]
            count[cut] += 1
    prob = (total / np.maximum(count, 1)).astype(np.float32)
    mask = prob >= np.float32(threshold)
    return prob, (mask * 255).astype(np.uint8), np.where(mask[..., None], np.minimum(image // 2 + np.array([0, 128, 0]), 255), image).astype(np.uint8)


@pytest.mark.parametrize("block,stride", [(13, 12), (64, 12), (7, 16), (13, 21)])
def test_segmentation_on_blocks(spark, images, block, stride):
    cfg = jobs.Config(patch_size=16, stride=stride, block=block, threshold=0.6, batch_size=3)
    got = {n: None for n in SIZES}
    for r in jobs.segment(images, make_step_model, cfg).collect():
        h, w = SIZES[r.source_id]
        if got[r.source_id] is None:
            got[r.source_id] = [np.full((h, w), -1, np.float32), np.zeros((h, w), np.uint8), np.zeros((h, w, 3), np.uint8)]
        for whole, body, kind, c in zip(got[r.source_id], (r.prob, r.mask, r.overlay), (np.float32, np.uint8, np.uint8), (1, 1, 3)):
            part = np.frombuffer(bytes(body), kind).reshape((r.h, r.w, 3) if c == 3 else (r.h, r.w))
            whole[r.y : r.y + r.h, r.x : r.x + r.w] = part
    for name in SIZES:
        for have, want in zip(got[name], whole_image(raster(name, 3), 16, stride, make_step_model, 0.6)):
            assert np.array_equal(have, want)


def test_an_image_larger_than_any_row(spark):
    """5,000 x 7,000 pixels (105 MB) that exist as blocks alone: no row holds more than a block and its margin, many tasks score it."""
    h, w, block, patch, stride = 5000, 7000, 512, 128, 128

    def paint(frames):
        for pdf in frames:
            out = []
            for k in pdf.id:
                by, bx = divmod(int(k), -(-w // block))
                y, x = np.ogrid[by * block : min(h, by * block + block), bx * block : min(w, bx * block + block)]
                out.append((1, w, h, by, bx, np.repeat(((y * 3 + x * 5) % 251).astype(np.uint8)[..., None], 3, 2).tobytes()))
            yield pd.DataFrame(out, columns=["source_id", "width", "height", "by", "bx", "image"])

    n = -(-h // block) * -(-w // block)
    table = spark.range(0, n, 1, 8).mapInPandas(paint, "source_id long, width int, height int, by int, bx int, image binary")
    largest = blocks.halo_blocks(table, patch - 1, block).agg(F.max(F.length("image"))).first()[0]
    assert largest <= 3 * (block + patch - 1) ** 2 < h * w * 3 / 80

    def make():
        bar = (100 / 255 - transforms.MEAN[0]) / transforms.STD[0]
        return lambda batch: np.where(batch[:, 0] > bar, 3.0, -3.0)[:, None]

    cfg = jobs.Config(patch_size=patch, stride=stride, block=block, batch_size=16)
    scored = jobs.segment_blocks(table, make, cfg)
    ones = F.length(F.translate(F.hex("mask"), "0", "")) / 2
    sums = scored.select("y", "x", "h", "w", ones.cast("long").alias("fg"), F.spark_partition_id().alias("task")).collect()
    y, x = np.ogrid[0:h, 0:w]
    truth = (y * 3 + x * 5) % 251 > 100
    assert sum(r.fg for r in sums) == int(truth.sum()) and len(sums) == n
    assert all(r.fg == int(truth[r.y : r.y + r.h, r.x : r.x + r.w].sum()) for r in sums)
    assert len({r.task for r in sums}) > 1
