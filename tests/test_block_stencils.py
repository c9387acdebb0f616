"""Stencils and losses on blocks equal to those of whole images, whatever the lattice."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktile.operators import block_stencils as bs
from sparktile.operators import kernels, losses

SIZES = {"a": (40, 27), "b": (7, 7), "c": (1, 33), "d": (1, 1), None: (16, 12)}


def plane(name, salt):
    h, w = SIZES[name]
    return np.random.default_rng(sum(map(ord, name or "~")) + salt).normal(0, 2, (h, w))


@pytest.fixture(scope="module")
def pixels(spark):
    rows = []
    for name, (h, w) in SIZES.items():
        z, t = plane(name, 1), plane(name, 2) > 0
        rows += [(name, w, h, y, x, float(z[y, x]), float(t[y, x])) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "source_id string, width int, height int, y int, x int, z double, t double").cache()


def images_of(df, value):
    out = {n: np.full(s, np.nan) for n, s in SIZES.items()}
    for r in df.collect():
        assert np.isnan(out[r.source_id][r.y, r.x])
        out[r.source_id][r.y, r.x] = r[value]
    return out


@pytest.mark.parametrize("block", [3, 5, 16, 64])
@pytest.mark.parametrize("what,iterations", [("erode", 1), ("dilate", 1), ("open", 1), ("skeleton", 1), ("skeleton", 3), ("skeleton", 6), ("skeleton", 0)])
def test_stencils_equal_those_of_whole_images(spark, pixels, block, what, iterations):
    table = bs.block_values(pixels, ["z"], block).repartition(5)
    got = images_of(bs.value_pixels(bs.stencil_blocks(table, "z", what, "v", iterations, block), ["v"], block), "v")
    work = {"erode": kernels.erode, "dilate": kernels.dilate, "open": lambda a: kernels.dilate(kernels.erode(a))}.get(what, lambda a: kernels.skeleton(a, iterations))
    for name in SIZES:
        assert np.array_equal(got[name], work(plane(name, 1)[None])[0])


@pytest.mark.parametrize("block", [4, 13, 64])
def test_losses_equal_those_of_the_long_form(spark, pixels, block):
    specs = ["bce", "bce_dice", "tversky", "soft_cldice", "cldice", {"name": "bcedicecldice", "iterations": 5}]
    table = bs.block_values(pixels, ["z", "t"], block)
    want = {r.loss: r.value for r in losses.evaluate_losses(pixels, specs, ["source_id"], F.col("z"), F.col("t"), "y", "x", colocate=False).collect()}
    got = {r.loss: r.value for r in bs.evaluate_losses_blocks(table, specs, block=block).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    each = {r.source_id: r.cldice for r in losses.cldice_score(pixels, ["source_id"], F.col("z"), F.col("t"), 4, threshold=0.5, y="y", x="x").collect()}
    found = {r.source_id: r.cldice for r in bs.cldice_blocks(table, iterations=4, threshold=0.5, block=block).collect()}
    assert found.keys() == each.keys() and all(found[k] == pytest.approx(each[k], abs=1e-12) for k in each)


def test_planes_of_other_types_and_no_task_with_an_image(spark):
    """float32 logits and byte masks; an image of 2000 x 1500 pixels is met in groups of one block and its margin."""
    h, w, block = 2000, 1500, 256
    rng = np.random.default_rng(5)
    z, t = rng.normal(size=(h, w)).astype(np.float32), rng.integers(0, 2, (h, w)).astype(np.uint8)
    rows = []
    for by in range(-(-h // block)):
        for bx in range(-(-w // block)):
            at = np.s_[by * block : by * block + block, bx * block : bx * block + block]
            rows.append(("i", w, h, by, bx, z[at].tobytes(), t[at].tobytes()))
    table = spark.createDataFrame(rows, "source_id string, width int, height int, by int, bx int, z binary, t binary")
    largest = (block + 8) ** 2

    def work(planes, inside):
        assert planes["z"].size <= largest
        return {"n": float(planes["z"][inside].size)}

    sizes = bs.over_margins(table, {"z": "float32"}, 4, block, work, "n double")
    assert sizes.agg(F.sum("n")).first()[0] == h * w and sizes.count() == len(rows)
    got = bs.cldice_blocks(table, iterations=3, block=block, kinds=("float32", "uint8")).first().cldice
    p, m = 1 / (1 + np.exp(-z.astype(float))), t.astype(float)
    sp, st = kernels.skeleton(p[None], 3)[0], kernels.skeleton(m[None], 3)[0]
    u, v = ((sp * m).sum() + 1) / (sp.sum() + 1), ((st * p).sum() + 1) / (st.sum() + 1)
    assert got == pytest.approx((2 * u * v + 1) / (u + v + 1), abs=1e-9)


def test_empty_tables_and_errors(spark, pixels):
    none = bs.block_values(pixels.limit(0), ["z", "t"], 8)
    assert bs.stencil_blocks(none, "z", "open", "v", block=8).count() == 0
    assert bs.cldice_blocks(none, block=8).count() == 0
    with pytest.raises(ValueError, match="unknown stencil"):
        bs.stencil_blocks(none, "z", "sharpen", "v")
    with pytest.raises(ValueError, match="halo"):
        bs.over_margins(none, {"z": "float64"}, -1, 8, None, "n double")


def test_pools_have_no_edge_value_and_blocks_use_no_frames(spark):
    rng = np.random.default_rng(9)
    for shape in ((1, 1, 1), (2, 1, 5), (1, 4, 1), (3, 6, 7)):
        a = rng.normal(size=shape)
        wide = np.pad(a, [(0, 0), (1, 1), (1, 1)], constant_values=np.inf)
        low = np.min([wide[:, 1:-1, 1:-1], wide[:, :-2, 1:-1], wide[:, 2:, 1:-1], wide[:, 1:-1, :-2], wide[:, 1:-1, 2:]], axis=0)
        wide = np.pad(a, [(0, 0), (1, 1), (1, 1)], constant_values=-np.inf)
        high = np.max([wide[:, i : i + a.shape[1], j : j + a.shape[2]] for i in range(3) for j in range(3)], axis=0)
        before = a.copy()
        assert np.array_equal(kernels.erode(a), low) and np.array_equal(kernels.dilate(a), high) and np.array_equal(a, before)
    pixels = spark.createDataFrame([(None, 3, 2, y, x, y + x / 2) for y in range(2) for x in range(3)], "source_id long, width int, height int, y int, x int, v double")
    blocks = bs.block_values(pixels, ["v"], 2)
    assert "FlatMapGroupsInArrow" in blocks._jdf.queryExecution().executedPlan().toString()
    assert {(r.y, r.x, r.v) for r in bs.value_pixels(blocks, ["v"], 2).collect()} == {(y, x, y + x / 2) for y in range(2) for x in range(3)}
