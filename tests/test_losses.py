import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktile.operators import kernels, losses, metrics, stencil


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(8)
    z = rng.normal(0, 2, (5, 9, 9))
    t = (rng.random((5, 9, 9)) < 0.4).astype(float)
    t[0], z[0] = 0.0, -800.0  # empty on both sides, with an extreme logit
    rows = [(i, int(y), int(x), float(z[i, y, x]), float(t[i, y, x])) for i in range(5) for y in range(9) for x in range(9)]
    return z, t, spark.createDataFrame(rows, "s int, dy int, dx int, z double, t double").cache()


SPECS = [
    "bce", "bce_dice", "tversky", "cldice", "soft_cldice", "tversky_soft_cldice", "bce_dice_cldice",
    {"name": "cldice", "label": "c5", "iterations": 5, "smooth": 2.0, "threshold": 0.3}, {"name": "soft_cldice", "label": "c1", "iterations": 1},
]


def brute(z, t, name, **k):
    """Losses straight from their formulas on arrays."""
    with np.errstate(over="ignore"):
        p = 1 / (1 + np.exp(-z))
    flat = lambda a: a.reshape(len(a), -1).sum(1)
    bce = np.mean(np.maximum(z, 0) - z * t + np.log1p(np.exp(-abs(z))))
    dice = 1 - np.mean((2 * flat(p * t) + 1e-6) / (flat(p) + flat(t) + 1e-6))
    tv = 1 - np.mean((flat(p * t) + 1e-6) / (flat(p * t) + 0.3 * flat(p * (1 - t)) + 0.7 * flat((1 - p) * t) + 1e-6))

    def cl(q, it, s=1.0):
        a, b = kernels.skeleton(q, it), kernels.skeleton(t, it)
        u, v = (flat(a * t) + s) / (flat(a) + s), (flat(b * q) + s) / (flat(b) + s)
        return 1 - np.mean((2 * u * v + s) / (u + v + s))

    return {
        "bce": bce, "bce_dice": 0.5 * bce + 0.5 * dice, "tversky": tv, "cldice": cl(p >= 0.5, 3), "soft_cldice": cl(p, 3),
        "tversky_soft_cldice": 0.7 * tv + 0.3 * cl(p, 3), "bce_dice_cldice": 0.3 * bce + 0.6 * dice + 0.1 * cl(p, 5),
        "c5": cl(p >= 0.3, 5, 2.0), "c1": cl(p, 1),
    }


def test_long_packed_and_brute_agree(spark, data):
    z, t, df = data
    long = {r.loss: r.value for r in losses.evaluate_losses(df, SPECS, ["s"], F.col("z"), F.col("t")).collect()}
    tiles = spark.createDataFrame(
        [(i, z[i].ravel().tolist(), bytearray(t[i].astype(np.uint8).tobytes())) for i in range(5)], "s int, logits array<double>, mask binary"
    )
    packed = {r.loss: r.value for r in losses.evaluate_losses_packed(tiles, SPECS, ["s"]).collect()}
    want = brute(z, t, None)
    assert set(long) == set(packed) == set(want)
    for k, v in want.items():
        assert long[k] == pytest.approx(v, abs=1e-9) and packed[k] == pytest.approx(v, abs=1e-9)


def test_names_and_smoothing():
    assert losses.loss_terms("BCE_Dice")[1].smooth == losses.loss_terms({"name": "bce_dice", "smooth": 5})[1].smooth == 1e-6
    assert losses.loss_terms({"name": "cldice", "smooth": 5})[0].smooth == 5
    assert losses.loss_terms({"name": "cldice", "smooth": 5, "cldice_smooth": 2})[0].smooth == 2
    assert losses.loss_terms("softcldice")[0].smooth == 1.0
    assert [t.iterations for t in losses.loss_terms("bcedicecldice")][2] == 5
    with pytest.raises(ValueError, match="unknown loss"):
        losses.loss_terms("focal")
    with pytest.raises(ValueError, match="label"):
        losses._named(["bce", "bce"])


def test_stencil_order_and_brute_pool(data):
    _, _, df = data
    e = stencil.soft_erode(df, "z", ["s"], "e", "dy", "dx")
    d = stencil.soft_dilate(e, "z", ["s"], "d", "dy", "dx", colocate=False)
    o = stencil.soft_open(d, "z", ["s"], "o", "dy", "dx", colocate=False)
    rows = o.collect()
    assert all(r.e <= r.z <= r.d and r.e <= r.o <= r.d for r in rows)
    z = data[0]
    wide = np.pad(z, ((0, 0), (1, 1), (1, 1)), constant_values=-np.inf)
    for r in rows:
        assert r.d == wide[r.s, r.dy : r.dy + 3, r.dx : r.dx + 3].max()


def test_dice_and_iou(data):
    _, _, df = data
    per = metrics.dice_iou_from_logits(df, ["s"], F.col("z"), F.col("t"))
    for r in per.collect():
        assert r.dice == pytest.approx(2 * r.iou / (1 + r.iou), abs=1e-5)
        if r.s == 0:
            assert r.dice == r.iou == 1.0
    m = metrics.mean_scores(per).first()
    assert m.samples == 5 and m.dice == pytest.approx(np.mean([r.dice for r in per.collect()]))


def test_no_samples_score_zero(data):
    none = metrics.dice_iou_from_logits(data[2].where("false"), ["s"], F.col("z"), F.col("t"))
    assert tuple(metrics.mean_scores(none).first()) == (0.0, 0.0, 0)
    assert metrics.epoch_metric(none.withColumn("batch", F.lit(0))).first().dice == 0.0


def test_short_batch_weighs_the_same(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0), (0, 0.0, 0.0), (0, 0.0, 0.0), (1, 1.0, 1.0)], "batch int, dice double, iou double")
    r = metrics.epoch_metric(df).first()
    assert r.dice == pytest.approx(2 / 3) and r.dice_per_tile == 0.5 and r.batches == 2


def test_tile_skeletons_take_one_sort_and_equal_the_line_windows(spark):
    """Samples with gaps in their lines too; the number of sorts does not grow with the iterations."""
    rows = [(s, y, x, ((s * 7 + y * 5 + x * 3) % 11) / 10.0 if (y * x + s) % 9 else None) for s in range(4) for y in range(7) for x in range(9) if (s + y * 3 + x) % 8]
    df = spark.createDataFrame(rows, "s int, y int, x int, v double")
    near = stencil.soft_skeletons(df, {"v": "k"}, ["s"], 4, colocate=True)
    far = stencil.soft_skeletons(df, {"v": "k"}, ["s"], 4, colocate=False)
    assert near.columns == far.columns
    assert sorted(near.collect(), key=str) == sorted(far.collect(), key=str)
    specs = [{"name": "soft_cldice", "iterations": 6}, {"name": "cldice", "iterations": 2}]
    losses_ = losses.evaluate_losses(df, specs, ["s"], F.col("v"), (F.col("v") > 0.5).cast("double"), "y", "x")
    assert losses_._jdf.queryExecution().executedPlan().toString().count("Sort [") <= 2
