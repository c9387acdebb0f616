"""Tile training against a loop over arrays, one-pass fold statistics, and small rules of metrics, logs and equalisation."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktile.operators import metrics, runs, tiling, training, transforms

KEYS = ["source_id", "y0", "x0"]


def tiles_of(spark, n=9, side=8):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(n):
        for k in range(3):
            image = rng.integers(0, 256, (side, side, 3), dtype=np.uint8)
            mask = (image[..., 0].astype(int) + rng.integers(0, 80, (side, side)) > 150).astype(np.uint8)
            rows.append((f"img{i}.png", 0, 8 * k, side, image.tobytes(), mask.tobytes()))
    frame = spark.createDataFrame(rows, "source_id string, y0 int, x0 int, patch_size int, image binary, mask binary")
    roles = [(f, f"img{i}.png", "val" if i % 3 == f else "train") for f in range(2) for i in range(n)]
    return frame, spark.createDataFrame(roles, "fold int, source_id string, role string"), rows, roles


def slow_training(rows, roles, epochs, lr, patience, factor, mode, monitor, batch_of=None, steps=1):
    role = {(f, s): r for f, s, r in roles}
    out, best = [], {}
    for fold in sorted({f for f, _, _ in roles}):
        w, rate, top, bad, kept = np.zeros(4), lr, None, 0, (None, np.zeros(4))
        for epoch in range(1, epochs + 1):
            used, losses, pixels = rate, 0.0, 0
            for step in range(steps):
                g, n = np.zeros(4), 0
                for s, y0, x0, _, image, mask in rows:
                    if role[(fold, s)] == "train" and (steps == 1 or batch_of(epoch, s, y0, x0) == step):
                        x, y = training.pixel_rows(image), np.frombuffer(mask, np.uint8)
                        for xi, yi in zip(x, y):
                            p = 1 / (1 + math.exp(-float(xi @ w)))
                            g, n = g + (p - yi) * xi, n + 1
                            losses -= math.log(p if yi else 1 - p)
                pixels += n
                w = w - used * g / n if n else w
            dices, by_image = [], {}
            for s, _, _, _, image, mask in rows:
                if role[(fold, s)] == "val":
                    p, y = training.pixel_rows(image) @ w >= 0, np.frombuffer(mask, np.uint8) > 0
                    one = np.array([(p & y).sum(), p.sum() + y.sum()])
                    dices.append((2 * one[0] + 1e-6) / (one[1] + 1e-6))
                    by_image[s] = by_image.get(s, 0) + one
            value = {"val_dice_per_patch": np.mean(dices), "val_dice_per_image": np.mean([(2 * a + 1e-6) / (b + 1e-6) for a, b in by_image.values()])}
            out.append((fold, epoch, used, losses / pixels, value["val_dice_per_patch"], value["val_dice_per_image"]))
            if kept[0] is None or value[monitor] > kept[0]:
                kept = (value[monitor], w)
            if top is None or value[monitor] > top * 1.0001:
                top, bad = value[monitor], 0
            else:
                bad += 1
                if bad > patience:
                    rate, bad = rate * factor, 0
        best[fold] = kept[1]
    return sorted(out), best


@pytest.mark.parametrize("steps,monitor,lr", [(1, "val_dice_per_patch", 2.0), (3, "val_dice_per_image", 6.0)])
def test_log_equals_a_loop(spark, steps, monitor, lr):
    frame, splits, rows, roles = tiles_of(spark)
    dealt = {}
    if steps > 1:
        for epoch in range(1, 7):
            for r in frame.select(*KEYS, F.pmod(F.xxhash64(F.lit(f"42:{epoch}"), *KEYS), F.lit(steps)).alias("b")).collect():
                dealt[(epoch, r.source_id, r.y0, r.x0)] = r.b
    want, best = slow_training(rows, roles, 6, lr, 0, 0.5, "max", monitor, lambda *k: dealt[k], steps)
    got, log = training.train_tiles(frame.repartition(5), splits, 6, lr, steps, monitor=monitor, patience=0)
    have = sorted((r.fold, r.epoch, r.lr, r.train_loss, r.val_dice_per_patch, r.val_dice_per_image) for r in log.collect())
    assert np.allclose(np.array(have), np.array(want), rtol=1e-9)
    assert len({r[2] for r in have}) > 1  # the rate fell
    for f in best:
        assert np.allclose(got[f], best[f])
    model = training.apply_model(got[0])
    x = training.pixel_rows(rows[0][4])
    assert np.allclose(model(x[:, :3].T.reshape(1, 3, 8, 8)).ravel(), x @ got[0])


def test_folds_without_tiles(spark):
    frame, _, rows, _ = tiles_of(spark, 2)
    splits = spark.createDataFrame([(0, "img0.png", "train"), (1, "img1.png", "val")], "fold int, source_id string, role string")
    best, log = training.train_tiles(frame, splits, 2)
    got = {(r.fold, r.epoch): r for r in log.collect()}
    assert got[(0, 2)].val_loss is None and got[(0, 2)].train_loss < math.log(2) and best[0].any()
    assert got[(1, 2)].train_loss is None and got[(1, 1)].val_loss == pytest.approx(math.log(2)) and not best[1].any()


def test_ridge_equals_a_fit_per_fold(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + rng.normal(size=300)
    image = rng.integers(0, 12, 300)
    rows = [(int(i), *map(float, r), float(v)) for i, r, v in zip(image, x, y)] + [(0, None, 1.0, 1.0, 1.0), (1, 1.0, 1.0, 1.0, None)]
    pixels = spark.createDataFrame(rows, "source_id int, a double, b double, c double, y double")
    folds = spark.createDataFrame([(i, i % 4) for i in range(12)], "source_id int, fold int")
    got = {(r.penalty, r.fold): r.mse for r in training.ridge_cv(pixels, folds, ["a", "b", "c"], "y", [0.0, 0.3]).collect()}
    assert len(got) == 8
    for (penalty, fold), mse in got.items():
        held = image % 4 == fold
        one = np.hstack([np.ones((300, 1)), x])
        free = np.diag([0.0, *[penalty * (~held).sum()] * 3])
        beta = np.linalg.solve(one[~held].T @ one[~held] + free, one[~held].T @ y[~held])
        assert mse == pytest.approx(((one[held] @ beta - y[held]) ** 2).mean())


@pytest.mark.parametrize("threshold", [0.0, 0.3, 0.9, 1.0])
def test_packed_scores_predict_like_long_ones(spark, threshold):
    z = [math.log(9), -1.0, 0.0, 800.0]
    packed = spark.createDataFrame([(1, z, bytes([1, 0, 1, 1]))], "key int, logits array<double>, mask binary")
    long = spark.createDataFrame([(1, v, t) for v, t in zip(z, (1, 0, 1, 1))], "key int, z double, t int")
    a = metrics.dice_iou_packed(packed, ["key"], threshold=threshold).first()
    b = metrics.dice_iou_from_logits(long, ["key"], F.col("z"), F.col("t"), threshold).first()
    assert (a.dice, a.iou, a.pred) == (b.dice, b.iou, b.pred)


def test_a_null_fold_gets_its_counts(spark):
    log = spark.createDataFrame([("r", None, 1, 0.5), ("r", 1, 1, 0.6)], "run string, fold int, epoch int, m double")
    counts = spark.createDataFrame([(None, 7), (1, 8)], "fold int, images int")
    got = runs.fold_results(log, "m", "max", counts)
    assert {(r.fold, r.images) for r in got.collect()} == {(None, 7), (1, 8)} and got.columns.count("fold") == 1


@pytest.mark.parametrize("side,grid,clip", [(16, (2, 2), 8.0), (13, (3, 4), 2.0), (9, (8, 8), 1.0), (5, (8, 2), 40.0), (20, (4, 4), 3.0)])
def test_equalisation_long_equals_packed(spark, side, grid, clip):
    rng = np.random.default_rng(side)
    rows = []
    for k, spread in enumerate((256, 40, 3, 1)):
        image = rng.integers(0, spread, (side, side, 3), dtype=np.uint16).astype(np.uint8) + (k * 7)
        if k % 2:
            image = np.repeat(image[..., :1], 3, 2)
        rows.append((k, side, side, 0, 0, side, image.astype(np.uint8).tobytes(), bytes(side * side)))
    packed = spark.createDataFrame(rows, "source_id long, width int, height int, y0 int, x0 int, patch_size int, image binary, mask binary")
    want = tiling.unpack_tiles(transforms.clahe(packed, clip, grid))
    got = transforms.clahe_long(tiling.unpack_tiles(packed), KEYS, side, clip, grid)
    columns = [*KEYS, "dy", "dx", "r", "g", "b", "t"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
