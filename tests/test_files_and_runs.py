import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktile.functions import extension, stem
from sparktile.operators import models, pairing, runs, splits
from sparktile.operators.kernels import png_bytes
from sparktile.plans import jobs
from sparktile.plans.job_queries import make_step_model
from sparktile.sources import files, sinks


@pytest.mark.parametrize("name,want_stem,want_ext", [
    ("a.b.png", "a.b", ".png"), (".png", ".png", ""), ("A.TIF", "A", ".tif"), ("plain", "plain", ""), (".x.JPG", ".x", ".jpg"), ("IN1 48h x5.tif", "IN1 48h x5", ".tif"),
])
def test_names(spark, name, want_stem, want_ext):
    r = spark.createDataFrame([(name,)], "n string").select(stem(F.col("n")).alias("s"), extension(F.col("n")).alias("e")).first()
    assert (r.s, r.e) == (want_stem, want_ext)


def image(seed, h, w, c=3):
    return np.random.default_rng(seed).integers(0, 256, (h, w, c) if c > 1 else (h, w), dtype=np.uint8)


@pytest.fixture
def folders(tmp_path):
    i, m = tmp_path / "images", tmp_path / "masks"
    (i / "sub").mkdir(parents=True)
    m.mkdir()
    for k, name in enumerate(["a b.png", "c+d%20.PNG", "only.png"]):
        (i / name).write_bytes(png_bytes(image(k, 20 + k, 31)))
    (i / "notes.txt").write_text("x")
    (i / "sub" / "deep.png").write_bytes(png_bytes(image(9, 4, 4)))
    (m / "a b.png").write_bytes(png_bytes(image(10, 20, 31, 1)))
    (m / "c+d%20.png").write_bytes(png_bytes(image(11, 21, 31)))
    (m / "lost.png").write_bytes(png_bytes(image(12, 4, 4, 1)))
    return str(i), str(m)


def test_listing_and_pairing(spark, folders):
    i, m = folders
    images, masks = files.list_images(spark, i), files.list_masks(spark, m)
    assert {r.source_id for r in images.collect()} == {"a b.png", "c+d%20.PNG", "only.png"}
    assert tuple(pairing.pair_diagnostics(images, masks).first()) == (2, 1, 1)
    assert [r.stem for r in pairing.missing_masks(images, masks).collect()] == ["only"]
    assert [r.stem for r in pairing.missing_images(images, masks).collect()] == ["lost"]
    one = files.list_images(spark, i + "/notes.txt")
    assert [r.source_id for r in one.collect()] == ["notes.txt"]
    with pytest.raises(ValueError, match="no images"):
        files.require_rows(images.where("false"), "images")


def test_load_pairs_decodes(spark, folders):
    rows = {r.stem: r for r in files.load_pairs(spark, *folders).collect()}
    assert set(rows) == {"a b", "c+d%20"}
    a = rows["a b"]
    assert bytes(a.image) == image(0, 20, 31).tobytes() and bytes(a.mask) == image(10, 20, 31, 1).tobytes()
    rgb = image(11, 21, 31).astype(np.int64)
    grey = (rgb @ np.array([19595, 38470, 7471]) + 32768) >> 16
    assert bytes(rows["c+d%20"].mask) == grey.astype(np.uint8).tobytes()


def test_unreadable_files(spark, folders):
    i, m = folders
    with open(f"{i}/broken.png", "wb") as f:
        f.write(b"not an image")
    images = files.read_images(spark, i)
    pairs = files.list_images(spark, i).select("source_id")
    assert files.image_records(pairs, images, drop_invalid=True).count() == 3
    with open(f"{m}/broken.png", "wb") as f:
        f.write(png_bytes(image(1, 5, 5, 1)))
    assert files.load_pairs(spark, i, m, drop_invalid=True).count() == 2
    with pytest.raises(Exception, match="unreadable image broken.png"):
        files.load_pairs(spark, i, m).collect()
    with pytest.raises(Exception, match="unreadable image broken.png"):
        files.image_records(pairs, images).collect()


def test_size_mismatch_is_reported(spark, folders):
    i, m = folders
    with open(f"{m}/a b.png", "wb") as f:
        f.write(png_bytes(image(1, 5, 5, 1)))
    with pytest.raises(Exception, match="differ in size: a b.png"):
        files.load_pairs(spark, i, m).collect()


def test_segmentation_job_writes_files(spark, folders, tmp_path):
    i, _ = folders
    cfg = jobs.Config(patch_size=16, stride=12, block=13, threshold=0.6)
    blocks = jobs.segment_images(spark, i, make_step_model, cfg)
    out = str(tmp_path / "out")
    assert jobs.write_segmentation(blocks, out, save_probabilities=True) == 3
    assert len([n for n in os.listdir(out) if n.endswith(".png") and not n.startswith(".")]) == 9
    read = {r.source_id: r for r in files.read_images(spark, out).collect()}
    rgb = image(0, 20, 31)
    prob = np.frombuffer(bytes(read["a b_prob.png"].data), np.uint8).reshape(20, 31)
    mask = np.frombuffer(bytes(read["a b_mask.png"].data), np.uint8).reshape(20, 31)
    over = np.frombuffer(bytes(read["a b_overlay.png"].data), np.uint8).reshape(20, 31, 3)[..., ::-1]
    assert set(np.unique(mask)) == {0, 255} and (mask[prob >= 154] == 255).all() and (mask[prob < 152] == 0).all()
    assert np.array_equal(over[mask == 0], rgb[mask == 0])
    tint = np.minimum(rgb // 2 + np.array([0, 128, 0]), 255)
    assert np.array_equal(over[mask == 255], tint[mask == 255])
    with pytest.raises(ValueError, match="no input images"):
        jobs.segment_images(spark, folders[1] + "/lost.png", make_step_model, cfg).sparkSession and files.require_rows(
            files.list_images(spark, i, [".bmp"]), "input images")


def test_analysis_job(spark, folders):
    cfg = jobs.Config(patch_size=16, stride=None, overlap=4, min_fg=100)
    stats, hist, diag = jobs.analyze_patches(spark, *folders, cfg)
    s = stats.first()
    assert s.total == s.kept + s.discarded == 12 and hist.agg(F.sum("tiles")).first()[0] == 12 and hist.count() == 41
    assert diag.first().pairs == 2
    with pytest.raises(ValueError, match="no matching"):
        jobs.analyze_patches(spark, folders[0], folders[0] + "/sub", cfg)


def test_samples_job_has_no_leakage(spark, folders):
    pairs = files.load_pairs(spark, *folders)
    cfg = jobs.Config(patch_size=16, stride=12, min_fg=1, val_ids=("a b",))
    train, val = jobs.prepare_samples(pairs, jobs.make_splits(pairs, cfg), cfg)
    assert {r.source_id for r in train.select("source_id").distinct().collect()} == {"c+d%20.PNG"}
    assert {r.source_id for r in val.select("source_id").distinct().collect()} == {"a b.png"}
    assert val.count() == 6 and all(r.folds == [0] for r in val.select("folds").collect())
    folds = jobs.Config(patch_size=16, stride=12, min_fg=1, split_mode="kfold", n_splits=2)
    train, val = jobs.prepare_samples(pairs, jobs.make_splits(pairs, folds), folds)
    where = lambda df: {(r.source_id, f) for r in df.select("source_id", "folds").collect() for f in r.folds}
    assert len(where(val)) == len(where(train)) == 2 and not where(val) & where(train)


def test_last_of_equal_stems_is_paired(spark, folders):
    i, m = folders
    with open(f"{i}/a b.tif", "wb") as f:
        f.write(png_bytes(image(5, 20, 31)))  # decoders go by content
    with open(f"{m}/notes.md", "w") as f:
        f.write("x")
    rows = {r.stem: r for r in files.load_pairs(spark, i, m).collect()}
    assert set(rows) == {"a b", "c+d%20"} and rows["a b"].source_id == "a b.tif"
    assert bytes(rows["a b"].image) == image(5, 20, 31).tobytes()


def test_png_kinds(spark, tmp_path):
    df = spark.createDataFrame([("p", 2, 2, bytearray(np.array([0, 0.5, 0.999, 1], np.float32).tobytes()))], "stem string, width int, height int, prob binary")
    assert sinks.write_rasters(df, str(tmp_path / "o"), "prob") == 1
    assert list(files.read_images(spark, str(tmp_path / "o" / "p_prob.png")).first().data) == [0, 127, 254, 255]
    with pytest.raises(ValueError):
        sinks.write_rasters(df, str(tmp_path / "o"), "depth")


LOG = "run string, fold int, epoch int, m double, img double"


@pytest.fixture(scope="module")
def log(spark):
    rng = np.random.default_rng(0)
    rows = []
    for fold in range(3):
        for e in range(1, 3001):
            rows.append(("r", fold, e, float(np.round(rng.random() * (0.9 + e / 30000), 3)), float(e) if e % 7 == 0 and fold else None))
    return spark.createDataFrame(rows, LOG).cache()


def by_fold(log):
    out = {}
    for r in log.orderBy("fold", "epoch").collect():
        out.setdefault(r.fold, []).append(r)
    return out


@pytest.mark.parametrize("mode", ["max", "min"])
def test_running_and_best_against_a_loop(log, mode):
    flags = {(r.fold, r.epoch): r.is_best for r in runs.running_best(log, "m", mode).collect()}
    best = {r.fold: r.epoch for r in runs.best_epoch(log, "m", mode).collect()}
    sign = 1 if mode == "max" else -1
    for fold, rows in by_fold(log).items():
        top = -np.inf
        for r in rows:
            assert flags[fold, r.epoch] == (sign * r.m > top)
            top = max(top, sign * r.m)
        assert best[fold] == next(r.epoch for r in rows if sign * r.m == top)


def test_latest_and_stats(log):
    last = {r.fold: r.img for r in runs.latest_metric(log, "img").collect()}
    assert last == {0: None, 1: 2996.0, 2: 2996.0}
    folds = runs.fold_results(log.withColumnRenamed("img", "val_dice_per_image"), "m", "max")
    s = runs.cv_stats(folds, ["val_dice_per_image"]).first()
    assert (s.mean_val_dice_per_image, s.std_val_dice_per_image) == (2996.0, 0.0)
    none = runs.cv_stats(folds.where("fold = 0"), ["val_dice_per_image", "m"]).first()
    assert none.mean_val_dice_per_image is None and none.std_val_dice_per_image is None and none.std_m == 0.0


@pytest.mark.parametrize("mode,patience,threshold", [("max", 3, 1e-4), ("min", 0, 1e-4), ("max", 2, 0.05)])
def test_plateau_against_a_loop(log, mode, patience, threshold):
    got = {(r.fold, r.epoch): (r.lr, r.bad, r.reduced) for r in runs.plateau_trace(
        log.repartition(5), "m", mode, 0.7, patience, 1e-5, 1e-3, threshold).collect()}
    for fold, rows in by_fold(log).items():
        lr, bad, best = 1e-3, 0, None
        for r in rows:
            before = lr
            good = best is None or (r.m > best * (1 + threshold) if mode == "max" else r.m < best * (1 - threshold))
            best, bad = (r.m, 0) if good else (best, bad + 1)
            cut = False
            if bad > patience:
                new, bad = max(lr * 0.7, 1e-5), 0
                if lr - new > 1e-8:
                    lr, cut = new, True
            assert got[fold, r.epoch] == (before, bad, cut)


def test_bad_mode(log):
    for f in (runs.running_best, runs.best_epoch, runs.plateau_trace):
        with pytest.raises(ValueError, match="max or min"):
            f(log, "m", "best")


def test_csv_and_json(spark, tmp_path):
    a = spark.createDataFrame([("r", 0, 1, 0.5)], "run string, fold int, epoch int, train_loss double")
    b = spark.createDataFrame([("r", 1, 1, 0.25, 0.75)], "run string, fold int, epoch int, train_loss double, val_iou double")
    sinks.write_metrics_csv(runs.epoch_rows(a, b), str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "csv"))
    assert back.columns == ["run", "fold", "epoch", "train_loss", "val_iou"]
    assert sorted(map(tuple, back.collect())) == [("r", 0, 1, 0.5, None), ("r", 1, 1, 0.25, 0.75)]
    folds = runs.epoch_rows(a, b).withColumnRenamed("epoch", "best_epoch")
    sinks.write_summary_json(runs.cv_summary(folds, ["train_loss", "val_iou"], 7), str(tmp_path / "json"))
    text = [open(os.path.join(tmp_path, "json", n)).read() for n in os.listdir(tmp_path / "json") if n.startswith("part") and n.endswith("json")]
    doc = json.loads("".join(text))
    assert doc["mean_train_loss"] == 0.375 and doc["num_original_images"] == 7
    assert [f["fold"] for f in doc["folds"]] == [0, 1] and doc["folds"][0]["val_iou"] is None
    sinks.write_metrics_csv(a.where("false"), str(tmp_path / "none"))
    assert spark.read.option("header", True).csv(str(tmp_path / "none")).count() == 0


def test_pixel_model_learns(spark):
    px = spark.range(4000).select((F.col("id") % 8).cast("string").alias("source_id"), F.rand(1).alias("a"), F.rand(2).alias("b"))
    px = px.withColumn("label", (F.col("a") > 0.5).cast("double"))
    roles = splits.kfold_splits(splits.distinct_groups(px), 2)
    best, log = models.fit_pixel_model(px, roles, ["a", "b"], "label", [{"reg": 5.0}, {"reg": 0.001}], monitor="val_loss", mode="min")
    rows = {(r.fold, r.epoch): r for r in log.collect()}
    assert set(rows) == {(0, 1), (0, 2), (1, 1), (1, 2)}
    assert all(rows[f, 2].val_dice_per_image > 0.95 for f in (0, 1))
    assert {r.fold: r.epoch for r in runs.best_epoch(log, "val_loss", "min").collect()} == {0: 2, 1: 2}
    losses = [r.loss for r in models.loss_history(best[0]).orderBy("iteration").collect()]
    assert losses[-1] < losses[0]


def test_needs_a_shared_folder_off_local(spark, monkeypatch):
    from sparktile import session

    class Conf:
        def get(self, key):
            return None

    class Context:
        master = "spark://cluster:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


def test_null_keys_and_empty_folds_stay(spark):
    rows = [(None, 0, 1, 0.5), (None, 0, 2, 0.7), ("r", None, 1, 0.1), ("r", 1, None, 0.2), ("r", 2, 1, None), ("r", 2, 2, None)]
    log = spark.createDataFrame(rows, "run string, fold int, epoch int, m double")
    flagged = runs.running_best(log, "m", "max").collect()
    assert len(flagged) == len(rows) and {(r.epoch, r.is_best) for r in flagged if r.run is None} == {(1, True), (2, True)}
    best = {(r.run, r.fold): (r.epoch, r.m) for r in runs.best_epoch(log, "m", "max").collect()}
    assert best[(None, 0)] == (2, 0.7) and best[("r", 2)] == (None, None) and len(best) == 4
    assert runs.fold_results(log.withColumn("val_dice_per_image", F.lit(1.0)), "m", "max").count() == 4


def test_fits_read_pixels_with_their_roles(spark, tmp_path, monkeypatch):
    """The roles of all folds are stored with the pixels, so that no fit joins them again; images in no fold are left out."""
    from sparktile.operators import models

    monkeypatch.setattr(models, "scratch_path", lambda spark, label: str(tmp_path / label))
    px = spark.createDataFrame([(i, float(i + j), float((i + j) % 2)) for i in range(5) for j in range(6)], "source_id long, a double, label double")
    roles = spark.createDataFrame([(f, i, "val" if i % 2 == f else "train") for f in range(2) for i in range(4)], "fold int, source_id long, role string")
    best, log = models.fit_pixel_model(px, roles, ["a"], "label", [{"max_iter": 2}])
    assert sorted(best) == [0, 1] and log.count() == 2
    stored = spark.read.parquet(str(tmp_path / "fit-pixels"))
    assert {(r.source_id, r.fold, r.role) for r in stored.selectExpr("source_id", "inline(_roles)").collect()} == {(r.source_id, r.fold, r.role) for r in roles.collect()}


def filtered_png(a, filters, depth=8):
    """A PNG of (H, W, C) bytes with the given row filters, each byte less its filter's guess."""
    h, w, c = a.shape
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[c] if depth == 8 else 0
    step, lines, above = c, [], np.zeros(w * c, int)
    for y in range(h):
        row, k = a[y].reshape(-1).astype(int), filters[y % len(filters)]
        left, corner = np.concatenate([np.zeros(step, int), row[:-step]]), np.concatenate([np.zeros(step, int), above[:-step]])
        p = left + above - corner
        d = np.abs(np.stack([p - left, p - above, p - corner]))
        paeth = np.choose(d.argmin(0), [left, above, corner])
        guess = [np.zeros_like(row), left, above, (left + above) // 2, paeth][k]
        lines.append(bytes([k]) + ((row - guess) % 256).astype(np.uint8).tobytes())
        above = row
    return png_of(w if depth == 8 else w // 2, h, depth, colour, b"".join(lines))


def png_of(w, h, depth, colour, raw):
    import struct
    import zlib

    def chunk(tag, body):
        return struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))

    packed = zlib.compress(raw)
    parts = [chunk(b"IDAT", packed[i : i + 50]) for i in range(0, len(packed), 50)]
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, 0)) + b"".join(parts) + chunk(b"IEND", b"")


@pytest.fixture
def mixed(tmp_path):
    folder = tmp_path / "mixed"
    (folder / "sub").mkdir(parents=True)
    (folder / "sub" / "deep.png").write_bytes(png_bytes(image(9, 4, 4)))
    for k in range(6):
        (folder / f"rgb {k}.png").write_bytes(png_bytes(image(k, 5 + k, 7)))
        (folder / f"c+d%20[{k}].PNG").write_bytes(png_bytes(image(k, 6, 3 + k, 1)))
        (folder / f"filters{k}.png").write_bytes(filtered_png(image(20 + k, 9, 5 + k), [k] if k < 5 else [4, 3, 0, 1, 2]))
        (folder / f"grey_filters{k}.png").write_bytes(filtered_png(image(30 + k, 7, 11, 1).reshape(7, 11, 1), [k] if k < 5 else [2, 4, 3]))
    (folder / "alpha{x}.png").write_bytes(filtered_png(image(40, 4, 5, 4), [1, 2]))
    (folder / "deep16.png").write_bytes(filtered_png(image(41, 4, 6, 1).reshape(4, 6, 1), [0], 16))
    (folder / "broken.png").write_bytes(b"not an image")
    (folder / "empty.tif").write_bytes(b"")
    return str(folder)


def both_ways(files_of, monkeypatch):
    """What ``files_of`` gives by Spark's sources, and by tasks."""
    found = []
    for many in (10**9, 3):
        monkeypatch.setattr(files, "MANY", many, raising=False)
        found.append(sorted(tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in files_of().collect()))
    return found


def test_large_folders_are_read_as_small_ones(spark, mixed, monkeypatch):
    # Spark's image source leaves out empty files
    for exts, drop, n in ((None, False, 27), (None, True, 26), ([".PNG"], False, 27), ([".tif", ".x"], False, 0)):
        whole, by_tasks = both_ways(lambda: files.read_images(spark, mixed, drop, exts), monkeypatch)
        assert whole == by_tasks and len(whole) == n
    # where most files are not plain PNGs, Spark's image source reads them all
    monkeypatch.setattr(files, "MOST_OTHERS", 2, raising=False)
    assert len(files.read_images(spark, mixed).collect()) == 27


def test_large_folders_are_listed_as_small_ones(spark, mixed, monkeypatch):
    whole, by_tasks = both_ways(lambda: files.list_masks(spark, mixed), monkeypatch)
    assert whole == by_tasks and len(whole) == 27
    # no list of files in the driver's plan
    assert "binaryFile" not in files.list_masks(spark, mixed)._jdf.queryExecution().toString()
    listed = files.list_masks(spark, mixed).select("path", "length")
    assert sorted(map(len, (r.content for r in files.with_content(listed).collect()))) == sorted(r.length for r in listed.collect())
    open(f"{mixed}/_x.png", "w").close()
    with pytest.raises(ValueError, match="_x.png"):
        files.list_masks(spark, mixed)
    assert files.read_images(spark, mixed).where("source_id like '%x.png'").count() == 0


def test_large_folders_with_damaged_files(spark, mixed, monkeypatch):
    import zlib

    whole = png_bytes(image(1, 30, 30))
    raw = bytes(91 * 30)
    wrong, packed = bytearray(raw), zlib.compress(raw)
    wrong[91 * 5] = 9
    bodies = {
        "short": whole[: len(whole) // 2], "no_end": whole[:-12], "tail": whole + b"xyz", "little": png_of(30, 30, 8, 2, raw[:1500]), "filter9": png_of(30, 30, 8, 2, bytes(wrong)),
        "much": png_of(30, 30, 8, 2, raw + b"abc"), "zlib": whole.replace(b"IDAT\x78", b"IDAT\0"), "sum": png_of(30, 30, 8, 2, raw).replace(packed[-4:], b"abcd"), "head": whole[:45],
    }
    for name, body in bodies.items():
        with open(f"{mixed}/{name}.png", "wb") as f:
            f.write(body)
    for drop in (False, True):
        found, by_tasks = both_ways(lambda: files.read_images(spark, mixed, drop), monkeypatch)
        assert found == by_tasks
        assert {r[0][:-4] for r in found if r[2] > 0} & set(bodies) == {"no_end", "tail", "much"}
