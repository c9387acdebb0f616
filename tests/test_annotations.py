import json
import os

import numpy as np
import pytest

from sparktile.operators import annotations as ann
from sparktile.operators import kernels
from sparktile.plans import jobs
from sparktile.plans.annotation_queries import _write_counts
from sparktile.sources import coco, files
from sparktile.operators.kernels import png_bytes


def fill(ring, h=8, w=8):
    grid = np.zeros((h, w), int)
    _, ys, x0, x1 = kernels.ring_spans([np.array(ring, float)], [h], [w])
    for y, a, b in zip(ys, x0, x1):
        grid[y, a : b + 1] = 1
    return ["".join(".#"[v] for v in row) for row in grid]


def test_triangle():
    assert fill([0, 0, 4, 0, 0, 4], 6, 6) == ["#####.", "####..", "###...", "##....", "#.....", "......"]


def test_downward_tip_and_direction():
    want = ["#######", ".#####.", "..###..", "...#...", "......."]
    assert fill([0, 0, 6, 0, 3, 3], 5, 7) == want == fill([3, 3, 6, 0, 0, 0], 5, 7)


def test_concave_keeps_the_notch():
    ring = [0, 0, 6, 0, 6, 5, 4, 5, 4, 2, 2, 2, 2, 5, 0, 5]
    assert fill(ring, 7, 7) == ["#######", "#######", "#######", "###.###", "###.###", "###.###", "......."]


def test_self_intersecting_is_even_odd():
    assert fill([0, 0, 4, 4, 4, 0, 0, 4], 5, 5) == ["#...#", "##.##", "#####", "##.##", "#...#"]


def test_clip_fraction_and_odd_number():
    assert fill([-3, -3, 2.9, -3, 2.9, 1.9, -3, 1.9, 77], 4, 4) == ["###.", "###.", "....", "...."]
    assert fill([1, 1, 2, 2], 4, 4) == ["...."] * 4
    assert fill([9, 9, 12, 9, 12, 12], 4, 4) == ["...."] * 4


def test_batches_do_not_mix():
    rng = np.random.default_rng(0)
    rings = [rng.uniform(-5, 40, 2 * rng.integers(2, 9)) for _ in range(60)]
    h, w = rng.integers(5, 40, 60), rng.integers(5, 40, 60)
    together = kernels.ring_spans(rings, h, w)
    for i in range(60):
        alone = kernels.ring_spans([rings[i]], h[i : i + 1], w[i : i + 1])
        got = sorted(zip(*(a[together[0] == i] for a in together[1:])))
        assert got == sorted(zip(*alone[1:]))


def runs_of(mask):
    flat = mask.T.ravel()
    cut = np.flatnonzero(np.diff(flat)) + 1
    counts = np.diff(np.concatenate([[0], cut, [flat.size]]))
    return np.concatenate([[0], counts]) if flat[0] else counts


def test_run_lengths_list_and_text():
    rng = np.random.default_rng(2)
    masks = [rng.random((rng.integers(1, 30), rng.integers(1, 30))) < rng.random() for _ in range(40)]
    masks += [np.zeros((4, 5), bool), np.ones((4, 5), bool)]
    runs = [runs_of(m.astype(int)) for m in masks]
    h, w = zip(*(m.shape for m in masks))
    who, y, a, b = kernels.run_spans(runs, h, w)
    for i, m in enumerate(masks):
        assert np.array_equal(kernels.read_counts(_write_counts(runs[i])), runs[i])
        alone = kernels.run_spans([runs[i]], h[i : i + 1], w[i : i + 1])
        for ys, xs, xe in ((y[who == i], a[who == i], b[who == i]), alone[1:]):
            back = np.zeros(m.shape, bool)
            for r, s, e in zip(ys, xs, xe):
                assert not back[r, s : e + 1].any()
                back[r, s : e + 1] = True
            assert np.array_equal(back, m)


def test_known_text():
    # "52203" decodes by hand: 5, 2, 2, 0+2, 3+2
    assert kernels.read_counts("52203").tolist() == [5, 2, 2, 2, 5]


def test_rle_of_many_images(spark):
    rng = np.random.default_rng(4)
    masks = [rng.random((9, 7)) < 0.5 for _ in range(6)]
    df = spark.createDataFrame([(i, 7, 9, [int(v) for v in runs_of(m.astype(int))]) for i, m in enumerate(masks)],
                               "image_id int, width int, height int, counts array<long>")
    got = ann.rle_spans(df, ["image_id"]).collect()
    for i, m in enumerate(masks):
        assert sum(r.x_end - r.x_start + 1 for r in got if r.image_id == i) == m.sum()


def test_compose_is_keep_minus_ignore(spark):
    """A hot image with many overlapping copies, against brute force."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        image = 1 if i % 3 else int(rng.integers(2, 6))
        y, x = rng.integers(0, 12, 2)
        rows.append((image, int(y), int(x), int(min(19, x + rng.integers(0, 8))), bool(rng.random() < 0.3)))
    spans = spark.createDataFrame(rows, "image_id int, y int, x_start int, x_end int, ign boolean")
    got = ann.compose_mask(spans).collect()
    want = {}
    for keep in (True, False):
        for image, y, a, b, ign in rows:
            if ign != keep:
                grid = want.setdefault(image, np.zeros((12, 21), bool))
                grid[y, a : b + 1] = keep
    back = {k: np.zeros((12, 21), bool) for k in want}
    for r in got:
        assert not back[r.image_id][r.y, max(0, r.x_start - 1) : r.x_end + 2].any()  # disjoint and maximal
        back[r.image_id][r.y, r.x_start : r.x_end + 1] = True
    assert all(np.array_equal(back[k], want[k]) for k in want)


def test_packed_spans_give_the_same_mask(spark, monkeypatch):
    """Spans as bytes, one row per image, band and kind of a batch; with small pieces a group goes on over many rows and slices."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        x, y, w, h = (float(v) for v in (*rng.integers(0, 120, 2), *rng.integers(1, 90, 2)))
        rows.append((None if i % 7 == 0 else "hot" if i % 2 else f"im{i % 11}", bool(rng.random() < 0.2), 150, 200, [[x, y, x + w, y, x + w, y + h, x, y + h]]))
    df = spark.createDataFrame(rows, "name string, ign boolean, width int, height int, polygons array<array<double>>").coalesce(1)
    want = {tuple(r) for r in ann.compose_mask(ann.polygon_spans(df, ["name", "ign"]), ["name"]).collect()}
    monkeypatch.setattr(ann, "PIECE", 5)
    monkeypatch.setattr(ann, "AT_ONCE", 17)
    packed = ann.polygon_spans(df, ["name", "ign"], packed=True)
    assert packed.columns == ["name", "_band", "_ign", "_spans"]
    assert {tuple(r) for r in ann.compose_mask(packed, ["name"]).collect()} == want
    grids = {}
    for keep in (True, False):
        for name, ign, w, h, ((x, y, x2, _, _, y2, *_),) in rows:
            if ign != keep:
                grids.setdefault(name, np.zeros((h, w), bool))[int(y) : int(y2) + 1, int(x) : int(x2) + 1] = keep
    back = {k: np.zeros((200, 150), bool) for k in grids}
    for name, y, a, b in want:
        back[name][y, a : b + 1] = True
    assert all(np.array_equal(back[k], grids[k]) for k in grids)


def test_texts_of_many_run_lengths_at_once():
    rng = np.random.default_rng(6)
    lists = [np.array([0]), np.zeros(0, np.int64)] + [rng.integers(0, 10 ** rng.integers(1, 10), rng.integers(0, 12)) for _ in range(200)]
    size = np.array([len(v) for v in lists])
    texts = kernels.write_many_counts(np.concatenate(lists), size)
    assert texts == [_write_counts(v) for v in lists]
    value, read = kernels.read_many_counts(texts)
    assert np.array_equal(read, size) and np.array_equal(value, np.concatenate(lists))


@pytest.fixture
def exports(tmp_path):
    """Two complete batches with one prefix, one without images, one without a document."""
    root = tmp_path / "exports"
    grey = png_bytes(np.zeros((6, 6), np.uint8))

    def make(batch, doc, names):
        if doc is not None:
            (root / batch / "annotations").mkdir(parents=True)
            (root / batch / "annotations" / "instances_default.json").write_text(json.dumps(doc, indent=1))
        if names is not None:
            (root / batch / "images" / "default").mkdir(parents=True)
            for n in names:
                (root / batch / "images" / "default" / n).write_bytes(grey)

    cats = [{"id": 1, "name": "hypha"}, {"id": 2, "name": "x"}, {"id": 2, "name": "INOCULUM"}]
    square = [1, 1, 4, 1, 4, 4, 1, 4]
    rle = {"counts": [7, 2, 27], "size": [6, 6]}
    img = lambda i, n: {"id": i, "file_name": n, "width": 6, "height": 6, "license": 0}
    anns = [
        {"image_id": 1, "category_id": 1, "segmentation": [square]},
        {"image_id": 1, "category_id": 2, "segmentation": {"counts": _write_counts([7, 2, 27]), "size": [6, 6]}},
        {"image_id": 2, "category_id": 9, "segmentation": rle},
        {"image_id": 4, "segmentation": [square, [0, 0, 1, 1]]},
        {"image_id": 2, "category_id": 1, "segmentation": []},
    ]
    make("batch_1", {"categories": cats, "images": [img(1, "a b.png"), img(2, "c+d.png"), img(9, "blank.jpg"), img(3, "blank.png"), img(4, "gone.png")],
                     "annotations": anns + [{"image_id": 9, "category_id": 1, "segmentation": [square]}]},
         ["a b.png", "c+d.png", "blank.png"])
    make("batch 2", {"images": [img(1, "blank.png")], "annotations": [{"image_id": 1, "category_id": 1, "segmentation": [square]}]}, ["blank.png"])
    make("no_images", {"images": [], "annotations": []}, None)
    make("no_doc", None, ["z.png"])
    return str(root)


def test_typed_segmentation(spark, exports):
    _, annotations, _ = coco.read_coco_exports(spark, exports)
    rows = coco.typed_segmentation(annotations).where("batch = 'batch_1'").collect()
    kinds = sorted((r.polygons is not None, r.counts is not None, r.counts_text is not None) for r in rows)
    assert kinds == [(False, False, True), (False, True, False)] + [(True, False, False)] * 4


def test_export_job(spark, exports, tmp_path):
    out = tmp_path / "data"
    (out / "masks").mkdir(parents=True)
    (out / "masks" / "stale.png").write_bytes(b"x")
    got = jobs.coco_to_masks(spark, exports, str(out), prefix=5)
    assert got["skipped"] == 1 and got["blank"] == 1 and got["collided"] == 2
    assert sorted(n for n in os.listdir(out / "masks") if not n.startswith(".")) == ["batch_a b.png", "batch_blank.png", "batch_c+d.png"]
    assert sorted(n for n in os.listdir(out / "images") if not n.startswith(".")) == ["batch_a b.png", "batch_blank.png", "batch_c+d.png"]
    masks = {r.stem: np.frombuffer(bytes(r.mask), np.uint8).reshape(6, 6) for r in files.decode_gray(files.read_images(spark, str(out / "masks"))).collect()}
    square = np.zeros((6, 6), int)
    square[1:5, 1:5] = 255
    erased = square.copy()
    erased[1:3, 1] = 0
    run = np.zeros((6, 6), int)
    run[1:3, 1] = 255
    assert np.array_equal(masks["batch_a b"], erased)
    assert np.array_equal(masks["batch_c+d"], run)
    # "batch 2" sorts before "batch_1", so the later batch's blank mask replaces the square
    assert not masks["batch_blank"].any()
    assert sorted(map(tuple, coco.incomplete_exports(spark, exports).collect())) == [("no_doc", "annotations"), ("no_images", "images")]


def test_whole_batch_names_lose_nothing(spark, exports, tmp_path):
    got = jobs.coco_to_masks(spark, exports, str(tmp_path / "all"))
    names = ["batch 2_blank.png", "batch_1_a b.png", "batch_1_blank.png", "batch_1_c+d.png"]
    assert got["collided"] == 0 and sorted(n for n in os.listdir(tmp_path / "all" / "masks") if not n.startswith(".")) == names


def test_hidden_files_are_reported(spark, exports, tmp_path):
    folder = tmp_path / "imgs"
    folder.mkdir()
    for name in ("a.png", "_b.png", ".c.png"):
        (folder / name).write_bytes(b"x")
    with pytest.raises(ValueError, match="_b.png"):
        files.list_masks(spark, str(folder))
    (folder / "_b.png").rename(folder / "b.png")
    (folder / ".c.png").rename(folder / "c.png")
    assert files.list_masks(spark, str(folder)).count() == 3


def test_ignore_list_falls_back(spark):
    cats = spark.createDataFrame([(1, "Inoculum", 0), (2, "Dust", 1)], "id long, name string, pos int")
    anns = spark.createDataFrame([(1,), (2,), (3,)], "category_id long")
    for ignore, want in (((), {1}), (None, {1}), (("dust",), {2})):
        assert {r.category_id for r in ann.annotation_classes(anns, cats, ignore).where("ign").collect()} == want


def test_spans_beyond_two_million_columns(spark):
    wide = (1 << 21) + 100
    rows = [(1, wide, 5, [[float(1 << 21), 1.0, float((1 << 21) + 9), 1.0, float((1 << 21) + 9), 2.0, float(1 << 21), 2.0]])]
    found = ann.polygon_spans(spark.createDataFrame(rows, "image_id long, width int, height int, polygons array<array<double>>"), ["image_id"])
    assert sorted(map(tuple, found.distinct().collect())) == [(1, y, 1 << 21, (1 << 21) + 9) for y in (1, 2)]
    runs = [(2, wide, 2, [2 * (1 << 21) + 1, 3])]
    spans = ann.rle_spans(spark.createDataFrame(runs, "image_id long, width int, height int, counts array<bigint>"), ["image_id"]).collect()
    assert sorted(map(tuple, spans)) == [(2, 0, (1 << 21) + 1, (1 << 21) + 1), (2, 1, 1 << 21, (1 << 21) + 1)]


def test_names_collide_only_when_shortened(spark):
    files = spark.createDataFrame([("export-1", "a"), ("export-2", "a"), ("other", "a")], "batch string, name string")
    whole = {r["out_name"]: r["collided"] for r in ann.prefix_names(files, "batch", "name").collect()}
    assert whole == {"export-1_a": 0, "export-2_a": 0, "other_a": 0}
    short = {r["out_name"]: (r["batch"], r["collided"]) for r in ann.prefix_names(files, "batch", "name", 5).collect()}
    assert short == {"expor_a": ("export-2", 1), "other_a": ("other", 0)}


def test_export_folders_are_of_bounded_size(spark, sf_dir, monkeypatch):
    from pyspark.sql import functions as F

    import __spark_entry__ as entry
    from oracle import connect, mismatch
    from sparktile.plans import job_queries
    from sparktile.sources.coco import read_coco_exports

    most = 400
    monkeypatch.setattr(job_queries, "FOLDER_ROWS", most, raising=False)
    images, annotations, _ = read_coco_exports(spark, job_queries._coco_folder(spark, sf_dir))
    sizes = images.select("batch").unionByName(annotations.select("batch")).groupBy("batch").count()
    total, largest = sizes.agg(F.sum("count"), F.max("count")).first()
    assert total > 5 * most and largest <= most
    # few rows a folder: some have images but no annotation
    monkeypatch.setattr(job_queries, "FOLDER_ROWS", 60, raising=False)
    assert mismatch(entry.queries()["q_coco_export"](spark, sf_dir), connect(sf_dir), entry.oracle_sql()["q_coco_export"]) is None


def test_images_of_exports_are_not_broadcast(spark, exports):
    """The frames look as small as the index of byte ranges; only the names of categories may be sent to every task."""
    plan = jobs.export_masks(*coco.read_coco_exports(spark, exports))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") <= 1 and plan.count("SortMergeJoin") >= 3
    # one branch, so that annotations are parsed in one pass
    assert "Union" not in plan


def test_spans_of_both_kinds_in_one_pass(spark):
    ring, far = [1.0, 1.0, 4.0, 1.0, 4.0, 3.0, 1.0, 3.0], [0.0, 0.0, 2.0, 0.0, 2.0, 5.0]
    kind = "image_id long, ign boolean, width int, height int, polygons array<array<double>>, counts array<bigint>, counts_text string"
    rows = [
        (1, False, 8, 6, [ring, far], None, None), (2, True, 8, 6, [[1.0, 2.0], None, ring[:7]], None, None), (3, None, 8, 6, [], None, None),
        (4, False, 5, 4, None, [3, 4, 2, 11], None), (5, True, 5, 4, None, [], None), (6, False, 5, 4, None, None, "342;"), (7, False, 5, 4, None, None, None),
        (None, False, 8, 6, [far], None, None),
    ]
    frame, keep = spark.createDataFrame(rows, kind), ["image_id", "ign"]
    apart = ann.polygon_spans(frame.where("polygons is not null"), keep).unionByName(ann.rle_spans(frame.where("polygons is null"), keep))
    want = sorted(map(str, apart.collect()))
    assert len(want) > 10
    for n in (1, 3):
        assert sorted(map(str, ann.shape_spans(frame.repartition(n), keep).collect())) == want
    masks = [sorted(map(str, ann.compose_mask(s).collect())) for s in (apart, ann.shape_spans(frame, keep, packed=True))]
    assert masks[0] == masks[1]


def test_both_planes_come_from_one_read(spark, tmp_path):
    import re

    from pyspark.sql import functions as F

    import __spark_entry__ as entry
    from sparktile.sources import tables

    rows = [(1, 7, 9, 3.0, "R"), (1, 7, 9, 3.0, "R"), (2, 39, 39, 23.0, "A"), (2, 0, 0, 12.0, "N"), (3, 5, None, 8.0, "N"), (3, 5, 4, None, "A"), (None, 1, 2, 9.0, None), (4, 38, 31, -11.0, "N")]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(k, "1-URGENT") for k in range(1, 6)], "o_orderkey long, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    whole = tables.coco_runs(spark, str(tmp_path))
    half = F.transform("counts", lambda c, i: F.when(i % 2 == 1, F.floor(c / 2).cast("long")).otherwise(c))
    # what a foreground run loses is given to the background run after it
    lost = F.transform("counts", lambda c, i: F.when((i % 2 == 0) & (i > 0), F.ceil(F.get("counts", i - 1) / 2).cast("long")).otherwise(F.lit(0).cast("long")))
    second = whole.withColumn("counts", F.zip_with(half, lost, lambda a, b: a + b))
    both = tables.coco_runs(spark, str(tmp_path), halves=True)
    assert both.schema == whole.schema
    assert sorted(map(str, both.collect())) == sorted(map(str, whole.unionByName(second).collect()))
    planes = entry.queries()["q_coco_planes"](spark, str(tmp_path))
    plan = planes._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation *\[[^]]*l_orderkey", plan)) == 1 and "lambda" not in plan
