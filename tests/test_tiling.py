import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparktile.functions import covering_origins, tile_positions
from sparktile.operators import scoring, tiling

SIZES = [(1, 1), (5, 9), (16, 16), (17, 16), (15, 40), (64, 33)]


def brute_axis(n, p, s):
    out = []
    at = 0
    while n > p and at + p <= n:
        out.append(at)
        at += s
    if n <= p:
        out = [0]
    elif out[-1] + p < n:
        out.append(n - p)
    return out


def packed(spark, sizes=SIZES, seed=1):
    rng = np.random.default_rng(seed)
    rows = [
        (f"i{k}.png", w, h, rng.integers(0, 256, (h, w, 3), dtype=np.uint8).tobytes(), rng.integers(0, 256, (h, w), dtype=np.uint8).tobytes())
        for k, (h, w) in enumerate(sizes)
    ]
    return spark.createDataFrame([(a, b, c, bytearray(d), bytearray(e)) for a, b, c, d, e in rows],
                                 "source_id string, width int, height int, image binary, mask binary"), rows


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(p=st.integers(1, 20), s=st.integers(1, 25))
def test_positions_and_cover(spark, p, s):
    lengths = list(range(1, 50))
    df = spark.createDataFrame([(n,) for n in lengths], "n int")
    got = {r.n: r.v for r in df.select("n", tile_positions(F.col("n"), p, s).alias("v")).collect()}
    assert got == {n: brute_axis(n, p, s) for n in lengths}
    cover = df.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    for r in cover.select("n", "x", covering_origins(F.col("x"), F.col("n"), p, s).alias("v")).collect():
        want = [o for o in got[r.n] if o <= r.x < o + p]
        assert sorted(r.v) == want, (r.n, r.x, p, s)
        assert s > p or want  # without gaps every pixel is covered


def test_bad_geometry(spark):
    with pytest.raises(ValueError):
        tile_positions(F.lit(4), 0, 1)
    with pytest.raises(ValueError):
        tiling.tile_grid(packed(spark)[0], 4, 0, overlap=4)


def to_long(rows):
    return [
        (sid, int(y), int(x), int(m), w, h)
        for sid, w, h, _, mask in rows
        for (y, x), m in np.ndenumerate(np.frombuffer(mask, np.uint8).reshape(h, w))
    ]


@pytest.mark.parametrize("p,s,thr", [(16, 12, 127), (8, 8, 200), (16, 5, -1)])
def test_long_and_packed_counts_agree(spark, p, s, thr):
    images, rows = packed(spark)
    pixels = spark.createDataFrame(to_long(rows), "source_id string, y int, x int, m int, width int, height int")
    cols = ["source_id", "y0", "x0", "fg"]
    long = tiling.foreground_count(pixels, images.drop("image", "mask"), p, s, thr).select(cols)
    got = tiling.foreground_count_packed(images, p, s, thr).select(cols)
    assert sorted(long.collect()) == sorted(got.collect())
    brute = []
    for sid, w, h, _, mask in rows:
        m = np.pad(np.frombuffer(mask, np.uint8).reshape(h, w).astype(int), ((0, p), (0, p)))
        brute += [(sid, y, x, int((m[y : y + p, x : x + p] > thr).sum())) for y in brute_axis(h, p, s) for x in brute_axis(w, p, s)]
    assert sorted(map(tuple, got.collect())) == sorted(brute)


def test_cut_tiles_pad_filter_and_manifest(spark):
    images, rows = packed(spark)
    tiles = tiling.cut_tiles(images, 16, 12).collect()
    by_id = {r[0]: r for r in rows}
    for t in tiles:
        _, w, h, image, _ = by_id[t.source_id]
        want = np.zeros((16, 16, 3), np.uint8)
        part = np.frombuffer(image, np.uint8).reshape(h, w, 3)[t.y0 : t.y0 + 16, t.x0 : t.x0 + 16]
        want[: part.shape[0], : part.shape[1]] = part
        assert bytes(t.image) == want.tobytes()
    kept = tiling.cut_tiles(images, 16, 12, 127, min_fg=120)
    listed = tiling.filter_empty_tiles(tiling.foreground_count_packed(images, 16, 12), 120)
    via = tiling.tile_samples(listed, images, 16, 12)
    order = ["source_id", "y0", "x0"]
    assert [tuple(r) for r in kept.orderBy(order).collect()] == [tuple(r) for r in via.orderBy(order).collect()]
    assert 0 < kept.count() < len(tiles)


def test_unfiltered_manifest_reads_no_pixels(spark):
    images, _ = packed(spark)
    assert tiling.build_tiles(images, None, 16, 12, filter_empty=False).count() == tiling.cut_tiles(images, 16, 12).count()


@pytest.mark.parametrize("p,s,block", [(16, 12, 10), (16, 16, 64), (4, 7, 5)])
def test_stitch_packed_equals_brute_force(spark, p, s, block):
    """Random scores, images smaller and larger than the patch, and strides that leave gaps."""
    images, rows = packed(spark)
    grid = tiling.tile_grid(images.drop("image", "mask"), p, s).collect()
    rng = np.random.default_rng(5)
    scored = [(g.source_id, g.width, g.height, g.y0, g.x0, p, rng.integers(0, 64, p * p).astype(float) / 64) for g in grid]
    df = spark.createDataFrame([(*r[:6], r[6].tolist()) for r in scored],
                               "source_id string, width int, height int, y0 int, x0 int, patch_size int, prob array<float>")
    want = {}
    for sid, w, h, _, _ in rows:
        total, count = np.zeros((h, w)), np.zeros((h, w))
        for i, _, _, y, x, _, v in scored:
            if i == sid:
                part = v.reshape(p, p)[: h - y, : w - x]
                total[y : y + p, x : x + p] += part
                count[y : y + p, x : x + p] += 1
        want |= {(sid, y, x): v for (y, x), v in np.ndenumerate((total / np.maximum(count, 1)).astype(np.float32))}
    for parts in (1, 7):
        blocks = scoring.stitch_packed(df.repartition(parts), images, block, p, s)
        got = {(r.source_id, r.y, r.x): r.prob for r in scoring.unpack_blocks(blocks).collect()}
        assert got == want
    long = scoring.stitch(scoring.unpack_scores(df), images, p, s).collect()
    assert {(r.source_id, r.y, r.x) for r in long} == set(want)
    assert max(abs(r.prob - want[(r.source_id, r.y, r.x)]) for r in long) < 1e-6


def test_batches(spark):
    tiles = spark.range(103).select(F.col("id").alias("source_id"), F.lit(0).alias("y0"), F.lit(0).alias("x0"))

    def order(df):
        return [r.source_id for r in df.orderBy("idx").collect()]

    plain = tiling.batches(tiles, 10, shuffle=False)
    assert order(plain) == list(range(103))
    assert [r["count"] for r in plain.groupBy("batch").count().orderBy("batch").collect()] == [10] * 10 + [3]
    one, again = (order(tiling.batches(tiles.repartition(n), 10, True, seed=3, epoch=1)) for n in (1, 13))
    other = order(tiling.batches(tiles, 10, True, seed=3, epoch=2))
    assert one == again and sorted(one) == list(range(103)) and one not in (other, list(range(103)))
    with pytest.raises(ValueError):
        tiling.batches(tiles, 0, True)


def test_unpack_images(spark):
    images, rows = packed(spark)
    got = {(r.source_id, r.y, r.x): (r.r, r.g, r.b, r.m) for r in tiling.unpack_images(images).collect()}
    want = {}
    for sid, w, h, image, mask in rows:
        rgb, m = np.frombuffer(image, np.uint8).reshape(h, w, 3), np.frombuffer(mask, np.uint8).reshape(h, w)
        want |= {(sid, y, x): (*map(int, rgb[y, x]), int(m[y, x])) for y in range(h) for x in range(w)}
    assert got == want
    assert tiling.unpack_images(images.drop("image")).columns == ["source_id", "width", "height", "y", "x", "m"]


@pytest.mark.parametrize("keys", [["source_id"], ["part", "source_id"]])
def test_ranks_are_exact_for_any_layout(spark, keys):
    """A third of all rows shares one leading key."""
    from sparktile.functions.ranking import ordered_index, ranged_index, shuffled_index

    df = spark.range(5000).select(F.col("id").alias("source_id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 97).alias("part"))
    want = [tuple(r[k] for k in keys) for r in df.orderBy(keys).collect()]
    for n in (1, 11):
        for rank in (ordered_index, ranged_index, lambda *a: ranged_index(*a, digits=0), lambda *a: ranged_index(*a, digits=5)):
            got = rank(df.repartition(n), keys).orderBy("idx").collect()
            assert [tuple(r[k] for k in keys) for r in got] == want and [r.idx for r in got] == list(range(5000))
    mixed = shuffled_index(df, keys, 5).orderBy("idx").collect()
    assert [r.idx for r in mixed] == list(range(5000)) and len({r.source_id for r in mixed}) == 5000


def test_ranks_are_lazy_and_order_nulls_strings_and_empty_tables(spark):
    from sparktile.functions.ranking import ranged_index

    df = spark.range(700).selectExpr("if(id % 50 = 7, null, concat('k', id % 60)) a", "if(id % 97 = 3, null, id / 4) b", "id").repartition(5)
    unique = df.dropDuplicates(["a", "b"])
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    ranked = ranged_index(unique, ["a", "b"], "at", 4)
    ranked._jdf.queryExecution().optimizedPlan()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == jobs
    want = [(r.a, r.b) for r in unique.orderBy("a", "b").collect()]
    got = ranked.orderBy("at").collect()
    assert [(r.a, r.b) for r in got] == want and [r.at for r in got] == list(range(len(want)))
    assert ranked.columns == ["a", "b", "id", "at"]
    assert ranged_index(df.limit(0), ["a", "b"]).count() == 0


def test_table_function_equals_the_grid(spark):
    from sparktile.functions.table_functions import register_table_functions

    rows = [("a", 40, 57), ("b", 16, 16), ("c", 70, 9), ("d", 1, 1), (None, 33, 12)]
    images = spark.createDataFrame(rows, "source_id string, width int, height int")
    sql = register_table_functions(spark).sql
    for patch, stride in ((16, 12), (16, 16), (5, 3), (8, 11), (64, 64)):
        got = sql(f"select source_id, y0, x0 from {{i}}, lateral tile_positions(width, height, {patch}, {stride})", i=images)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, tiling.tile_grid(images, patch, stride).select("source_id", "y0", "x0").collect()))
    corners = sql("select * from tile_positions(20, 10, 16, 8, corners => true)")
    assert [tuple(r) for r in corners.collect()] == [(0, 0, 9, 15), (0, 4, 9, 19)]
    assert sql("select * from tile_positions(cast(null as int), 10, 16, 8)").count() == 0
    for bad in ("tile_positions(10, 10, 0, 8)", "tile_positions(10, 10, 8, -1)", "tile_positions(10, 10, 8, 8, corners => 3)"):
        with pytest.raises(Exception, match="at least 1|true or false"):
            sql(f"select * from {bad}").collect()


def _lacking(tmp_path, sf_dir):
    """Embeddings whose last image has five vectors of eight; three others lack one each."""
    import duckdb

    source = f"from read_parquet('{sf_dir}/embeddings.parquet')"
    duckdb.connect().execute(
        f"copy (select * {source} where vec_id < 85 and vec_id not in (21, 34, 47)) to '{tmp_path}/embeddings.parquet' (format parquet)"
    )
    return str(tmp_path)


def test_missing_pixels_by_brute_force(spark):
    sizes = [(1, 70, 3), (2, 32, 2), (3, 1, 1), (4, 33, 1)]
    places = [(s, y, x) for s, w, h in sizes for y in range(h) for x in range(w)]
    have = [p for p in places if (p[1] * 31 + p[2] * 17 + p[0]) % 5 or p[0] == 2]
    images = spark.createDataFrame(sizes, "source_id long, width int, height int")
    pixels = spark.createDataFrame(have + have[:40], "source_id long, y int, x int")
    rows = tiling.missing_pixels(pixels, images).collect()
    assert sorted((r.source_id, r.y, r.x) for r in rows) == sorted(set(places) - set(have))
    assert {(r.source_id, r.width, r.height) for r in rows} <= set(sizes)
    assert tiling.missing_pixels(pixels.limit(0), images).count() == len(places)


@pytest.mark.parametrize("name", [
    "q_affine", "q_gauss_blur", "q_crop_pad", "q_erode_packed", "q_evaluate_losses_packed", "q_dice_iou_image", "q_dice_iou_image_packed",
    "q_raster_roundtrip", "q_image_records", "q_decode_gray", "q_stitch_gaps",
])
def test_images_that_lack_vectors_match_sql(spark, tmp_path, sf_dir, name):
    import __spark_entry__ as entry
    from oracle import connect, mismatch

    folder = _lacking(tmp_path, sf_dir)
    assert mismatch(entry.queries()[name](spark, folder), connect(folder), entry.oracle_sql()[name]) is None


def test_repeated_pixels_leave_one_per_place(spark, tmp_path, sf_dir):
    from sparktile.sources import tables

    folder = _lacking(tmp_path, sf_dir)
    once = {r.source_id: (bytes(r.image), bytes(r.mask)) for r in tables.px_packed(spark, folder).collect()}
    extra = spark.read.parquet(f"{folder}/embeddings.parquet")
    extra.unionByName(extra.where("vec_id = 3")).write.parquet(f"{tmp_path}/twice/embeddings.parquet")
    twice = {r.source_id: (bytes(r.image), bytes(r.mask)) for r in tables.px_packed(spark, f"{tmp_path}/twice").collect()}
    assert once == twice and all(len(i) == 3 * len(m) for i, m in once.values())
