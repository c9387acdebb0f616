import numpy as np
import pytest
from functools import partial
from pyspark.sql import functions as F

from sparktile.operators import kernels, tiling, transforms
from test_tiling import packed


@pytest.fixture(scope="module")
def tiles(spark):
    images, _ = packed(spark, [(40, 33), (16, 16), (9, 20)])
    return tiling.cut_tiles(images, 16, 12).cache()


ORDER = ["source_id", "y0", "x0"]


def rows(df):
    return [tuple(bytes(v) if isinstance(v, bytearray) else tuple(v) if isinstance(v, list) else v for v in r) for r in df.orderBy(ORDER).collect()]


@pytest.mark.parametrize("long,step", [
    (lambda d: transforms.hflip(d, 16), partial(transforms._flip, axis=1)),
    (lambda d: transforms.vflip(d, 16), partial(transforms._flip, axis=0)),
    (lambda d: transforms.rot90(d, 16, 1), partial(transforms._turn, k=1)),
    (lambda d: transforms.rot90(d, 16, 3), partial(transforms._turn, k=3)),
    (lambda d: transforms.brightness_contrast(d, 0.07, -0.13), partial(transforms._tone, brightness=0.07, contrast=-0.13)),
    (lambda d: transforms.gamma(d, 0.93), partial(transforms._power, exponent=0.93)),
])
def test_long_equals_packed(tiles, long, step):
    want = long(tiling.unpack_tiles(tiles))
    got = tiling.unpack_tiles(transforms.apply_steps(tiles, [step])).select(want.columns)
    assert want.exceptAll(got).isEmpty() and got.exceptAll(want).isEmpty()


def test_identities(tiles):
    pixels = tiling.unpack_tiles(tiles)
    same = [
        transforms.hflip(transforms.hflip(pixels, 16), 16), transforms.rot90(transforms.rot90(pixels, 16, 1), 16, 3),
        transforms.rot90(pixels, 16, 4), transforms.brightness_contrast(pixels, 0.0, 0.0), transforms.gamma(pixels, 1.0),
    ]
    for s in same:
        assert s.exceptAll(pixels).isEmpty()
    plain = rows(tiles.select(*ORDER, "image", "mask"))
    for t in (transforms.affine(tiles), transforms.resize(tiles, 16)):
        assert rows(t.select(*ORDER, "image", "mask")) == plain


def test_resize_changes_side(tiles):
    r = transforms.resize(tiles, 10).first()
    assert r.side == 10 and len(r.image) == 300 and len(r.mask) == 100 and r.patch_size == 16


def test_affine_shift_moves_pixels(tiles):
    src = {r[:3]: np.frombuffer(r[3], np.uint8).reshape(16, 16, 3) for r in rows(tiles.select(*ORDER, "image"))}
    for r in rows(transforms.affine(tiles, translate=(0.25, -0.125)).select(*ORDER, "image")):
        want = np.zeros((16, 16, 3), np.uint8)
        want[:14, 4:] = src[r[:3]][2:, :12]
        assert r[3] == want.tobytes()


def test_even_kernel_is_refused(tiles):
    with pytest.raises(ValueError):
        transforms.gaussian_blur(tiles, 4, 1.0)


def test_flat_images_stay_flat():
    flat = np.full((12, 12, 3), 77, np.uint8)
    for k in (kernels.gaussian_kernel(5, 0.7), kernels.disk_kernel(3, 0.2), kernels.disk_kernel(9, 0.3)):
        assert abs(k.sum() - 1) < 1e-9
        assert (kernels.to_u8(kernels.correlate(flat, k)) == 77).all()


def test_equalize_colour_keeps_hue_order_and_shape():
    rng = np.random.default_rng(0)
    image = rng.integers(0, 256, (30, 25, 3), dtype=np.uint8)
    out = kernels.equalize(image, 2.0, (4, 3))
    assert out.shape == image.shape and out.dtype == np.uint8
    high = kernels.equalize_plane((np.arange(64 * 64).reshape(64, 64) // 64 + 100).astype(np.uint8), 40.0, (2, 2))
    assert high.max() - high.min() > 63  # contrast grows


def test_augment_is_a_function_of_the_key(tiles):
    first = rows(transforms.augment_tiles(tiles, seed=1, epoch=2).select(*ORDER, "side", "tensor", "mask"))
    again = rows(transforms.augment_tiles(tiles.repartition(7), seed=1, epoch=2).select(*ORDER, "side", "tensor", "mask"))
    later = rows(transforms.augment_tiles(tiles, seed=1, epoch=3).select(*ORDER, "side", "tensor", "mask"))
    assert first == again != later


def test_augment_without_chances_is_the_eval_transform(tiles):
    off = {"train": {
        "horizontal_flip_p": 0, "vertical_flip_p": 0, "random_rotate_90_p": 0, "affine": {"p": 0}, "gauss_noise_p": 0,
        "random_brightness_contrast_p": 0, "random_gamma": {"p": 0}, "clahe": {"p": 0}, "blur": {"p": 0},
    }, "normalize": {"mean": [0.1, 0.2, 0.3], "std": [0.5, 0.5, 0.25]}}
    cols = [*ORDER, "side", "tensor", "mask"]
    assert rows(transforms.augment_tiles(tiles, off, image_size=12).select(cols)) == rows(transforms.eval_transform(tiles, off, 12).select(cols))


def test_every_step_runs(tiles):
    on = {"train": {
        "horizontal_flip_p": 1, "vertical_flip_p": 1, "random_rotate_90_p": 1, "affine": {"p": 1}, "gauss_noise_p": 1,
        "random_brightness_contrast": {"p": 1}, "random_gamma": {"p": 1}, "clahe": {"p": 1}, "blur": {"p": 1},
    }}
    out = transforms.augment_tiles(tiles, on, image_size=20)
    assert out.select(F.size("tensor")).distinct().collect() == [(1200,)]
    assert len({r[3] for r in rows(out.select(*ORDER, "tensor"))}) == tiles.count()


def test_brightness_chance_names():
    old = transforms._settings({"train": {"random_brightness_contrast_p": 0.9}})
    new = transforms._settings({"train": {"random_brightness_contrast_p": 0.9, "random_brightness_contrast": {"p": 0.1}}})
    assert old["random_brightness_contrast"]["p"] == 0.9 and new["random_brightness_contrast"]["p"] == 0.1
    assert transforms._settings(None)["random_brightness_contrast"]["p"] == 0.3


def test_noise_has_the_asked_spread(spark):
    grey = bytearray(np.full((64, 64, 3), 128, np.uint8).tobytes())
    images = spark.createDataFrame([("a", 64, 64, grey, bytearray(64 * 64))], "source_id string, width int, height int, image binary, mask binary")
    out = transforms.gauss_noise(tiling.cut_tiles(images, 64, 64), 0.05).first()
    assert abs(np.frombuffer(bytes(out.image), np.uint8).astype(float).std() - 0.05 * 255) < 0.5


def test_one_of_picks_exactly_one(tiles):
    a, b = partial(transforms._tone, brightness=1.0, contrast=0.0), partial(transforms._tone, brightness=-1.0, contrast=0.0)
    seen = {bytes(r.image)[0] for r in transforms.one_of(tiles, [a, b]).collect()}
    assert seen == {0, 255}
    assert rows(transforms.one_of(tiles, [a, b], p=0.0).select("image", *ORDER)) == rows(tiles.select("image", *ORDER))


def brute_augment(tile, seed, epoch):
    """One tile through the documented default chain, pixel by pixel; only CLAHE and the counter's normals come from the kernels."""
    import hashlib
    import math

    n, c = tile.patch_size, (tile.patch_size - 1) / 2
    key = lambda name: int(hashlib.md5(f"{seed}:{epoch}:{tile.source_id}:{tile.x0}:{tile.y0}:{name}".encode()).hexdigest()[:13], 16)
    draw = lambda name, low=0.0, high=1.0: low + (high - low) * (key(name) / 2.0**52)
    byte = lambda v: min(255, max(0, math.floor(v + 0.5)))
    image = np.frombuffer(bytes(tile.image), np.uint8).reshape(n, n, 3).tolist()
    mask = np.frombuffer(bytes(tile.mask), np.uint8).reshape(n, n).tolist()
    around = range(n)
    pixelwise = lambda f: [[[byte(f(v)) for v in px] for px in row] for row in image]
    mirror = lambda i: -i if i < 0 else 2 * (n - 1) - i if i >= n else i
    ran = set()
    runs = lambda name, p: draw(name) < p and (ran.add(name) or True)
    if runs("hflip", 0.8):
        image, mask = [r[::-1] for r in image], [r[::-1] for r in mask]
    if runs("vflip", 0.6):
        image, mask = image[::-1], mask[::-1]
    if runs("turn", 0.8):
        for _ in range(int(draw("turn_k") * 4)):
            image, mask = ([[a[y][n - 1 - x] for y in around] for x in around] for a in (image, mask))
    if runs("affine", 0.6):
        tx, ty = (round(draw(f"affine_translate_{k}", -0.05, 0.05) * n) for k in "xy")
        fx, fy = (draw(f"affine_scale_{k}", 0.9, 1.1) for k in "xy")
        turn = math.radians(draw("affine_rotate", -30, 30))
        at = lambda a, y, x, none: a[y][x] if 0 <= y < n and 0 <= x < n else none
        out, low = [], []
        for y in around:
            for x in around:
                u, v = x - c - tx, y - c - ty
                sy, sx = (-math.sin(turn) * u + math.cos(turn) * v) / fy + c, (math.cos(turn) * u + math.sin(turn) * v) / fx + c
                iy, ix = math.floor(sy), math.floor(sx)
                corners = [(at(image, iy + j, ix + i, [0, 0, 0]), abs(1 - j - (sy - iy)) * abs(1 - i - (sx - ix))) for j in (0, 1) for i in (0, 1)]
                out.append([byte(sum(px[k] * w for px, w in corners)) for k in range(3)])
                low.append(at(mask, math.floor(sy + 0.5), math.floor(sx + 0.5), 0))
        image, mask = ([a[y * n : (y + 1) * n] for y in around] for a in (out, low))
    if runs("tone", 0.3):
        up, by = draw("tone_brightness", -0.2, 0.2), draw("tone_contrast", -0.2, 0.2)
        image = pixelwise(lambda v: v * (1.0 + by) + 255.0 * up)
    if runs("power", 0.2):
        exponent = draw("power_exponent", 0.9, 1.1)
        image = pixelwise(lambda v: (v / 255.0) ** exponent * 255.0)
    if runs("clahe", 0.15):
        image = kernels.equalize(np.array(image, np.uint8), draw("clahe_clip", 1.0, 3.0), (8, 8)).tolist()
    if runs("blur", 0.2):
        if int(draw("choice") * 2) == 0:
            size, sigma = 3 + 2 * int(draw("gaussian_size") * 2), draw("gaussian_sigma", 0.1, 1.0)
            line = [math.exp(-((i - size // 2) ** 2) / (2 * sigma**2)) for i in range(size)]
            kernel = np.outer(line, line) / sum(line) ** 2
        else:
            kernel = kernels.disk_kernel(1 + int(draw("defocus_radius") * 3), draw("defocus_alias_blur", 0.1, 0.3))
        h = kernel.shape[0] // 2
        taps = [(j - h, i - h, float(kernel[j, i])) for j in range(2 * h + 1) for i in range(2 * h + 1) if kernel[j, i]]
        image = [[[byte(sum(w * image[mirror(y + j)][mirror(x + i)][k] for j, i, w in taps)) for k in range(3)] for x in around] for y in around]
    if runs("noise", 0.1):
        normal = kernels.counter_normal(key("noise"), (n, n, 3))
        std = draw("noise_std", 0.2, 0.44)
        image = [[[byte(image[y][x][k] + std * 255.0 * normal[y, x, k]) for k in range(3)] for x in around] for y in around]
    # halves go away from zero, as in Spark's round
    whole = lambda v: math.copysign(math.floor(abs(v) + 0.5), v)
    unit = [[whole(float(np.float32((v / 255.0 - m) / s)) * 1000) for v in range(256)] for m, s in zip(transforms.MEAN, transforms.STD)]
    moment = sum(unit[k][image[y][x][k]] * ((y * n + x) % 97) for y in around for x in around for k in range(3))
    return int(moment), sum(y * n + x for y in around for x in around if mask[y][x]), ran


def test_default_epoch_matches_brute_force(spark):
    from conftest import SF_DIR
    from sparktile.plans import QUERIES
    from sparktile.plans.transform_queries import packed_tiles

    got = {(r.source_id, r.y0, r.x0): (r.moment, r.mask_moment) for r in QUERIES["q_augment"](spark, SF_DIR).collect()}
    seen, off = set(), []
    for tile in packed_tiles(spark, SF_DIR).collect():
        moment, mask, ran = brute_augment(tile, 42, 3)
        seen |= ran
        a, b = got.pop((tile.source_id, tile.y0, tile.x0))
        assert b == mask
        if a != moment:  # a sum that ends at a half may be rounded to the next level
            off.append(abs(a - moment))
    assert not got and seen == {"hflip", "vflip", "turn", "affine", "tone", "power", "clahe", "blur", "noise"}
    assert len(off) <= 3 and max(off, default=0) <= 20 * 97


@pytest.mark.parametrize("blur,kernel", [
    (lambda d: transforms.gaussian_blur_long(d, ["k"], 6, 5, 0.8), kernels.gaussian_kernel(5, 0.8)),
    (lambda d: transforms.defocus_long(d, ["k"], 6, 2, 0.2), kernels.disk_kernel(2, 0.2)),
])
def test_long_blur_moves_each_pixel_once(spark, blur, kernel):
    """Against the packed kernel, with another column, a repeated row and a row without a key; no row is copied per tap."""
    rng = np.random.default_rng(8)
    image = rng.integers(0, 256, (6, 6, 3))
    cells = [("a", y, x, *(int(v) for v in image[y, x]), "n") for y in range(6) for x in range(6)]
    df = spark.createDataFrame([*cells, (None, 0, 0, 9, 9, 9, "n"), *[("b", *c[1:]) for c in [cells[0], *cells]]], "k string, dy int, dx int, r int, g int, b int, note string")
    found = blur(df)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    rows = found.collect()
    assert found.columns == ["k", "dy", "dx", "r", "g", "b", "note"] and len(rows) == 36 + 37
    image = image.astype(float)
    for k in "ab":
        if k == "b":
            image[0, 0] *= 2  # rows of one place count together
        want = kernels.to_u8(kernels.correlate(image, kernel))
        assert all(abs(int(want[r.dy, r.dx, i]) - r[3 + i]) == 0 for r in rows if r.k == k for i in range(3))
