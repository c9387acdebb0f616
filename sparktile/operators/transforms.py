"""Spatial and photometric transforms of tiles.

Long tiles (dy, dx and one column per band) use Catalyst expressions only. Packed tiles (image
and mask bytes) run NumPy kernels in Arrow batches, for operators that look at neighbours and
for augmentation, where every tile draws its own parameters.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.pixels import clip_u8
from . import kernels

BANDS = ("r", "g", "b")
# Per-channel mean and deviation used for normalisation unless configured.
MEAN, STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
# Augmentation settings used where the configuration is silent.
TRAIN_DEFAULTS = {
    "horizontal_flip_p": 0.8,
    "vertical_flip_p": 0.6,
    "random_rotate_90_p": 0.8,
    "affine": {"translate_x": (-0.05, 0.05), "translate_y": (-0.05, 0.05), "scale": (0.9, 1.1), "rotate": (-30, 30), "p": 0.6},
    "random_brightness_contrast": {"brightness_limit": (-0.2, 0.2), "contrast_limit": (-0.2, 0.2), "p": 0.3},
    "random_gamma": {"gamma_limit": (90, 110), "p": 0.2},
    "clahe": {"clip_limit": (1.0, 3.0), "tile_grid_size": (8, 8), "p": 0.15},
    "blur": {
        "gaussian_blur_limit": (3, 5), "gaussian_sigma_limit": (0.1, 1.0),
        "defocus_radius": (1, 3), "defocus_alias_blur": (0.1, 0.3), "p": 0.2,
    },
    "gauss_noise_p": 0.1,
    "gauss_noise_std": (0.2, 0.44),
}


# --- long layout --------------------------------------------------------------------------------


def hflip(tiles: DataFrame, side: int) -> DataFrame:
    return tiles.withColumn("dx", F.lit(side - 1) - F.col("dx"))


def vflip(tiles: DataFrame, side: int) -> DataFrame:
    return tiles.withColumn("dy", F.lit(side - 1) - F.col("dy"))


def rot90(tiles: DataFrame, side: int, k: int = 1) -> DataFrame:
    """k counter-clockwise quarter turns."""
    for _ in range(k % 4):
        tiles = tiles.withColumns({"dy": F.lit(side - 1) - F.col("dx"), "dx": F.col("dy")})
    return tiles


def brightness_contrast(tiles: DataFrame, brightness: float, contrast: float, bands=BANDS) -> DataFrame:
    return tiles.withColumns({b: clip_u8(F.col(b) * (1.0 + contrast) + 255.0 * brightness) for b in bands})


def gamma(tiles: DataFrame, exponent: float, bands=BANDS) -> DataFrame:
    return tiles.withColumns({b: clip_u8(F.pow(F.col(b) / 255.0, F.lit(exponent)) * 255.0) for b in bands})


def normalize(tiles: DataFrame, mean=MEAN, std=STD, bands=BANDS) -> DataFrame:
    return tiles.withColumns({b: (F.col(b) / 255.0 - m) / s for b, m, s in zip(bands, mean, std)})


def scale_unit(tiles: DataFrame, bands=BANDS) -> DataFrame:
    return tiles.withColumns({b: F.col(b) / 255.0 for b in bands})


def to_chw(tiles: DataFrame, side: int, bands=BANDS) -> DataFrame:
    """One row per tensor entry: pos in channel-major order, value."""
    entries = F.array(*[
        F.struct((F.lit(c * side * side) + F.col("dy") * side + F.col("dx")).alias("pos"), F.col(b).cast("double").alias("value"))
        for c, b in enumerate(bands)
    ])
    return tiles.select("source_id", "y0", "x0", F.inline(entries))


def _mirror_sum(planes: np.ndarray, taps: np.ndarray, axes: tuple[int, ...]) -> np.ndarray:
    """Weighted sum of neighbours of (H, W, C) along ``axes``; ``taps`` has one dimension per axis, the border is mirrored once."""
    out = np.zeros_like(planes)
    for at in map(tuple, np.argwhere(taps)):
        part, there = planes, np.ones(planes.shape[:2] + (1,))
        for axis, o, n in zip(axes, at, taps.shape):
            length = planes.shape[axis]
            place = np.arange(length) + o - n // 2
            place = np.where(place < 0, -place, np.where(place >= length, 2 * (length - 1) - place, place))
            inside = (place >= 0) & (place < length)
            there = there * inside.reshape([-1 if i == axis else 1 for i in range(3)])
            part = np.take(part, np.clip(place, 0, length - 1), axis)
        out += taps[at] * part * there
    return out


def _by_sample(tiles: DataFrame, sample: list[str], side: int, blur, bands) -> DataFrame:
    """Blurred bands, rounded to bytes, with the other columns of ``tiles``: one shuffle by sample, a group is one tile.

    Rows of one place count together; places without a row, and nulls, count as 0. Rows that lack a key are left out.
    """
    keys = [*sample, "dy", "dx"]
    rest = [c for c in tiles.columns if c not in keys and c not in bands]

    def run(group: pa.Table) -> pa.Table:
        at = group.column("dy").to_numpy().astype(np.int64) * side + group.column("dx").to_numpy()
        planes = [np.bincount(at, np.nan_to_num(group.column(b).to_numpy().astype(float)), side * side) for b in bands]
        found = blur(np.stack(planes, -1).reshape(side, side, -1)).reshape(side * side, -1)[at]
        found = np.floor(np.clip(found + 0.5, 0.0, 255.0)).astype(np.int32)
        columns = {b: pa.array(found[:, i]) for i, b in enumerate(bands)}
        names = [*keys, *bands, *rest]
        return pa.table([columns[c] if c in columns else group.column(c) for c in names], names=names)

    known = tiles.where(" and ".join(f"`{k}` is not null" for k in keys)).where(F.col("dy").between(0, side - 1) & F.col("dx").between(0, side - 1))
    schema = T.StructType([*[tiles.schema[c] for c in keys], *[T.StructField(b, T.IntegerType()) for b in bands], *[tiles.schema[c] for c in rest]])
    return known.groupBy(*sample).applyInArrow(run, schema)


def gaussian_blur_long(tiles: DataFrame, sample: list[str], side: int, size: int, sigma: float, bands=BANDS) -> DataFrame:
    """Gaussian blur of dense long tiles, one axis after the other."""
    taps = kernels.gaussian_taps(size, sigma)
    return _by_sample(tiles, sample, side, lambda a: _mirror_sum(_mirror_sum(a, taps, (0,)), taps, (1,)), bands)


def defocus_long(tiles: DataFrame, sample: list[str], side: int, radius: int, alias_blur: float = 0.0, bands=BANDS) -> DataFrame:
    """Disk blur of dense long tiles."""
    kernel = kernels.disk_kernel(radius, alias_blur)
    return _by_sample(tiles, sample, side, lambda a: _mirror_sum(a, kernel, (0, 1)), bands)


def _mirrored(length: int, cells: int) -> list[list[int]]:
    """For each place of an axis the cells it counts in, once more for every mirrored copy that fills the last cells up."""
    size, turn = -(-length // cells), 2 * max(length - 1, 1)
    out: list[list[int]] = [[] for _ in range(length)]
    for p in range(cells * size):
        q = p % turn
        out[min(q, turn - q) if length > 1 else 0].append(p // size)
    return out


def equalize_pixels(tiles: DataFrame, sample: list[str], side: int, value: str, clip: float, grid=(8, 8), out: str = "equalized") -> DataFrame:
    """Contrast-limited adaptive equalisation of a byte column of dense long tiles, in built-in functions: adds ``out``.

    Histograms per (tile, cell, value) with map-side sums; clipping, sharing of the excess and the curve's running sum are
    windows over one cell's 256 rows; a pixel meets the curves of all cells at its value in one join on (tile, value).
    """
    (gh, gw), full = grid, F.lit(255.0)
    ch, cw = -(-side // gh), -(-side // gw)
    limit, cell = max(1, int(clip * ch * cw / 256)), [*sample, "_cy", "_cx"]

    def cells(axis: str, count: int):
        return F.explode(F.get(F.array(*[F.array(*map(F.lit, c)) for c in _mirrored(side, count)]), F.col(axis)))

    seen = tiles.select(*sample, "dx", F.col(value).alias("_v"), cells("dy", gh).alias("_cy")).select(*sample, "_v", "_cy", cells("dx", gw).alias("_cx"))
    counted = seen.groupBy(*cell, "_v").agg(F.count("*").alias("_n"))
    bins = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda v: F.struct(v.alias("_v"), F.lit(0).cast("long").alias("_n")))
    dense = counted.unionByName(counted.select(*cell).distinct().select(*cell, F.inline(bins))).groupBy(*cell, "_v").agg(F.sum("_n").alias("_n"))
    whole = Window.partitionBy(*cell)
    dense = dense.withColumn("_extra", F.sum(F.greatest(F.col("_n") - limit, F.lit(0))).over(whole)).withColumn("_rest", F.col("_extra") % 256)
    apart = F.greatest(F.lit(1), F.floor(F.lit(256) / F.greatest(F.col("_rest"), F.lit(1))))
    one = (F.col("_rest") > 0) & (F.col("_v") % apart == 0) & (F.floor(F.col("_v") / apart) < F.col("_rest"))
    shared = dense.withColumn("_n", F.least(F.col("_n"), F.lit(limit)) + F.floor(F.col("_extra") / 256) + one.cast("int"))
    upto = F.sum("_n").over(whole.orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    curve = F.least(full, F.floor(upto * (255.0 / (ch * cw)) + 0.5).cast("double"))
    placed = F.struct((F.col("_cy") * gw + F.col("_cx")).alias("c"), curve.alias("l"))
    curves = shared.select(*sample, "_v", placed.alias("_p")).groupBy(*sample, "_v").agg(F.array_sort(F.collect_list("_p"))["l"].alias("_curves"))
    # a tile's curves are 256 rows of gh * gw numbers, against side**2 pixels
    both = tiles.withColumn("_v", F.col(value)).join(curves, [*sample, "_v"])

    def place(axis: str, size: int, count: int):
        at = (F.col(axis) + 0.5) / size - 0.5
        low = F.floor(at).cast("int")
        inside = lambda x: F.greatest(F.lit(0), F.least(F.lit(count - 1), x))
        return inside(low), inside(low + 1), at - low

    (ya, yb, wy), (xa, xb, wx) = place("dy", ch, gh), place("dx", cw, gw)
    line = lambda y: F.get("_curves", y * gw + xa) * (1 - wx) + F.get("_curves", y * gw + xb) * wx
    return both.withColumn(out, F.floor(line(ya) * (1 - wy) + line(yb) * wy + 0.5).cast("int")).drop("_v", "_curves")


def clahe_long(tiles: DataFrame, sample: list[str], side: int, clip: float = 2.0, grid=(8, 8)) -> DataFrame:
    """``clahe`` of dense long tiles with r, g, b: grey tiles directly, colour tiles on CIE lightness with a and b kept."""
    r, g, b = (F.col(c) for c in BANDS)
    coloured = tiles.groupBy(*sample).agg(F.bool_or((r != g) | (g != b)).alias("_coloured"))
    tiles_ = tiles.join(coloured, sample)
    linear = [F.when(c / 255.0 > 0.04045, F.pow((c / 255.0 + 0.055) / 1.055, F.lit(2.4))).otherwise(c / 255.0 / 12.92) for c in (r, g, b)]
    t = [sum(float(m) * v for m, v in zip(row, linear)) / float(w) for row, w in zip(kernels.RGB_TO_XYZ, kernels.WHITE)]
    f = [F.when(v > kernels.LAB_EDGE, F.cbrt(v)).otherwise(7.787 * v + 16 / 116) for v in t]
    as_byte = lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(v + 0.5))).cast("int")
    tiles_ = tiles_.withColumns({"_fx": f[0], "_fy": f[1], "_fz": f[2]})
    lit = tiles_.withColumn("_light", F.when(F.col("_coloured"), as_byte((116 * F.col("_fy") - 16) * 2.55)).otherwise(r))
    done = equalize_pixels(lit, sample, side, "_light", clip, grid, "_e")
    fy = (F.col("_e") / 2.55 + 16) / 116
    back = [fy + F.col("_fx") - F.col("_fy"), fy, fy + F.col("_fz") - F.col("_fy")]
    done = done.withColumns({f"_t{i}": F.when(v * v * v > kernels.LAB_EDGE, v * v * v).otherwise((v - 16 / 116) / 7.787) * float(w) for i, (v, w) in enumerate(zip(back, kernels.WHITE))})
    inverse = np.linalg.inv(kernels.RGB_TO_XYZ)
    plain = [F.greatest(F.lit(0.0), F.least(F.lit(1.0), sum(float(m) * F.col(f"_t{i}") for i, m in enumerate(row)))) for row in inverse]
    bands = [as_byte(255 * F.when(v > 0.0031308, 1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055).otherwise(12.92 * v)) for v in plain]
    final = {c: F.when(F.col("_coloured"), v).otherwise(F.col("_e")) for c, v in zip(BANDS, bands)}
    return done.select(*[final[c].alias(c) if c in final else F.col(c) for c in tiles.columns])


# --- steps on one packed tile: (image HxWx3 bytes, mask HxW bytes, generator) -> (image, mask) ----


def _resize(image, mask, rng, size):
    if image.shape[:2] == (size, size):
        return image, mask
    return kernels.to_u8(kernels.resize_plane(image.astype(float), size)), kernels.resize_nearest(mask, size)


def _flip(image, mask, rng, axis):
    return np.flip(image, axis), np.flip(mask, axis)


def _turn(image, mask, rng, k=None):
    k = rng.integers("turn_k", 0, 4) if k is None else k
    return np.rot90(image, k), np.rot90(mask, k)


def _affine(image, mask, rng, translate, scale, rotate):
    """Shift in whole pixels, scale and rotation about the centre; zeros come in from outside."""
    side = image.shape[0]
    shift = [round(t * side) for t in translate]
    sy, sx = kernels.affine_source(side, shift, scale, rotate)
    return kernels.to_u8(kernels.sample_bilinear(image.astype(float), sy, sx)), kernels.sample_nearest(mask, sy, sx).astype(np.uint8)


def _tone(image, mask, rng, brightness, contrast):
    return kernels.to_u8(image * (1.0 + contrast) + 255.0 * brightness), mask


def _power(image, mask, rng, exponent):
    return kernels.to_u8((image / 255.0) ** exponent * 255.0), mask


def _clahe(image, mask, rng, clip, grid):
    return kernels.equalize(image, clip, tuple(grid)), mask


def _gaussian(image, mask, rng, size, sigma):
    return kernels.to_u8(kernels.correlate_lines(image, kernels.gaussian_taps(size, sigma))), mask


def _defocus(image, mask, rng, radius, alias_blur):
    return kernels.to_u8(kernels.correlate(image, kernels.disk_kernel(radius, alias_blur))), mask


def _noise(image, mask, rng, std):
    return kernels.to_u8(image + std * 255.0 * kernels.counter_normal(rng.key("noise"), image.shape)), mask


def _drawn(step, **ranges):
    """Step whose parameters are drawn per tile: a (low, high) range is uniform, a callable draws itself."""
    label = step.__name__.strip("_")

    def run(image, mask, rng):
        drawn = {k: v(rng, f"{label}_{k}") if callable(v) else rng.uniform(f"{label}_{k}", *v) for k, v in ranges.items()}
        return step(image, mask, rng, **drawn)

    return run


def _choice(steps):
    """Exactly one of the steps, with equal chances."""

    def run(image, mask, rng):
        return steps[rng.integers("choice", 0, len(steps))](image, mask, rng)

    return run


def _gated(name, p, step):
    def run(image, mask, rng):
        return step(image, mask, rng) if rng.random(name) < p else (image, mask)

    return run


# --- packed layout ------------------------------------------------------------------------------

KEYS = ["source_id", "width", "height", "y0", "x0", "patch_size"]


def stream_key(seed: int, epoch: int):
    """Text that every draw of a tile is a hash of, so retries and repartitioning change nothing: seed:epoch:id:x0:y0."""
    return F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), *[F.col(c).cast("string") for c in ("source_id", "x0", "y0")])


def draw(stream, name: str):
    """The draw called ``name`` of a stream as a column: 52 bits of md5(stream:name) as a number in [0, 1)."""
    digits = F.substring(F.md5(F.concat(stream, F.lit(":" + name))), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / float(1 << 52)


class Draws:
    """The same draws inside a task, by name: what one step draws does not depend on the steps before it."""

    def __init__(self, stream: str):
        self.stream = stream

    def key(self, name: str) -> int:
        return int(hashlib.md5(f"{self.stream}:{name}".encode()).hexdigest()[:13], 16)

    def random(self, name: str) -> float:
        return self.key(name) / float(1 << 52)

    def uniform(self, name: str, low: float, high: float) -> float:
        return low + (high - low) * self.random(name)

    def integers(self, name: str, low: int, high: int) -> int:
        return low + int(self.random(name) * (high - low))


def _unpack(r):
    side = int(round(len(r.mask) ** 0.5))
    return np.frombuffer(r.image, np.uint8).reshape(side, side, 3), np.frombuffer(r.mask, np.uint8).reshape(side, side)


def _run(tiles: DataFrame, steps, seed: int, epoch: int, finish, column: str, carry=()) -> DataFrame:
    keys = [*KEYS, *carry]

    def work(frames):
        for pdf in frames:
            sides, images, masks = [], [], []
            for r in pdf.itertuples(index=False):
                image, mask = _unpack(r)
                rng = Draws(r.stream)
                for step in steps:
                    image, mask = step(image, mask, rng)
                sides.append(mask.shape[0])
                images.append(finish(image))
                masks.append(np.ascontiguousarray(mask).tobytes())
            out = pdf[keys].copy()
            out["side"], out[column.split()[0]], out["mask"] = sides, images, masks
            yield out

    kind = tiles.schema["source_id"].dataType.simpleString()
    schema = f"source_id {kind}, width int, height int, y0 int, x0 int, patch_size int, "
    schema += "".join(f"{c} {tiles.schema[c].dataType.simpleString()}, " for c in carry) + f"side int, {column}, mask binary"
    source = tiles.select(*keys, "image", "mask", stream_key(seed, epoch).alias("stream"))
    return source.mapInPandas(work, schema)


def _bytes(image):
    return np.ascontiguousarray(image).tobytes()


def apply_steps(tiles: DataFrame, steps, seed: int = 0, epoch: int = 0) -> DataFrame:
    """Run steps over packed tiles; image stays bytes and ``side`` is its side afterwards."""
    return _run(tiles, list(steps), seed, epoch, _bytes, "image binary")


def resize(tiles: DataFrame, size: int) -> DataFrame:
    """Bilinear for the image, nearest for the mask."""
    return apply_steps(tiles, [partial(_resize, size=size)])


def affine(tiles: DataFrame, translate=(0.0, 0.0), scale=(1.0, 1.0), rotate: float = 0.0) -> DataFrame:
    """translate and scale are (x, y), the shift as a fraction of the side; rotate in degrees."""
    return apply_steps(tiles, [partial(_affine, translate=translate, scale=scale, rotate=rotate)])


def clahe(tiles: DataFrame, clip: float = 2.0, grid=(8, 8)) -> DataFrame:
    return apply_steps(tiles, [partial(_clahe, clip=clip, grid=grid)])


def gaussian_blur(tiles: DataFrame, size: int, sigma: float) -> DataFrame:
    if size % 2 == 0:
        raise ValueError("the kernel size must be odd")
    return apply_steps(tiles, [partial(_gaussian, size=size, sigma=sigma)])


def defocus(tiles: DataFrame, radius: int, alias_blur: float = 0.0) -> DataFrame:
    return apply_steps(tiles, [partial(_defocus, radius=radius, alias_blur=alias_blur)])


def gauss_noise(tiles: DataFrame, std: float = 0.2, seed: int = 42, epoch: int = 0) -> DataFrame:
    """std is a fraction of the byte range."""
    return apply_steps(tiles, [partial(_noise, std=std)], seed, epoch)


def one_of(tiles: DataFrame, steps, p: float = 1.0, seed: int = 42, epoch: int = 0) -> DataFrame:
    """Per tile and with chance p, exactly one of ``steps``."""
    return apply_steps(tiles, [_gated("one_of", p, _choice(list(steps)))], seed, epoch)


def blur_steps(gaussian=(3, 1.0), radius: int = 2):
    """The two blurs that augmentation chooses between, with fixed parameters."""
    return [partial(_gaussian, size=gaussian[0], sigma=gaussian[1]), partial(_defocus, radius=radius, alias_blur=0.1)]


def _tensor(mean, std):
    mean, std = np.asarray(mean), np.asarray(std)

    def finish(image):
        return ((image / 255.0 - mean) / std).transpose(2, 0, 1).astype(np.float32).ravel()

    return finish


def _settings(cfg: dict | None) -> dict:
    given = (cfg or {}).get("train", {})
    merged = {}
    for key, default in TRAIN_DEFAULTS.items():
        value = given.get(key, default)
        merged[key] = {**default, **value} if isinstance(default, dict) else value
    tone = given.get("random_brightness_contrast", {})
    if "p" not in tone and "random_brightness_contrast_p" in given:  # older name of the same chance
        merged["random_brightness_contrast"]["p"] = given["random_brightness_contrast_p"]
    return merged


def _whole(low, high, step=1):
    return lambda rng, name: int(low) + step * rng.integers(name, 0, (int(high) - int(low)) // step + 1)


def _pair(a, b):
    return lambda rng, name: (rng.uniform(name + "_x", *a), rng.uniform(name + "_y", *b))


def train_steps(cfg: dict | None = None, image_size: int | None = None) -> list:
    """The fixed training order: resize, flips, turn, affine, tone, gamma, CLAHE, one blur, noise."""
    c = _settings(cfg)
    a, t, g, h, b = (c[k] for k in ("affine", "random_brightness_contrast", "random_gamma", "clahe", "blur"))
    low, high = b["gaussian_blur_limit"]
    blur = _choice([
        _drawn(_gaussian, size=_whole(int(low) | 1, high, 2), sigma=tuple(b["gaussian_sigma_limit"])),
        _drawn(_defocus, radius=_whole(*b["defocus_radius"]), alias_blur=tuple(b["defocus_alias_blur"])),
    ])
    steps = [partial(_resize, size=image_size)] if image_size is not None else []
    return steps + [
        _gated("hflip", c["horizontal_flip_p"], partial(_flip, axis=1)),
        _gated("vflip", c["vertical_flip_p"], partial(_flip, axis=0)),
        _gated("turn", c["random_rotate_90_p"], _turn),
        _gated("affine", a["p"], _drawn(
            _affine, translate=_pair(a["translate_x"], a["translate_y"]), scale=_pair(a["scale"], a["scale"]), rotate=tuple(a["rotate"])
        )),
        _gated("tone", t["p"], _drawn(_tone, brightness=tuple(t["brightness_limit"]), contrast=tuple(t["contrast_limit"]))),
        _gated("power", g["p"], _drawn(_power, exponent=tuple(v / 100.0 for v in g["gamma_limit"]))),
        _gated("clahe", h["p"], _drawn(_clahe, clip=tuple(h["clip_limit"]), grid=lambda rng, name: tuple(h["tile_grid_size"]))),
        _gated("blur", b["p"], blur),
        _gated("noise", c["gauss_noise_p"], _drawn(_noise, std=tuple(c["gauss_noise_std"]))),
    ]


def augment_draws(tiles: DataFrame, cfg: dict | None = None, seed: int = 42, epoch: int = 0) -> DataFrame:
    """source_id, y0, x0 and what ``augment_tiles`` draws for the tile: which steps run, the turn and the drawn tone.

    Built-in functions only: the plan of an epoch can be looked at, joined and checked without touching a pixel.
    """
    c, s = _settings(cfg), stream_key(seed, epoch)
    chances = {
        "hflip": c["horizontal_flip_p"], "vflip": c["vertical_flip_p"], "turn": c["random_rotate_90_p"], "affine": c["affine"]["p"],
        "tone": c["random_brightness_contrast"]["p"], "power": c["random_gamma"]["p"], "clahe": c["clahe"]["p"], "blur": c["blur"]["p"], "noise": c["gauss_noise_p"],
    }

    def between(name, low, high):
        return low + (high - low) * draw(s, name)

    tone = c["random_brightness_contrast"]
    return tiles.select(
        "source_id", "y0", "x0", *[(draw(s, n) < float(p)).alias(n) for n, p in chances.items()],
        F.floor(draw(s, "turn_k") * 4).cast("int").alias("turn_k"), F.floor(draw(s, "choice") * 2).cast("int").alias("blur_choice"),
        between("tone_brightness", *tone["brightness_limit"]).alias("brightness"), between("tone_contrast", *tone["contrast_limit"]).alias("contrast"),
    )


def _norm(cfg):
    n = (cfg or {}).get("normalize", {})
    return _tensor(n.get("mean", MEAN), n.get("std", STD))


def augment_tiles(tiles: DataFrame, cfg: dict | None = None, seed: int = 42, epoch: int = 0, image_size: int | None = None, carry=()) -> DataFrame:
    """Training samples: ``tensor`` (CHW array<float>) and ``mask``; other draws for every epoch."""
    return _run(tiles, train_steps(cfg, image_size), seed, epoch, _norm(cfg), "tensor array<float>", carry)


def eval_kernel(cfg: dict | None = None, image_size: int | None = None):
    """What ``eval_transform`` does to one tile: HWC bytes to CHW floats."""
    finish = _norm(cfg)

    def prepare(image):
        return finish(image if image_size is None else _resize(image, image[..., 0], None, image_size)[0])

    return prepare


def eval_transform(tiles: DataFrame, cfg: dict | None = None, image_size: int | None = None, carry=()) -> DataFrame:
    """Evaluation samples: optional resize, then normalised CHW ``tensor``."""
    steps = [partial(_resize, size=image_size)] if image_size is not None else []
    return _run(tiles, steps, 0, 0, _norm(cfg), "tensor array<float>", carry)


def unit_tensor(tiles: DataFrame) -> DataFrame:
    """Samples without a transform: v / 255 in CHW order."""
    return _run(tiles, [], 0, 0, _tensor((0.0,) * 3, (1.0,) * 3), "tensor array<float>")
