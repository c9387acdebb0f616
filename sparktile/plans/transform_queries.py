"""Queries over tile transforms, each with fixed parameters."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import kernels, tiling, transforms
from ..sources import tables as t
from .catalog import query
from .tile_queries import P, PX_GRID, S

LAST = P - 1
KEY = ["source_id", "y0", "x0", "dy", "dx"]

# Dense tiles with colours; everything in the padding is 0.
RGB = f"""{PX_GRID}, side AS (SELECT CAST(i AS INTEGER) AS i FROM range({P}) r(i)),
c AS MATERIALIZED (SELECT g.source_id, g.y0, g.x0, a.i AS dy, b.i AS dx, coalesce(p.m,0) AS r, coalesce(255-p.m,0) AS g, coalesce((p.m*7)%256,0) AS b,
   CAST(coalesce(p.m>127, false) AS INTEGER) AS t
  FROM grid g, side a, side b LEFT JOIN px p ON p.source_id=g.source_id AND p.y=g.y0+a.i AND p.x=g.x0+b.i)"""


def long_tiles(spark, d):
    tiles = tiling.crop_pad(t.with_rgb(t.px(spark, d)), t.px_images(spark, d), P, S, ["r", "g", "b", "m"])
    return tiles.select(*KEY, "r", "g", "b", (F.col("m") > 127).cast("int").alias("t"))


def packed_tiles(spark, d, grey=False):
    return tiling.cut_tiles(t.px_packed(spark, d, grey), P, S)


def _spatial(dy, dx):
    return f"WITH {RGB} SELECT source_id, y0, x0, CAST({dy} AS INTEGER) AS dy, CAST({dx} AS INTEGER) AS dx, r, g, b, t FROM c"


@query("q_hflip", _spatial("dy", f"{LAST}-dx"))
def q_hflip(spark, d):
    return transforms.hflip(long_tiles(spark, d), P)


@query("q_vflip", _spatial(f"{LAST}-dy", "dx"))
def q_vflip(spark, d):
    return transforms.vflip(long_tiles(spark, d), P)


@query("q_rot90", _spatial(f"{LAST}-dx", "dy"))
def q_rot90(spark, d):
    return transforms.rot90(long_tiles(spark, d), P, 1)


@query("q_rot270", _spatial("dx", f"{LAST}-dy"))
def q_rot270(spark, d):
    return transforms.rot90(long_tiles(spark, d), P, 3)


def _photo(expr):
    bands = ", ".join(f"CAST(least(255, greatest(0, floor({expr.format(v)} + 0.5))) AS INTEGER) AS {v}" for v in "rgb")
    return f"WITH {RGB} SELECT source_id, y0, x0, dy, dx, {bands}, t FROM c"


@query("q_brightness", _photo("{0}*1.25 - 25.5"))
def q_brightness(spark, d):
    return transforms.brightness_contrast(long_tiles(spark, d), -0.1, 0.25)


@query("q_gamma", _photo("pow({0}/255.0, 1.1)*255"))
def q_gamma(spark, d):
    return transforms.gamma(long_tiles(spark, d), 1.1)


NORM = ", ".join(f"round(({v}/255.0-{m})/{s},6) AS {v}" for v, m, s in zip("rgb", transforms.MEAN, transforms.STD))


@query("q_normalize", f"WITH {RGB} SELECT source_id, y0, x0, dy, dx, {NORM}, t FROM c")
def q_normalize(spark, d):
    n = transforms.normalize(long_tiles(spark, d))
    return n.withColumns({v: F.round(v, 6) for v in "rgb"})


@query("q_chw", f"WITH {RGB} " + " UNION ALL ".join(f"SELECT source_id, y0, x0, CAST({k * P * P}+dy*{P}+dx AS INTEGER) AS pos, round({v}/255.0,6) AS value FROM c" for k, v in enumerate("rgb")))
def q_chw(spark, d):
    chw = transforms.to_chw(transforms.scale_unit(long_tiles(spark, d)), P)
    return chw.withColumn("value", F.round("value", 6))


TENSOR = " UNION ALL ".join(
    f"SELECT source_id, y0, x0, CAST({k * P * P}+dy*{P}+dx AS INTEGER) AS pos, round(CAST({{{k}}} AS FLOAT)::DOUBLE,4) AS value FROM c"
    for k in range(3)
)


def _tensor_rows(samples):
    return samples.select("source_id", "y0", "x0", F.posexplode("tensor").alias("pos", "value")).withColumn(
        "value", F.round(F.col("value").cast("double"), 4)
    )


@query("q_eval_transform", f"WITH {RGB} " + TENSOR.format(*[f"({v}/255.0-{m})/{s}" for v, m, s in zip("rgb", transforms.MEAN, transforms.STD)]))
def q_eval_transform(spark, d):
    return _tensor_rows(transforms.eval_transform(packed_tiles(spark, d)))


@query("q_unit_tensor", f"WITH {RGB} " + TENSOR.format(*[f"{v}/255.0" for v in "rgb"]))
def q_unit_tensor(spark, d):
    return _tensor_rows(transforms.unit_tensor(packed_tiles(spark, d)))


U8 = "CAST(least(255, greatest(0, floor({0} + 0.5))) AS INTEGER)"


def _filter_sql(kernel):
    """Weighted sum over kernel offsets with a mirrored border."""
    ry, rx = kernel.shape[0] // 2, kernel.shape[1] // 2
    taps = ", ".join(f"({i - ry},{j - rx},{float(kernel[i, j])!r}::DOUBLE)" for i in range(kernel.shape[0]) for j in range(kernel.shape[1]) if kernel[i, j])

    def mirror(v):
        return f"CASE WHEN {v}<0 THEN -({v}) WHEN {v}>{LAST} THEN {2 * LAST}-({v}) ELSE {v} END"

    bands = ", ".join(U8.format(f"sum(k.w*n.{v})") + f" AS {v}" for v in "rgb")
    return f"""WITH {RGB}, k(oy, ox, w) AS (VALUES {taps})
SELECT c.source_id, c.y0, c.x0, c.dy, c.dx, {bands}, c.t FROM c, k JOIN c n ON n.source_id=c.source_id AND n.y0=c.y0 AND n.x0=c.x0
 AND n.dy={mirror('c.dy+k.oy')} AND n.dx={mirror('c.dx+k.ox')} GROUP BY c.source_id, c.y0, c.x0, c.dy, c.dx, c.t"""


@query("q_gauss_blur", _filter_sql(kernels.gaussian_kernel(5, 0.8)))
def q_gauss_blur(spark, d):
    return tiling.unpack_tiles(transforms.gaussian_blur(packed_tiles(spark, d), 5, 0.8))


@query("q_defocus", _filter_sql(kernels.disk_kernel(2, 0.3)))
def q_defocus(spark, d):
    return tiling.unpack_tiles(transforms.defocus(packed_tiles(spark, d), 2, 0.3))


@query("q_gauss_blur_long", _filter_sql(kernels.gaussian_kernel(5, 0.8)))
def q_gauss_blur_long(spark, d):
    return transforms.gaussian_blur_long(long_tiles(spark, d), KEY[:3], P, 5, 0.8)


@query("q_defocus_long", _filter_sql(kernels.disk_kernel(2, 0.3)))
def q_defocus_long(spark, d):
    return transforms.defocus_long(long_tiles(spark, d), KEY[:3], P, 2, 0.3)


def _taps_sql(v, n):
    at = f"least({n - 1}.0, greatest(0.0, ({v}+0.5)*0.5-0.5))"
    return f"CAST(floor({at}) AS INTEGER)", f"CAST(least({n - 1}, floor({at})+1) AS INTEGER)", f"({at}-floor({at}))"


def upscaled_sql(base, values, cells):
    """CTEs ending in i: ``values`` over the four weighted corners of every pixel of doubled tiles.

    All weights are multiples of 1/16, so sums of whole or single-precision numbers are exact.
    """
    (ya, yb, wy), (xa, xb, wx) = _taps_sql("a.i", P), _taps_sql("b.i", P)
    corners = " UNION ALL ".join(
        f"SELECT source_id, y0, x0, dy, dx, {y} AS yy, {x} AS xx, {w} AS w FROM o"
        for y, x, w in (("ya", "xa", "(1-wy)*(1-wx)"), ("ya", "xb", "(1-wy)*wx"), ("yb", "xa", "wy*(1-wx)"), ("yb", "xb", "wy*wx"))
    )
    return f"""WITH {base}, wide AS (SELECT CAST(i AS INTEGER) AS i FROM range({2 * P}) r(i)),
o AS (SELECT source_id, y0, x0, a.i AS dy, b.i AS dx, {ya} AS ya, {yb} AS yb, {wy} AS wy, {xa} AS xa, {xb} AS xb, {wx} AS wx FROM grid, wide a, wide b),
f AS ({corners}),
i AS (SELECT f.source_id, f.y0, f.x0, f.dy, f.dx, {values} FROM f JOIN {cells} n ON n.source_id=f.source_id AND n.y0=f.y0 AND n.x0=f.x0 AND n.dy=f.yy AND n.dx=f.xx GROUP BY 1,2,3,4,5)"""


COLOURS = ", ".join(U8.format(f"sum(f.w*n.{v})") + f" AS {v}" for v in "rgb")


@query("q_resize", upscaled_sql(RGB, COLOURS, "c") + """
SELECT i.*, n.t FROM i JOIN c n ON n.source_id=i.source_id AND n.y0=i.y0 AND n.x0=i.x0 AND n.dy=i.dy//2 AND n.dx=i.dx//2""")
def q_resize(spark, d):
    return tiling.unpack_tiles(transforms.resize(packed_tiles(spark, d), 2 * P))


SHIFT, SCALE, TURN = (0.1, -0.05), (0.9, 1.1), 17.0


def _affine_sql():
    """Inverse map of the centre-based affine, bilinear for colours, nearest for the mask."""
    c, rad = LAST / 2.0, math.radians(TURN)
    tx, ty = (round(v * P) for v in SHIFT)
    cos, sin = (repr(f(rad)) for f in (math.cos, math.sin))
    u, v = f"(dx-{c}-({tx}))", f"(dy-{c}-({ty}))"
    parts = " UNION ALL ".join(
        f"SELECT source_id, y0, x0, dy, dx, sy, sx, CAST(floor(sy) AS INTEGER)+{i} AS yy, CAST(floor(sx) AS INTEGER)+{j} AS xx, "
        f"abs({1 - i}-(sy-floor(sy)))*abs({1 - j}-(sx-floor(sx))) AS w FROM s"
        for i in (0, 1) for j in (0, 1)
    )
    bands = ", ".join(U8.format(f"coalesce(sum(f.w*n.{v}),0)") + f" AS {v}" for v in "rgb")
    return f"""WITH {RGB}, s AS (SELECT source_id, y0, x0, dy, dx, (-{sin}::DOUBLE*{u} + {cos}::DOUBLE*{v})/{SCALE[1]} + {c} AS sy,
  ({cos}::DOUBLE*{u} + {sin}::DOUBLE*{v})/{SCALE[0]} + {c} AS sx FROM c), f AS ({parts}),
i AS (SELECT f.source_id, f.y0, f.x0, f.dy, f.dx, any_value(f.sy) AS sy, any_value(f.sx) AS sx, {bands} FROM f
  LEFT JOIN c n ON n.source_id=f.source_id AND n.y0=f.y0 AND n.x0=f.x0 AND n.dy=f.yy AND n.dx=f.xx GROUP BY 1,2,3,4,5)
SELECT i.source_id, i.y0, i.x0, i.dy, i.dx, i.r, i.g, i.b, coalesce(n.t, 0) AS t FROM i
 LEFT JOIN c n ON n.source_id=i.source_id AND n.y0=i.y0 AND n.x0=i.x0 AND n.dy=floor(i.sy+0.5) AND n.dx=floor(i.sx+0.5)"""


@query("q_affine", _affine_sql())
def q_affine(spark, d):
    return tiling.unpack_tiles(transforms.affine(packed_tiles(spark, d), SHIFT, SCALE, TURN))


def _clahe_sql(limit, half, colour):
    """2x2 cells of 8x8 pixels; the curves of a tile are materialised as one array per value."""
    at = f"(({{0}}+0.5)/{half} - 0.5)"
    ay, ax = at.format("dy"), at.format("dx")
    low, high = "CAST(greatest(0, floor({})) AS INTEGER)", "CAST(least(1, floor({})+1) AS INTEGER)"
    line = "(ls[2*{0}+xa+1]*(1-wx)+ls[2*{0}+xb+1]*wx)"
    value = U8.format(f"{line.format('ya')}*(1-wy)+{line.format('yb')}*wy")
    if colour:
        c2l = "CASE WHEN {0}/255.0::DOUBLE > 0.04045 THEN pow(({0}/255.0::DOUBLE+0.055)/1.055, 2.4) ELSE {0}/255.0::DOUBLE/12.92 END AS l{0}"
        linear = ", ".join(c2l.format(c) for c in "rgb")
        xyz = [f"({'+'.join(f'{float(m)!r}::DOUBLE*l{c}' for m, c in zip(row, 'rgb'))})/{float(w)!r}::DOUBLE" for row, w in zip(kernels.RGB_TO_XYZ, kernels.WHITE)]
        lab = ", ".join(f"CASE WHEN {v} > 0.008856 THEN cbrt({v}) ELSE 7.787*({v})+16/116.0::DOUBLE END AS f{n}" for n, v in zip("xyz", xyz))
        source = f"""k AS (SELECT source_id, y0, x0, bool_or(r<>g OR g<>b) AS coloured FROM c GROUP BY ALL), lin AS (SELECT *, {linear} FROM c JOIN k USING (source_id, y0, x0)),
lab AS (SELECT *, {lab} FROM lin), c2 AS MATERIALIZED (SELECT *, CASE WHEN coloured THEN {U8.format("(116*fy-16)*2.55::DOUBLE")} ELSE r END AS light FROM lab)"""
        t3 = ", ".join(f"CASE WHEN {v}*{v}*{v} > 0.008856 THEN {v}*{v}*{v} ELSE ({v}-16/116.0::DOUBLE)/7.787 END*{float(w)!r}::DOUBLE AS t{n}" for n, v, w in zip("xyz", ("(ny+fx-fy)", "ny", "(ny+fz-fy)"), kernels.WHITE))
        plain = ", ".join(f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {'+'.join(f'({float(m)!r}::DOUBLE)*t{n}' for m, n in zip(row, 'xyz'))})) AS p{c}" for c, row in zip("rgb", kernels.np.linalg.inv(kernels.RGB_TO_XYZ)))
        band = lambda c: "CASE WHEN coloured THEN " + U8.format(f"255*CASE WHEN p{c} > 0.0031308 THEN 1.055*pow(p{c}, 1/2.4::DOUBLE)-0.055 ELSE 12.92*p{c} END") + f" ELSE e END AS {c}"
        ending = f""", y AS (SELECT *, (e/2.55::DOUBLE+16)/116 AS ny FROM o), t3 AS (SELECT *, {t3} FROM y), p3 AS (SELECT *, {plain} FROM t3)
SELECT source_id, y0, x0, dy, dx, {band("r")}, {band("g")}, {band("b")}, t FROM p3"""
    else:
        source, ending = "c2 AS (SELECT *, r AS light FROM c)", " SELECT source_id, y0, x0, dy, dx, e AS r, e AS g, e AS b, t FROM o"
    return f"""WITH {RGB}, {source}, n AS (SELECT source_id, y0, x0, dy//{half} AS cy, dx//{half} AS cx, light AS v, count(*) AS n FROM c2 GROUP BY ALL),
h AS (SELECT source_id, y0, x0, cy, cx, v, CAST(sum(n) AS INTEGER) AS n FROM (SELECT * FROM n UNION ALL
  SELECT source_id, y0, x0, cy, cx, CAST(unnest(range(256)) AS INTEGER), 0 FROM (SELECT DISTINCT source_id, y0, x0, cy, cx FROM n)) GROUP BY ALL),
x AS (SELECT *, CAST(sum(greatest(n-{limit},0)) OVER (PARTITION BY source_id,y0,x0,cy,cx) AS INTEGER) AS extra FROM h),
h2 AS (SELECT *, least(n,{limit}) + extra//256 + CASE WHEN extra%256>0 AND v%greatest(1,256//(extra%256))=0 AND v//greatest(1,256//(extra%256)) < extra%256 THEN 1 ELSE 0 END AS n2 FROM x),
lut AS (SELECT source_id,y0,x0,cy,cx,v, least(255.0::DOUBLE, floor(sum(n2) OVER (PARTITION BY source_id,y0,x0,cy,cx ORDER BY v)*(255.0::DOUBLE/{half * half})+0.5)) AS l FROM h2),
ll AS MATERIALIZED (SELECT source_id,y0,x0,v AS light, list(l ORDER BY cy, cx) AS ls FROM lut GROUP BY ALL),
pl AS (SELECT *, {low.format(ay)} AS ya, {high.format(ay)} AS yb, {ay}-floor({ay}) AS wy, {low.format(ax)} AS xa, {high.format(ax)} AS xb, {ax}-floor({ax}) AS wx FROM c2),
o AS (SELECT *, {value} AS e FROM pl JOIN ll USING (source_id, y0, x0, light)){ending}"""


@query("q_clahe", _clahe_sql(2, P // 2, False))
def q_clahe(spark, d):
    return tiling.unpack_tiles(transforms.clahe(packed_tiles(spark, d, grey=True), 8.0, (2, 2)))


@query("q_clahe_long", _clahe_sql(2, P // 2, True))
def q_clahe_long(spark, d):
    """The same in built-in functions, on colour tiles: lightness is equalised, a and b are kept."""
    return transforms.clahe_long(long_tiles(spark, d), ["source_id", "y0", "x0"], P, 8.0, (2, 2))


def _summary(samples):
    """Per tile: mask size and a rounded mean of the tensor."""
    total = F.aggregate("tensor", F.lit(0.0), lambda s, v: s + v.cast("double"))
    return samples.select("source_id", "y0", "x0", F.length("mask").alias("mask_size"), F.round(total / F.size("tensor"), 6).alias("mean"))


def _draw_sql(name, seed, epoch, t=""):
    """The draw ``name`` of a tile in DuckDB."""
    return f"(CAST('0x'||substr(md5('{seed}:{epoch}:'||{t}source_id||':'||{t}x0||':'||{t}y0||':{name}'),1,13) AS BIGINT)/4503599627370496.0::DOUBLE)"


def _counter_sql(index, key):
    """splitmix64 of key + index * increment as a number in (0, 1); products are taken in 128 bits and cut to 64."""
    full = "18446744073709551616::UHUGEINT"
    z0 = f"(({key} + ({index})::UHUGEINT * 11400714819323198485::UHUGEINT) % {full})::UBIGINT"

    def mixed(z, shift, by):
        return f"((xor({z}, {z} >> {shift}))::UHUGEINT * {by}::UHUGEINT % {full})::UBIGINT"

    return z0, mixed


def _noise_sql(std, seed):
    z0, mixed = _counter_sql("j", "key")
    return f"""WITH {RGB}, keyed AS (SELECT *, CAST('0x'||substr(md5('{seed}:0:'||source_id||':'||x0||':'||y0||':noise'),1,13) AS BIGINT)::UHUGEINT AS key FROM c),
p AS (SELECT source_id, y0, x0, dy, dx, t, key, unnest([r,g,b]) AS v, unnest([0,1,2]) AS ch FROM keyed),
n AS (SELECT *, 2*((dy*{P}+dx)*3+ch) AS i FROM p), w AS (SELECT *, unnest([i+1, i+2]) AS j, unnest([0,1]) AS second FROM n),
a AS (SELECT *, {z0} AS z FROM w), b AS (SELECT * EXCLUDE z, {mixed("z", 30, 13787848793156543929)} AS z FROM a),
d AS (SELECT * EXCLUDE z, {mixed("z", 27, 10723151780598845931)} AS z FROM b),
u AS (SELECT source_id, y0, x0, dy, dx, t, ch, v, max(CASE WHEN second=0 THEN ((xor(z, z >> 31) >> 11)::DOUBLE+0.5)/9007199254740992.0 END) AS u,
  max(CASE WHEN second=1 THEN ((xor(z, z >> 31) >> 11)::DOUBLE+0.5)/9007199254740992.0 END) AS w FROM d GROUP BY ALL),
o AS (SELECT *, {U8.format(f"v + {std}::DOUBLE*255.0*(sqrt(-2.0*ln(u))*cos(2.0*pi()*w))")} AS o FROM u)
SELECT source_id, y0, x0, dy, dx, max(CASE WHEN ch=0 THEN o END) AS r, max(CASE WHEN ch=1 THEN o END) AS g, max(CASE WHEN ch=2 THEN o END) AS b, t FROM o GROUP BY source_id, y0, x0, dy, dx, t"""


@query("q_gauss_noise", _noise_sql(0.05, 7))
def q_gauss_noise(spark, d):
    return tiling.unpack_tiles(transforms.gauss_noise(packed_tiles(spark, d), 0.05, seed=7))


def _one_of_sql():
    """Both blurs of every pixel, and the one that the tile draws, or the pixel itself."""
    gauss, disk = (_filter_sql(k).split("SELECT c.source_id", 1) for k in (kernels.gaussian_kernel(3, 1.0), kernels.disk_kernel(2, 0.1)))
    taps = [g[0].rsplit("k(oy, ox, w) AS", 1)[1] for g in (gauss, disk)]
    bodies = ["SELECT c.source_id" + g[1].replace("FROM c, k JOIN", f"FROM c, k{i} k JOIN") for i, g in enumerate((gauss, disk))]
    bands = ", ".join(f"CASE WHEN NOT on_ THEN c.{v} WHEN pick=0 THEN g.{v} ELSE h.{v} END AS {v}" for v in "rgb")
    keys = "source_id, y0, x0, dy, dx"
    return f"""WITH {RGB}, k0(oy, ox, w) AS {taps[0]}, k1(oy, ox, w) AS {taps[1]}, ga AS ({bodies[0]}), di AS ({bodies[1]}),
w AS (SELECT DISTINCT source_id, y0, x0, {_draw_sql("one_of", 42, 0)} < 0.8 AS on_, CAST(floor({_draw_sql("choice", 42, 0)}*2) AS INTEGER) AS pick FROM c)
SELECT c.source_id, c.y0, c.x0, c.dy, c.dx, {bands}, c.t FROM c JOIN w USING (source_id, y0, x0) JOIN ga g USING ({keys}) JOIN di h USING ({keys})"""


@query("q_one_of", _one_of_sql())
def q_one_of(spark, d):
    return tiling.unpack_tiles(transforms.one_of(packed_tiles(spark, d), transforms.blur_steps(), p=0.8))


def _gates_sql(names):
    return ", ".join(f"{_draw_sql(n, 42, 3)} < {p}::DOUBLE AS {n}" for n, p in names.items())


GATES = {"hflip": 0.8, "vflip": 0.6, "turn": 0.8, "affine": 0.6, "tone": 0.3, "power": 0.2, "clahe": 0.15, "blur": 0.2, "noise": 0.1}


@query("q_augment_draws", f"""WITH {RGB} SELECT DISTINCT source_id, y0, x0, {_gates_sql(GATES)}, CAST(floor({_draw_sql("turn_k", 42, 3)}*4) AS INTEGER) AS turn_k,
 CAST(floor({_draw_sql("choice", 42, 3)}*2) AS INTEGER) AS blur_choice, -0.2::DOUBLE + 0.4::DOUBLE*{_draw_sql("tone_brightness", 42, 3)} AS brightness,
 -0.2::DOUBLE + 0.4::DOUBLE*{_draw_sql("tone_contrast", 42, 3)} AS contrast FROM c""")
def q_augment_draws(spark, d):
    """Gates, turn, blur and tone that an epoch of augmentation draws for every tile."""
    return transforms.augment_draws(packed_tiles(spark, d), seed=42, epoch=3)


# only steps whose result has a closed form per pixel: flips, quarter turns and tone
CLOSED = {"train": {"affine": {"p": 0.0}, "random_gamma": {"p": 0.0}, "clahe": {"p": 0.0}, "blur": {"p": 0.0}, "gauss_noise_p": 0.0, "random_brightness_contrast": {"p": 0.5}}}


def _augment_sql():
    tone = ", ".join(f"CASE WHEN tone THEN {U8.format(f'{v}*(1.0+contrast)+255.0*brightness')} ELSE {v} END AS {v}" for v in "rgb")
    return f"""WITH {RGB}, w AS (SELECT DISTINCT source_id, y0, x0, {_gates_sql({"hflip": 0.8, "vflip": 0.6, "turn": 0.8, "tone": 0.5})},
  CAST(floor({_draw_sql("turn_k", 42, 3)}*4) AS INTEGER) AS k, -0.2::DOUBLE + 0.4::DOUBLE*{_draw_sql("tone_brightness", 42, 3)} AS brightness,
  -0.2::DOUBLE + 0.4::DOUBLE*{_draw_sql("tone_contrast", 42, 3)} AS contrast FROM c),
f AS (SELECT c.source_id, c.y0, c.x0, CASE WHEN vflip THEN {LAST}-dy ELSE dy END AS dy, CASE WHEN hflip THEN {LAST}-dx ELSE dx END AS dx, r, g, b, t, CASE WHEN turn THEN k ELSE 0 END AS k, tone, brightness, contrast
  FROM c JOIN w USING (source_id, y0, x0)),
p AS (SELECT source_id, y0, x0, CAST(CASE k WHEN 0 THEN dy WHEN 1 THEN {LAST}-dx WHEN 2 THEN {LAST}-dy ELSE dx END AS INTEGER) AS dy,
  CAST(CASE k WHEN 0 THEN dx WHEN 1 THEN dy WHEN 2 THEN {LAST}-dx ELSE {LAST}-dy END AS INTEGER) AS dx, {tone}, t FROM f),
v AS (SELECT source_id, y0, x0, dy*{P}+dx AS i, round((r/255.0-0.485)/0.229*1000)+round((g/255.0-0.456)/0.224*1000)+round((b/255.0-0.406)/0.225*1000) AS v, t FROM p)
SELECT source_id, y0, x0, CAST(sum(v*(i%97)) AS BIGINT) AS moment, CAST(sum(t*i) AS BIGINT) AS mask_moment FROM v GROUP BY source_id, y0, x0"""


def _moments(samples):
    """Samples reduced to position-weighted sums of tensor and mask."""
    area = P * P
    moment = F.aggregate(F.transform("tensor", lambda v, i: F.round(v.cast("double") * 1000) * (i % area % 97)), F.lit(0.0), lambda s, v: s + v)
    mask = F.aggregate(F.sequence(F.lit(0), F.lit(area - 1)), F.lit(0).cast("long"), lambda s, i: s + F.when(F.substring("mask", i + 1, 1) == F.unhex(F.lit("00")), 0).otherwise(i))
    return samples.select("source_id", "y0", "x0", moment.cast("long").alias("moment"), mask.alias("mask_moment"))


@query("q_augment")
def q_augment(spark, d):
    """Samples of an epoch with the default chances of all steps."""
    return _moments(transforms.augment_tiles(packed_tiles(spark, d), seed=42, epoch=3))


@query("q_augment_closed", _augment_sql())
def q_augment_closed(spark, d):
    return _moments(transforms.augment_tiles(packed_tiles(spark, d), CLOSED, seed=42, epoch=3))
