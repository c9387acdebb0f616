"""Small NumPy kernels that run inside Arrow batches, one tile or one stack of tiles at a time."""

from __future__ import annotations

import struct
import zlib

import numpy as np


def to_u8(a: np.ndarray) -> np.ndarray:
    """Round half up and clamp to bytes."""
    return np.clip(np.floor(a + 0.5), 0, 255).astype(np.uint8)


# --- stencils on stacks (N, H, W) ---------------------------------------------------------------


def _pool(a: np.ndarray, axis: int, pick) -> np.ndarray:
    """Minimum or maximum of each place and its neighbours along ``axis``; the edge has fewer."""
    out = a.copy()
    ahead, back = (tuple(part if i == axis else slice(None) for i in range(a.ndim)) for part in (np.s_[1:], np.s_[:-1]))
    pick(out[ahead], a[back], out=out[ahead])
    pick(out[back], a[ahead], out=out[back])
    return out


def erode(a: np.ndarray) -> np.ndarray:
    return np.minimum(_pool(a, 1, np.minimum), _pool(a, 2, np.minimum))


def dilate(a: np.ndarray) -> np.ndarray:
    return _pool(_pool(a, 2, np.maximum), 1, np.maximum)


def skeleton(a: np.ndarray, iterations: int) -> np.ndarray:
    mask, found = np.clip(a, 0.0, 1.0), None
    for _ in range(max(1, iterations)):
        thinner = erode(mask)
        delta = np.maximum(mask - dilate(thinner), 0.0)
        found = delta if found is None else found + np.maximum(delta - found * delta, 0.0)
        mask = thinner
    return found


# --- sampling -----------------------------------------------------------------------------------


def _taps(n_in: int, n_out: int):
    """Two source rows and a weight per output row, half-pixel centres, clamped."""
    at = np.clip((np.arange(n_out) + 0.5) * (n_in / n_out) - 0.5, 0, n_in - 1)
    low = np.floor(at).astype(int)
    return low, np.minimum(low + 1, n_in - 1), at - low


def resize_plane(a: np.ndarray, side: int) -> np.ndarray:
    """Bilinear resize of (H, W) or (H, W, C) to side x side."""
    for axis in (0, 1):
        low, high, w = _taps(a.shape[axis], side)
        w = w.reshape([-1 if i == axis else 1 for i in range(a.ndim)])
        a = np.take(a, low, axis) * (1 - w) + np.take(a, high, axis) * w
    return a


def resize_nearest(a: np.ndarray, side: int) -> np.ndarray:
    rows, cols = (np.minimum(np.floor(np.arange(side) * (n / side)).astype(int), n - 1) for n in a.shape[:2])
    return a[np.ix_(rows, cols)]


def affine_source(side: int, translate, scale, degrees: float):
    """Source coordinates of every output pixel: rotate and scale about the centre, then shift."""
    c = (side - 1) / 2.0
    rad = np.deg2rad(degrees)
    y, x = np.mgrid[0:side, 0:side].astype(float)
    u, v = x - c - translate[0], y - c - translate[1]
    return (np.sin(-rad) * u + np.cos(rad) * v) / scale[1] + c, (np.cos(rad) * u + np.sin(rad) * v) / scale[0] + c


def sample_bilinear(a: np.ndarray, sy: np.ndarray, sx: np.ndarray) -> np.ndarray:
    """Values at fractional positions; everything beyond the border is 0."""
    y0, x0 = np.floor(sy).astype(int), np.floor(sx).astype(int)
    total = 0.0
    for oy in (0, 1):
        for ox in (0, 1):
            yy, xx = y0 + oy, x0 + ox
            weight = np.abs(1 - oy - (sy - y0)) * np.abs(1 - ox - (sx - x0))
            inside = (yy >= 0) & (yy < a.shape[0]) & (xx >= 0) & (xx < a.shape[1])
            value = a[np.clip(yy, 0, a.shape[0] - 1), np.clip(xx, 0, a.shape[1] - 1)]
            total = total + value * (weight * inside)[..., None]
    return total


def sample_nearest(a: np.ndarray, sy: np.ndarray, sx: np.ndarray) -> np.ndarray:
    yy, xx = np.floor(sy + 0.5).astype(int), np.floor(sx + 0.5).astype(int)
    inside = (yy >= 0) & (yy < a.shape[0]) & (xx >= 0) & (xx < a.shape[1])
    return np.where(inside, a[np.clip(yy, 0, a.shape[0] - 1), np.clip(xx, 0, a.shape[1] - 1)], 0)


# --- filters ------------------------------------------------------------------------------------


def gaussian_taps(size: int, sigma: float) -> np.ndarray:
    r = np.arange(size) - size // 2
    w = np.exp(-(r * r) / (2.0 * sigma * sigma))
    return w / w.sum()


def correlate(a: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """2-D correlation of (H, W, C) with a mirrored border (edge pixel not repeated)."""
    ry, rx = kernel.shape[0] // 2, kernel.shape[1] // 2
    wide = np.pad(a.astype(float), [(ry, ry), (rx, rx), (0, 0)], mode="reflect")
    h, w = a.shape[:2]
    out = np.zeros(a.shape)
    for i, j in zip(*np.nonzero(kernel)):
        out += kernel[i, j] * wide[i : i + h, j : j + w]
    return out


def correlate_lines(a: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Correlation of (H, W, C) with the outer product of ``taps``, one axis after the other: 2k instead of k*k passes."""
    return correlate(correlate(a, taps[:, None]), taps[None, :])


def gaussian_kernel(size: int, sigma: float) -> np.ndarray:
    taps = gaussian_taps(size, sigma)
    return np.outer(taps, taps)


def disk_kernel(radius: int, alias_blur: float) -> np.ndarray:
    """Normalised disk, softened by a small Gaussian when alias_blur > 0."""
    soft = 1 if radius <= 8 else 2
    reach = radius + soft
    y, x = np.mgrid[-reach : reach + 1, -reach : reach + 1]
    disk = ((x * x + y * y) <= radius * radius).astype(float)
    disk /= disk.sum()
    if alias_blur <= 0:
        return disk
    g, h = gaussian_kernel(2 * soft + 1, alias_blur), np.pad(disk, soft)
    n = disk.shape[0]
    return sum(g[i, j] * h[i : i + n, j : j + n] for i in range(g.shape[0]) for j in range(g.shape[1]))


def equalize_plane(v: np.ndarray, clip: float, grid: tuple[int, int]) -> np.ndarray:
    """Contrast-limited adaptive equalisation of a byte plane (H, W).

    Each grid cell has a histogram clipped at max(1, int(clip * area / 256)); the excess is
    shared evenly, its remainder one each to evenly spaced bins from 0. Cell curves are mixed bilinearly.
    """
    gh, gw = grid
    ch, cw = -(-v.shape[0] // gh), -(-v.shape[1] // gw)
    wide = np.pad(v, [(0, gh * ch - v.shape[0]), (0, gw * cw - v.shape[1])], mode="reflect")
    cells = wide.reshape(gh, ch, gw, cw).swapaxes(1, 2).reshape(gh * gw, ch * cw)
    hist = np.stack([np.bincount(c, minlength=256) for c in cells])
    limit = max(1, int(clip * ch * cw / 256))
    extra = np.maximum(hist - limit, 0).sum(1)
    hist = np.minimum(hist, limit) + (extra // 256)[:, None]
    for cell, rest in enumerate(extra % 256):
        if rest:
            hist[cell, np.arange(rest) * max(1, 256 // rest)] += 1
    curve = np.floor(hist.cumsum(1) * (255.0 / (ch * cw)) + 0.5).clip(0, 255).reshape(gh, gw, 256)

    def place(n, size, count):
        at = (np.arange(n) + 0.5) / size - 0.5
        low = np.floor(at).astype(int)
        return np.clip(low, 0, count - 1), np.clip(low + 1, 0, count - 1), at - low

    (y0, y1, wy), (x0, x1, wx) = place(v.shape[0], ch, gh), place(v.shape[1], cw, gw)
    wy, wx = wy[:, None], wx[None, :]
    top = curve[y0[:, None], x0[None], v] * (1 - wx) + curve[y0[:, None], x1[None], v] * wx
    low = curve[y1[:, None], x0[None], v] * (1 - wx) + curve[y1[:, None], x1[None], v] * wx
    return to_u8(top * (1 - wy) + low * wy)


# sRGB (D65) to CIE XYZ, white point and the CIE L*a*b* breakpoint.
RGB_TO_XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
WHITE = np.array([0.950456, 1.0, 1.088754])
LAB_EDGE = 0.008856


def equalize(image: np.ndarray, clip: float, grid: tuple[int, int]) -> np.ndarray:
    """Equalise grey images directly and colour images on CIE lightness, keeping a and b."""
    if (image == image[..., :1]).all():
        return np.repeat(equalize_plane(image[..., 0], clip, grid)[..., None], 3, 2)
    c = image / 255.0
    linear = np.where(c > 0.04045, ((c + 0.055) / 1.055) ** 2.4, c / 12.92)
    t = linear @ RGB_TO_XYZ.T / WHITE
    f = np.where(t > LAB_EDGE, np.cbrt(t), 7.787 * t + 16 / 116)
    light = equalize_plane(to_u8((116 * f[..., 1] - 16) * 2.55), clip, grid) / 2.55
    fy = (light + 16) / 116
    g = np.stack([fy + f[..., 0] - f[..., 1], fy, fy + f[..., 2] - f[..., 1]], -1)
    t = np.where(g**3 > LAB_EDGE, g**3, (g - 16 / 116) / 7.787) * WHITE
    linear = np.clip(t @ np.linalg.inv(RGB_TO_XYZ).T, 0, 1)
    return to_u8(255 * np.where(linear > 0.0031308, 1.055 * linear ** (1 / 2.4) - 0.055, 12.92 * linear))


# --- files --------------------------------------------------------------------------------------


def png_bytes(a: np.ndarray) -> bytes:
    """8-bit grey (H, W) or RGB (H, W, 3) PNG."""
    a = np.ascontiguousarray(a, np.uint8)
    h, w = a.shape[:2]
    lines = np.concatenate([np.zeros((h, 1), np.uint8), a.reshape(h, -1)], 1).tobytes()

    def chunk(tag, body):
        return struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))

    head = struct.pack(">IIBBBBB", w, h, 8, 2 if a.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines, 6)) + chunk(b"IEND", b"")


PNG_LOOK = 41  # bytes that ``is_plain_png`` looks at


def is_plain_png(head: bytes) -> bool:
    """Whether a file that begins so is an 8-bit grey or RGB PNG, not interlaced, whose pixels follow its header at once."""
    plain = head[:16] == b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" and head[24:25] == b"\x08" and head[25:26] in (b"\0", b"\x02")
    return plain and head[26:29] == b"\0\0\0" and head[37:41] == b"IDAT" and 0 not in struct.unpack(">II", head[16:24])


def png_pixels(body: bytes) -> np.ndarray:
    """(H, W, C) of a PNG for which ``is_plain_png`` holds; an error if it is damaged."""
    w, h = struct.unpack(">II", body[16:24])
    c, at, pieces = 3 if body[25] == 2 else 1, 33, []
    while at + 8 <= len(body):
        size, tag = struct.unpack(">I4s", body[at : at + 8])
        if tag == b"IEND":
            break
        if tag == b"IDAT":
            pieces.append(body[at + 8 : at + 8 + size])
        at += size + 12
    need = h * (1 + w * c)
    unpack = zlib.decompressobj()
    raw = unpack.decompress(b"".join(pieces), need)
    if not unpack.eof:
        unpack.decompress(unpack.unconsumed_tail, 1)  # the checksum, if it is there
    if len(raw) < need:
        raise ValueError(f"a PNG of {need} bytes ends after {len(raw)}")
    lines = np.frombuffer(raw, np.uint8).reshape(h, 1 + w * c)
    kind, diff = lines[:, 0], lines[:, 1:].reshape(h, w, c)
    if kind.max() > 4:
        raise ValueError(f"a PNG has a row filter {kind.max()}")
    if not kind.any():
        return diff
    # pixels need those to the left and above: whole diagonals at a time, in a frame of zeros
    out = np.zeros((h + 1, w + 1, c), np.int16)
    for t in range(h + w - 1):
        r = np.arange(max(0, t - w + 1), min(h, t + 1))
        x = t - r
        left, up, corner = out[r + 1, x], out[r, x + 1], out[r, x]
        to_left, to_up, to_corner = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
        nearest = np.where((to_left <= to_up) & (to_left <= to_corner), left, np.where(to_up <= to_corner, up, corner))
        k = kind[r][:, None]
        out[r + 1, x + 1] = (diff[r, x] + np.select([k == 1, k == 2, k == 3, k == 4], [left, up, (left + up) // 2, nearest], 0)) & 255
    return out[1:, 1:].astype(np.uint8)


# --- noise -------------------------------------------------------------------------------------

# Increment and multipliers of the public splitmix64 mixing function.
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def counter_uniform(key: int, index: np.ndarray) -> np.ndarray:
    """Number in (0, 1) for each counter value: splitmix64 of key + index * increment, top 53 bits."""
    step, first, second = (np.uint64(v) for v in _MIX)
    z = np.uint64(key) + index.astype(np.uint64) * step
    z = (z ^ (z >> np.uint64(30))) * first
    z = (z ^ (z >> np.uint64(27))) * second
    z ^= z >> np.uint64(31)
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def counter_normal(key: int, shape) -> np.ndarray:
    """Standard normal numbers in row-major order, by Box and Muller from counters 2i and 2i + 1."""
    i = np.arange(int(np.prod(shape)))
    u, v = counter_uniform(key, 2 * i + 1), counter_uniform(key, 2 * i + 2)
    return (np.sqrt(-2.0 * np.log(u)) * np.cos(2.0 * np.pi * v)).reshape(shape)


# --- run lengths --------------------------------------------------------------------------------


def read_counts(text: str) -> np.ndarray:
    """Compressed counts: 5 payload bits per character above '0', bit 6 continues, the last
    payload bit is the sign, and from the fourth number on each is a difference to the second last."""
    code = np.frombuffer(text.encode("ascii"), np.uint8).astype(np.int64) - 48
    ends = np.flatnonzero((code & 32) == 0)
    starts = np.concatenate([[0], ends[:-1] + 1]).astype(int)
    place = np.arange(len(code)) - np.repeat(starts, ends - starts + 1)
    value = np.add.reduceat((code & 31) << (5 * place), starts)
    value -= np.where(code[ends] & 16, 1 << (5 * (place[ends] + 1)), 0)
    value[1::2] = np.cumsum(value[1::2])
    value[2::2] = np.cumsum(value[2::2])
    return value


def read_many_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``read_counts`` of many texts at once: the numbers of all texts one after the other, and how many each text has."""
    code = np.frombuffer("".join(texts).encode("ascii"), np.uint8).astype(np.int64) - 48
    chars = np.array([len(s) for s in texts], np.int64)
    if not code.size:
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    ends = np.flatnonzero((code & 32) == 0)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(code.size) - np.repeat(starts, ends - starts + 1)
    value = np.add.reduceat((code & 31) << (5 * place), starts)
    value -= np.where(code[ends] & 16, 1 << (5 * (place[ends] + 1)), 0)
    owner = np.repeat(np.arange(len(texts)), chars)[ends]
    size = np.bincount(owner, minlength=len(texts))
    at = np.arange(value.size) - np.repeat(size.cumsum() - size, size)
    # odd places add up to odd ones and even ones to even ones from the third number on: one running sum over each such row
    order = np.lexsort((at, np.where(at == 0, 0, 2 - at % 2), owner))
    row = (owner * 3 + np.where(at == 0, 0, 2 - at % 2))[order]
    total = value[order].cumsum()
    head = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    before = np.concatenate([[0], total])[head]
    value[order] = total - np.repeat(before, np.diff(np.append(head, row.size)))
    return value, size


def write_many_counts(counts: np.ndarray, size: np.ndarray) -> list[str]:
    """Compressed texts of many lists of run lengths, laid end to end: what ``read_many_counts`` reads."""
    at = np.arange(counts.size) - np.repeat(size.cumsum() - size, size)
    value = counts - np.where(at > 2, np.concatenate([[0, 0], counts])[: counts.size], 0)
    chars, longer = np.ones(value.size, np.int64), (value < -16) | (value > 15)
    while longer.any():
        chars += longer
        longer &= (value >> (5 * chars - 1) != 0) & (value >> (5 * chars - 1) != -1)
    who = np.repeat(np.arange(value.size), chars)
    start = chars.cumsum() - chars
    place = np.arange(who.size) - start[who]
    code = (value[who] >> (5 * place)) & 31 | np.where(place + 1 < chars[who], 32, 0)
    text = (code + 48).astype(np.uint8).tobytes().decode("ascii")
    cut = np.concatenate([[0], np.append(start, who.size)[size.cumsum()]])
    return [text[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]


def run_spans(runs: list[np.ndarray], heights, widths):
    """Column-major runs (background first) of many rasters to inclusive row spans: owner, y, x_start, x_end."""
    length = np.concatenate(runs) if runs else np.zeros(0, np.int64)
    return flat_run_spans(length, np.array([len(r) for r in runs], np.int64), heights, widths)


def flat_run_spans(length: np.ndarray, size: np.ndarray, heights, widths):
    """``run_spans`` of lists laid end to end, ``size`` numbers each.

    A row span starts where a column's runs are not covered by those of the column before, and ends before the place where
    the opposite holds. Both are differences of intervals, so the work follows runs and row spans, not pixels.
    """
    none = (np.zeros(0, np.int64),) * 4
    if not length.size:
        return none
    first = np.concatenate([[0], size.cumsum()[:-1]])
    owner = np.repeat(np.arange(len(size)), size)
    end = length.cumsum()
    begin = end - length
    begin = begin - np.repeat(begin[np.minimum(first, begin.size - 1)], size)
    end = begin + length
    h, w = np.asarray(heights, np.int64), np.asarray(widths, np.int64)
    # each raster gets its own stretch of a line, with one empty column after the last
    base = np.concatenate([[0], (h * (w + 1)).cumsum()])
    fg = (np.arange(length.size) - first[owner]) % 2 == 1
    owner, begin, end = owner[fg], begin[fg], np.minimum(end[fg], (h * w)[owner[fg]])
    owner, begin, end = (v[begin < end] for v in (owner, begin, end))
    if not owner.size:
        return none
    at, to, step = base[owner] + begin, base[owner] + end, h[owner]
    places = np.concatenate([at, to, at + step, to + step])
    kinds = np.concatenate([np.ones(at.size), -np.ones(at.size), np.zeros(2 * at.size)]).astype(np.int64)
    moved = np.concatenate([np.zeros(2 * at.size), np.ones(at.size), -np.ones(at.size)]).astype(np.int64)
    order = np.argsort(places, kind="stable")
    places, here, before = places[order], kinds[order].cumsum(), moved[order].cumsum()

    def positions(mask: np.ndarray) -> np.ndarray:
        """All places of the stretches after the marked events."""
        index = np.flatnonzero(mask[:-1] & (places[1:] > places[:-1]))
        low, n = places[index], places[index + 1] - places[index]
        return np.repeat(low - (n.cumsum() - n), n) + np.arange(n.sum())

    def cells(line: np.ndarray):
        who = np.searchsorted(base, line, "right") - 1
        local = line - base[who]
        return who, local % h[who], local // h[who]

    who, y, x_start = cells(positions((here > 0) & (before <= 0)))
    closer, y_end, x_stop = cells(positions((here <= 0) & (before > 0)))
    opens, closes = np.lexsort((x_start, y, who)), np.lexsort((x_stop, y_end, closer))
    return who[opens], y[opens], x_start[opens], x_stop[closes] - 1


def ring_spans(rings: list[np.ndarray], heights, widths):
    """Filled rings of flat x,y numbers: owner, y, x_start, x_end, clipped to each raster."""
    flat = np.concatenate([np.asarray(r, float) for r in rings]) if rings else np.zeros(0)
    return flat_ring_spans(flat, np.array([len(r) for r in rings], np.int64), heights, widths)


def flat_ring_spans(numbers: np.ndarray, size: np.ndarray, heights, widths):
    """``ring_spans`` of rings laid end to end, ``size`` numbers each.

    Vertices are truncated to whole pixels. Rows are filled between pairs of edge crossings
    (even-odd; an edge counts from its upper end down to just above its lower end; ends rounded
    inwards at .5). Horizontal edges and lower corner points, which that leaves out, are added.
    Every row of a closed ring has an even number of crossings, so one sort pairs them all.
    """
    n = np.where(size >= 6, size // 2, 0)
    if not n.sum():
        return (np.zeros(0, np.int64),) * 4
    place = np.arange(numbers.size) - np.repeat(size.cumsum() - size, size)
    pts = numbers[place < np.repeat(2 * n, size)].reshape(-1, 2).astype(np.int64)
    owner = np.repeat(np.arange(len(size)), n)
    first = np.repeat(n.cumsum() - n, n)
    place = np.arange(len(pts)) - first
    nxt = np.where(place + 1 == n[owner], first, np.arange(len(pts)) + 1)
    before = np.empty_like(nxt)
    before[nxt] = np.arange(len(pts))
    h, w = np.asarray(heights, np.int64), np.asarray(widths, np.int64)

    x, y = pts.T
    down = y <= y[nxt]
    xa, ya = np.where(down, x, x[nxt]), np.where(down, y, y[nxt])
    xb, yb = np.where(down, x[nxt], x), np.where(down, y[nxt], y)
    low = np.maximum(ya, 0)
    rows = np.maximum(np.minimum(yb, h[owner]) - low, 0)
    e = np.repeat(np.arange(len(pts)), rows)
    cy = low[e] + np.arange(len(e)) - np.repeat(rows.cumsum() - rows, rows)
    cx = xa[e] + (cy - ya[e]) * (xb[e] - xa[e]) / (yb[e] - ya[e])
    order = np.lexsort((cx, cy, owner[e]))
    left, right = order[0::2], order[1::2]
    flat = np.flatnonzero(ya == yb)
    foot = np.flatnonzero((y[before] < y) & (y[nxt] < y))

    who = np.concatenate([owner[e][left], owner[flat], owner[foot]])
    row = np.concatenate([cy[left], y[flat], y[foot]])
    start = np.concatenate([np.floor(cx[left] + 0.5).astype(np.int64), np.minimum(xa, xb)[flat], x[foot]])
    stop = np.concatenate([np.ceil(cx[right] - 0.5).astype(np.int64), np.maximum(xa, xb)[flat], x[foot]])
    start, stop = np.maximum(start, 0), np.minimum(stop, w[who] - 1)
    ok = (start <= stop) & (row >= 0) & (row < h[who])
    return who[ok], row[ok], start[ok], stop[ok]
