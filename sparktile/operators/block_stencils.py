"""Stencils and losses of whole images that fit no row or task: blocks that trade margins with their eight neighbours.

A plane table has one row per cell of a ``block`` x ``block`` lattice: source_id, width, height, by, bx and one or more planes,
row-major bytes of a NumPy type (``FLOAT`` unless said otherwise). An erosion or dilation reads one pixel around, so after k
erosions and a dilation the inside of a block is right if its margin had k + 1 pixels; what is wrong at the outer edge of the
margin has not come further. One shuffle on the block carries (1 + 2 * margin / block)**2 of the bytes; a group is one block with
its margin, whatever the image. Where the image ends the margin ends, so edges have fewer neighbours as in ``stencil``.

Null ids are one image like any other. A table holds a cell once; repeated cells of one id overwrite each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .blocks import SIZE, _kind
from .losses import BASE, Term, _named, _names, _skeletons, cldice_of, losses_from_sums
from .scoring import BLOCK, BLOCK_KEY
from .stencil import PACKED

FLOAT = "float64"


def block_values(pixels: DataFrame, values: list[str], block: int = BLOCK) -> DataFrame:
    """Long pixels (source_id, width, height, y, x and ``values``) to a plane table of float64; absent pixels are 0."""

    def fill(group: pa.Table) -> pa.Table:
        height, width, by, bx = (int(group.column(c)[0].as_py()) for c in ("height", "width", "by", "bx"))
        h, w = _inner(by, bx, height, width, block)
        at = (group.column("y").to_numpy().astype(np.int64) - by * block) * w + group.column("x").to_numpy() - bx * block
        names = ["source_id", "width", "height", "by", "bx"]
        out = group.select(names).slice(0, 1)
        for v in values:
            plane = np.zeros(h * w)
            plane[at] = group.column(v).to_numpy().astype(float)
            out = out.append_column(v, pa.array([plane.tobytes()], pa.binary()))
        return out

    cell = [F.expr(f"cast({c} div {block} as int)").alias(f"b{c}") for c in "yx"]
    placed = pixels.select("source_id", "width", "height", "y", "x", *values, *cell)
    return placed.groupBy(*BLOCK_KEY).applyInArrow(fill, f"source_id {_kind(pixels)}, {SIZE}" + "".join(f", {v} binary" for v in values))


def value_pixels(blocks: DataFrame, values: list[str], block: int = BLOCK) -> DataFrame:
    """The way back: source_id, y, x and the float64 planes as doubles, without a shuffle."""

    def spell(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                h, w = _inner(r.by, r.bx, r.height, r.width, block)
                y, x = np.divmod(np.arange(h * w), w)
                out = {"source_id": [r.source_id] * (h * w), "y": y + r.by * block, "x": x + r.bx * block}
                yield pd.DataFrame(out | {v: np.frombuffer(getattr(r, v)) for v in values})

    schema = f"source_id {_kind(blocks)}, y int, x int" + "".join(f", {v} double" for v in values)
    return blocks.select("source_id", "width", "height", "by", "bx", *values).mapInPandas(spell, schema)


def _inner(by: int, bx: int, height: int, width: int, block: int) -> tuple[int, int]:
    return min(block, height - by * block), min(block, width - bx * block)


def _window(at: int, length: int, block: int, halo: int) -> tuple[int, int]:
    """First and last + 1 place of block ``at`` with its margin on both sides."""
    return max(0, at * block - halo), min(length, at * block + block + halo)


def over_margins(
    blocks: DataFrame, planes: dict[str, str], halo: int, block: int, work: Callable[[dict[str, np.ndarray], tuple], dict], out: str
) -> DataFrame:
    """Run ``work`` on every block with ``halo`` pixels around it; ``planes`` names the plane columns and their NumPy types.

    ``work`` gets the planes (height, width, margin included) and the slices of the block itself; it returns one value per column
    of ``out`` (fields of a schema text). Result: source_id, width, height, by, bx and those columns.
    """
    if halo < 0 or block < 1:
        raise ValueError("halo must not be negative and block must be positive")
    kind, reach = _kind(blocks), -(-halo // block)

    def lend(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                y, x = r.by * block, r.bx * block
                h, w = _inner(r.by, r.bx, r.height, r.width, block)
                body = {c: np.frombuffer(getattr(r, c), t).reshape(h, w) for c, t in planes.items()}
                rows = []
                for by in range(max(0, r.by - reach), min(-(-r.height // block), r.by + reach + 1)):
                    for bx in range(max(0, r.bx - reach), min(-(-r.width // block), r.bx + reach + 1)):
                        (y0, y1), (x0, x1) = _window(by, r.height, block, halo), _window(bx, r.width, block, halo)
                        y0, y1, x0, x1 = max(y0, y), min(y1, y + h), max(x0, x), min(x1, x + w)
                        if y0 < y1 and x0 < x1:
                            parts = [p[y0 - y : y1 - y, x0 - x : x1 - x].tobytes() for p in body.values()]
                            rows.append((r.source_id, r.width, r.height, by, bx, y0, x0, y1 - y0, x1 - x0, *parts))
                yield pd.DataFrame(rows, columns=["source_id", "width", "height", "by", "bx", "fy", "fx", "fh", "fw", *planes])

    def gather(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        first = rows[0]
        (y0, y1), (x0, x1) = _window(first["by"], first["height"], block, halo), _window(first["bx"], first["width"], block, halo)
        whole = {c: np.zeros((y1 - y0, x1 - x0), t) for c, t in planes.items()}
        for r in rows:
            at = np.s_[r["fy"] - y0 : r["fy"] - y0 + r["fh"], r["fx"] - x0 : r["fx"] - x0 + r["fw"]]
            for c, t in planes.items():
                whole[c][at] = np.frombuffer(r[c], t).reshape(r["fh"], r["fw"])
        h, w = _inner(first["by"], first["bx"], first["height"], first["width"], block)
        y, x = first["by"] * block - y0, first["bx"] * block - x0
        key = ["source_id", "width", "height", "by", "bx"]
        keys = pa.table({c: [first[c]] for c in key}, pa.schema([group.schema.field(c) for c in key]))
        for name, value in work(whole, np.s_[y : y + h, x : x + w]).items():
            keys = keys.append_column(name, pa.array([value], pa.binary() if isinstance(value, bytes) else pa.float64()))
        return keys

    pieces = blocks.select("source_id", "width", "height", "by", "bx", *planes).mapInPandas(
        lend, f"source_id {kind}, {SIZE}, fy int, fx int, fh int, fw int" + "".join(f", {c} binary" for c in planes)
    )
    return pieces.groupBy(*BLOCK_KEY).applyInArrow(gather, f"source_id {kind}, {SIZE}, {out}")


def stencil_blocks(blocks: DataFrame, v: str, what: str, out: str, iterations: int = 3, block: int = BLOCK) -> DataFrame:
    """source_id, width, height, by, bx and ``out``: the float64 plane ``v`` eroded, dilated, opened or its soft skeleton."""
    if what != "skeleton" and what not in PACKED:
        raise ValueError(f"unknown stencil {what}; use skeleton, {', '.join(PACKED)}")
    halo = {"erode": 1, "dilate": 1, "open": 2}.get(what, max(1, iterations) + 1)

    def work(planes: dict[str, np.ndarray], inside: tuple) -> dict:
        stack = planes[v][None]
        done = kernels.skeleton(stack, iterations) if what == "skeleton" else PACKED[what](stack)
        return {out: np.ascontiguousarray(done[0][inside]).tobytes()}

    return over_margins(blocks, {v: FLOAT}, halo, block, work, f"{out} binary")


def loss_sums_blocks(
    blocks: DataFrame, terms: list[Term], logits: str = "z", mask: str = "t", block: int = BLOCK, kinds: tuple[str, str] = (FLOAT, FLOAT)
) -> DataFrame:
    """The sums of ``loss_sums`` with whole images as samples: partial sums per block, added per image with map-side combine.

    ``kinds`` are the NumPy types of the logits and of the 0/1 mask. Without a skeleton among the terms no margin is sent.
    """
    wanted = _skeletons(terms)
    halo = max((max(1, k) + 1 for _, k in wanted), default=0)
    names = BASE + [n for i in range(len(wanted)) for n in _names(i)]

    def work(planes: dict[str, np.ndarray], inside: tuple) -> dict:
        z, t = planes[logits].astype(float), planes[mask].astype(float)
        p = 1.0 / (1.0 + np.exp(-z))
        own = lambda a: float(a[inside].sum())
        found = [float(z[inside].size), own(np.maximum(z, 0) - z * t + np.log1p(np.exp(-np.abs(z)))), own(p), own(t), own(p * t)]
        for hard, k in wanted:
            pred = p if hard is None else (p >= hard).astype(float)
            sp, st = (kernels.skeleton(a[None], k)[0] for a in (pred, t))
            found += [own(sp), own(sp * t), own(st), own(st * pred)]
        return dict(zip(names, found))

    parts = over_margins(blocks, dict(zip((logits, mask), kinds)), halo, block, work, ", ".join(f"{n} double" for n in names))
    return parts.groupBy("source_id").agg(*[F.sum(n).alias(n) for n in names])


def evaluate_losses_blocks(blocks: DataFrame, specs, logits: str = "z", mask: str = "t", block: int = BLOCK, kinds: tuple[str, str] = (FLOAT, FLOAT)) -> DataFrame:
    """Any set of losses over whole images: one shuffle of blocks with margins, one of sums per image."""
    named = _named(specs)
    return losses_from_sums(loss_sums_blocks(blocks, [t for ts in named.values() for t in ts], logits, mask, block, kinds), named)


def cldice_blocks(
    blocks: DataFrame, logits: str = "z", mask: str = "t", iterations: int = 3, smooth: float = 1.0, threshold: float | None = None,
    block: int = BLOCK, kinds: tuple[str, str] = (FLOAT, FLOAT),
) -> DataFrame:
    """source_id, cldice: centreline Dice of every whole image, of probabilities or of hard predictions when a threshold is given."""
    term = Term("cldice", iterations=iterations, smooth=smooth, threshold=threshold)
    return loss_sums_blocks(blocks, [term], logits, mask, block, kinds).select("source_id", cldice_of(0, smooth).alias("cldice"))
