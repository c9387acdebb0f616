"""3x3 stencils on dense long rasters: soft erosion, dilation, opening and skeleton.

``sample`` names the key columns of one raster, whose positions are ``y`` and ``x``. The
windows look one row back and ahead, so every raster must be dense: use padded tiles.

``colocate`` repartitions once by sample, after which all windows only sort within tasks; right
for tiles, which are small. Skeletons of colocated samples are worked out group by group instead, after one sort whatever the
number of iterations. Without it, the default, each window shuffles on (sample, line), which
spreads a raster of any size. Packed tiles need neither: ``stencil_packed`` works on each row alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from . import kernels


def _lines(sample: list[str], along: str, y: str, x: str):
    """Neighbours on one line: one step back and one ahead, the edge has fewer."""
    across = x if along == y else y
    return Window.partitionBy(*sample, across).orderBy(along).rowsBetween(-1, 1)


def _pool(df: DataFrame, agg, values: list[str], sample, along, y, x, suffix) -> DataFrame:
    window = _lines(sample, along, y, x)
    return df.select("*", *[agg(F.col(v)).over(window).alias(v + suffix) for v in values])


def colocated(df: DataFrame, sample: list[str]) -> DataFrame:
    return df.repartition(*[F.col(c) for c in sample])


def _erode(df, values, sample, out, y, x):
    """Minimum over the plus-shaped neighbourhood; inputs stay, results get suffix ``out``."""
    df = _pool(df, F.min, values, sample, y, y, x, "_ey")
    df = _pool(df, F.min, values, sample, x, y, x, "_ex")
    return df.select(
        *[c for c in df.columns if not c.endswith(("_ey", "_ex"))],
        *[F.least(v + "_ey", v + "_ex").alias(v + out) for v in values],
    )


def _dilate(df, values, sample, out, y, x):
    """Maximum over the 3x3 neighbourhood, one axis after the other."""
    df = _pool(df, F.max, values, sample, x, y, x, "_dx")
    rows = [v + "_dx" for v in values]
    df = _pool(df, F.max, rows, sample, y, y, x, "_dy")
    return df.select(
        *[c for c in df.columns if not c.endswith(("_dx", "_dy"))], *[F.col(v + "_dx_dy").alias(v + out) for v in values]
    )


def soft_erode(df: DataFrame, v: str, sample: list[str], out: str = "eroded", y: str = "y", x: str = "x", colocate: bool = False) -> DataFrame:
    df = colocated(df, sample) if colocate else df
    return _erode(df, [v], sample, "_out", y, x).withColumnRenamed(v + "_out", out)


def soft_dilate(df: DataFrame, v: str, sample: list[str], out: str = "dilated", y: str = "y", x: str = "x", colocate: bool = False) -> DataFrame:
    df = colocated(df, sample) if colocate else df
    return _dilate(df, [v], sample, "_out", y, x).withColumnRenamed(v + "_out", out)


def soft_open(df: DataFrame, v: str, sample: list[str], out: str = "opened", y: str = "y", x: str = "x", colocate: bool = False) -> DataFrame:
    df = colocated(df, sample) if colocate else df
    df = _erode(df, [v], sample, "_e", y, x)
    df = _dilate(df, [v + "_e"], sample, "_out", y, x)
    return df.withColumnRenamed(v + "_e_out", out).drop(v + "_e")


def soft_extremes(df: DataFrame, values: list[str], sample: list[str], y: str = "y", x: str = "x") -> DataFrame:
    """Add <value>_max (3x3) and <value>_min (plus shape) for several columns at once: one window per axis and kind serves all."""
    df = _dilate(df, values, sample, "_max", y, x)
    return _erode(df, values, sample, "_min", y, x)


def soft_skeletons(df: DataFrame, values: dict[str, str], sample: list[str], iterations: int = 3, y: str = "y", x: str = "x", colocate: bool = False) -> DataFrame:
    """Soft skeleton of several value columns at once; ``values`` maps input to output name.

    One erosion serves both the opening of a step and the mask of the next, and all columns
    share each window, so a step costs four sorts whatever the number of columns.
    """
    if colocate:
        return sample_skeletons(df, [(v, iterations, name) for v, name in values.items()], sample, y, x)
    base = df.columns
    cur = {v: f"_k{i}" for i, v in enumerate(values)}
    df = df.select("*", *[
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(v).cast("double"))).alias(k) for v, k in cur.items()
    ])
    masks = list(cur.values())
    for step in range(max(1, iterations)):
        df = _erode(df, masks, sample, "e", y, x)
        df = _dilate(df, [m + "e" for m in masks], sample, "o", y, x)
        grown = []
        for m in masks:
            delta = F.greatest(F.lit(0.0), F.col(m) - F.col(m + "eo"))
            if step:
                kept = F.col(m + "s")
                delta = kept + F.greatest(F.lit(0.0), delta - kept * delta)
            grown.append(delta.alias(m + "s"))
        df = df.select(*base, *[F.col(m + "e").alias(m) for m in masks], *grown)
    return df.select(*base, *[F.col(cur[v] + "s").alias(name) for v, name in values.items()])


class _Lines:
    """Rows of one sample in line order along an axis: minimum or maximum of each row and its neighbours on its line."""

    def __init__(self, across: np.ndarray, along: np.ndarray):
        self.order = np.lexsort((along, across))
        line = across[self.order]
        self.same = line[1:] == line[:-1]

    def pool(self, values: np.ndarray, pick) -> np.ndarray:
        """``values`` (columns, rows) pooled over one step back and one ahead."""
        line = values[:, self.order]
        here = line.copy()
        here[:, 1:] = np.where(self.same, pick(here[:, 1:], line[:, :-1]), here[:, 1:])
        here[:, :-1] = np.where(self.same, pick(here[:, :-1], line[:, 1:]), here[:, :-1])
        out = np.empty_like(values)
        out[:, self.order] = here
        return out


def sample_skeletons(df: DataFrame, wanted: list[tuple[str, int, str]], sample: list[str], y: str = "y", x: str = "x") -> DataFrame:
    """Add a soft skeleton per (value, iterations, output name) of ``wanted``: one shuffle and one sort by sample in all.

    A group is one sample, so this is for tiles; the steps and neighbours are those of the line windows.
    """
    base = df.columns
    first = [F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(v).cast("double"))).alias(f"_k{i}") for i, (v, _, _) in enumerate(wanted)]
    steps = [max(1, n) for _, n, _ in wanted]
    names = [name for _, _, name in wanted]

    def grow(group: pa.Table) -> pa.Table:
        ys, xs = (group.column(c).to_numpy() for c in (y, x))
        down, right = _Lines(xs, ys), _Lines(ys, xs)
        mask = np.stack([group.column(f"_k{i}").to_numpy() for i in range(len(names))])
        kept, done = np.zeros_like(mask), [None] * len(names)
        for step in range(max(steps)):
            eroded = np.minimum(down.pool(mask, np.minimum), right.pool(mask, np.minimum))
            opened = down.pool(right.pool(eroded, np.maximum), np.maximum)
            delta = np.maximum(0.0, mask - opened)
            kept = kept + np.maximum(0.0, delta - kept * delta) if step else delta
            mask = eroded
            for i, n in enumerate(steps):
                if n == step + 1:
                    done[i] = kept[i]
        out = group.select(base)
        for name, skeleton in zip(names, done):
            out = out.append_column(name, pa.array(skeleton))
        return out

    schema = T.StructType([*df.schema.fields, *[T.StructField(name, T.DoubleType()) for name in names]])
    return df.select("*", *first).groupBy(*sample).applyInArrow(grow, schema)


def soft_skeleton(df: DataFrame, v: str, sample: list[str], iterations: int = 3, out: str = "skeleton", **where) -> DataFrame:
    return soft_skeletons(df, {v: out}, sample, iterations, **where)


PACKED = {
    "erode": kernels.erode,
    "dilate": kernels.dilate,
    "open": lambda a: kernels.dilate(kernels.erode(a)),
}


def stencil_packed(tiles: DataFrame, v: str, what: str, out: str, iterations: int = 3) -> DataFrame:
    """Add ``out``, the eroded, dilated, opened tile or its skeleton, of square packed tiles ``v`` array<double>. No shuffle."""
    if what != "skeleton" and what not in PACKED:
        raise ValueError(f"unknown stencil {what}; use skeleton, {', '.join(PACKED)}")
    work = (lambda a: kernels.skeleton(a, iterations)) if what == "skeleton" else PACKED[what]

    @pandas_udf("array<double>")
    def run(values: pd.Series) -> pd.Series:
        def one(flat):
            side = int(round(len(flat) ** 0.5))
            return work(np.asarray(flat, float).reshape(1, side, side)).ravel()

        return pd.Series([one(x) for x in values], dtype=object)

    return tiles.withColumn(out, run(v))
