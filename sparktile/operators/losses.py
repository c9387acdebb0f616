"""Segmentation losses as aggregates over shared per-sample sums.

Every loss is a weighted list of terms, every term a formula over a few sums, so any set of
losses needs one aggregation. The sums come from long pixels (Catalyst) or from packed tiles
(one Arrow pass); the formulas are the same.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.pixels import sigmoid
from . import kernels
from .stencil import sample_skeletons, soft_skeletons


@dataclass(frozen=True)
class Term:
    kind: str  # bce, dice, tversky or cldice
    weight: float = 1.0
    smooth: float = 1e-6
    alpha: float = 0.3
    beta: float = 0.7
    iterations: int = 3
    threshold: float | None = None  # None: probabilities, else hard predictions

    @property
    def skeleton(self) -> tuple:
        return (self.threshold, self.iterations)


# Accepted names of each loss.
NAMES = {
    "bce_with_logits": "bce",
    "bce": "bce",
    "binary_cross_entropy_with_logits": "bce",
    "bce_dice": "bce_dice",
    "bce_dice_cldice": "bce_dice_cldice",
    "bce_dice_soft_cldice": "bce_dice_cldice",
    "bcedicecldice": "bce_dice_cldice",
    "tversky": "tversky",
    "cldice": "cldice",
    "soft_cldice": "soft_cldice",
    "softcldice": "soft_cldice",
    "tversky_soft_cldice": "tversky_soft_cldice",
    "tversky_softcldice": "tversky_soft_cldice",
}


def loss_terms(spec: dict | str) -> list[Term]:
    """Terms of a loss given as a name or as a dict with ``name`` and parameters."""
    spec = {"name": spec} if isinstance(spec, str) else spec
    name = NAMES.get(str(spec["name"]).lower())
    if name is None:
        raise ValueError(f"unknown loss {spec['name']!r}; known: {sorted(NAMES)}")

    def num(key, default):
        return float(spec.get(key, default))

    bce, dice = Term("bce"), Term("dice")  # the plain bce_dice keeps its 1e-6 whatever ``smooth`` says
    tversky = Term("tversky", alpha=num("alpha", 0.3), beta=num("beta", 0.7), smooth=num("smooth", 1e-6))
    center = Term("cldice", iterations=int(spec.get("iterations", 3)), smooth=num("cldice_smooth", 1.0))
    alone = replace(center, smooth=num("cldice_smooth", spec.get("smooth", 1.0)))
    if name == "bce":
        return [bce]
    if name == "bce_dice":
        return [replace(bce, weight=num("bce_weight", 0.5)), replace(dice, weight=num("dice_weight", 0.5))]
    if name == "bce_dice_cldice":
        return [
            replace(bce, weight=num("bce_weight", 0.3)),
            replace(dice, weight=num("dice_weight", 0.6), smooth=num("smooth", 1e-6)),
            replace(center, weight=num("soft_cldice_weight", 0.1), iterations=int(spec.get("iterations", 5))),
        ]
    if name == "tversky":
        return [tversky]
    if name == "cldice":
        return [replace(alone, threshold=num("threshold", 0.5))]
    if name == "soft_cldice":
        return [alone]
    return [replace(tversky, weight=num("tversky_weight", 0.7)), replace(center, weight=num("soft_cldice_weight", 0.3))]


def _skeletons(terms: list[Term]) -> list[tuple]:
    return sorted({t.skeleton for t in terms if t.kind == "cldice"}, key=str)


def _names(i: int) -> list[str]:
    """Columns of the i-th skeleton: its own sum, its overlap with the target, and the reverse pair."""
    return [f"sk{i}_p", f"sk{i}_pt", f"sk{i}_t", f"sk{i}_tp"]


BASE = ["n", "bce", "p", "t", "pt"]


def loss_sums(df: DataFrame, sample: list[str], logit: Column, target: Column, terms: list[Term], y: str = "dy", x: str = "dx", colocate: bool = True) -> DataFrame:
    """Per-sample sums from long pixels; skeletons only for the terms that need them.

    ``colocate`` works skeletons out sample by sample, right for tiles; without it windows shuffle by line, for whole images as samples.
    """
    wanted = _skeletons(terms)
    px = df.select(*sample, F.col(y), F.col(x), logit.cast("double").alias("z"), target.cast("double").alias("tt"))
    px = px.withColumn("pp", sigmoid(F.col("z")))
    hard = {h: f"h{k}" for k, h in enumerate(sorted({h for h, _ in wanted if h is not None}))}
    for h, name in hard.items():
        px = px.withColumn(name, (F.col("pp") >= h).cast("double"))
    cols, every = [], []
    for k in sorted({it for _, it in wanted}):
        outs = {"tt": f"s_tt_{k}"}
        outs |= {(hard[h] if h is not None else "pp"): f"s_{hard.get(h, 'pp')}_{k}" for h, it in wanted if it == k}
        every += [(v, k, name) for v, name in outs.items()]
        px = px if colocate else soft_skeletons(px, outs, sample, k, y, x)
    if wanted and colocate:
        px = sample_skeletons(px, every, sample, y, x)
    for i, (h, k) in enumerate(wanted):
        pred = hard.get(h, "pp")
        sp, st = F.col(f"s_{pred}_{k}"), F.col(f"s_tt_{k}")
        exprs = (sp, sp * F.col("tt"), st, st * F.col(pred))
        cols += [F.sum(e).alias(n) for e, n in zip(exprs, _names(i))]
    z, t, p = F.col("z"), F.col("tt"), F.col("pp")
    bce = F.greatest(z, F.lit(0.0)) - z * t + F.log1p(F.exp(-F.abs(z)))
    return px.groupBy(*sample).agg(
        F.count("*").cast("double").alias("n"), F.sum(bce).alias("bce"), F.sum(p).alias("p"), F.sum(t).alias("t"),
        F.sum(p * t).alias("pt"), *cols,
    )


def loss_sums_packed(tiles: DataFrame, sample: list[str], logits: str, mask: str, terms: list[Term]) -> DataFrame:
    """The same sums from packed tiles: ``logits`` array<float or double>, ``mask`` 0/1 bytes. No shuffle."""
    wanted = _skeletons(terms)
    names = BASE + [n for i in range(len(wanted)) for n in _names(i)]

    @pandas_udf(", ".join(f"{n} double" for n in names))
    def sums(zs: pd.Series, ms: pd.Series) -> pd.DataFrame:
        z = np.stack([np.asarray(v, np.float64) for v in zs])
        side = int(round(z.shape[1] ** 0.5))
        z = z.reshape(-1, side, side)
        t = np.stack([np.frombuffer(b, np.uint8) for b in ms]).reshape(z.shape).astype(float)
        p = 1.0 / (1.0 + np.exp(-z))
        bce = np.maximum(z, 0) - z * t + np.log1p(np.exp(-np.abs(z)))

        def total(a):
            return a.sum((1, 2))

        out = {"n": np.full(len(z), float(side * side)), "bce": total(bce), "p": total(p), "t": total(t), "pt": total(p * t)}
        for i, (h, k) in enumerate(wanted):
            pred = p if h is None else (p >= h).astype(float)
            sp, st = kernels.skeleton(pred, k), kernels.skeleton(t, k)
            out |= dict(zip(_names(i), (total(sp), total(sp * t), total(st), total(st * pred))))
        return pd.DataFrame(out)[names]

    return tiles.select(*sample, sums(logits, mask).alias("_sums")).select(*sample, "_sums.*")


def term_value(term: Term, skeletons: list[tuple]) -> Column:
    """Aggregate expression of one term over per-sample sums."""
    s = term.smooth
    p, t, pt = F.col("p"), F.col("t"), F.col("pt")
    if term.kind == "bce":
        return F.sum("bce") / F.sum("n")
    if term.kind == "dice":
        return 1.0 - F.avg((2.0 * pt + s) / (p + t + s))
    if term.kind == "tversky":
        return 1.0 - F.avg((pt + s) / (pt + term.alpha * (p - pt) + term.beta * (t - pt) + s))
    return 1.0 - F.avg(cldice_of(skeletons.index(term.skeleton), s))


def cldice_of(i: int, smooth: float) -> Column:
    """Harmonic mix of the skeleton precision and sensitivity of one sample."""
    own, hit, own_t, hit_t = (F.col(n) for n in _names(i))
    prec, sens = (hit + smooth) / (own + smooth), (hit_t + smooth) / (own_t + smooth)
    return (2.0 * prec * sens + smooth) / (prec + sens + smooth)


def losses_from_sums(sums: DataFrame, named: dict[str, list[Term]]) -> DataFrame:
    """One row per loss: loss, value."""
    skeletons = _skeletons([t for terms in named.values() for t in terms])
    values = []
    for i, terms in enumerate(named.values()):
        total = sum((t.weight * term_value(t, skeletons) for t in terms[1:]), terms[0].weight * term_value(terms[0], skeletons))
        values.append(total.alias(f"v{i}"))
    row = sums.agg(*values)
    pairs = F.array(*[F.struct(F.lit(n).alias("loss"), F.col(f"v{i}").alias("value")) for i, n in enumerate(named)])
    return row.select(F.inline(pairs))


def _named(specs) -> dict[str, list[Term]]:
    specs = specs if isinstance(specs, (list, tuple)) else [specs]
    out = {}
    for spec in specs:
        label = spec if isinstance(spec, str) else spec.get("label", spec["name"])
        if label in out:
            raise ValueError(f"two losses are called {label!r}; give one a label")
        out[label] = loss_terms(spec)
    return out


def evaluate_losses(df: DataFrame, specs, sample: list[str], logit: Column, target: Column, y: str = "dy", x: str = "dx", colocate: bool = True) -> DataFrame:
    """Any set of losses over long pixels in one aggregation; see ``loss_sums`` for ``colocate``."""
    named = _named(specs)
    terms = [t for ts in named.values() for t in ts]
    return losses_from_sums(loss_sums(df, sample, logit, target, terms, y, x, colocate), named)


def evaluate_losses_packed(tiles: DataFrame, specs, sample: list[str], logits: str = "logits", mask: str = "mask") -> DataFrame:
    """Any set of losses over packed tiles: a narrow Arrow pass and a final one-row aggregate."""
    named = _named(specs)
    terms = [t for ts in named.values() for t in ts]
    return losses_from_sums(loss_sums_packed(tiles, sample, logits, mask, terms), named)


def cldice_score(df: DataFrame, sample: list[str], logit: Column, target: Column, iterations: int = 3, smooth: float = 1.0, threshold: float | None = None, y: str = "dy", x: str = "dx") -> DataFrame:
    """Per-sample centreline Dice of probabilities, or of hard predictions when a threshold is given."""
    term = Term("cldice", iterations=iterations, smooth=smooth, threshold=threshold)
    return loss_sums(df, sample, logit, target, [term], y, x).select(*sample, cldice_of(0, smooth).alias("cldice"))


def _single(name):
    def loss(df: DataFrame, sample: list[str], logit: Column, target: Column, y: str = "dy", x: str = "dx", **params) -> DataFrame:
        return evaluate_losses(df, [{"name": name, **params}], sample, logit, target, y, x)

    loss.__name__, loss.__doc__ = name, f"One row (loss, value) of the {name} loss over long pixels."
    return loss


bce = _single("bce")
bce_dice = _single("bce_dice")
tversky = _single("tversky")
hard_cldice = _single("cldice")
soft_cldice = _single("soft_cldice")
bce_dice_cldice = _single("bce_dice_cldice")
tversky_soft_cldice = _single("tversky_soft_cldice")


def soft_dice_loss(df: DataFrame, sample: list[str], logit: Column, target: Column, smooth: float = 1e-6) -> DataFrame:
    """One row (loss, value): 1 - mean soft Dice."""
    term = Term("dice", smooth=smooth)
    return losses_from_sums(loss_sums(df, sample, logit, target, [term]), {"soft_dice": [term]})
