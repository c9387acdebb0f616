"""Learning rates of long logs by blocks: which epochs improve is worked out in many tasks, whatever the length of a fold.

An epoch improves when it beats the best accepted value by a relative threshold, so the next improvement after an epoch depends on
that epoch's value alone: every epoch has one link ahead. A fold is cut into blocks of ``step`` consecutive epochs.

1. Each block follows all its links at once by pointer doubling and tells, for any best value it may be entered with, where the
   chain of improvements starts, where it ends and how often the rate is cut on the way: a table of at most ``step`` records.
2. One pass over the tables of a fold (a row a block) gives every block the state it is entered with.
3. Each block marks its improvements from that state; counts of bad epochs are distances to them.

Steps 1 and 3 are groups of at most ``step`` epochs (epochs of a fold are distinct; repeated ones are read by metric) and hold no
loop over rows. Null runs and folds are keys like others; a NaN improves on nothing and, where it comes first, is never beaten.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEP = 1024
KEY = ["run", "fold", "block"]
FRESH = -1  # epochs since the best where there is none yet


def _bars(values: np.ndarray, up: bool, threshold: float) -> np.ndarray:
    return values * (1 + threshold if up else 1 - threshold)


def _better(values: np.ndarray, bars, up: bool) -> np.ndarray:
    return values > bars if up else values < bars


def next_links(values: np.ndarray, up: bool, threshold: float) -> np.ndarray:
    """For each place the first later one that improves on it; the length where there is none."""
    n = len(values)
    later = np.triu(_better(values[None, :], _bars(values, up, threshold)[:, None], up), 1)
    return np.where(later.any(1), later.argmax(1), n)


def chain_ends(links: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray]:
    """By pointer doubling: the last place of the chain that starts at each place, and the rate cuts between its places."""
    n = len(links)
    to = np.append(links, n)
    at = np.arange(n + 1)
    cuts = np.where(to < n, (to - at - 1) // period, 0)
    end = np.where(to < n, to, at)
    hop, total = to, cuts
    while (hop < n).any():
        end = np.where(hop < n, end[np.minimum(hop, n)], end)
        total = total + np.where(hop < n, total[np.minimum(hop, n)], 0)
        hop = hop[hop]
    return end[:n], total[:n]


def block_table(values: np.ndarray, up: bool, threshold: float, period: int) -> dict[str, np.ndarray]:
    """Places that improve on all before them: value (``bar``), place (``first``), where the chain from it ends (``last``, its value
    ``end``) and the rate cuts on the way. A block entered with a best value joins the chain of the first one that beats it."""
    best = (np.fmax if up else np.fmin).accumulate(values)
    ahead = _better(values[1:], best[:-1], up) | (np.isnan(best[:-1]) & ~np.isnan(values[1:]))
    places = np.flatnonzero(np.append(True, ahead))
    last, cuts = chain_ends(next_links(values, up, threshold), period)
    return {"bar": values[places], "first": places, "last": last[places], "end": values[last[places]], "cuts": cuts[places]}


def leave(r, best: float, since: int, up: bool, threshold: float, period: int) -> tuple[float, int, int]:
    """Best value, epochs since it and rate cuts of a block (``n`` and its table) that is entered ``since`` epochs after ``best``."""
    if since == FRESH:
        hits, since = np.zeros(1, int), 0
    else:
        hits = np.flatnonzero(_better(np.asarray(r.bar, float), _bars(np.float64(best), up, threshold), up))
    if not hits.size:
        return best, since + r.n, (since + r.n) // period - since // period
    k = int(hits[0])
    tail = r.n - 1 - int(r.last[k])
    return float(r.end[k]), tail, (since + int(r.first[k])) // period - since // period + int(r.cuts[k]) + tail // period


def improvements(values: np.ndarray, best: float, since: int, up: bool, threshold: float) -> np.ndarray:
    """Which places improve when the block is entered ``since`` epochs after ``best``."""
    n = len(values)
    hits = np.zeros(1, int) if since == FRESH else np.flatnonzero(_better(values, _bars(np.float64(best), up, threshold), up))
    reached, hop = np.zeros(n + 1, bool), np.append(next_links(values, up, threshold), n)
    if hits.size:
        reached[hits[0]] = True
        while not (hop == n).all():
            reached[hop[reached]] = True
            hop = hop[hop]
    return reached[:n]


def rates_up_to(lr0: float, cuts: int, factor: float, min_lr: float, eps: float) -> np.ndarray:
    """Rates after 0, 1, ... tries to cut, up to ``cuts`` or to where tries change nothing any more."""
    rates = [lr0]
    while len(rates) <= cuts:
        lower = max(rates[-1] * factor, min_lr)
        if not rates[-1] - lower > eps:
            break
        rates.append(lower)
    return np.array(rates)


def trace(rows: DataFrame, up: bool, factor: float, patience: int, min_lr: float, lr0: float, threshold: float, eps: float, step: int = STEP) -> DataFrame:
    """(run, fold, epoch, metric), without null metrics, to run, fold, epoch, lr, bad, reduced; see ``runs.plateau_trace``."""
    if patience < 0 or step < 1:
        raise ValueError("patience must not be negative and step must be positive")
    period = patience + 1
    cut = rows.withColumn("block", F.floor(F.col("epoch") / F.lit(step)).cast("long"))
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    key = f"run {kind['run']}, fold {kind['fold']}"

    def tabulate(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf.sort_values(["epoch", "metric"]).metric.to_numpy(float)
        lists = {c: [v.tolist()] for c, v in block_table(values, up, threshold, period).items()}
        return pd.DataFrame({**{c: pdf[c].iloc[:1].tolist() for c in KEY}, "n": [len(values)], **lists})

    def carry(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fold, best, since, tries = None, np.nan, FRESH, 0
        for pdf in frames:
            out = {"best": [], "since": [], "tries": []}
            for r in pdf.itertuples(index=False):
                this = tuple(None if pd.isna(k) else k for k in (r.run, r.fold))
                if this != fold:
                    fold, best, since, tries = this, np.nan, FRESH, 0
                for c, v in zip(out, (best, since, tries)):
                    out[c].append(v)
                best, since, more = leave(r, best, since, up, threshold, period)
                tries += more
            yield pd.DataFrame({**{c: pdf[c] for c in KEY}, **out})

    def mark(pdf: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["epoch", "metric"])
        best, since, tries = float(state.best.iloc[0]), int(state.since.iloc[0]), int(state.tries.iloc[0])
        better, place = improvements(pdf.metric.to_numpy(float), best, since, up, threshold), np.arange(len(pdf))
        behind = np.maximum.accumulate(np.where(better, place, -1))
        away = np.where(behind >= 0, place - behind, max(since, 0) + place + 1)
        tried = (away > 0) & (away % period == 0)
        before = tries + np.cumsum(tried) - tried
        rates = rates_up_to(lr0, int(before[-1]) + 1, factor, min_lr, eps)
        return pd.DataFrame({
            "run": pdf.run, "fold": pdf.fold, "epoch": pdf.epoch, "lr": rates[np.minimum(before, len(rates) - 1)], "bad": away % period,
            "reduced": tried & (before < len(rates) - 1),
        })

    tables = cut.groupBy(*KEY).applyInPandas(
        tabulate, f"{key}, block long, n int, bar array<double>, first array<int>, last array<int>, end array<double>, cuts array<int>"
    )
    states = tables.repartition("run", "fold").sortWithinPartitions(*KEY).mapInPandas(carry, f"{key}, block long, best double, since long, tries long")
    return cut.groupBy(*KEY).cogroup(states.groupBy(*KEY)).applyInPandas(mark, f"{key}, epoch {kind['epoch']}, lr double, bad int, reduced boolean")
