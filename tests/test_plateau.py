"""Plateau rates by blocks equal to a loop over epochs, whatever the blocks."""

from types import SimpleNamespace

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparktile.operators import plateau, runs


def loop(values, up, factor, patience, min_lr, lr0, threshold, eps=1e-8):
    lr, bad, best, out = lr0, 0, None, []
    for v in values:
        before, cut = lr, False
        good = best is None or (v > best * (1 + threshold) if up else v < best * (1 - threshold))
        best, bad = (v, 0) if good else (best, bad + 1)
        if bad > patience:
            new, bad = max(lr * factor, min_lr), 0
            if lr - new > eps:
                lr, cut = new, True
        out.append((before, bad, cut))
    return out


numbers = st.one_of(st.integers(-6, 6).map(float), st.floats(-2, 2), st.just(float("nan")))


@settings(max_examples=300, deadline=None)
@given(st.lists(numbers, min_size=1, max_size=40), st.booleans(), st.integers(1, 9), st.integers(1, 4), st.sampled_from([0.0, 1e-4, 0.3]))
def test_blocks_hand_on_what_a_loop_has(values, up, step, period, threshold):
    """Improvements, distances and numbers of cuts at every border of blocks."""
    values, best, since, tries, marks, entered = np.array(values), np.nan, plateau.FRESH, 0, [], []
    with np.errstate(all="ignore"):
        for i in range(0, len(values), step):
            part = values[i : i + step]
            entered.append(tries)
            marks += plateau.improvements(part, best, since, up, threshold).tolist()
            table = SimpleNamespace(n=len(part), **plateau.block_table(part, up, threshold, period))
            best, since, more = plateau.leave(table, best, since, up, threshold, period)
            tries += more
    top, away, want, cuts = None, 0, [], []
    for v in values:
        cuts.append(sum(cuts[-1:]) + 0 if cuts else 0)
        good = top is None or bool(v > top * (1 + threshold) if up else v < top * (1 - threshold))
        top, away = (v, 0) if good else (top, away + 1)
        want.append(good)
        cuts[-1] += bool(away and away % period == 0)
    assert marks == want and tries == cuts[-1] and since == away
    assert entered == [cuts[i - 1] if i else 0 for i in range(0, len(values), step)]
    assert best == top or (np.isnan(best) and np.isnan(top))


@pytest.mark.parametrize("mode,patience,threshold,step", [("max", 0, 1e-4, 1), ("min", 2, 1e-4, 7), ("max", 3, 0.05, 64), ("min", 1, 0.0, 5000)])
def test_folds_null_keys_and_steady_logs(spark, mode, patience, threshold, step):
    rng = np.random.default_rng(7)
    logs = {
        ("a", 0): rng.random(90), ("a", 1): np.linspace(5, 0.1, 90), ("a", None): rng.normal(size=90), (None, 2): np.full(90, 0.5),
        ("b", 0): np.linspace(-3, -9, 90), ("c", 0): np.array([0.25]), (None, None): np.where(rng.random(90) < 0.2, np.nan, rng.random(90)),
    }
    rows = [(*k, e * 3, float(v)) for k, vs in logs.items() for e, v in enumerate(vs)]
    rows += [("a", 0, 1, None), ("d", 0, 1, None)]
    log = spark.createDataFrame(rows, "run string, fold int, epoch int, m double").repartition(5)
    got = {}
    for r in runs.plateau_trace(log, "m", mode, 0.7, patience, 1e-4, 1e-3, threshold, step=step).collect():
        assert got.setdefault((r.run, r.fold, r.epoch), (r.lr, r.bad, r.reduced)) == (r.lr, r.bad, r.reduced)
    want = {}
    for k, vs in logs.items():
        for e, x in enumerate(loop(vs, mode == "max", 0.7, patience, 1e-4, 1e-3, threshold)):
            want[(*k, e * 3)] = x
    assert got == want


def test_one_fold_is_many_groups_and_errors(spark):
    log = spark.range(5000).selectExpr("'r' run", "cast(0 as int) fold", "cast(id as int) epoch", "1 / (1 + id) + (id * 7919 % 13) / 100 m")
    values = [r.m for r in log.orderBy("epoch").collect()]
    got = [(r.lr, r.bad, r.reduced) for r in runs.plateau_trace(log, "m", "min", 0.5, 4, 1e-9, 1.0, 1e-4, step=100).orderBy("epoch").collect()]
    assert got == loop(values, False, 0.5, 4, 1e-9, 1.0, 1e-4)
    none = runs.plateau_trace(log.limit(0), "m")
    assert none.count() == 0 and none.columns == ["run", "fold", "epoch", "lr", "bad", "reduced"]
    with pytest.raises(ValueError, match="patience"):
        runs.plateau_trace(log, "m", patience=-1)
