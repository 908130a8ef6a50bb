import numpy as np
import pytest

from hazardframe.operators import cox_likelihood as cl, lasso_cox as lc, model_concordance as mc
from tests_support import brute_c_index


def brute(x, code):
    asks = np.flatnonzero(code % 2 == 0)
    later = code[None, :] > code[asks, None]
    low, high = mc.thresholds(x[asks])
    with np.errstate(invalid="ignore"):
        below = [np.where(np.isnan(v)[:, None], ~np.isnan(x)[None, :], x[None, :] < v[:, None]) for v in (low, high)]
    return [int((later & b).sum()) for b in below]


def counted(x, code, edges, n_codes, parts=5):
    held = {}
    for rows in np.array_split(np.arange(len(x)), parts):
        for _, number, *record in mc.pack(0, x[rows], code[rows], edges):
            held.setdefault(number, []).append(record)
    got = [mc.count_range(k, held[k], edges, n_codes) for k in sorted(held)]
    across = mc.count_across(np.stack([v[2] for v in got])) if len(edges) else (0, 0)
    return [sum(v[i] for v in got) + across[i] for i in (0, 1)], len(held)


@pytest.mark.parametrize("seed", range(6))
def test_ranges_lose_no_pair(seed):
    rng = np.random.default_rng(seed)
    n = 1500
    x = [rng.normal(size=n), rng.integers(0, 9, n) / 3, np.zeros(n), np.round(rng.normal(size=n), 2) + rng.choice([0, 4e-9, 9e-9, 1e-8], n),
         np.where(rng.random(n) < 0.1, np.nan, rng.normal(size=n)), np.where(rng.random(n) < 0.6, 0.0, rng.normal(size=n))][seed]
    code = rng.integers(0, 62, n).astype(np.int32)
    for edges in (np.zeros(0), np.unique(np.nanquantile(x, [0.2, 0.5, 0.8])), np.array([-1e9, np.nanmedian(x) + 5e-9])):
        assert counted(x, code, edges, 62)[0] == brute(x, code)


def test_blocks_of_both_orders():
    rng = np.random.default_rng(1)
    for n in (1, 127, 128, 129, 70_000):
        q, m = rng.permutation(n), 300
        u, v = rng.integers(0, n + 1, m), rng.integers(0, n + 1, m)
        assert mc.count_below(q, u, v) == sum(int((q[:a] >= b).sum()) for a, b in zip(u, v))


def _table(spark, n=600):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(n, 3)), 1)
    t, e, f = rng.integers(1, 40, n).astype(float), rng.random(n) < 0.7, rng.integers(0, 3, n)
    rows = [(float(t[i]), bool(e[i]), x[i].tolist(), [int(f[i])]) for i in range(n)]
    return spark.createDataFrame(rows, "time double, event boolean, features array<double>, folds array<int>").repartition(3), x, t, e, f


@pytest.mark.parametrize("plan", ["whole", "ranges", "rows"])
def test_scores_of_many_models(spark, monkeypatch, plan):
    """Equal and zero coefficients, both sides, in each of the plans."""
    df, x, t, e, f = _table(spark)
    if plan == "ranges":
        for name, v in (("CELL_ROWS", 40), ("SAMPLED", 30)):
            monkeypatch.setattr(mc, name, v)
    judged = None if plan != "rows" else lc.Judged(len(t), None)
    betas = np.random.default_rng(5).normal(size=(3, 4, 3))
    betas[:, 2] = 0
    betas[:, 3] = betas[:, 0]
    sets = [cl.TrainSet(((0, g),)) for g in range(3)]
    got = {(r["side"], r["set"], r["alpha_no"]): r["c_index"] for r in lc.fold_scores(df, sets, betas, ("train", "test"), judged).collect()}
    assert len(got) == 24
    for (side, g, a), v in got.items():
        rows = f != g if side == "train" else f == g
        assert v == pytest.approx(brute_c_index(t[rows], e[rows], x[rows] @ betas[g, a]), abs=1e-12)


def test_scores_are_not_rows(spark, monkeypatch):
    """A search made a row of every score and ordered them all."""
    df, *_ = _table(spark)
    monkeypatch.setattr(lc, "concordance_index", lambda *a, **k: pytest.fail("a row for each score"))
    assert lc.fold_scores(df, [cl.TrainSet(((0, 1),))], np.ones((1, 2, 3))).count() == 2
