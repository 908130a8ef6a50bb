import numpy as np
import pytest

from hazardframe.operators import cox_likelihood as cl, lasso_cox as lc


def _table(spark, n=400, p=3, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) * [1, 50, 0.1] + [0, 1000, 3]
    x[rng.random((n, p)) < 0.1] = np.nan
    t, e, f = rng.integers(1, 30, n).astype(float), rng.random(n) < 0.7, rng.integers(0, 3, (n, 2))
    rows = [(float(t[i]), bool(e[i]), [None if np.isnan(v) else float(v) for v in x[i]], f[i].tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "time double, event boolean, features array<double>, folds array<int>").repartition(3)
    sets = []
    for held in (((0, 1),), ((0, 0), (1, 2)), ()):
        inside = cl.TrainSet(held).rows(f, n)
        middle = np.nanmedian(x[inside], axis=0)
        filled = np.where(np.isnan(x), middle, x)[inside]
        sets.append(cl.TrainSet(held, tuple(middle), tuple(filled.mean(axis=0)), tuple(filled.std(axis=0))))
    return df, sets


@pytest.mark.parametrize("cells", [cl.MAX_CURVE_CELLS, 1])
def test_one_design_gives_what_each_set_gives(spark, monkeypatch, cells):
    df, sets = _table(spark)
    beta = np.random.default_rng(2).normal(size=(5, 3)) / 3
    models, working = cl.Models(sets, np.array([2, 0, 1, 0, 2]), beta), [np.arange(3)] * 5
    got = [cl.Likelihood(df, cells).ordered().evaluate(models, working)]
    monkeypatch.setattr(cl.Shared, "fits", staticmethod(lambda *a: False))
    want = cl.Likelihood(df, cells).evaluate(models, working)
    for name, values in want.items():
        np.testing.assert_allclose(got[0][name], values, rtol=1e-9, atol=1e-9)


def test_equal_models_are_evaluated_once(spark, monkeypatch):
    """All penalties of a training set start at zero, where they are one model."""
    df, sets = _table(spark)
    seen, plain = [], cl.Likelihood.evaluate
    monkeypatch.setattr(cl.Likelihood, "evaluate", lambda self, models, *a: seen.append(len(models.beta)) or plain(self, models, *a))
    alphas = [0.02, 0.05, 0.1, 0.3, 2.0, 3.0, 4.0]
    betas = lc.fit_models(df, sets, alphas, [1.0] * 3, 1e-8)
    assert seen[0] == 3 and max(seen) <= 3 * 4
    monkeypatch.undo()
    for a, alpha in enumerate(alphas):
        np.testing.assert_allclose(betas[1, a], lc.fit_models(df, [sets[1]], [alpha], [1.0] * 3, 1e-8)[0, 0], atol=1e-9)
