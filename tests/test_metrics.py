import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hazardframe.operators import curves, metrics, stratify


def brute(t, e, x):
    comparable = concordant = tied = 0
    for i in range(len(t)):
        if not e[i]:
            continue
        mask = (t > t[i]) | ((t == t[i]) & ~e)
        mask[i] = False
        comparable += mask.sum()
        d = x[i] - x[mask]
        tied += (np.abs(d) <= 1e-8).sum()
        concordant += (d > 1e-8).sum()
    return comparable, concordant, tied


def skewed(seed, n=700):
    """A third of the rows share one time, a third share one score, and both are full of ties."""
    rng = np.random.default_rng(seed)
    t = np.where(rng.random(n) < 1 / 3, 50.0, rng.integers(0, 90, n)).astype(float)
    x = np.where(rng.random(n) < 1 / 3, 0.25, np.round(rng.normal(size=n), 1))
    return t, rng.random(n) < 0.5, x


@pytest.mark.parametrize("rows_per_range", [20, 90, 100_000])
@pytest.mark.parametrize("seed", [0, 1])
def test_concordance_matches_all_pairs(spark, rows_per_range, seed):
    t, e, x = skewed(seed)
    df = spark.createDataFrame(pd.DataFrame({"t": t, "e": e, "x": x}))
    got = metrics.concordance_index(df, "t", "e", "x", rows_per_range=rows_per_range).first()
    want = brute(t, e, x)
    assert (int(got.comparable), int(got.concordant), int(got.tied)) == want
    assert got.c_index == pytest.approx((want[1] + want[2] / 2) / want[0])


def test_concordance_with_continuous_scores_and_groups(spark):
    rng = np.random.default_rng(5)
    n = 600
    g = np.where(rng.random(n) < 0.7, "hot", "cold")
    t, e, x = rng.exponential(size=n), rng.random(n) < 0.6, rng.normal(size=n)
    df = spark.createDataFrame(pd.DataFrame({"g": g, "t": t, "e": e, "x": x}))
    for r in metrics.concordance_index(df, "t", "e", "x", ["g"], rows_per_range=60).collect():
        m = g == r.g
        assert (int(r.comparable), int(r.concordant), int(r.tied)) == brute(t[m], e[m], x[m])


def test_concordance_of_many_groups_of_very_different_size(spark):
    """A group of 900 rows, 300 of one to five, one with the null key; a third of the rows share one time and score."""
    rng = np.random.default_rng(8)
    g = np.concatenate([np.zeros(900), np.repeat(np.arange(1, 301), rng.integers(1, 6, 300))])
    n = len(g)
    t = np.where(rng.random(n) < 1 / 3, 7.0, rng.integers(0, 40, n)).astype(float)
    x = np.where(rng.random(n) < 1 / 3, 0.5, np.round(rng.normal(size=n), 1))
    e = rng.random(n) < 0.5
    rows = [(None if k == 17 else int(k), float(a), bool(b), float(v)) for k, a, b, v in zip(g, t, e, x)]
    df = spark.createDataFrame(rows, "g int, t double, e boolean, x double")
    for size in (25, 100_000):
        got = {r.g: (int(r.comparable), int(r.concordant), int(r.tied)) for r in metrics.concordance_index(df, "t", "e", "x", ["g"], rows_per_range=size).collect()}
        assert got == {(None if k == 17 else int(k)): brute(t[g == k], e[g == k], x[g == k]) for k in np.unique(g)}


def test_merged_cells_stay_below_n_log_n(spark, monkeypatch):
    """Rows that the merge over cells handles, at two sizes: no more than a digit of the ranges for each row."""
    rng = np.random.default_rng(3)
    for n in (400, 1600):
        df = spark.createDataFrame(pd.DataFrame({"ta": rng.integers(0, n // 10, n), "xa": rng.integers(0, n // 10, n), "kind": rng.integers(0, 3, n), "w": 1}))
        df = df.selectExpr("cast(ta as bigint) ta", "cast(xa as bigint) xa", "cast(kind as int) kind", "w")
        seen = []
        monkeypatch.setattr(metrics, "match_stats", lambda a, b, k: seen.append(real(a, b, k)) or seen[-1])
        real = __import__("hazardframe.operators.ordered", fromlist=["match_stats"]).match_stats
        got = {r.kind: int(r.n) for r in metrics._cell_counts(df, []).collect()}
        rows = [tuple(r) for r in df.collect()]
        want = {k: sum(1 for a in rows if a[2] == k for p in rows if p[2] == 0 and p[0] > a[0] and p[1] < a[1]) for k in (1, 2)}
        assert got == want
        assert seen[0].count() <= n


def test_near_ties_count_as_ties(spark):
    rows = [(1.0, True, 0.5), (2.0, True, 0.5 + 5e-9), (3.0, False, 0.5 + 3e-8)]
    got = metrics.concordance_index(spark.createDataFrame(rows, "t double, e boolean, x double"), "t", "e", "x").first()
    assert (int(got.comparable), int(got.concordant), int(got.tied)) == (3, 0, 1)


def test_no_comparable_pair_gives_null(spark):
    df = spark.createDataFrame([(1.0, False, 0.1), (2.0, False, 0.2)], "t double, e boolean, x double")
    assert metrics.concordance_index(df, "t", "e", "x").first().c_index is None


def test_brier_matches_a_direct_computation(spark):
    rng = np.random.default_rng(7)
    n = 300
    pdf = pd.DataFrame({"time": rng.integers(1, 60, n).astype(float), "event": rng.random(n) < 0.6, "eta": rng.normal(size=n)})
    train, test = pdf[:200], pdf[200:]
    tr, te = spark.createDataFrame(train), spark.createDataFrame(test)
    base = curves.breslow_baseline(tr, "time", "event", "eta")
    grid = metrics.time_grid(tr, te, "time", 20)
    got = metrics.brier_scores(te, tr, base, "time", "event", "eta", grid).toPandas().sort_values("time").brier.to_numpy()
    times = np.unique(train.time)
    h0, g, hazard, surv = [], [], 0.0, 1.0
    for u in times:
        risk, d = np.exp(train.eta[train.time >= u]).sum(), (train.event & (train.time == u)).sum()
        hazard += d / risk
        left = (train.time >= u).sum() - d
        c = (~train.event & (train.time == u)).sum()
        surv *= 1 - c / left if left else 1.0
        h0.append(hazard)
        g.append(surv)
    h0, g = np.asarray(h0), np.asarray(g)
    at = lambda curve, t, before: np.where(np.searchsorted(times, t, "right") > 0, curve[np.maximum(np.searchsorted(times, t, "right") - 1, 0)], before)
    want = []
    for u in grid:
        s = np.exp(-at(h0, [u], h0[0])[0] * np.exp(test.eta))
        gi, gu = at(g, test.time, 1.0), at(g, [u], 1.0)[0]
        died = (test.time <= u) & test.event & (gi > 0)
        term = np.where(died, s ** 2 / np.where(gi > 0, gi, 1), 0) + np.where(test.time > u, (1 - s) ** 2 / gu, 0)
        want.append(term.mean())
    np.testing.assert_allclose(got, want, rtol=1e-9)
    ibs = metrics.integrated_brier(te, tr, base, "time", "event", "eta", 20).first()
    x, y = np.asarray(grid), np.asarray(want)
    assert ibs.ibs == pytest.approx(((x[1:] - x[:-1]) * (y[1:] + y[:-1]) / 2).sum() / (x[-1] - x[0]))
    assert ibs.better_than_random == (ibs.ibs < 0.25)


def test_logrank_ranges_agree_and_empty_group_is_an_error(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"t": rng.integers(0, 80, 400).astype(float), "e": rng.random(400) < .5, "risk_class": (rng.random(400) < .4).astype(int)})
    df = spark.createDataFrame(pdf)
    a = stratify.logrank_test(df, "t", "e", "risk_class").first()
    b = stratify.logrank_test(df, "t", "e", "risk_class", rows_per_range=7).first()
    assert a.chi2 == pytest.approx(b.chi2) and 0 <= a.p_value <= 1
    with pytest.raises(ValueError):
        stratify.evaluate_stratification(df.withColumn("risk_class", F.lit(0)), "t", "e")


def test_significance_bands(spark):
    from hazardframe.functions.scalar import significance
    rows = spark.createDataFrame([(0.01,), (0.05,), (0.1,), (0.2,)], "p double").select(significance(F.col("p")).alias("s")).collect()
    assert [r.s for r in rows] == ["significant", "borderline", "borderline", "not significant"]


def test_classifier_threshold_and_guards(spark):
    train = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "risk_score double")
    c = stratify.RiskClassifier().fit(train)
    assert c.threshold == 2.0
    assert sorted(r.risk_class for r in c.transform(train).collect()) == [0, 0, 1]  # a tie is low risk
    with pytest.raises(ValueError):
        stratify.RiskClassifier().transform(train)
    with pytest.raises(ValueError):
        c.transform(train.withColumnRenamed("risk_score", "other"))
    assert stratify.RiskClassifier("s").fit(train, lambda d: d.withColumn("s", F.col("risk_score") * 2)).threshold == 4.0


def test_confusion_has_four_cells_and_report_handles_one_class(spark):
    df = spark.createDataFrame([(1.0, True, 1), (2.0, True, 1), (3.0, False, 0)], "t double, e boolean, risk_class int")
    m = stratify.confusion_matrix(df, "t", "e", 10.0)
    assert {(r.truth, r.predicted): r.n for r in m.collect()} == {(0, 0): 0, (0, 1): 0, (1, 0): 0, (1, 1): 2}
    rep = {r.label: r for r in stratify.classification_report(m).collect()}
    assert rep["low"].precision == 0.0 and rep["high"].f1 == 1.0 and rep["accuracy"].f1 == 1.0
