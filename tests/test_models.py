import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hazardframe.operators import cox_likelihood as cl, deep_cox as dc, lasso_cox as lc, splits
from tests_support import brute_c_index, dense_gradient, dense_lasso


def make(spark, n=240, p=5, seed=0, parts=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    x = (x - x.mean(0)) / x.std(0)
    t = np.ceil(rng.exponential(size=n) * np.exp(-x[:, 0] + 0.5 * x[:, 1]) * 20)
    e = rng.random(n) < 0.7
    rows = [(i, float(t[i]), bool(e[i]), [float(v) for v in x[i]]) for i in range(n)]
    df = spark.createDataFrame(rows, "sid long, time double, event boolean, features array<double>").repartition(parts)
    return df.cache(), x, t, e


@pytest.fixture(scope="module")
def data(spark):
    return make(spark)


def test_lasso_is_optimal_and_matches_a_dense_solver(data):
    df, x, t, e = data
    names = [f"f{j}" for j in range(x.shape[1])]
    m = lc.LassoCox(names, 0.05).fit(df)
    beta = np.asarray(m.coefficients)
    gap = lc.kkt_gap(dense_gradient(x, t, e, beta), beta, np.full(len(beta), 0.05))
    assert gap.max() < 1e-5
    np.testing.assert_allclose(beta, dense_lasso(x, t, e, 0.05), atol=1e-4)
    h = m.baseline.orderBy("time").toPandas().cum_hazard
    assert (h.diff().dropna() >= -1e-15).all()


def test_joined_curves_and_working_set_reach_the_same_optimum(data):
    df, x, t, e = data
    w = [1.0] * x.shape[1]
    plain = lc.fit_models(df, [cl.TrainSet()], [0.05], w, 1e-8)
    joined = lc.fit_models(df, [cl.TrainSet()], [0.05], w, 1e-8, likelihood=cl.Likelihood(df, max_curve_cells=1))
    narrow = lc.fit_models(df, [cl.TrainSet()], [0.05], w, 1e-8, working_set=2)
    np.testing.assert_allclose(joined, plain, atol=1e-6)
    np.testing.assert_allclose(narrow, plain, atol=1e-6)


def test_more_features_than_rows(spark):
    df, x, t, e = make(spark, n=40, p=60, seed=3)
    beta = lc.fit_models(df, [cl.TrainSet()], [0.1], [1.0] * 60, 1e-7, working_set=20)[0, 0]
    assert lc.kkt_gap(dense_gradient(x, t, e, beta), beta, np.full(60, 0.1)).max() < 1e-5
    assert 0 < (beta != 0).sum() < 40


def test_unpenalised_columns_stay_in(data):
    df, x, t, e = data
    w = lc.penalty_weights(["stage", "gender", "hist_a", "r1", "r2"], ["stage", "gender"], "hist")
    assert w == [0.0, 0.0, 0.0, 2.5, 2.5]
    assert lc.penalty_weights(["a", "b"], ["a"], rescale=False) == [0.0, 1.0]
    beta = lc.fit_models(df, [cl.TrainSet()], [5.0], w)[0, 0]
    assert (beta[:3] != 0).all() and (beta[3:] == 0).all()


def test_grid_search_equals_serial_fits(spark, data):
    df, x, t, e = data
    names, alphas = [f"f{j}" for j in range(5)], [0.05, 0.3, 5.0]
    found = lc.grid_search(df, names, alphas, 3, 2, tol=1e-8, max_iter=80)
    folds = {r.sid: r.folds for r in splits.kfold(df, ["sid"], 3, 2).select("sid", "folds").collect()}
    for r in range(2):
        for f in range(3):
            inside = np.asarray([folds[i][r] != f for i in range(len(t))])
            for a, alpha in enumerate(alphas):
                beta = dense_lasso(x[inside], t[inside], e[inside], alpha)
                want = brute_c_index(t[~inside], e[~inside], x[~inside] @ beta)
                assert found.fold_scores[(r * 3 + f, a)] == pytest.approx(want, abs=2e-3)
    table = found.table(spark).collect()
    assert found.best_alpha == alphas[int(np.argmax([x.mean_score for x in table]))]
    assert table[2].mean_score == 0.5  # all coefficients zero: every pair is tied


def test_first_of_equal_alphas_wins():
    g = lc.GridSearch([0.1, 0.2], {(0, 0): 0.7, (0, 1): 0.7}, 1)
    assert g.best_alpha == 0.1


def test_a_fold_that_cannot_be_scored_counts_half():
    g = lc.GridSearch([0.1], {(0, 0): 0.9}, 2)
    assert g._row(0).tolist() == [0.9, 0.5]


def test_nested_cv_rows_and_ranges(data):
    df = data[0].withColumn("features", F.transform("features", lambda v, i: F.when((i == 2) & (v > 1.5), None).otherwise(v)))
    rows = lc.nested_cv(df, [f"f{j}" for j in range(5)], [0.05, 0.2], 2, 1).collect()
    assert [(r.repeat, r.fold) for r in rows] == [(0, 0), (0, 1)]
    assert all(0.5 < r.train_score <= 1 and 0.5 < r.test_score <= 1 and r.alpha in (0.05, 0.2) for r in rows)
    s = lc.cv_summary(data[0].sparkSession.createDataFrame(rows)).first()
    assert s.mean_score == pytest.approx(np.mean([r.test_score for r in rows]))
    assert s.std_score == pytest.approx(np.std([r.test_score for r in rows]))


def test_models_need_a_fit(spark, data):
    for m in (lc.LassoCox(["a"], 0.1), dc.DeepCox(["a"])):
        with pytest.raises(ValueError):
            m.score(data[0])


def test_existing_scores_are_reused_and_models_survive_storage(spark, data, tmp_path):
    df = data[0]
    m = lc.LassoCox([f"f{j}" for j in range(5)], 0.05).fit(df)
    assert m.score(df.withColumn("risk_score", F.lit(7.0))).first().risk_score == 7.0
    sel = m.selected_features(spark).collect()
    assert [abs(r.coefficient) for r in sel] == sorted([abs(r.coefficient) for r in sel], reverse=True)
    assert all(r.hazard_ratio == pytest.approx(np.exp(r.coefficient)) for r in sel)
    m.save(str(tmp_path / "m"))
    back = lc.LassoCox.load(spark, str(tmp_path / "m"))
    assert back.coefficients == m.coefficients and back.baseline.count() == m.baseline.count()


def test_losses_on_a_known_batch_and_with_ties(spark):
    rows = [("b", 1, 120.0, True, 0.5), ("b", 2, 80.0, False, -0.2), ("b", 3, 30.0, True, 1.1)]
    df = spark.createDataFrame(rows, "g string, sid long, time double, event boolean, eta double")
    for ties in ("breslow", "rowwise"):
        got = cl.negative_log_likelihood(df, "time", "event", "eta", ["g"], ties, "sid").first().loss
        assert got == pytest.approx(0.2997871868, abs=1e-9)
    loss, _ = dc.cox_loss_gradient(np.array([.5, -.2, 1.1]), np.array([120., 80, 30]), np.array([1., 0, 1]))
    assert loss == pytest.approx(0.2997871868, abs=1e-9)
    with pytest.raises(ValueError):
        cl.negative_log_likelihood(df, "time", "event", "eta", ties="rowwise")


def test_network_gradient_matches_finite_differences():
    net, rng = dc.Network(5, [4, 3]), np.random.default_rng(0)
    v, x = net.start(1), rng.normal(size=(20, 5))
    t, e = rng.integers(1, 8, 20).astype(float), (rng.random(20) < .6).astype(float)
    grad = net.train_batch(v, x, t, e)[1]
    for i in range(len(grad)):
        step = np.zeros_like(v)
        step[i] = 1e-5
        want = (net.train_batch(v + step, x, t, e)[0] - net.train_batch(v - step, x, t, e)[0]) / 2e-5
        assert grad[i] == pytest.approx(want, abs=1e-7)


def test_deep_training_learns_and_ignores_partitioning(spark, data, tmp_path):
    df, x, t, e = data
    fit = lambda d: dc.DeepCox([f"f{j}" for j in range(5)], [6], 0.1, 1e-2).fit(d, 8, 32, steps_per_epoch=4)
    a = fit(df)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        b = fit(df.repartition(7))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    np.testing.assert_allclose(a.weights, b.weights, rtol=1e-9)
    assert a.losses[-1] < a.losses[0] and len(a.losses) == 8
    eta = {r.sid: r.risk_score for r in a.score(df).collect()}
    assert brute_c_index(t, e, np.asarray([eta[i] for i in range(len(t))])) > 0.65
    a.save(str(tmp_path / "d"))
    back = dc.DeepCox.load(spark, str(tmp_path / "d"))
    assert {r.sid: r.risk_score for r in back.score(df).collect()} == eta
    assert a.loss_history(spark).count() == 8


@pytest.mark.parametrize("batch_size", [10**6, 32])
def test_a_step_is_the_mean_gradient_of_all_batches(spark, data, batch_size):
    df, x, t, e = data
    m = dc.DeepCox([f"f{j}" for j in range(5)], [4], 0.0, 1e-2, 0.01).fit(df, 3, batch_size)
    net, n_batches = m.network, max(1, len(t) // batch_size)
    place = {r.sid: r.place for r in df.withColumn("copy", F.lit(0).cast("long")).withColumn("ev", F.col("event").cast("double")).select(
        "sid", F.xxhash64("time", "ev", "features", "copy", F.lit(42)).alias("place")).collect()}
    order = sorted(range(len(t)), key=lambda i: place[i])
    parts = [[i for i in order if place[i] % n_batches == b] for b in range(n_batches)]
    w, mom, vel = net.start(42), np.zeros(net.trainable), np.zeros(net.trainable)
    for step in range(1, 4):
        got = [(len(p), *net.train_batch(w, x[p], t[p], e[p].astype(float))) for p in parts if p]
        g = sum(n * g for n, _, g, _ in got) / len(t) + 0.01 * w[:net.trainable]
        mom, vel = 0.9 * mom + 0.1 * g, 0.999 * vel + 0.001 * g * g
        w[:net.trainable] -= 1e-2 * (mom / (1 - 0.9 ** step)) / (np.sqrt(vel / (1 - 0.999 ** step)) + 1e-8)
        w[net.trainable:] = sum(n * s for n, _, _, s in got) / len(t)
        assert m.losses[step - 1] == pytest.approx(sum(n * v for n, v, _, _ in got) / len(t))
    np.testing.assert_allclose(m.weights, w, rtol=1e-9, atol=1e-12)


def test_a_fit_that_runs_out_of_steps_is_an_error(data):
    df = data[0]
    with pytest.raises(lc.NotConverged):
        lc.LassoCox([f"f{j}" for j in range(5)], 0.01).fit(df, max_iter=2)


def test_joined_curves_are_cut_into_ranges(data, monkeypatch):
    df = data[0]
    like = cl.Likelihood(df, max_curve_cells=1)
    monkeypatch.setattr(cl, "range_bounds", lambda *a, **k: [2.0, 5.0, 9.0])
    one = cl.Models([cl.TrainSet()], np.zeros(1, dtype=int), np.full((1, 5), 0.3))
    got, want = like.evaluate(one), cl.Likelihood(df).evaluate(one)
    assert like.bounds == [2.0, 5.0, 9.0]
    np.testing.assert_allclose(got["gradient"][0], want["gradient"][0], rtol=1e-9)
    assert got["loglik"][0] == pytest.approx(want["loglik"][0])


def test_copies_of_one_row_are_spread(spark):
    rows = [(1.0, 1.0, [0.5])] * 9000 + [(2.0, 0.0, [0.1])] * 10
    df = spark.createDataFrame(rows, "time double, event double, features array<double>")
    numbered = dc._numbered(df, block=1000)
    assert numbered.count() == 9010 and numbered.distinct().count() == 9010
    shards = numbered.groupBy(F.pmod(F.xxhash64("time", "event", "features", "copy", F.lit(42)), F.lit(4)).alias("s")).count().collect()
    assert len(shards) == 4 and max(r["count"] for r in shards) < 2600
