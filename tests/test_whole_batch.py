import numpy as np
import pytest

from hazardframe.operators import deep_cox, whole_batch as wb
from hazardframe.operators.deep_cox import DeepCox, Network


def table(n=90, features=3, seed=2):
    """Rows with many ties; a third share one time, so that it spans several blocks of a few rows."""
    rng = np.random.default_rng(seed)
    t = np.where(rng.random(n) < 1 / 3, 12.0, rng.integers(1, 25, n)).astype(float)
    return t, (rng.random(n) < 0.6).astype(float), rng.normal(size=(n, features))


def frame(spark, t, e, x):
    return spark.createDataFrame([(float(a), bool(b), [float(v) for v in r]) for a, b, r in zip(t, e, x)], "time double, event boolean, features array<double>")


@pytest.mark.parametrize("hidden", [[], [4], [5, 3], [4, 4, 2]])
@pytest.mark.parametrize("block_rows", [7, 1000])
def test_a_step_is_that_of_one_batch_with_all_rows(spark, hidden, block_rows):
    t, e, x = table()
    net = Network(3, hidden)
    w = net.start(3)
    want = net.train_batch(w, x, t, e)
    blocks = wb.time_blocks(frame(spark, t, e, x).repartition(5), block_rows)
    assert blocks.count() == -(-len(t) // block_rows)
    got = wb.exact_step(blocks, net, w, 0.0, [1, 0], deep_cox.MOMENTUM)
    assert got[0] == pytest.approx(want[0], rel=1e-10)
    assert np.allclose(got[1], want[1], rtol=1e-8, atol=1e-10) and np.allclose(got[2], want[2], rtol=1e-8, atol=1e-10)


def dense(model, t, e, x, epochs):
    """The same training in one process."""
    net = model.network
    w, m, v, losses = net.start(model.seed), np.zeros(net.trainable), np.zeros(net.trainable), []
    for k in range(1, epochs + 1):
        loss, grad, stats = net.train_batch(w, x, t, e)
        grad = grad + model.weight_decay * w[:net.trainable]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w[:net.trainable] -= model.lr * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.999 ** k)) + 1e-8)
        w[net.trainable:] = stats
        losses.append(loss)
    return w, losses


def test_a_fit_is_the_dense_one_whatever_the_partitions(spark, monkeypatch):
    t, e, x = table(70)
    want, losses = dense(DeepCox(["a", "b", "c"], [4, 3], 0.0, 1e-2), t, e, x, 12)
    for parts, rows in ((2, 11), (8, 4096)):
        monkeypatch.setattr(deep_cox, "time_blocks", lambda df, rows=rows: wb.time_blocks(df, rows))
        got = DeepCox(["a", "b", "c"], [4, 3], 0.0, 1e-2).fit(frame(spark, t, e, x).repartition(parts), 12, None)
        assert np.allclose(got.weights, want, rtol=1e-8, atol=1e-8) and got.losses == pytest.approx(losses, abs=1e-8)
    assert losses[-1] < losses[0]


def test_dropout_masks_are_the_same_in_every_pass(spark):
    """With dropout the derivative still is that of the loss: compared with a difference of losses under the same masks."""
    t, e, x = table(40)
    net = Network(3, [4])
    blocks = wb.time_blocks(frame(spark, t, e, x), 16)
    w = net.start(5)
    step = lambda v: wb.exact_step(blocks, net, v, 0.3, [9, 1], 0.1)
    loss, grad, _ = step(w)
    for k in (0, 7, net.trainable - 2):
        moved = w.copy()
        moved[k] += 1e-5
        assert (step(moved)[0] - loss) / 1e-5 == pytest.approx(grad[k], abs=2e-4)


def test_scores_of_any_size_stay_finite(spark):
    t, e, x = table(30)
    net = Network(3, [])
    w = net.start(1) * 4000
    loss, grad, _ = wb.exact_step(wb.time_blocks(frame(spark, t, e, x), 8), net, w, 0.0, [1, 0], 0.1)
    eta = x @ w[:3] + w[3]
    total = np.array([np.logaddexp.reduce(eta[t >= s]) for s in t])
    shares = np.array([[np.exp(eta[j] - total[i]) if t[j] >= t[i] else 0.0 for j in range(30)] for i in range(30)])
    d_eta = -(e - e @ shares) / e.sum()
    assert loss == pytest.approx(-np.sum(e * (eta - total)) / e.sum(), rel=1e-7) and np.allclose(grad[:3], x.T @ d_eta, atol=1e-7)


def test_missing_times_are_refused(spark):
    df = spark.createDataFrame([(None, True, [1.0])], "time double, event boolean, features array<double>")
    with pytest.raises(Exception, match="a time is missing"):
        wb.time_blocks(df).collect()
