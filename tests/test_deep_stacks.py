import numpy as np
import pyarrow as pa

from hazardframe.operators import deep_cox as dc


def _packed(sizes, p=3, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(rng.integers(1, 9, n).astype(float), (rng.random(n) < 0.6).astype(float), rng.normal(size=(n, p))) for n in sizes]
    columns = [pa.array([v.ravel().tolist() for v in c]) for c in zip(*rows)]
    return rows, pa.record_batch([pa.array(range(100, 100 + len(sizes)), pa.int64()), *columns], names=["batch", "time", "event", "features"])


def test_mini_batches_of_one_size_are_computed_together():
    sizes = [5, 7, 5, 1] * 300
    rows, packed = _packed(sizes)
    stacks = list(dc._stacks(packed, 4))
    assert len(stacks) < 10
    found = {k: (t[i], e[i], x[i]) for number, t, e, x in stacks for i, k in enumerate(number)}
    assert sorted(found) == list(range(100, 1300))
    for k, parts in found.items():
        for got, want in zip(parts, rows[k - 100]):
            np.testing.assert_array_equal(got, want)


def test_a_stack_gives_the_sums_of_its_mini_batches():
    rows, packed = _packed([6] * 40)
    net = dc.Network(3, [5, 4])
    w = net.start(1)
    (number, t, e, x), = dc._stacks(packed, 5)
    generators = lambda: [np.random.default_rng([7, k]) for k in number]
    loss, grad, stats = net.train_batches(w, x, t, e, 0.3, generators())
    each = [net.train_batch(w, a, b, c, 0.3, r) for (b, c, a), r in zip(rows, generators())]
    np.testing.assert_allclose(loss, sum(v[0] for v in each))
    np.testing.assert_allclose(grad, sum(v[1] for v in each), atol=1e-12)
    np.testing.assert_allclose(stats, sum(v[2] for v in each))
