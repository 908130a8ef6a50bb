import numpy as np
import pyarrow as pa

from hazardframe.operators import cox_likelihood as cl


def test_blocks_are_small_however_many_models():
    batch = pa.record_batch({"time": np.arange(10_000.0)})
    parts = list(cl._sliced([batch, batch.slice(0, 0)], 3000))
    assert max(p.num_rows for p in parts) * 3000 <= cl.BLOCK_CELLS
    assert np.concatenate([p.column("time").to_numpy() for p in parts]).tolist() == list(range(10_000))


def test_sums_per_time_of_many_blocks():
    rng = np.random.default_rng(0)
    t, rows = rng.integers(0, 50, 900).astype(float), rng.normal(size=(900, 4))
    times = sums = None
    for at in range(0, 900, 70):
        times, sums = cl._merge_times(t[at:at + 70], rows[at:at + 70], times, sums)
    assert times.tolist() == sorted(set(t))
    np.testing.assert_allclose(sums, [rows[t == v].sum(axis=0) for v in times], atol=1e-12)
