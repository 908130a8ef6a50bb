import numpy as np
import pytest

from hazardframe.operators.cox_likelihood import TrainSet
from hazardframe.operators.fold_statistics import set_medians, set_moments

NAMES = ["plain", "tied", "constant", "heavy"]
SETS = [TrainSet(), *[TrainSet(((0, f),)) for f in range(4)], *[TrainSet(((0, f), (1, g))) for f in range(4) for g in range(3)]]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    n = 3000
    x = np.stack([rng.normal(1e4, 2.0, n), rng.integers(0, 5, n).astype(float), np.full(n, 7.25),
                  np.where(rng.random(n) < 0.45, 3.5, rng.lognormal(1.2, 2.0, n))], axis=1)
    x[rng.random(x.shape) < 0.1] = np.nan
    folds = np.stack([rng.integers(0, 4, n), rng.integers(0, 3, n)], axis=1)
    data = [([None if np.isnan(v) and k % 2 else float(v) for k, v in enumerate(a)], [int(f) for f in b]) for a, b in zip(x, folds)]
    return spark.createDataFrame(data, "features array<double>, folds array<int>").repartition(5), x, folds


@pytest.mark.parametrize("bins, max_group", [(None, 10**6), (8, 10**6), (8, 20)])
def test_medians_and_moments_of_all_sets(rows, bins, max_group):
    df, x, folds = rows
    medians = set_medians(df, SETS, NAMES, bins=bins, max_group=max_group)
    want = [np.nanmedian(x[s.rows(folds, len(x))], axis=0) for s in SETS]
    assert np.array_equal(medians, want)
    means, deviations = set_moments(df, SETS, medians)
    for s, m, mean, deviation in zip(SETS, want, means, deviations):
        part = x[s.rows(folds, len(x))]
        full = np.where(np.isnan(part), m, part)
        assert np.allclose(mean, full.mean(axis=0), rtol=1e-12)
        sd = full.std(axis=0)
        sd[2] = 1.0
        assert np.allclose(deviation, sd, rtol=1e-9)


def test_a_set_of_one_other_value_is_constant(spark):
    df = spark.createDataFrame([([0.1 * k], [0]) for k in range(9)] + [([1e3 / 3], [1])] * 8, "features array<double>, folds array<int>")
    sets = [TrainSet(((0, 1),)), TrainSet(((0, 0),))]
    medians = set_medians(df, sets, ["a"])
    assert medians == [[0.4], [1e3 / 3]]
    assert set_moments(df, sets, medians)[1][1] == [1.0]


def test_no_values_and_no_columns(spark):
    df = spark.createDataFrame([([None, 1.0], [0]), ([2.0, 1.0], [1])], "features array<double>, folds array<int>")
    with pytest.raises(ValueError, match="a"):
        set_medians(df, [TrainSet(), TrainSet(((0, 1),))], ["a", "b"])
    empty = df.limit(0)
    with pytest.raises(ValueError, match="a"):
        set_medians(empty, [TrainSet()], ["a", "b"])
    assert set_medians(df, [TrainSet()], []) == [[]] and set_moments(df, [TrainSet()], [[]]) == ([[]], [[]])
