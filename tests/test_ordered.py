import hashlib

import numpy as np
import pandas as pd
import pytest

from hazardframe.operators import ordered
from hazardframe.session import settle


def test_range_of_counts_boundaries(spark):
    from pyspark.sql import functions as F
    bounds = [float(b) for b in np.unique(np.random.default_rng(0).normal(size=37))]
    xs = [float(x) for x in np.linspace(-4, 4, 200)] + bounds
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", ordered.range_of(F.col("x"), bounds).alias("k")).collect()
    assert all(r.k == np.searchsorted(bounds, r.x, side="right") for r in got)


@pytest.mark.parametrize("rows_per_range", [10, 10_000])
@pytest.mark.parametrize("descending", [False, True])
def test_running_matches_pandas_with_one_group_holding_most_rows(spark, rows_per_range, descending):
    rng = np.random.default_rng(1)
    n = 400
    pdf = pd.DataFrame({"g": ["hot" if i % 4 else f"g{i % 12}" for i in range(n)], "t": rng.permutation(n).astype(float),
                        "v": rng.normal(size=n), "q": rng.uniform(0.9, 1.0, n),
                        "w": [None if i % 3 else float(i) for i in range(n)]})
    rows = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in pdf.itertuples(index=False)]
    df, count = settle(spark.createDataFrame(rows, "g string, t double, v double, q double, w double"))
    bounds = ordered.range_bounds(df, "t", count, rows_per_range)
    assert bool(bounds) == (rows_per_range == 10)
    got = ordered.running(df, ["g"], "t", {"s": ("sum", "v"), "p": ("product", "q"), "l": ("last", "w"), "m": ("max", "v")},
                          descending, bounds).toPandas().sort_values("t").reset_index(drop=True)
    want = pdf.sort_values("t", ascending=not descending)
    want["s"] = want.groupby("g").v.cumsum()
    want["p"] = want.groupby("g").q.cumprod()
    want["l"] = want.groupby("g").w.ffill()
    want["m"] = want.groupby("g").v.cummax()
    want = want.sort_values("t").reset_index(drop=True)
    for c in ("s", "p", "l", "m"):
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9)


@pytest.mark.parametrize("descending", [False, True])
def test_running_takes_values_that_cut_the_key(spark, descending):
    df = spark.createDataFrame([("a" if i % 3 else "b", float(i), float(i)) for i in range(30)], "g string, t double, v double")
    got = ordered.running(df, ["g"], "t", {"s": ("sum", "v")}, descending, [4.0, 5.0, 5.5, 21.0]).collect()
    want = lambda r: sum(x for x in range(30) if ("a" if x % 3 else "b") == r.g and (x >= r.t if descending else x <= r.t))
    assert len(got) == 30 and all(r.s == want(r) for r in got)


def test_running_keeps_null_groups_apart(spark):
    df, n = settle(spark.createDataFrame([(None, float(i), 1.0) for i in range(50)] + [("a", float(i), 2.0) for i in range(50)],
                                         "g string, t double, v double"))
    got = ordered.running(df, ["g"], "t", {"s": ("sum", "v")}, bounds=ordered.range_bounds(df, "t", n, 10))
    assert got.count() == 100
    assert {r.g: r.s for r in got.where("t = 49").collect()} == {None: 50.0, "a": 100.0}


@pytest.mark.parametrize("rows_per_range", [25, 10_000])
def test_quantiles_are_exact_with_heavy_ties(spark, rows_per_range):
    rng = np.random.default_rng(2)
    x = np.where(rng.random(900) < 0.4, 3.0, np.round(rng.normal(size=900) * 10, 1))
    g = np.where(rng.random(900) < 0.6, "a", "b")
    df = spark.createDataFrame(pd.DataFrame({"g": g, "x": x}))
    got = ordered.quantiles(df, "x", {"p10": 0.1, "m": 0.5, "p90": 0.9}, ["g"], rows_per_range).toPandas().set_index("g")
    for k in ("a", "b"):
        np.testing.assert_allclose(got.loc[k, ["p10", "m", "p90"]].astype(float), np.quantile(x[g == k], [0.1, 0.5, 0.9]), rtol=1e-12)


def test_median_ignores_null_and_nan(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (4.0,), (2.0,), (3.0,)], "x double")
    assert ordered.median_of(df, "x") == 2.5
    assert ordered.median_of(df.where("x > 100 and not isnan(x)"), "x") is None


def test_hash_cuts_give_the_ranked_strings(spark):
    from pyspark.sql import functions as F
    keys = [hashlib.md5(str(i).encode()).hexdigest() for i in range(500)]
    df = spark.range(500).select(F.lit("all").alias("label"), F.md5(F.col("id").cast("string")).alias("h"))
    cuts = ordered.hash_cuts(df, {"all": [0, 1, 250, 500]})
    ranked = sorted(keys)
    assert cuts == {("all", 0): "", ("all", 1): ranked[0], ("all", 250): ranked[249], ("all", 500): ranked[499]}


@pytest.mark.parametrize("digit, most", [(1, 3), (2, 20), (4, 1000)])
def test_radix_selection_narrows_until_prefixes_are_small(spark, monkeypatch, digit, most):
    """Labels of different size, with one string that a third of the rows share."""
    from pyspark.sql import functions as F
    keys = [hashlib.md5(str(i if i % 3 else 0).encode()).hexdigest() for i in range(300)]
    rows = [("a", k) for k in keys] + [("b", k) for k in keys[:40]]
    seen = []
    real = ordered._picked
    monkeypatch.setattr(ordered, "_picked", lambda df, small, length: seen.append((small, length)) or real(df, small, length))
    df = spark.createDataFrame(rows, "label string, h string")
    cuts = ordered.hash_cuts(df, {"a": [0, 1, 77, 150, 300], "b": [1, 40, 0]}, digit, most)
    a, b = sorted(keys), sorted(keys[:40])
    assert cuts == {("a", 0): "", ("a", 1): a[0], ("a", 77): a[76], ("a", 150): a[149], ("a", 300): a[299], ("b", 1): b[0], ("b", 40): b[39], ("b", 0): ""}
    of = {"a": a, "b": b}
    assert all(sum(k.startswith(prefix) for k in of[label]) <= most for small, _ in seen for (label, _), (prefix, _) in small.items())


@pytest.mark.parametrize("descending", [False, True])
def test_thousands_of_ranges_equal_one_window(spark, descending):
    from pyspark.sql import Window as W, functions as F
    df, n = settle(spark.range(3000).select((F.col("id") % 4 == 0).cast("int").alias("g"), F.pmod(F.xxhash64("id"), F.lit(10 ** 9)).cast("double").alias("t"), (F.col("id") % 7).cast("long").alias("v"),
                                            F.when(F.col("id") % 11 == 0, F.col("id")).alias("w")))
    got = ordered.running(df, ["g"], "t", {"s": ("sum", "v"), "m": ("max", "v"), "l": ("last", "w")}, descending, ordered.Places(n, 2))
    w = W.partitionBy("g").orderBy(F.desc("t") if descending else F.asc("t")).rowsBetween(W.unboundedPreceding, W.currentRow)
    want = df.withColumns({"s": F.sum("v").over(w), "m": F.max("v").over(w), "l": F.last("w", ignorenulls=True).over(w)})
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_quantiles_shuffle_only_what_lies_in_the_brackets(spark, monkeypatch):
    from pyspark.sql import functions as F
    df = spark.range(60_000).select((F.col("id") % 3).alias("g"), F.pmod(F.xxhash64("id"), F.lit(10 ** 12)).cast("double").alias("v"))
    sizes = []
    real = ordered.settle
    monkeypatch.setattr(ordered, "settle", lambda d: (lambda r: sizes.append(r[1]) or r)(real(d)))
    got = {r.g: (r.a, r.b) for r in ordered.quantiles(df, "v", {"a": 0.25, "b": 0.9}, ["g"]).collect()}
    pdf = df.toPandas()
    for g in range(3):
        assert got[g] == pytest.approx(tuple(np.quantile(pdf.v[pdf.g == g], [0.25, 0.9])), rel=1e-12)
    assert max(sizes) < 0.01 * 60_000
