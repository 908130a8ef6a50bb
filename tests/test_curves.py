import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hazardframe.operators import curves, residuals

# Known curves of the fifteen subjects: time, at risk, survival, censoring survival, Nelson-Aalen.
EXPECTED = [(5, 15, .933333, 1, .066667), (8, 14, .866667, 1, .138095), (10, 13, .8, 1, .215018), (12, 12, .733333, 1, .298352),
            (15, 11, .666667, 1, .389261), (19, 10, .6, 1, .489261), (22, 9, .533333, 1, .600372), (25, 8, .466667, 1, .725372),
            (30, 7, .4, 1, .868229), (34, 6, .4, .833333, .868229), (40, 5, .4, .666667, .868229), (45, 4, .4, .5, .868229),
            (50, 3, .4, .333333, .868229), (55, 2, .4, .166667, .868229), (60, 1, .4, 0, .868229)]


@pytest.fixture(scope="module")
def cohort(spark, survival_rows):
    return spark.createDataFrame(survival_rows, "sid string, time double, event boolean").withColumn("zero", F.lit(0.0))


@pytest.mark.parametrize("rows_per_range", [3, 1000])
def test_known_curves(cohort, rows_per_range):
    km = curves.km_curve(cohort, "time", "event", rows_per_range=rows_per_range).orderBy("time").collect()
    assert (km[0].time, km[0].survival, km[0].n_risk) == (0.0, 1.0, 15)
    g = curves.censoring_curve(cohort, "time", "event", rows_per_range=rows_per_range).orderBy("time").collect()
    h = curves.breslow_baseline(cohort, "time", "event", "zero", rows_per_range=rows_per_range).orderBy("time").collect()
    for row, (t, n, s, c, na) in enumerate(EXPECTED):
        assert (km[row + 1].time, km[row + 1].n_risk) == (t, n)
        assert km[row + 1].survival == pytest.approx(s, abs=1e-6)
        assert g[row].censoring_survival == pytest.approx(c, abs=1e-6)
        assert h[row].cum_hazard == pytest.approx(na, abs=1e-6)


def test_confidence_band_contains_the_curve(cohort):
    for r in curves.km_curve(cohort, "time", "event", confidence=True).collect():
        assert r.ci_lower <= r.survival <= r.ci_upper


def test_step_lookup_sides_and_ends(spark):
    curve = spark.createDataFrame([(10.0, 1.0), (20.0, 0.8), (30.0, 0.5), (40.0, 0.2)], "t double, v double")
    df = spark.createDataFrame([(x,) for x in (5.0, 10.0, 25.0, 50.0)] + [(None,)], "x double")
    for plan in (1000, 0):  # sorted arrays, and the merged plan for large curves
        got = lambda side, **k: {r.x: r.v for r in curves.curve_lookup(df, curve, "x", "t", "v", "v", side, max_curve_rows=plan, **k).collect()}
        assert got("forward") == {5.0: 1.0, 10.0: 1.0, 25.0: 0.5, 50.0: 0.2, None: None}
        assert got("backward") == {5.0: 1.0, 10.0: 1.0, 25.0: 0.8, 50.0: 0.2, None: None}
        assert got("backward", before=9.0)[5.0] == 9.0
    with pytest.raises(ValueError):
        curves.curve_lookup(df, curve, "x", "t", "v", "v", "nearest")


def test_merged_lookup_equals_broadcast_lookup_per_group(spark):
    rng = np.random.default_rng(3)
    curve = pd.DataFrame({"g": np.repeat(["a", "b", None], 40), "t": np.tile(np.sort(rng.permutation(200)[:40]), 3).astype(float)})
    curve["v"] = rng.random(120)
    df = pd.DataFrame({"g": rng.choice(["a", "b", None, "absent"], 600), "x": np.where(rng.random(600) < .4, 77.0, rng.integers(-5, 220, 600))})
    c, d = spark.createDataFrame(curve, "g string, t double, v double"), spark.createDataFrame(df, "g string, x double")
    for side in ("backward", "forward"):
        frames = [curves.curve_lookup(d, c, "x", "t", "v", "v", side, ["g"], max_curve_rows=m, rows_per_range=20).toPandas()
                  .fillna({"g": "-"}).sort_values(["g", "x", "v"]).reset_index(drop=True) for m in (1000, 0)]
        pd.testing.assert_frame_equal(*frames)


def test_grid_values(spark):
    curve = spark.createDataFrame([(10.0, 1.0), (20.0, 0.8), (30.0, 0.5)], "t double, v double")
    assert curves.grid_values(curve, "t", "v", [5.0, 10.0, 29.9, 30.0, 99.0]) == [1.0, 1.0, 0.8, 0.5, 0.5]
    assert curves.grid_values(curve, "t", "v", [5.0, 10.0], before=7.0) == [7.0, 1.0]
    assert curves.grid_values(curve, "t", "v", [5.0, 10.0, 20.1, 99.0], "forward") == [1.0, 1.0, 0.5, 0.5]


def test_median_survival_is_the_first_crossing(cohort):
    df = cohort.withColumn("eta", F.col("time") / 50 - 0.5)
    base = curves.breslow_baseline(df, "time", "event", "eta").toPandas().sort_values("time")
    got = residuals.median_survival(df, curves.breslow_baseline(df, "time", "event", "eta"), "eta").collect()
    for r in got:
        s = np.exp(-base.cum_hazard.to_numpy() * math.exp(r.eta))
        below = np.nonzero(s <= 0.5)[0]
        want = base.time.iloc[below[0]] if len(below) else base.time.iloc[-1]
        assert r.predicted_days == want
        assert r.predicted_months == pytest.approx(want / 30.437)


def test_residual_identities(cohort):
    df = cohort.withColumn("eta", F.col("time") / 50 - 0.5)
    base = curves.breslow_baseline(df, "time", "event", "eta")
    rows = residuals.flag_outliers(residuals.diagnostic_residuals(df, base, "time", "event", "sid", "eta")).collect()
    assert sum(r.martingale for r in rows) == pytest.approx(0, abs=1e-9)
    for r in rows:
        assert r.martingale <= 1 and r.cum_hazard >= 1e-7
        inner = r.martingale + (math.log(r.cum_hazard) if r.event else 0.0)
        assert r.deviance == pytest.approx(np.sign(r.martingale) * math.sqrt(max(-2 * inner, 0)), abs=1e-9)
        assert r.is_outlier == (abs(r.deviance) > 2)
    with pytest.raises(ValueError):
        residuals.time_residuals(df, "time", "event", "sid", "eta")


def test_error_summary_without_events(cohort):
    df = cohort.withColumns({"eta": F.lit(0.0), "predicted_days": F.lit(1.0), "predicted_months": F.lit(1.0), "event": F.lit(False)})
    row = residuals.error_summary(residuals.time_residuals(df, "time", "event", "sid", "eta")).first()
    assert row.n_events == 0 and row.mae_days is None and row.rmse_months is None


FLAT = [(1.0, 0.1), (1.0, 0.2), (2.0, 0.3), (3.0, 0.3), (4.0, 0.3), (4.0, 0.4), (float("nan"), 9.0), (5.0, None), (None, 1.0)]
ASKED = [0.0, 0.5, 1.0, 1.5, 2.0, 3.5, 4.0, 4.5, 99.0, float("nan"), None]


@pytest.mark.parametrize("side, before, want", [
    ("backward", None, [0.1, 0.1, 0.2, 0.2, 0.3, 0.3, 0.4, 0.4, 0.4, None, None]),
    ("backward", 0.0, [0.0, 0.0, 0.2, 0.2, 0.3, 0.3, 0.4, 0.4, 0.4, None, None]),
    ("forward", None, [0.1, 0.1, 0.1, 0.3, 0.3, 0.3, 0.3, 0.4, 0.4, None, None])])
@pytest.mark.parametrize("rows", [1_000_000, 0])
def test_both_plans_agree_on_flat_ends_and_missing_numbers(spark, side, before, want, rows):
    curve = spark.createDataFrame([(a, *p) for a in ("x", None) for p in FLAT], "a string, at double, value double")
    asked = spark.createDataFrame([(a, i, v) for a in ("x", None, "none") for i, v in enumerate(ASKED)], "a string, i int, v double")
    one = curves.curve_lookup(asked, curve, "v", "at", "value", "found", side, ["a"], before, rows).collect()
    got = {(r.a, r.i): r.found for r in one}
    assert len(one) == 3 * len(ASKED)
    assert [got["x", i] for i in range(len(ASKED))] == want == [got[None, i] for i in range(len(ASKED))]
    assert all(got["none", i] is None for i in range(len(ASKED)))
    by = {"b": F.lit(1), "c": F.lit("y"), "d": F.lit(None).cast("int")}
    more = curves.curve_lookup(asked.withColumns(by), curve.withColumns({**by, "b": F.lit(1).cast("long")}), "v", "at", "value", "found", side, ["a", *by], before, rows)
    assert {(r.a, r.i): r.found for r in more.collect()} == got
    none = curves.curve_lookup(asked, curve.limit(0), "v", "at", "value", "found", side, ["a"], before, rows)
    assert none.where("found IS NOT NULL").count() == 0


@pytest.mark.parametrize("rows", [1_000_000, 0])
def test_forward_past_the_end_gives_the_last_curve_time(spark, rows):
    curve = spark.createDataFrame([(1.0, .1), (2.0, .3), (3.0, .3), (4.0, .3)], "time double, h double")
    asked = spark.createDataFrame([(0.5,), (0.3,)], "need double")
    got = {r.need: r.t for r in curves.curve_lookup(asked, curve, "need", "h", "time", "t", "forward", max_curve_rows=rows).collect()}
    assert got == {0.5: 4.0, 0.3: 2.0}


@pytest.mark.parametrize("side", ["backward", "forward"])
@pytest.mark.parametrize("rows_per_range", [7, 100_000])
def test_merged_lookup_with_one_x_in_most_rows(spark, side, rows_per_range):
    """Both plans agree, row for row, where 90 % of the rows ask at one x; nulls, NaN and groups without a curve included."""
    rng = np.random.default_rng(6)
    rows = [(i, "a" if i % 5 else "b", 3.0 if rng.random() < 0.9 else float(rng.integers(-1, 9))) for i in range(400)]
    rows += [(1000, "a", None), (1001, "b", float("nan")), (1002, "none", 3.0), (1003, None, 2.0)]
    curve = [("a", float(t), float(t * t)) for t in range(0, 8, 2)] + [("b", 3.0, 1.0), ("b", 3.0, 5.0), ("b", 5.0, 7.0), (None, 1.0, 4.0)]
    df, c = spark.createDataFrame(rows, "id int, g string, x double"), spark.createDataFrame(curve, "g string, t double, v double")
    for before in (None, -1.0):
        read = lambda most: {r.id: r.out for r in curves.curve_lookup(df, c, "x", "t", "v", "out", side, ["g"], before, most, rows_per_range).collect()}
        assert read(0) == read(10_000) and len(read(0)) == 404
