"""Event tables, Kaplan-Meier and Breslow curves, and as-of lookups on step curves.

Every curve starts from one aggregate per (group, time); the raw rows are scanned once and never ordered.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import DoubleType

from hazardframe.operators.ordered import ROWS_PER_RANGE, Places, match, match_stats, match_stats_left, positions, range_bounds, running
from hazardframe.session import cut_lineage, settle

Z95 = 1.959963984540054  # fixed value: two-sided 95 % normal quantile
MAX_CURVE_ROWS = 1_000_000


def event_table(df: DataFrame, time: str, event: str, by: list[str] = (),
                rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Per group and distinct time: ``n_event``, ``n_censor`` and ``n_risk`` (subjects with time >= t)."""
    return _event_table(df, time, event, list(by), rows_per_range)[0]


def _event_table(df, time, event, by, rows_per_range):
    e = F.col(event).cast("int")
    counts, n = settle(df.groupBy(*by, F.col(time).cast("double").alias("time")).agg(
        F.sum(e).alias("n_event"), F.sum(1 - e).alias("n_censor"), F.count("*").alias("__m")))
    bounds = range_bounds(counts, "time", n, rows_per_range)
    table = running(counts, by, "time", {"n_risk": ("sum", "__m")}, descending=True, bounds=bounds)
    starts = counts.groupBy(*by).agg(F.sum("__m").alias("n_risk"), F.min("time").alias("__first"))
    return table.drop("__m"), bounds, starts


def km_curve(df: DataFrame, time: str, event: str, by: list[str] = (), confidence: bool = False,
             rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Kaplan-Meier survival per group, with a row at time 0; optionally the 95 % log-log Greenwood band."""
    by = list(by)
    table, bounds, starts = _event_table(df, time, event, by, rows_per_range)
    steps = table.select("*", (1 - F.col("n_event") / F.col("n_risk")).alias("__q"),
                         F.coalesce(F.try_divide(F.col("n_event").cast("double"),
                                                 F.col("n_risk") * (F.col("n_risk") - F.col("n_event"))),
                                    F.lit(0.0)).alias("__v"))
    outputs = {"survival": ("product", "__q")}
    if confidence:
        outputs["__var"] = ("sum", "__v")
    curve = running(steps, by, "time", outputs, bounds=bounds).drop("__q", "__v")
    start = starts.where("__first > 0").select(
        *by, F.lit(0.0).alias("time"), F.lit(0).cast("long").alias("n_event"), F.lit(0).cast("long").alias("n_censor"),
        "n_risk", F.lit(1.0).alias("survival"), *([F.lit(0.0).alias("__var")] if confidence else []))
    curve = curve.unionByName(start)
    if not confidence:
        return curve
    s = F.col("survival")
    inner = (s > 0) & (s < 1)
    log_s = F.ln(F.when(inner, s))
    width = F.lit(Z95) * F.try_divide(F.sqrt("__var"), log_s)
    # ln S is negative, so the width is too: subtracting it lowers the curve.
    band = lambda sign: F.exp(-F.exp(F.ln(-log_s) + sign * width))
    return curve.select("*", F.when(inner, band(-1)).otherwise(s).alias("ci_lower"),
                        F.when(inner, band(1)).otherwise(s).alias("ci_upper")).drop("__var")


def censoring_curve(df: DataFrame, time: str, event: str, by: list[str] = (),
                    rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Kaplan-Meier of the censoring time; at a tie the events leave the risk set first."""
    by = list(by)
    table, bounds, _ = _event_table(df, time, event, by, rows_per_range)
    q = 1 - F.coalesce(F.try_divide(F.col("n_censor"), F.col("n_risk") - F.col("n_event")), F.lit(0.0))
    steps = table.select(*by, "time", "n_risk", "n_censor", q.alias("__q"))
    return running(steps, by, "time", {"censoring_survival": ("product", "__q")}, bounds=bounds).drop("__q")


def risk_set_sums(df: DataFrame, time: str, event: str, score: str, by: list[str] = (),
                  rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Per distinct time: deaths and the sum of exp(score) over everyone still at risk."""
    return _risk_sets(df, time, event, score, list(by), rows_per_range)[0]


def _risk_sets(df, time, event, score, by, rows_per_range):
    sums, n = settle(df.groupBy(*by, F.col(time).cast("double").alias("time")).agg(
        F.sum(F.col(event).cast("int")).alias("n_event"), F.sum(F.exp(F.col(score))).alias("__r")))
    bounds = range_bounds(sums, "time", n, rows_per_range)
    return running(sums, by, "time", {"risk_sum": ("sum", "__r")}, descending=True,
                   bounds=bounds).drop("__r"), bounds


def breslow_baseline(df: DataFrame, time: str, event: str, score: str, by: list[str] = (),
                     rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Baseline cumulative hazard at every distinct time (a constant zero score gives Nelson-Aalen)."""
    by = list(by)
    table, bounds = _risk_sets(df, time, event, score, by, rows_per_range)
    steps = table.withColumn("hazard", F.coalesce(F.try_divide(F.col("n_event").cast("double"), F.col("risk_sum")),
                                                  F.col("n_event").cast("double")))
    return running(steps, by, "time", {"cum_hazard": ("sum", "hazard")}, bounds=bounds)


def _group_key(by: list[str]) -> Column:
    """The grouping columns as one string, with nulls apart from every value; the empty string without columns."""
    return F.to_json(F.struct(*[F.col(b).cast("string").alias(f"k{i}") for i, b in enumerate(by)])) if by else F.lit("")


def curve_lookup(df: DataFrame, curve: DataFrame, x: str, at: str, value: str, out: str, side: str = "backward",
                 by: list[str] = (), before: float | None = None, max_curve_rows: int = MAX_CURVE_ROWS,
                 rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Read a step curve ``(by, at, value)`` at ``x``.

    ``backward`` takes the largest ``at <= x``, of equal ones the largest value; before the curve starts it gives ``before``
    or the first value. ``forward`` takes the smallest ``at >= x``, of equal ones the smallest value. Past the end both
    give the last value: the largest one at the largest ``at``. Curve rows without a number on either axis are left out;
    an ``x`` that is null or NaN, and a group without a curve, give null.

    A curve of at most ``max_curve_rows`` rows (checked) goes to the executors as sorted arrays, and the lookup is then
    row-local, so ``df`` may be a stream. A larger one is merged with the distinct ``x`` values by a running fill. Both
    plans give the same values.
    """
    if side not in ("backward", "forward"):
        raise ValueError(f"side must be 'backward' or 'forward', not {side!r}")
    by = list(by)
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    points = (curve.select(_group_key(by).alias("__key"), number(at).alias("__at"), number(value).alias("__value"))
              .where("__at IS NOT NULL AND __value IS NOT NULL"))
    small = points.limit(max_curve_rows + 1).toPandas()
    if len(small) <= max_curve_rows:
        return df.withColumn(out, _broadcast_lookup(small, side == "backward", before)(_group_key(by), F.col(x).cast("double")))
    return _merged_lookup(df, points, x, out, side == "backward", by, before, rows_per_range)


def _broadcast_lookup(small: pd.DataFrame, backward: bool, before: float | None):
    small = small.sort_values(["__key", "__at", "__value"], kind="stable")
    sides = {k: (small["__at"].to_numpy()[i], small["__value"].to_numpy()[i]) for k, i in small.groupby("__key").indices.items()}

    @F.pandas_udf(DoubleType())
    def lookup(key: pd.Series, x: pd.Series) -> pd.Series:
        out, xs = np.full(len(x), np.nan), x.to_numpy(dtype=float)
        for k, rows in key.groupby(key).indices.items():
            if k not in sides:
                continue
            at, value = sides[k]
            q = xs[rows]
            if backward:
                pos = np.searchsorted(at, q, side="right") - 1
            else:
                pos = np.minimum(np.searchsorted(at, q, side="left"), len(at) - 1)
            found = value[np.maximum(pos, 0)]
            if backward and before is not None:
                found = np.where(pos < 0, before, found)
            out[rows] = np.where(np.isnan(q), np.nan, found)
        result = pd.Series(out)
        return result.where(result.notna(), None)

    return lookup


def _merged_lookup(df, points, x, out, backward, by, before, rows_per_range):
    """Rows and curve in one order, cut into the same ranges; each range is filled once, from the value carried into it.

    Rows go through whole, so nothing is joined back, and very many rows at one ``x`` are as many places as any others.
    """
    asked = F.col(x).cast("double")
    real = asked.isNotNull() & ~F.isnan(asked)
    names = df.columns
    row = df.select(_group_key(by).alias("__key"), F.when(real, asked).alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast("double").alias("__value"),
                    F.struct(*names).alias("__row"))
    collapse = F.max if backward else F.min
    curve = points.groupBy("__key", "__at").agg(collapse("__value").alias("__value")).withColumn("__kind", F.lit(0))
    merged = row.unionByName(curve, allowMissingColumns=True).withColumn("__turned", F.col("__at") if backward else -F.col("__at"))
    merged, n = settle(merged.drop("__at"))
    order = ["__turned", "__kind"]  # at one place the curve comes first
    if n <= rows_per_range:
        place = W.partitionBy("__key").orderBy(*[F.col(c).asc_nulls_first() for c in order])
        filled = merged.withColumn("__found", F.last("__value", ignorenulls=True).over(place.rowsBetween(W.unboundedPreceding, W.currentRow)))
    else:
        placed = cut_lineage(positions(merged, ["__key"], order).withColumn("__range", F.floor(F.col("__pos") / rows_per_range)))
        inside = W.partitionBy("__key", "__range").orderBy("__pos").rowsBetween(W.unboundedPreceding, W.currentRow)
        last, n_ranges = settle(placed.groupBy("__key", "__range").agg(
            F.max_by("__value", F.when(F.col("__value").isNotNull(), F.col("__pos"))).alias("__last")))
        carried = running(last, ["__key"], "__range", {"__carried": ("last", "__last")}, bounds=Places(n_ranges, rows_per_range))
        carried = carried.select("__key", (F.col("__range") + 1).alias("__range"), "__carried")
        filled = (match_stats_left(placed.withColumn("__found", F.last("__value", ignorenulls=True).over(inside)), carried, ["__key", "__range"])
                  .withColumn("__found", F.coalesce("__found", "__carried")))
    # The ends come from the curve itself: one abscissa can have several values, and the last one is the largest.
    pair = F.struct("__at", "__value")
    ends = points.groupBy("__key").agg(F.min(pair).alias("__first"), F.max(pair).alias("__end"))
    rows = match_stats_left(filled.where("__kind = 1").select("__key", "__turned", "__found", "__row"), ends, ["__key"])
    edge = (F.lit(before) if before is not None else F.col("__first.__value")) if backward else F.col("__end.__value")
    read = F.when(F.col("__turned").isNotNull() & F.col("__end").isNotNull(), F.coalesce("__found", edge))
    return rows.select(*[F.col(f"__row.{c}") for c in names], read.cast("double").alias(out))


def survival_on_grid(df: DataFrame, baseline: DataFrame, score: str, grid: list[float], keep: list[str],
                     side: str = "backward") -> DataFrame:
    """Survival of each subject on a fixed time grid: one row per (subject, grid time)."""
    h0 = grid_values(baseline, "time", "cum_hazard", grid, side)
    cells = F.array(*[F.struct(F.lit(float(t)).alias("time"), F.lit(float(h)).alias("h0")) for t, h in zip(grid, h0)])
    return (df.select(*keep, F.exp(F.col(score)).alias("__r"), F.explode(cells).alias("__c"))
            .select(*keep, F.col("__c.time").alias("time"), F.exp(-F.col("__c.h0") * F.col("__r")).alias("survival")))


def grid_values(curve: DataFrame, at: str, value: str, grid: list[float], side: str = "backward",
                before: float | None = None) -> list[float]:
    """A step curve read at a short ascending list of times.

    Each curve row belongs to one gap of the grid; one aggregate keeps the row of every gap that a lookup can see.
    """
    points, x = F.lit([float(g) for g in grid]), F.col(at)
    backward = side == "backward"
    # Backward: the first grid time that is not before the row. Forward: the last grid time that is not after it.
    gap = F.size(F.filter(points, (lambda g: g < x) if backward else (lambda g: g <= x))) - (0 if backward else 1)
    pick = F.max_by if backward else F.min_by
    kept = {r["gap"]: r for r in curve.groupBy(gap.alias("gap")).agg(
        pick(value, at).alias("v"), F.min_by(F.struct(at, value), at).alias("lo"), F.max_by(F.struct(at, value), at).alias("hi")).collect()}
    if not kept:
        raise ValueError("The curve is empty.")
    if backward:
        first = min((r["lo"] for r in kept.values()), key=lambda c: c[0])[1]
        now, out = first if before is None else before, []
        for i in range(len(grid)):
            now = kept[i]["v"] if i in kept else now
            out.append(now)
        return out
    now, out = max((r["hi"] for r in kept.values()), key=lambda c: c[0])[1], []
    for i in reversed(range(len(grid))):
        now = kept[i]["v"] if i in kept else now
        out.append(now)
    return out[::-1]
