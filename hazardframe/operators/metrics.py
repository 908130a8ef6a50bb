"""Discrimination and calibration: concordance, Brier scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from hazardframe.functions.scalar import RANDOM_BRIER, RISK_TIE_TOLERANCE
from hazardframe.operators.curves import censoring_curve, curve_lookup, event_table, grid_values
from hazardframe.operators.ordered import ROWS_PER_RANGE, match, match_stats, positions, range_bounds, running
from hazardframe.session import cut_lineage, settle

WIDE = "decimal(38,0)"  # pair counts grow with the square of the rows


def comparable_pairs(df: DataFrame, time: str, event: str, by: list[str] = (),
                     rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Number of pairs that can be ranked: an event against everyone who outlives it, or is censored with it."""
    table = event_table(df, time, event, by, rows_per_range)
    pairs = F.col("n_event").cast(WIDE) * (F.col("n_risk") - F.col("n_event")).cast(WIDE)
    return table.groupBy(*by).agg(F.sum(pairs).cast(WIDE).alias("comparable"))


def _below(rank: np.ndarray, weight: np.ndarray, upto: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """For each query the weight among the first ``upto`` rows whose rank is below ``limit``: one aligned block per bit of ``upto``."""
    n, base, size = len(rank), int(rank.max(initial=0)) + 2, 1
    total = np.zeros(len(upto), np.int64)
    while size <= n:
        used = np.flatnonzero(upto & size)
        if len(used):
            keys = np.arange(n) // size * base + rank
            inside = np.argsort(keys, kind="stable")
            mass = np.concatenate([[0], np.cumsum(weight[inside])])
            block = upto[used] // (2 * size) * 2
            found = np.searchsorted(keys[inside], block * base + limit[used], side="left")
            total[used] += mass[found] - mass[block * size]
        size *= 2
    return total


def _dominated(keys: list[str], unit: str, times: list[str]):
    """Kernel that counts, for the asks of each (group, unit), the weight of points later in ``times`` and lower in ``x``.

    Where both are equal neither counts: at one time points stand before asks, at one score asks before points.
    """
    def count(rows: pd.DataFrame) -> pd.DataFrame:
        cell = rows.groupby([*keys, unit], dropna=False, sort=False).ngroup().to_numpy()
        ask = rows.kind.to_numpy() > 0
        order = np.lexsort([ask, *[rows[c].to_numpy() for c in reversed(times)], cell])
        by_score = np.lexsort([~ask, rows.x.to_numpy()])
        rank = np.empty(len(rows), np.int64)
        rank[by_score] = np.arange(len(rows))
        cell, ask, rank, w, kind = cell[order], ask[order], rank[order], rows.w.to_numpy(np.int64)[order], rows.kind.to_numpy()[order]
        asks = np.flatnonzero(ask)
        ends = np.searchsorted(cell, cell[asks], side="right")
        points = np.where(ask, 0, w)
        hits = _below(rank, points, ends, rank[asks]) - _below(rank, points, asks, rank[asks])
        # Exact integers of any size; they travel as text.
        sums: dict[tuple[int, int], int] = {}
        for key, h in zip(zip(cell[asks].tolist(), kind[asks].tolist()), (hits.astype(object) * w[asks].astype(object)).tolist()):
            sums[key] = sums.get(key, 0) + h
        first = np.unique(cell, return_index=True)[1]
        heads = rows.iloc[order[first]][keys]
        out = [(*heads.iloc[c], k, str(n)) for (c, k), n in sums.items()]
        return pd.DataFrame(out, columns=[*keys, "kind", "n"])
    return count


def concordance_index(df: DataFrame, time: str, event: str, score: str, by: list[str] = (),
                      rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Exact Harrell concordance: ``comparable``, ``concordant``, ``tied`` and ``c_index`` per group.

    A pair counts where a point comes later and scores lower than an event asks for. Every group is cut into ranges of
    ``rows_per_range`` places in time and in score, whatever its size and however many values are equal. Pairs inside one
    time range, and pairs inside one score range, are counted there with sorted arrays, many small groups side by side; all
    others by a divide and conquer over the occupied cells. No pair is ever formed.
    """
    by = list(by)
    names = {f"__by{i}": b for i, b in enumerate(by)}
    keys = list(names)
    c = (1 - F.col(event).cast("int")).alias("c")
    points, n = settle(
        df.select(*[F.col(b).alias(k) for k, b in names.items()], F.col(time).cast("double").alias("t"), c,
                  F.col(score).cast("double").alias("x"))
        .groupBy(*keys, "t", "c", "x").agg(F.count("*").alias("w")))

    tol = F.lit(RISK_TIE_TOLERANCE)
    above = F.greatest(F.col("x") + tol * (1 + 1e-7), F.col("x") + F.abs("x") * 2.5e-16)
    asked = F.array(F.struct(F.lit(1).alias("kind"), (F.col("x") - tol).alias("x")), F.struct(F.lit(2).alias("kind"), above.alias("x")))
    asks = points.where("c = 0").select(*keys, "t", "c", "w", F.explode(asked).alias("q")).select(*keys, "t", "c", "w", "q.kind", "q.x")
    rows = points.withColumn("kind", F.lit(0)).unionByName(asks)
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in points.schema.fields if f.name in names], "kind int", "n string"])

    def kernel(cells: DataFrame, unit: str, times: list[str]) -> DataFrame:
        bins = max(1, 3 * n // rows_per_range)
        packed = cells.withColumn("__bin", F.pmod(F.xxhash64(*keys, unit), F.lit(bins)))
        return packed.groupBy("__bin").applyInPandas(_dominated(keys, unit, times), schema).withColumn("n", F.col("n").cast(WIDE))

    if n <= rows_per_range:
        parts = kernel(rows.withColumn("ta", F.lit(0)), "ta", ["t", "c"])
    else:
        place = F.floor(F.col("__pos") / rows_per_range)
        placed = positions(rows.withColumn("ask", F.col("kind") > 0), keys, ["t", "c", "ask"])
        placed = placed.withColumn("ta", place).withColumn("large", F.col("__size") > rows_per_range).drop("__pos", "__size")
        placed = positions(placed.withColumn("point", F.col("kind") == 0), keys, ["x", "point"])
        placed = cut_lineage(placed.withColumn("xa", place).select(*keys, "t", "c", "x", "w", "kind", "ta", "xa", "large"))
        large = placed.where("large")
        parts = (kernel(placed, "ta", ["t", "c"]).unionByName(kernel(large, "xa", ["ta"]))
                 .unionByName(_cell_counts(large, keys)))
    totals = (parts.groupBy(*keys).pivot("kind", [1, 2]).agg(F.sum("n"))
              .select(*keys, F.coalesce(F.col("1"), F.lit(0)).cast(WIDE).alias("concordant"),
                      (F.coalesce(F.col("2"), F.lit(0)) - F.coalesce(F.col("1"), F.lit(0))).cast(WIDE).alias("tied")))
    at_times = points.groupBy(*keys, "t").agg(F.sum("w").alias("n"), F.sum(F.when(F.col("c") == 0, F.col("w")).otherwise(0)).alias("d"))
    values, n_values = settle(at_times.where("t is not null and not isnan(t)"))
    at_risk = running(values, keys, "t", {"r": ("sum", "n")}, descending=True, bounds=range_bounds(values, "t", n_values, rows_per_range))
    d = lambda name: F.col(name).cast(WIDE)
    pairs = at_risk.groupBy(*keys).agg(F.sum((d("d") * (d("r") - d("d"))).cast(WIDE)).cast(WIDE).alias("comparable"))
    full = match(pairs, totals, keys, "left").select(
        *[F.col(k).alias(b) for k, b in names.items()], "comparable", F.coalesce("concordant", F.lit(0).cast(WIDE)).alias("concordant"),
        F.coalesce("tied", F.lit(0).cast(WIDE)).alias("tied"))
    d = lambda name: F.col(name).cast("double")
    return full.withColumn("c_index", F.try_divide(d("concordant") + 0.5 * d("tied"), d("comparable")))


def _cell_counts(placed: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs whose time range is later and whose score range is lower, merged over the occupied cells.

    Two different time ranges differ first in one binary digit: there the later one has a one, and all digits above agree. So
    a point goes to the node of each of its ones and an ask to that of each of its zeros; in a node, points of all lower
    score ranges count. A node has one row for each score range and kind at most.
    """
    cells = placed.groupBy(*keys, "ta", "xa", "kind").agg(F.sum(F.col("w").cast(WIDE)).cast(WIDE).alias("w"))
    bits = F.filter(F.transform(F.sequence(F.lit(0), F.lit(40)), lambda b: F.struct(
        b.alias("bit"), F.call_function("shiftright", F.col("ta"), b + 1).alias("node"),
        (F.call_function("shiftright", F.col("ta"), b) % 2).alias("digit"))),
        lambda s: (s["digit"] == F.when(F.col("kind") == 0, 1).otherwise(0)) & (F.call_function("shiftright", F.col("last"), s["bit"]) > 0))
    last = cells.groupBy(*keys).agg(F.max("ta").alias("last"))
    nodes = (match_stats(cells, last, keys).withColumn("s", F.explode(bits))
             .groupBy(*keys, "s.bit", "s.node", "xa", "kind").agg(F.sum("w").cast(WIDE).alias("w")))
    lower = W.partitionBy(*keys, "bit", "node").orderBy("xa").rangeBetween(W.unboundedPreceding, -1)
    mass = F.sum(F.when(F.col("kind") == 0, F.col("w"))).over(lower)
    return (nodes.withColumn("m", mass).where("kind > 0 and m is not null")
            .groupBy(*keys, "kind").agg(F.sum((F.col("w") * F.col("m")).cast(WIDE)).cast(WIDE).alias("n")))


def time_grid(train: DataFrame, test: DataFrame, time: str, points: int = 100) -> list[float]:
    """Evenly spaced times strictly inside the range that train and test share."""
    bounds = lambda d: d.agg(F.min(time).cast("double").alias("lo"), F.max(time).cast("double").alias("hi")).first()
    a, b = bounds(train), bounds(test)
    return [float(v) for v in np.linspace(max(a.lo, b.lo) + 1, min(a.hi, b.hi) - 1, points)]


def brier_scores(test: DataFrame, train: DataFrame, baseline: DataFrame, time: str, event: str, score: str,
                 grid: list[float], side: str = "backward", ipcw: bool = True) -> DataFrame:
    """Brier score at each grid time, weighted by the censoring curve of the training rows.

    Each row is expanded over the short grid and summed per grid time in the same stage, so the expansion is
    folded by the partial aggregate before anything is shuffled.
    """
    h0 = grid_values(baseline, "time", "cum_hazard", grid, side)
    if ipcw:
        censor = cut_lineage(censoring_curve(train, time, event))
        g = grid_values(censor, "time", "censoring_survival", grid, before=1.0)
        rows = curve_lookup(test, censor, time, "time", "censoring_survival", "__gt", before=1.0)
    else:
        g, rows = [1.0] * len(grid), test.withColumn("__gt", F.lit(1.0))
    cells = F.array(*[F.struct(F.lit(float(t)).alias("t"), F.lit(float(h)).alias("h"), F.lit(float(w)).alias("g"))
                      for t, h, w in zip(grid, h0, g)])
    rows = rows.select(F.col(time).cast("double").alias("__t"), F.col(event).alias("__e"), "__gt",
                       F.exp(F.col(score)).alias("__r"), F.explode(cells).alias("cell"))
    s = F.exp(-F.col("cell.h") * F.col("__r"))
    died = F.when(F.col("__e") & (F.col("__gt") > 0), s * s / F.col("__gt")).otherwise(0.0)
    alive = F.when(F.col("cell.g") > 0, (1 - s) * (1 - s) / F.col("cell.g")).otherwise(0.0)
    term = F.when(F.col("__t") <= F.col("cell.t"), died).otherwise(alive)
    return rows.groupBy(F.col("cell.t").alias("time")).agg(F.avg(term).alias("brier"))


def trapezoid_mean(df: DataFrame, x: str, y: str, out: str) -> DataFrame:
    """Trapezoid integral of a short curve divided by its span."""
    w = W.orderBy(x)
    step = (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2
    return (df.select(x, step.alias("__a"))
            .agg(F.try_divide(F.sum("__a"), F.max(x) - F.min(x)).alias(out)))


def integrated_brier(test: DataFrame, train: DataFrame, baseline: DataFrame, time: str, event: str, score: str,
                     points: int = 100, side: str = "backward", ipcw: bool = True) -> DataFrame:
    """Integrated Brier score over the shared time range, and whether it beats an uninformative model."""
    grid = time_grid(train, test, time, points)
    scores = brier_scores(test, train, baseline, time, event, score, grid, side, ipcw)
    return trapezoid_mean(scores, "time", "brier", "ibs").withColumn("better_than_random",
                                                                     F.col("ibs") < RANDOM_BRIER)
