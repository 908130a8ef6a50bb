"""Medians, means and deviations of many overlapping training sets at once, from additive statistics.

A row is read once per pass, whatever the number of sets: a batch's membership matrix (rows x sets) times its values gives the
sums of all sets, and the parts of all batches add up. Rows are never copied per set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hazardframe.functions.scalar import clean
from hazardframe.operators.cox_likelihood import TrainSet, _unpack, _vectors, sum_vectors

MAX_CELLS = 4_000_000  # counts (sets x features x bins) that a task holds
MOST_BINS = 4096
MAX_GROUP = 1_000_000  # rows between two edges that one task may sort
SAME = 1e-13  # a variance below this share of the mean square from the shift is rounding


def members(sets: list[TrainSet], folds: np.ndarray | None, n: int) -> np.ndarray:
    """Membership of the rows of a batch in each training set (rows x sets)."""
    return np.stack([s.rows(folds, n) for s in sets], axis=1)


def _table(df: DataFrame, column: str) -> DataFrame:
    folds = ["folds"] if "folds" in df.columns else []
    return df.select(F.lit(0.0).alias("time"), F.lit(False).alias("event"), F.col(column).alias("features"), *folds)


def _batches(batches: Iterator[pa.RecordBatch], sets: list[TrainSet]):
    for b in batches:
        if b.num_rows:
            t, _, x, folds = _unpack(b)
            yield x, members(sets, folds, len(t))


def _edges(table: DataFrame, p: int, bins: int, spans: list[tuple[float, float]] | None) -> list[np.ndarray]:
    """Quantiles of each feature (inside its span), sorted and distinct, from one sketch per feature."""
    shares = [i / bins for i in range(bins + 1)]
    value = lambda j: clean(F.col("features")[j])
    inside = lambda j: value(j) if spans is None else F.when(value(j).between(*map(float, spans[j])), value(j))
    found = []
    for at in range(0, p, 64):
        found += list(table.agg(*[F.percentile_approx(inside(j), shares, 4 * bins).alias(f"q{j}") for j in range(at, min(p, at + 64))]).first())
    return [np.unique(np.asarray(q if q is not None else [], float)) for q in found]


def bin_of(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Odd numbers are the edges themselves, even ones what lies between two of them."""
    lo, hi = np.searchsorted(edges, x, side="left"), np.searchsorted(edges, x, side="right")
    return lo + hi


def _histograms(table: DataFrame, sets: list[TrainSet], edges: list[np.ndarray]) -> dict[int, np.ndarray]:
    """Rows of every set in every bin, per feature: (sets, bins)."""
    def scan(batches):
        held = [np.zeros((2 * len(e) + 1, len(sets))) for e in edges]
        for x, inside in _batches(batches, sets):
            for j, e in enumerate(edges):
                known = ~np.isnan(x[:, j])
                bins = bin_of(x[known, j], e)
                order = np.argsort(bins, kind="stable")
                bins = bins[order]
                starts = np.flatnonzero(np.diff(bins, prepend=-1))
                if len(starts):
                    held[j][bins[starts]] += np.add.reduceat(inside[known][order].astype(float), starts, axis=0)
        for j, h in enumerate(held):
            yield _vectors([j], h.reshape(1, -1), pa.int64())

    rows = sum_vectors(table.mapInArrow(scan, "key bigint, vec array<double>"), "bigint").toLocalIterator()
    return {r["key"]: np.asarray(r["vec"]).reshape(-1, len(sets)).T for r in rows}


def _wanted(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin and rank inside it of the two middle values of each set: two arrays (sets, 2)."""
    ends = counts.cumsum(axis=1)
    n = ends[:, -1].astype(np.int64)
    ranks = np.stack([(n - 1) // 2, n // 2], axis=1)
    bins = np.stack([np.searchsorted(e, r, side="right") for e, r in zip(ends, ranks)])
    before = np.take_along_axis(np.concatenate([np.zeros((len(ends), 1)), ends], axis=1), bins, axis=1)
    return bins, (ranks - before).astype(np.int64)


def set_medians(df: DataFrame, sets: list[TrainSet], names: list[str], column: str = "features", bins: int | None = None,
                max_group: int = MAX_GROUP) -> list[list[float]]:
    """Exact median of every position of ``column`` in every training set; nulls and NaN are left out.

    A sketch of the whole column gives edges that all sets share, and one pass counts the rows of each set on and between them. A
    frequent value is an edge, and a median on an edge is known. For the others the values between the two edges around them
    are sent once for all sets, with their memberships as bits, and ranked; while more than ``max_group`` rows lie there, edges
    are set anew inside. A position without any value in some set is an error.
    """
    p, table = len(names), _table(df, column)
    if not p:
        return [[] for _ in sets]
    bins = bins or max(16, min(MOST_BINS, MAX_CELLS // (2 * p * len(sets))))
    edges, largest = _edges(table, p, bins, None), None
    while True:
        counts = _histograms(table, sets, edges)
        empty = [names[j] for j in range(p) if j not in counts or not counts[j].sum(axis=1).all()]
        if empty:
            raise ValueError(f"Columns without any value cannot be imputed: {sorted(empty)}")
        wanted = {j: _wanted(counts[j]) for j in range(p)}
        between = {j: sorted({int(b) for b in w[0].ravel() if b % 2 == 0}) for j, w in wanted.items()}
        most = max((counts[j][:, b].max() for j, bs in between.items() for b in bs), default=0)
        if most <= max_group or (largest is not None and most >= largest):
            break
        largest = most
        bound = lambda j, b: (edges[j][b // 2 - 1] if b else -np.inf, edges[j][b // 2] if b // 2 < len(edges[j]) else np.inf)
        spans = [(min(bound(j, b)[0] for b in between[j]), max(bound(j, b)[1] for b in between[j])) if between[j] else (0.0, 0.0) for j in range(p)]
        finer = _edges(table, p, bins, spans)
        keep = lambda j: [v for b in between[j] for v in bound(j, b) if np.isfinite(v)]
        edges = [np.unique(np.concatenate([finer[j], keep(j)])) if between[j] else edges[j] for j in range(p)]

    out = np.full((len(sets), p, 2), np.nan)
    asks: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for j, (at, rank) in wanted.items():
        for g in range(len(sets)):
            for side in (0, 1):
                b = int(at[g, side])
                if b % 2:
                    out[g, j, side] = edges[j][b // 2]
                else:
                    asks.setdefault((j, b), []).append((g, side, int(rank[g, side])))
    if asks:
        for r in _ranked(table, sets, edges, between, asks).toLocalIterator():
            out[r["g"], r["feature"], r["side"]] = r["value"]
    return out.mean(axis=2).tolist()


def _ranked(table: DataFrame, sets: list[TrainSet], edges, between, asks) -> DataFrame:
    """(feature, g, side, value) of the asked ranks between edges; a group is what lies between two edges of a feature."""
    def send(batches):
        for x, inside in _batches(batches, sets):
            bits = np.packbits(inside, axis=1)
            for j, bs in between.items():
                if bs:
                    known = np.flatnonzero(~np.isnan(x[:, j]))
                    at = bin_of(x[known, j], edges[j])
                    hit = np.isin(at, bs)
                    rows = known[hit]
                    if len(rows):
                        yield pa.RecordBatch.from_pydict({
                            "feature": pa.array(np.full(len(rows), j, "int32")), "bin": pa.array(at[hit].astype("int32")),
                            "value": pa.array(x[rows, j]), "bits": pa.array([m.tobytes() for m in bits[rows]], pa.binary())})

    def rank(group: pa.Table) -> pa.Table:
        j, b = group["feature"][0].as_py(), group["bin"][0].as_py()
        order = np.argsort(group["value"].to_numpy(), kind="stable")
        values = group["value"].to_numpy()[order]
        bits = np.frombuffer(b"".join(group["bits"].to_pylist()), np.uint8).reshape(len(values), -1)[order]
        found = [(j, g, side, values[np.flatnonzero(bits[:, g // 8] >> (7 - g % 8) & 1)[r]]) for g, side, r in asks[j, b]]
        return pa.table({name: pa.array(column, kind) for name, column, kind in zip(
            ("feature", "g", "side", "value"), zip(*found), (pa.int32(), pa.int32(), pa.int32(), pa.float64()))})

    sent = table.mapInArrow(send, "feature int, bin int, value double, bits binary")
    return sent.groupBy("feature", "bin").applyInArrow(rank, "feature int, g int, side int, value double")


def set_moments(df: DataFrame, sets: list[TrainSet], medians: list[list[float]], column: str = "features") -> tuple[list[list[float]], list[list[float]]]:
    """Population mean and deviation of every position in every training set, nulls taken as the set's median; a constant
    position gets deviation one. One pass: counts, sums and sums of squares around the first set's medians."""
    fills = np.asarray(medians, float)
    if not fills.size:
        return [[] for _ in sets], [[] for _ in sets]
    p, shift = fills.shape[1], fills[0]

    def scan(batches):
        sums = np.zeros((len(sets), 1 + 3 * p))
        for x, inside in _batches(batches, sets):
            known = ~np.isnan(x)
            away = np.where(known, x - shift, 0.0)
            sums += inside.T.astype(float) @ np.concatenate([np.ones((len(x), 1)), known, away, away * away], axis=1)
        yield _vectors(np.arange(len(sets)), sums, pa.int64())

    got = {r["key"]: np.asarray(r["vec"]) for r in
           sum_vectors(_table(df, column).mapInArrow(scan, "key bigint, vec array<double>"), "bigint").collect()}
    v = np.stack([got.get(g, np.zeros(1 + 3 * p)) for g in range(len(sets))])
    n, filled = np.maximum(v[:, :1], 1.0), v[:, :1] - v[:, 1:1 + p]
    mean = (v[:, 1 + p:1 + 2 * p] + filled * (fills - shift)) / n
    square = (v[:, 1 + 2 * p:] + filled * (fills - shift) ** 2) / n
    variance = square - mean ** 2
    return (mean + shift).tolist(), np.where(variance > SAME * square, np.sqrt(np.maximum(variance, 0.0)), 1.0).tolist()
