"""Exact concordance of many models that are judged on shared rows, without a row for each score.

Scores stay packed in arrays from the scan that makes them. The scores of a model are dealt to ranges of bounded size; pairs
inside a range are counted there with sorted arrays, pairs of two ranges from counts per range and time. A score that is
frequent enough to be an edge between ranges is only counted. No pair is ever formed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hazardframe.functions.scalar import RISK_TIE_TOLERANCE
from hazardframe.operators.fold_statistics import bin_of

CELL_ROWS = 262_144  # scores that a task sorts at a time, about
MOST_TIMES = 10_000  # distinct times, where counts per range and time are needed
SAMPLED = 200  # scores looked at for each range
MOST_SAMPLED = 100_000
ASKS = 4096
ROWS, LOW, HIGH, N_ROWS, N_LOW, N_HIGH = range(6)  # what a packed record holds: rows or asks of a range; counts at an edge


def count_below(q: np.ndarray, u: np.ndarray, v: np.ndarray) -> int:
    """Over all asks, the points among the first ``u`` in score whose place in time is ``v`` or later.

    ``q`` has the place in time of each point, by score. Both orders are cut into blocks: whole blocks come from a table, and
    every ask is compared with the points of one block of each order.
    """
    n, b = len(q), 128
    if not n or not len(u):
        return 0
    while 4 * b * b < n:
        b *= 2
    g, at = n // b + 1, np.arange(n)
    table = np.bincount(at // b * g + q // b, minlength=g * g).reshape(g, g)
    full = np.zeros((g + 1, g + 1), np.int64)
    full[1:, :g] = table[:, ::-1].cumsum(axis=1)[:, ::-1].cumsum(axis=0)
    total = int(full[u // b, v // b + 1].sum())
    s = np.empty(n, np.int32)
    s[q] = at
    inside = np.arange(b, dtype=np.int32)
    for by, other, source, below in ((u, v, q.astype(np.int32), True), (v, u // b * b, s, False)):
        order = np.argsort(by, kind="stable")
        by, other = by[order].astype(np.int32), other[order].astype(np.int32)
        ends = np.searchsorted(by, np.arange(1, g + 1) * b, side="left")
        for i, (lo, hi) in enumerate(zip([0, *ends[:-1]], ends)):
            block = source[i * b:(i + 1) * b]
            for a in range(lo, hi, ASKS):
                edge, limit = by[a:min(hi, a + ASKS), None] - i * b, other[a:min(hi, a + ASKS), None]
                k = inside[:len(block)]
                total += int(np.count_nonzero((block >= limit) & (k < edge) if below else (block < limit) & (k >= edge)))
    return total


def thresholds(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Below the first a score is lower, below the second lower or tied."""
    return x - RISK_TIE_TOLERANCE, np.maximum(x + RISK_TIE_TOLERANCE * (1 + 1e-7), x + np.abs(x) * 2.5e-16)


def time_codes(times: np.ndarray, t: np.ndarray, event: np.ndarray) -> np.ndarray:
    """Place of a time and, at one time, events (even) before censored rows; a missing time is later than all others."""
    return (2 * np.searchsorted(times, t) + ~event).astype(np.int32)


def comparable(counts: np.ndarray) -> int:
    """Pairs that can be ranked, from the rows of each code; rows without a time are left out."""
    counts = counts[:-2]
    return int((counts * (counts.sum() - counts.cumsum()))[::2].sum())


def pack(model: int, x: np.ndarray, code: np.ndarray, edges: np.ndarray) -> list[tuple]:
    """The records of a model's rows: (model, range, kind, values, codes)."""
    if not len(edges):
        return [(model, 0, ROWS, x.tobytes(), code.tobytes())]
    out, asks, own = [], code % 2 == 0, bin_of(x, edges)

    def put(bins, values, codes, plain, counted):
        order = np.lexsort([codes, bins])
        bins, values, codes = bins[order], values[order], codes[order]
        cuts = np.flatnonzero(np.diff(bins, prepend=-1))
        for lo, hi in zip(cuts, [*cuts[1:], len(bins)]):
            if bins[lo] % 2:  # an edge itself
                c, n = np.unique(codes[lo:hi], return_counts=True)
                out.append((model, int(bins[lo]), counted, n.astype(float).tobytes(), c.tobytes()))
            else:
                out.append((model, int(bins[lo]), plain, values[lo:hi].tobytes(), codes[lo:hi].tobytes()))

    put(own, x, code, ROWS, N_ROWS)
    for y, plain, counted in zip(thresholds(x[asks]), (LOW, HIGH), (N_LOW, N_HIGH)):
        bins = bin_of(y, edges)
        away = (bins != own[asks]) | (bins % 2 == 1)  # the others are derived from the rows of the range
        put(bins[away], y[away], code[asks][away], plain, counted)
    return out


def count_range(number: int, records: list[tuple], edges: np.ndarray, n_codes: int) -> tuple[int, int, np.ndarray]:
    """Pairs inside a range (lower; lower or tied) and the counts of rows, low and high asks for each code."""
    def join(kind, dtype=float):
        parts = [(np.frombuffer(v), np.frombuffer(c, np.int32)) for k, v, c in records if k == kind]
        return tuple(np.concatenate(p) for p in zip(*parts)) if parts else (np.zeros(0), np.zeros(0, np.int32))

    counts = np.zeros((3, n_codes), np.int64)
    for i, kind in enumerate((N_ROWS, N_LOW, N_HIGH)):
        n, c = join(kind)
        np.add.at(counts[i], c, n.astype(np.int64))
    x, code = join(ROWS)
    events = code % 2 == 0
    y, c = x[events], code[events]
    low, high = thresholds(y)
    here = [bin_of(v, edges) == number for v in (low, high)]
    far = [join(LOW), join(HIGH)]
    for i, codes in enumerate([(code,), (c[here[0]], far[0][1]), (c[here[1]], far[1][1])]):
        for some in codes:
            counts[i] += np.bincount(some, minlength=n_codes)
    by_time, by_score = np.argsort(code, kind="stable"), np.argsort(x, kind="stable")
    place = np.empty(len(x), np.int64)
    place[by_time] = np.arange(len(x))
    q, x, code = place[by_score], x[by_score], code[by_time]
    u = [np.searchsorted(x, v) for v in (low, high)]
    v = np.searchsorted(code, c, side="right")
    both = here[0] & here[1]
    wide = both & (u[1] - u[0] > 1)  # otherwise nothing but the row itself lies between
    same = count_below(q, u[0][both], v[both])
    pairs = [same, same + count_below(q, u[1][wide], v[wide]) - count_below(q, u[0][wide], v[wide])]
    for i in (0, 1):
        alone = here[i] & ~both
        pairs[i] += count_below(q, u[i][alone], v[alone])
        pairs[i] += count_below(q, np.searchsorted(x, far[i][0]), np.searchsorted(code, far[i][1], side="right"))
    return pairs[0], pairs[1], counts


def count_across(counts: np.ndarray) -> tuple[int, int]:
    """Pairs of two ranges, from the counts (ranges, 3, codes) by rising range."""
    rows = counts[:, 0]
    below = rows.cumsum(axis=0) - rows
    later = below.sum(axis=1, keepdims=True) - below.cumsum(axis=1)
    return int((counts[:, 1] * later).sum()), int((counts[:, 2] * later).sum())


def cut_scores(scores: np.ndarray, share: float) -> np.ndarray:
    """Edges between ranges of about ``CELL_ROWS`` scores, from a sample that holds ``share`` of them."""
    scores = np.sort(scores[~np.isnan(scores)])
    k = int(np.ceil(len(scores) / share / CELL_ROWS))
    return np.unique(scores[[i * len(scores) // k for i in range(1, k)]]) if k > 1 else np.zeros(0)


def many_concordances(packed: DataFrame, edges: dict[int, np.ndarray], n_codes: int) -> DataFrame:
    """``model``, ``comparable``, ``concordant`` and ``tied`` of every model from its packed records (see :func:`pack`)."""
    none = np.zeros(0)

    def inside(group: pa.Table) -> pa.Table:
        model, number = group["model"][0].as_py(), group["bin"][0].as_py()
        cuts = edges.get(model, none)
        records = list(zip(*[group[c].to_pylist() for c in ("kind", "vals", "codes")]))
        low, high, counts = count_range(number, records, cuts, n_codes)
        sent = counts.tobytes() if len(cuts) else None
        return pa.table({"model": pa.array([model], pa.int64()), "bin": pa.array([number], pa.int32()), "low": pa.array([low], pa.int64()), "high": pa.array([high], pa.int64()),
                         "comparable": pa.array([comparable(counts[0])], pa.int64()), "counts": pa.array([sent], pa.binary())})

    def whole(group: pa.Table) -> pa.Table:
        order = np.argsort(group["bin"].to_numpy())
        low, high, pairs = (sum(group[c].to_pylist()) for c in ("low", "high", "comparable"))
        sent = [v for v in group["counts"].to_pylist() if v is not None]
        if sent:
            counts = np.stack([np.frombuffer(sent[i], np.int64).reshape(3, -1) for i in order])
            across = count_across(counts)
            low, high, pairs = low + across[0], high + across[1], comparable(counts[:, 0].sum(axis=0))
        return pa.table({c: pa.array([v], pa.int64()) for c, v in (
            ("model", group["model"][0].as_py()), ("comparable", pairs), ("concordant", low), ("tied", high - low))})

    cells = packed.groupBy("model", "bin").applyInArrow(inside, "model bigint, bin int, low bigint, high bigint, comparable bigint, counts binary")
    return cells.groupBy("model").applyInArrow(whole, "model bigint, comparable bigint, concordant bigint, tied bigint")
