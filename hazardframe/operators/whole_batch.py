"""Exact gradient of the neural Cox model over a whole table: one risk set, one batch normalisation, any number of rows.

Rows are sorted by falling time once and cut into blocks. What couples the rows are a few sums: mean and variance of each
layer, the risk still to come at each time, the hazard up to each time, and the two sums that batch normalisation needs on the
way back. Each of them is one map-only pass over the blocks; a block gives totals, the driver adds up one number for each
block and sends the sums before and after it back. Times that continue in neighbouring blocks share their risk set. A step
takes three passes and two for each hidden layer; nothing is joined or shuffled but the vectors of sums.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hazardframe.operators.cox_likelihood import CHUNK, _vectors, sum_vectors
from hazardframe.operators.ordered import positions
from hazardframe.session import cut_lineage

EPS = 1e-5  # fixed value: of batch normalisation
BLOCK_ROWS = 4096


def time_blocks(df: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(block, time, event, features)`` with the rows of each block as arrays, times falling; written once.

    Rows with equal times take any order. A time of null or NaN is refused.
    """
    rows = df.select(F.col("time").cast("double").alias("time"), F.col("event").cast("double").alias("event"), "features")
    bad = F.col("time").isNull() | F.isnan("time")
    rows = rows.withColumn("late", -F.when(bad, F.raise_error(F.lit("a time is missing")).cast("double")).otherwise(F.col("time")))
    placed = positions(rows, [], ["late"])
    row = F.struct("__pos", "time", "event", "features")
    packed = (placed.withColumn("block", F.floor(F.col("__pos") / block_rows)).groupBy("block")
              .agg(F.sort_array(F.collect_list(row)).alias("rows")))  # at most block_rows of them
    return cut_lineage(packed.select("block", F.col("rows.time").alias("time"), F.col("rows.event").alias("event"),
                                     F.flatten("rows.features").alias("features")))


@dataclass
class _State:
    """What a pass knows: weights, the moments of the layers so far, and sums before and after each block."""

    weights: np.ndarray
    moments: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    ahead: dict[int, tuple[float, float]] = field(default_factory=dict)  # logarithms: risk of earlier blocks; of the last time in later ones
    behind: dict[int, tuple[float, float]] = field(default_factory=dict)  # the same for the hazard, the other way round
    deaths: float = 0.0
    rows: float = 0.0
    normed: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)  # sums of the way back, from the top layer down


class _Block:
    """One block in one pass."""

    def __init__(self, net, state: _State, number: int, time, event, features, dropout: float, seed: list[int]):
        self.net, self.state, self.number, self.t, self.e = net, state, number, time, event
        self.x = features.reshape(len(time), -1)
        self.w = net.split(state.weights)[0]
        self.dropout, self.rng = dropout, np.random.default_rng([*seed, number])
        self.tape: list[tuple] = []
        for i in range(len(state.moments)):
            self._layer(i, *state.moments[i])

    def inputs(self, i: int) -> np.ndarray:
        """What layer ``i`` adds up, before normalisation."""
        return self.x @ self.w[4 * i] + self.w[4 * i + 1]

    def _layer(self, i: int, mean: np.ndarray, var: np.ndarray) -> None:
        weight, _, scale, shift = self.w[4 * i:4 * i + 4]
        sd = np.sqrt(var + EPS)
        norm = (self.inputs(i) - mean) / sd
        act = np.maximum(norm * scale + shift, 0.0)
        keep = np.ones_like(act) if not self.dropout else (self.rng.random(act.shape) >= self.dropout) / (1 - self.dropout)
        self.tape.append((self.x, norm, sd, act > 0, keep, weight, scale))
        self.x = act * keep

    def scores(self) -> np.ndarray:
        return (self.x @ self.w[-2] + self.w[-1])[:, 0]

    def _edges(self, logs: np.ndarray) -> list[float]:
        """Logarithms of the total and of the shares of the first and of the last time; with these times."""
        sums = [np.logaddexp.reduce(part) for part in (logs, logs[self.t == self.t[0]], logs[self.t == self.t[-1]])]
        return [*sums, self.t[0], self.t[-1]]

    def risk(self) -> list[float]:
        return self._edges(self.scores())

    def _shares(self) -> tuple[np.ndarray, np.ndarray]:
        """Scores, and the logarithm of the risk of everyone at least as late."""
        eta = self.scores()
        before, more = self.state.ahead[self.number]
        last = np.searchsorted(-self.t, -self.t, side="right") - 1
        total = np.logaddexp(before, np.logaddexp.accumulate(eta)[last])
        return eta, np.logaddexp(total, np.where(self.t == self.t[-1], more, -np.inf))

    def _steps(self, total: np.ndarray) -> np.ndarray:
        return np.where(self.e > 0, -total, -np.inf)

    def hazard(self) -> list[float]:
        eta, total = self._shares()
        return [*self._edges(self._steps(total)), np.sum(self.e * (eta - total)), self.e.sum()]

    def gradient(self, depth: int) -> np.ndarray:
        """Sums of the way back through ``depth`` layers: derivatives of the last one passed, then the sums for the next."""
        eta, total = self._shares()
        after, more = self.state.behind[self.number]
        first = np.searchsorted(-self.t, -self.t, side="left")
        hazard = np.logaddexp(after, np.logaddexp.accumulate(self._steps(total)[::-1])[::-1][first])
        hazard = np.logaddexp(hazard, np.where(self.t == self.t[0], more, -np.inf))
        back = (-(self.e - np.exp(eta + hazard)) / self.state.deaths)[:, None]
        out = [self.x.T @ back, back.sum(axis=0)]
        back = back @ self.w[-2].T
        for k in range(depth):
            inp, norm, sd, alive, keep, weight, scale = self.tape[-1 - k]
            by_norm, plain = self.state.normed[k]
            back = back * keep * alive * scale
            back = (back - scale * plain / self.state.rows - norm * scale * by_norm / self.state.rows) / sd
            out = [inp.T @ back, back.sum(axis=0)]
            back = back @ weight.T
        if depth < len(self.tape):
            _, norm, _, alive, keep, _, _ = self.tape[-1 - depth]
            back = back * keep * alive
            out += [(back * norm).sum(axis=0), back.sum(axis=0)]
        return np.concatenate([np.ravel(o) for o in out])


def _blocks(batches, *args):
    for b in batches:
        for number, time, event, features in zip(b.column("block").to_pylist(), b.column("time"), b.column("event"), b.column("features")):
            yield number, *(c.values.to_numpy(zero_copy_only=False) for c in (time, event, features))


def _summed(packed: DataFrame, net, state: _State, dropout: float, seed: list[int], of) -> np.ndarray:
    """Sum over all blocks of the vector that ``of`` gives for one."""
    sent = packed.sparkSession.sparkContext.broadcast(state)

    def run(batches):
        total = None
        for block in _blocks(batches):
            vec = of(_Block(net, sent.value, *block, dropout, seed))
            total = vec if total is None else total + vec
        if total is not None:
            for c in range(0, len(total), CHUNK):
                yield _vectors([c // CHUNK], total[None, c:c + CHUNK], pa.int64())

    got = {r["key"]: np.asarray(r["vec"]) for r in sum_vectors(packed.mapInArrow(run, "key bigint, vec array<double>"), "bigint").collect()}
    sent.destroy()
    return np.concatenate([got[k] for k in sorted(got)])


def _each(packed: DataFrame, net, state: _State, dropout: float, seed: list[int], of) -> np.ndarray:
    """A few numbers of every block, ordered by block: one short row for each ``BLOCK_ROWS`` rows of the table."""
    sent = packed.sparkSession.sparkContext.broadcast(state)

    def run(batches):
        found = [(block[0], of(_Block(net, sent.value, *block, dropout, seed))) for block in _blocks(batches)]
        if found:
            yield _vectors([k for k, _ in found], [v for _, v in found], pa.int64())

    rows = sorted((r["key"], r["vec"]) for r in packed.mapInArrow(run, "key bigint, vec array<double>").collect())
    sent.destroy()
    return np.array([[k, *v] for k, v in rows])


def _carried(total: np.ndarray, first: np.ndarray, early: np.ndarray, late: np.ndarray) -> list[tuple[float, float]]:
    """For each block the sum of those before it, and what later ones add to its last time (``first`` is their share of it); all logarithms."""
    before = np.concatenate([[-np.inf], np.logaddexp.accumulate(total)[:-1]])
    more = np.full(len(total), -np.inf)
    for k in range(len(total) - 2, -1, -1):
        if early[k + 1] == late[k]:
            more[k] = np.logaddexp(first[k + 1], more[k + 1]) if late[k + 1] == late[k] else first[k + 1]
    return list(zip(before.tolist(), more.tolist()))


def exact_step(packed: DataFrame, net, weights: np.ndarray, dropout: float, seed: list[int], momentum: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient of the trainable part and updated running statistics, as of one batch that holds every row."""
    state, layers, fresh = _State(weights), len(net.hidden), []
    stats = net.split(weights)[1]
    for i in range(layers):
        def moments(block, i=i):
            z = block.inputs(i)
            return np.concatenate([z.sum(axis=0), (z * z).sum(axis=0), [len(z)]])
        got, h = _summed(packed, net, state, dropout, seed, moments), net.hidden[i]
        n = got[-1]
        mean = got[:h] / n
        var = np.maximum(got[h:2 * h] / n - mean * mean, 0.0)
        state.moments.append((mean, var))
        fresh += [(1 - momentum) * stats[2 * i] + momentum * mean, (1 - momentum) * stats[2 * i + 1] + momentum * var * n / max(n - 1, 1)]
        state.rows = n
    numbers, total, first, _, early, late = _each(packed, net, state, dropout, seed, lambda b: b.risk()).T
    keys = numbers.astype(int).tolist()
    state.ahead = dict(zip(keys, _carried(total, first, early, late)))
    _, total, _, last, _, _, loss, deaths = _each(packed, net, state, dropout, seed, lambda b: b.hazard()).T
    state.behind = dict(zip(keys, _carried(total[::-1], last[::-1], late[::-1], early[::-1])[::-1]))
    state.deaths = float(deaths.sum()) + 1e-8
    parts: list[np.ndarray] = []
    for depth in range(layers + 1):
        got = _summed(packed, net, state, dropout, seed, lambda b, depth=depth: b.gradient(depth))
        below = net.hidden[layers - 1 - depth] if depth < layers else 0
        own = got[:len(got) - 2 * below]
        if depth:
            parts[0] = np.concatenate([own, parts[0]])  # the layer's weights stand before its scale and shift
        else:
            parts.append(own)
        if below:
            state.normed.append((got[len(own):len(own) + below], got[len(own) + below:]))
            parts.insert(0, got[len(own):])
    return -float(loss.sum()) / state.deaths, np.concatenate(parts), np.concatenate(fresh) if fresh else np.zeros(0)
