"""A neural Cox model trained where the rows are.

Rows are dealt to mini-batches once, by a hash of the row and the seed. In every training step all batches of the step
compute their gradient at the same weights (batch normalisation and the risk set are those of the batch); the mean gradient,
weighted by rows, makes one Adam step. Only weights and gradients travel, the rows never move again, and the result is a
function of the data, the parameters and the seed: neither cores nor partitions take part in it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType

from hazardframe.operators.cox_likelihood import CHUNK, _vectors, sum_vectors
from hazardframe.operators.curves import breslow_baseline
from hazardframe.operators.whole_batch import EPS, exact_step, time_blocks
from hazardframe.session import cut_lineage

MOMENTUM = 0.1  # fixed values: of batch normalisation, and Adam's constants
ADAM = (0.9, 0.999, 1e-8)
STACK_CELLS = 16_384  # numbers of one layer that a task computes at a time, so that they stay in the cache


def cox_loss_gradient(eta: np.ndarray, time: np.ndarray, event: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean negative log partial likelihood of a batch (Breslow ties) and its derivative by the scores."""
    loss, grad = _loss_gradients(eta[None], time[None], event[None])
    return float(loss[0]), grad[0]


def _loss_gradients(eta: np.ndarray, time: np.ndarray, event: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for many batches of one size, a batch in each row: a loss per batch and all derivatives."""
    order = np.argsort(-time, axis=1, kind="stable")
    t, e, s = (np.take_along_axis(v, order, axis=1) for v in (time, event, eta - eta.max(axis=1, keepdims=True)))
    risk = np.exp(s)
    new = np.ones((len(t), t.shape[1] + 1), dtype=bool)  # everyone with the same time shares a risk set
    new[:, 1:-1] = (t[:, 1:] != t[:, :-1]) & ~(np.isnan(t[:, 1:]) & np.isnan(t[:, :-1]))
    at = np.arange(t.shape[1])
    first = np.maximum.accumulate(np.where(new[:, :-1], at, 0), axis=1)
    last = np.minimum.accumulate(np.where(new[:, 1:], at, t.shape[1])[:, ::-1], axis=1)[:, ::-1]
    total = np.take_along_axis(np.cumsum(risk, axis=1), last, axis=1)
    deaths = e.sum(axis=1, keepdims=True) + 1e-8
    loss = -np.sum(e * (s - np.log(total)), axis=1) / deaths[:, 0]
    hazard = np.take_along_axis(np.cumsum((e / total)[:, ::-1], axis=1)[:, ::-1], first, axis=1)
    grad = np.empty_like(eta)
    np.put_along_axis(grad, order, -(e - risk * hazard) / deaths, axis=1)
    return loss, grad


@dataclass
class Network:
    """Layer sizes and the layout of all weights in one vector; running statistics come last."""

    inputs: int
    hidden: list[int]

    def __post_init__(self):
        self.shapes, prev = [], self.inputs
        for h in self.hidden:
            self.shapes += [(prev, h), (h,), (h,), (h,)]  # weight, bias, scale, shift
            prev = h
        self.shapes += [(prev, 1), (1,)]
        self.trainable = sum(math.prod(s) for s in self.shapes)
        self.size = self.trainable + 2 * sum(self.hidden)

    def start(self, seed: int) -> np.ndarray:
        rng, parts, prev = np.random.default_rng(seed), [], self.inputs
        for h in [*self.hidden, 1]:
            bound = 1 / math.sqrt(prev)
            parts += [rng.uniform(-bound, bound, prev * h), rng.uniform(-bound, bound, h)]
            if len(parts) < 4 * len(self.hidden) + 2:
                parts += [np.ones(h), np.zeros(h)]
            prev = h
        stats = [v for h in self.hidden for v in (np.zeros(h), np.ones(h))]
        return np.concatenate([*parts, *stats])

    def split(self, vec: np.ndarray):
        out, at = [], 0
        for s in [*self.shapes, *[(h,) for h in self.hidden for _ in range(2)]]:
            n = math.prod(s)
            out.append(vec[at:at + n].reshape(s))
            at += n
        return out[:len(self.shapes)], out[len(self.shapes):]

    def predict(self, vec: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Scores with running statistics and without dropout."""
        w, stats = self.split(vec)
        for i in range(len(self.hidden)):
            weight, bias, scale, shift = w[4 * i:4 * i + 4]
            z = (x @ weight + bias - stats[2 * i]) / np.sqrt(stats[2 * i + 1] + EPS)
            x = np.maximum(z * scale + shift, 0.0)
        return (x @ w[-2] + w[-1])[:, 0]

    def train_batch(self, vec, x, time, event, dropout=0.0, rng=None):
        """Loss, gradient of the trainable part, and updated running statistics for one mini-batch."""
        return self.train_batches(vec, x[None], time[None], event[None], dropout, [rng])

    def train_batches(self, vec, x, time, event, dropout=0.0, rngs=()):
        """The same, summed over mini-batches of one size: ``x`` is (batches, rows, features), and each batch has its generator."""
        w, stats = self.split(vec)
        tape, new_stats, (many, n) = [], [], x.shape[:2]
        flat = lambda a: a.reshape(many * n, -1)
        shaped = lambda a: a.reshape(many, n, -1)
        mean = lambda a: np.add.reduce(a, axis=1, keepdims=True) / n
        mean_of = lambda a, b: np.einsum("bnh,bnh->bh", a, b)[:, None] / n
        masks = [np.empty((many, n, h)) for h in self.hidden] if dropout else []
        for b, rng in enumerate(rngs if dropout else ()):
            for m in masks:
                rng.random(out=m[b])
        for i in range(len(self.hidden)):
            weight, bias, scale, shift = w[4 * i:4 * i + 4]
            z = shaped(flat(x) @ weight)
            center = mean(z)
            z -= center
            var = mean_of(z, z)
            new_stats += [many * (1 - MOMENTUM) * stats[2 * i] + MOMENTUM * (center + bias).sum(axis=(0, 1)),
                          many * (1 - MOMENTUM) * stats[2 * i + 1] + MOMENTUM * var.sum(axis=(0, 1)) * n / max(n - 1, 1)]
            sd = np.sqrt(var + EPS)
            z /= sd
            act = z * (scale / (1 - dropout))
            act += shift / (1 - dropout)
            alive = act > 0
            if dropout:
                alive &= masks[i] >= dropout
            np.maximum(act, 0.0, out=act)
            act *= alive
            tape.append((x, z, sd, alive, weight, scale))
            x = act
        losses, d_eta = _loss_gradients((flat(x) @ w[-2] + w[-1]).reshape(many, n), time, event)
        d_eta = d_eta.reshape(-1, 1)
        grads = [flat(x).T @ d_eta, np.array([d_eta.sum()])]
        back = shaped(d_eta * w[-2].T)
        for i, (inp, norm, sd, alive, weight, scale) in reversed(list(enumerate(tape))):
            back *= alive
            back /= 1 - dropout
            level, slope = mean(back), mean_of(back, norm)
            d_scale, d_shift = n * slope.sum(axis=(0, 1)), n * level.sum(axis=(0, 1))
            back -= level
            back -= norm * slope
            back *= scale / sd
            grads = [flat(inp).T @ flat(back), flat(back).sum(axis=0), d_scale, d_shift, *grads]
            if i:
                back = shaped(flat(back) @ weight.T)
        stats_vec = np.concatenate(new_stats) if new_stats else np.zeros(0)
        return float(losses.sum()), np.concatenate([g.ravel() for g in grads]), stats_vec


def _numbered(rows: DataFrame, block: int = 10_000) -> DataFrame:
    """Number the copies of identical rows, so that a row repeated very often is dealt to all batches.

    Copies are counted first and written out again in blocks that are spread over the tasks.
    """
    names = rows.columns
    counted = rows.groupBy(*names).agg(F.count("*").alias("n"))
    blocks = counted.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / block))))
    spread = blocks.repartition(F.xxhash64(*names, "b"))
    last = F.least(F.col("n"), (F.col("b") + 1) * block) - 1
    return spread.select(*names, F.explode(F.sequence(F.col("b") * block, last)).alias("copy"))


def _stacks(batch: pa.RecordBatch, width: int):
    """The mini-batches of an Arrow batch, those of one size together: numbers, times, events and features as stacked arrays."""
    number, lists = batch.column("batch").to_numpy(), [batch.column(c) for c in ("time", "event", "features")]
    sizes = pc.list_value_length(lists[0]).to_numpy()
    values = [c.flatten().to_numpy(zero_copy_only=False) for c in lists]
    starts = np.cumsum(sizes) - sizes
    values[2] = values[2].reshape(len(values[0]), -1)
    for n in np.unique(sizes):
        same = np.flatnonzero(sizes == n)
        step = max(1, STACK_CELLS // (int(n) * max(1, width, values[2].shape[1])))
        for at in range(0, len(same), step):
            part = same[at:at + step]
            rows = starts[part][:, None] + np.arange(n)
            yield number[part].tolist(), *[v[rows] for v in values]


@dataclass
class DeepCox:
    """Hidden layers of Linear, BatchNorm, ReLU and Dropout, then one linear score."""

    # The sizes and rates that the method is published with.
    names: list[str]
    hidden: list[int] = field(default_factory=lambda: [64, 32])
    dropout: float = 0.2
    lr: float = 1e-4
    weight_decay: float = 1e-4
    seed: int = 42
    weights: np.ndarray | None = None
    baseline: DataFrame | None = None
    losses: list[float] = field(default_factory=list)

    @property
    def network(self) -> Network:
        return Network(len(self.names), list(self.hidden))

    def fit(self, df: DataFrame, epochs: int = 200, batch_size: int | None = 64, steps_per_epoch: int = 1) -> "DeepCox":
        """``df`` has ``time``, ``event`` and a scaled ``features`` array.

        There are ``rows // batch_size`` batches (one at least). With ``steps_per_epoch`` = 1, the default, each step uses all
        rows; a larger number deals the batches to that many steps, each with an update of its own. Without a ``batch_size``
        the whole table is one batch: risk sets and batch normalisation span all rows, see :mod:`whole_batch`.
        """
        net = self.network
        w = net.start(self.seed)
        m, v, done, self.losses = np.zeros(net.trainable), np.zeros(net.trainable), 0, []
        for epoch, steps in enumerate(self._epochs(df, epochs, batch_size, steps_per_epoch)):
            losses = []
            for step in steps:
                n, loss, grad, stats = step(w, epoch)
                grad = grad + self.weight_decay * w[:net.trainable]
                done += 1
                m, v = ADAM[0] * m + (1 - ADAM[0]) * grad, ADAM[1] * v + (1 - ADAM[1]) * grad * grad
                w[:net.trainable] -= self.lr * (m / (1 - ADAM[0] ** done)) / (np.sqrt(v / (1 - ADAM[1] ** done)) + ADAM[2])
                w[net.trainable:] = stats
                losses.append((loss * n, n))
            self.losses.append(sum(x for x, _ in losses) / max(1.0, sum(n for _, n in losses)))
        self.weights = w
        self.baseline = cut_lineage(breslow_baseline(self.score(df), "time", "event", "risk_score"))
        return self

    def _epochs(self, df: DataFrame, epochs: int, batch_size: int | None, steps_per_epoch: int):
        """For each epoch its steps: functions of weights and epoch that give rows, mean loss, mean gradient and statistics."""
        net = self.network
        if batch_size is None:
            blocks = time_blocks(df)
            whole = lambda w, epoch: (1.0, *exact_step(blocks, net, w, self.dropout, [self.seed, epoch], MOMENTUM))
            return [[whole]] * epochs
        rows = cut_lineage(_numbered(df.select(F.col("time").cast("double").alias("time"),
                                               F.col("event").cast("double").alias("event"), "features")))
        batches = max(1, rows.count() // batch_size)
        n_steps = max(1, min(steps_per_epoch, batches))
        place = F.xxhash64("time", "event", "features", "copy", F.lit(self.seed))
        packed = cut_lineage(rows.select(F.pmod(place, F.lit(batches)).alias("batch"), F.struct(place.alias("place"), "time", "event", "features").alias("row"))
                             .groupBy("batch").agg(F.sort_array(F.collect_list("row")).alias("rows"))
                             .select("batch", F.pmod("batch", F.lit(n_steps)).alias("step"), F.col("rows.time").alias("time"),
                                     F.col("rows.event").alias("event"), F.flatten("rows.features").alias("features")))
        present = {r["step"] for r in packed.select("step").distinct().collect()}

        def mean_step(number):
            part = packed.where(F.col("step") == number) if n_steps > 1 else packed

            def run(w, epoch):
                total = self._gradient(part, w, epoch)
                n = total[-1]
                return n, total[-2] / n, total[:net.trainable] / n, total[net.trainable:net.size] / n
            return run

        return [[mean_step(k) for k in range(n_steps) if k in present]] * epochs

    def _gradient(self, packed: DataFrame, weights: np.ndarray, epoch: int) -> np.ndarray | None:
        """Sums over batches, weighted by their rows: gradient, running statistics, loss; and the number of rows."""
        net, dropout, seed = self.network, self.dropout, self.seed
        sent = packed.sparkSession.sparkContext.broadcast(weights)

        def train(batches):
            total = None
            for b in batches:
                for number, t, e, x in _stacks(b, len(net.hidden) and max(net.hidden)):
                    rngs = [np.random.default_rng([seed, epoch, k]) for k in number] if dropout else ()
                    loss, grad, stats = net.train_batches(sent.value, x, t, e, dropout, rngs)
                    vec = np.concatenate([grad, stats, [loss, len(number)]]) * t.shape[1]
                    total = vec if total is None else total + vec
            if total is not None:
                for c in range(0, len(total), CHUNK):
                    yield _vectors([c // CHUNK], total[None, c:c + CHUNK], pa.int64())

        parts = packed.select("batch", "time", "event", "features").mapInArrow(train, "key bigint, vec array<double>")
        got = {r["key"]: np.asarray(r["vec"]) for r in sum_vectors(parts, "bigint").collect()}
        sent.unpersist()
        return np.concatenate([got[k] for k in sorted(got)]) if got else None

    def _require(self):
        if self.weights is None:
            raise ValueError("No weights yet; call fit() or load().")

    def score(self, df: DataFrame, out: str = "risk_score") -> DataFrame:
        """Row-local, so ``df`` may be a stream. An existing score column is reused."""
        self._require()
        if out in df.columns:
            return df
        net, weights = self.network, self.weights

        @F.pandas_udf(DoubleType())
        def forward(features: pd.Series) -> pd.Series:
            return pd.Series(net.predict(weights, np.stack(features.to_numpy())) if len(features) else [], dtype=float)

        return df.withColumn(out, forward("features"))

    def hazards(self, df: DataFrame) -> DataFrame:
        return self.score(df).withColumn("hazard", F.exp("risk_score"))

    def loss_history(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(self.losses)], "epoch int, loss double")

    def save(self, path: str) -> None:
        self._require()
        meta = self.baseline.sparkSession.createDataFrame(
            [(self.names, [int(h) for h in self.hidden], [float(v) for v in self.weights], [float(v) for v in self.losses])],
            "names array<string>, hidden array<int>, weights array<double>, losses array<double>")
        meta.write.mode("overwrite").parquet(f"{path}/model")
        self.baseline.write.mode("overwrite").parquet(f"{path}/baseline")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "DeepCox":
        m = spark.read.parquet(f"{path}/model").first()
        return cls(list(m.names), list(m.hidden), weights=np.asarray(m.weights), losses=list(m.losses),
                   baseline=spark.read.parquet(f"{path}/baseline"))
