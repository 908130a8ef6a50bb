"""The Cox partial likelihood as Spark aggregates, for many linear models at once.

With Breslow ties the derivative of the log partial likelihood by the score of row i is the martingale residual
M_i = e_i - H0(t_i) exp(eta_i). One evaluation is two scans: the first sums exp(eta) and deaths per distinct time,
the second sums M_i x_i (and the curvature) over the rows. Rows are never ordered and never leave the executors.
A *model* is a coefficient vector with its own training rows (given by cross-validation folds) and its own
imputation and scaling, so that a whole penalty path over all folds shares the two scans.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hazardframe.operators.ordered import match, match_stats, range_bounds, running
from hazardframe.session import cut_lineage, settle

MAX_CURVE_CELLS = 4_000_000  # distinct times x models that may be held as one array
CHUNK = 8192
BLOCK_CELLS = 1_000_000  # numbers that a task computes at a time: 8 MB
MAX_SCORE = 500.0  # exp() stays finite
SHARED_COLUMNS = 32  # of models that are evaluated on one design
ORDERED_MODELS = 20  # from here on the rows are worth ordering by time


@dataclass(frozen=True)
class TrainSet:
    """Training rows (those in none of the held-out folds) and the affine map of their features."""

    held_out: tuple[tuple[int, int], ...] = ()  # (position in the folds array, fold number)
    medians: tuple[float, ...] | None = None
    means: tuple[float, ...] | None = None
    deviations: tuple[float, ...] | None = None

    def mask(self, folds: str = "folds") -> Column | None:
        cond = None
        for pos, fold in self.held_out:
            c = F.col(folds)[pos] != fold
            cond = c if cond is None else cond & c
        return cond

    def design(self, x: np.ndarray) -> np.ndarray:
        if self.medians is not None:
            x = np.where(np.isnan(x), np.asarray(self.medians), x)
        return x if self.means is None else (x - np.asarray(self.means)) / np.asarray(self.deviations)

    def rows(self, folds: np.ndarray | None, n: int) -> np.ndarray:
        keep = np.ones(n, dtype=bool)
        for pos, fold in self.held_out:
            keep &= folds[:, pos] != fold
        return keep


@dataclass
class Models:
    """Coefficients ``beta`` (models x features) and the training set of each model."""

    sets: list[TrainSet]
    set_of: np.ndarray
    beta: np.ndarray

    def groups(self):
        for g, s in enumerate(self.sets):
            yield s, np.nonzero(self.set_of == g)[0]


class Shared:
    """One design for all models: columns on a common scale, a mark for each imputed value, and ones.

    The features of every training set are an affine map of it, so scores, sums and curvatures of all models are products of
    a few matrices, and only their small results are mapped to each model's own features.
    """

    def __init__(self, models: Models, h: int):
        self.models, p = models, h
        self.order = np.argsort(models.set_of, kind="stable")
        ends = np.searchsorted(models.set_of[self.order], np.arange(len(models.sets) + 1))
        self.slices = [slice(a, b) for a, b in zip(ends[:-1], ends[1:])]
        self.imputed = models.sets[0].medians is not None
        scaled = next((s for s in models.sets if s.means is not None), None)
        self.center = np.zeros(p) if scaled is None else np.asarray(scaled.means)
        self.scale = np.ones(p) if scaled is None else np.asarray(scaled.deviations)
        self.width = p * (2 if self.imputed else 1) + 1
        self.maps = np.stack([self._map(s, p) for s in models.sets])[models.set_of[self.order]]  # z = design @ map

    def _map(self, s: TrainSet, p: int) -> np.ndarray:
        means = np.zeros(p) if s.means is None else np.asarray(s.means)
        deviations = np.ones(p) if s.means is None else np.asarray(s.deviations)
        rows = [np.diag(self.scale / deviations)]
        if self.imputed:
            rows.append(np.diag((np.asarray(s.medians) - self.center) / deviations))
        return np.concatenate([*rows, (self.center - means)[None] / deviations])

    @staticmethod
    def fits(models: Models, working: list[np.ndarray]) -> bool:
        """Whether all models use the same columns, few enough to multiply them all by each other."""
        p = models.beta.shape[1]
        alike = len({len(w) for w in working}) == 1 and len(working[0]) in (0, p)
        return alike and p <= SHARED_COLUMNS and len({s.medians is None for s in models.sets}) == 1

    def design(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.center) / self.scale
        ones = np.ones((len(x), 1))
        if not self.imputed:
            return np.concatenate([z, ones], axis=1)
        gone = np.isnan(x)
        return np.concatenate([np.where(gone, 0.0, z), gone, ones], axis=1)

    def coefficients(self) -> np.ndarray:
        return np.einsum("mqp,mp->qm", self.maps, self.models.beta[self.order])

    def inside(self, folds, n: int) -> list[np.ndarray]:
        return [s.rows(folds, n).astype(float) for s in self.models.sets]

    def risk(self, design: np.ndarray, coefficients: np.ndarray, inside: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Scores, and exp(score) of the training rows of each model (in ``order``)."""
        eta = design @ coefficients
        np.clip(eta, -MAX_SCORE, MAX_SCORE, out=eta)
        risk = np.exp(eta)
        for at, rows in zip(self.slices, inside):
            risk[:, at] *= rows[:, None]
        return eta, risk


def matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """An Arrow list column with equal lengths as a 2-D array; nulls become NaN."""
    col = batch.column(name)
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def _unpack(batch: pa.RecordBatch):
    t = batch.column("time").to_numpy(zero_copy_only=False)
    e = batch.column("event").to_numpy(zero_copy_only=False).astype(float)
    x = matrix(batch, "features").astype(float)
    folds = matrix(batch, "folds") if "folds" in batch.schema.names else None
    return t, e, x, folds


def _vectors(keys, vecs, key_type) -> pa.RecordBatch:
    vecs = np.asarray(vecs, dtype=float)
    offsets = pa.array(np.arange(0, vecs.size + 1, vecs.shape[1]), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(keys, key_type), pa.ListArray.from_arrays(offsets, pa.array(vecs.ravel()))],
                                      names=["key", "vec"])


def sum_vectors(df: DataFrame, key_type: str, combine: bool = False) -> DataFrame:
    """Element-wise sum of ``vec`` per ``key``; each task keeps one running vector per key it owns.

    ``combine`` first sums inside the producing tasks, for sources that give many rows per key and task.
    """
    arrow = pa.float64() if key_type == "double" else pa.int64()

    def add(batches):
        held = {}
        for b in batches:
            keys, vecs = b.column("key").to_pylist(), b.column("vec")
            for i, k in enumerate(keys):
                v = vecs[i].values.to_numpy(zero_copy_only=False)
                held[k] = held[k] + v if k in held else v.copy()
        by_size = {}
        for k, v in held.items():
            by_size.setdefault(len(v), []).append(k)
        for ks in by_size.values():
            yield _vectors(ks, [held[k] for k in ks], arrow)

    schema = f"key {key_type}, vec array<double>"
    if combine:
        df = df.mapInArrow(add, schema)
    return df.repartition(F.col("key")).mapInArrow(add, schema)


def _sliced(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a block of ``width`` numbers a row is small, however many models are evaluated together."""
    rows = max(64, BLOCK_CELLS // max(1, width))
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _merge_times(t, rows, keep_t=None, keep_rows=None):
    """Add rows of a batch to the sums per distinct time; the sums are only copied when a new time comes."""
    order = np.argsort(t, kind="stable")
    t = t[order]
    starts = np.nonzero(np.concatenate([[True], t[1:] != t[:-1]]))[0]
    t, rows = t[starts], np.add.reduceat(rows[order], starts, axis=0)
    if keep_t is None:
        return t, rows
    at = np.minimum(np.searchsorted(keep_t, t), len(keep_t) - 1)
    known = keep_t[at] == t
    keep_rows[at[known]] += rows[known]
    if known.all():
        return keep_t, keep_rows
    keep_t, keep_rows = np.concatenate([keep_t, t[~known]]), np.concatenate([keep_rows, rows[~known]])
    order = np.argsort(keep_t, kind="stable")
    return keep_t[order], keep_rows[order]


class Likelihood:
    """Evaluations over one training table with columns ``time``, ``event``, ``features`` and, for CV, ``folds``."""

    def __init__(self, df: DataFrame, max_curve_cells: int = MAX_CURVE_CELLS):
        cols = [F.col("time").cast("double").alias("time"), F.col("event").cast("boolean").alias("event"), "features"]
        self.df = df.select(*cols, *(["folds"] if "folds" in df.columns else []))
        self.times, self.n_times = settle(self.df.select("time").distinct())
        self.limit = max_curve_cells
        self._bounds: list[float] | None = None

    def ordered(self) -> "Likelihood":
        """Deal the rows by time once, so that a task of a scan sees few times; equal times may be dealt to several tasks."""
        dealt = self.df.withColumn("__deal", F.xxhash64("features")).repartitionByRange("time", "__deal").sortWithinPartitions("time")
        self.df = cut_lineage(dealt.drop("__deal"))
        return self

    @property
    def bounds(self) -> list[float]:
        """Time ranges of bounded size for the joined plan, found when it first runs."""
        if self._bounds is None:
            self._bounds = range_bounds(self.times, "time", self.n_times)
        return self._bounds

    def models_per_scan(self, working: int = 0) -> int:
        """How many models fit the checked size together, with ``working`` curvature features each."""
        return max(1, self.limit // max(1, self.n_times * (3 + working)))

    def _time_sums(self, models: Models, working: list[np.ndarray]) -> DataFrame:
        """Per distinct time, a vector that holds for each model: sum of exp(eta), deaths, sum of exp(eta) * features."""
        starts = np.concatenate([[0], np.cumsum([2 + len(w) for w in working])])
        if Shared.fits(models, working):
            return self._shared_time_sums(models, len(working[0]))

        def scan(batches):
            keep_t = keep_rows = None
            for b in _sliced(batches, int(starts[-1])):
                if b.num_rows == 0:
                    continue
                t, e, x, folds = _unpack(b)
                rows = np.zeros((len(t), starts[-1]))
                for s, ids in models.groups():
                    inside = s.rows(folds, len(t))
                    z = s.design(x)
                    risk = np.exp(np.clip(z @ models.beta[ids].T, -MAX_SCORE, MAX_SCORE)) * inside[:, None]
                    for j, m in enumerate(ids):
                        at = starts[m]
                        rows[:, at] = risk[:, j]
                        rows[:, at + 1] = e * inside
                        if len(working[m]):
                            rows[:, at + 2:starts[m + 1]] = z[:, working[m]] * risk[:, [j]]
                keep_t, keep_rows = _merge_times(t, rows, keep_t, keep_rows)
            if keep_t is not None:
                for i in range(0, len(keep_t), CHUNK):
                    yield _vectors(keep_t[i:i + CHUNK], keep_rows[i:i + CHUNK], pa.float64())

        return sum_vectors(self.df.mapInArrow(scan, "key double, vec array<double>"), "double")

    def _shared_time_sums(self, models: Models, p: int) -> DataFrame:
        """The same sums from one product for each time of a batch."""
        k = len(models.beta)
        shared = Shared(models, models.beta.shape[1])
        coefficients, back = shared.coefficients(), np.argsort(shared.order, kind="stable")
        used = shared.width if p else 1  # the last column, of ones, gives the sum of exp(eta)

        def scan(batches):
            keep_t = keep_risk = keep_dead = None
            for b in _sliced(batches, 3 * k):
                if b.num_rows == 0:
                    continue
                t, e, x, folds = _unpack(b)
                order = np.argsort(t, kind="stable")
                inside = shared.inside(folds, len(t))
                design = shared.design(x)
                risk = shared.risk(design, coefficients, inside)[1]
                dead = np.stack([e * rows for rows in inside], axis=1)
                if (np.diff(order) != 1).any():
                    t, risk, design, dead = t[order], risk[order], design[order], dead[order]
                heads = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
                sums = np.empty((len(heads), k * used))
                for i, (lo, hi) in enumerate(zip(heads, [*heads[1:], len(t)])):
                    np.matmul(risk[lo:hi].T, design[lo:hi, -used:], out=sums[i].reshape(k, used))
                dead = np.add.reduceat(dead, heads, axis=0)
                old_t = keep_t
                keep_t, keep_risk = _merge_times(t[heads], sums, old_t, keep_risk)
                keep_dead = _merge_times(t[heads], dead, old_t, keep_dead)[1]
            if keep_t is not None:
                for i in range(0, len(keep_t), 64):
                    own = keep_risk[i:i + 64].reshape(-1, k, used)
                    parts = [own[:, :, -1:], keep_dead[i:i + 64][:, models.set_of[shared.order], None]]
                    if p:
                        parts.append(np.einsum("tmq,mqp->tmp", own, shared.maps, optimize=True))
                    out = np.concatenate(parts, axis=2)[:, back]
                    yield _vectors(keep_t[i:i + 64], out.reshape(len(out), -1), pa.float64())

        return sum_vectors(self.df.mapInArrow(scan, "key double, vec array<double>"), "double")

    def _held_curves(self, models: Models, working: list[np.ndarray]):
        """Curves as arrays: (times, H0), the sum of d log S0, and the risk-set part of the curvature, per model."""
        local = self._time_sums(models, working).toPandas().sort_values("key")
        vec = np.stack(local["vec"].to_numpy())
        hazards, logs, corrections, at = [], [], [], 0
        for w in working:
            block, at = vec[:, at:at + 2 + len(w)], at + 2 + len(w)
            deaths = block[:, 1]
            risk = np.cumsum(block[::-1], axis=0)[::-1]
            safe = np.where(risk[:, 0] > 0, risk[:, 0], 1.0)
            hazards.append(np.cumsum(deaths / safe))
            logs.append((deaths * np.log(safe)).sum())
            mean = risk[:, 2:] / safe[:, None]
            corrections.append((mean * deaths[:, None]).T @ mean)
        return (local["key"].to_numpy(), np.stack(hazards, axis=1)), np.asarray(logs), corrections

    def _joined_curves(self, models: Models):
        """The same curves as a table keyed by time, for more distinct times than may be held; and sum of d log S0."""
        k = len(models.beta)
        sums = self._time_sums(models, [np.arange(0)] * k)
        pairs = F.array(*[F.struct(F.col("vec")[2 * m].alias("r"), F.col("vec")[2 * m + 1].alias("d")) for m in range(k)])
        long = cut_lineage(sums.select(F.col("key").alias("time"), F.posexplode(pairs).alias("model", "c"))
                           .select("time", "model", "c.*"))
        risk = running(long, ["model"], "time", {"s": ("sum", "r")}, descending=True, bounds=self.bounds)
        risk = risk.withColumn("s", F.when(F.col("s") > 0, F.col("s")).otherwise(1.0))
        steps = cut_lineage(risk.select("model", "time", "d", "s", (F.col("d") / F.col("s")).alias("inc"),
                                        (F.col("d") / F.col("s") / F.col("s")).alias("inc2")))
        logs = np.zeros(k)
        for r in steps.groupBy("model").agg(F.sum(F.col("d") * F.ln("s")).alias("l")).collect():
            logs[r["model"]] = r["l"]
        cum = running(steps, ["model"], "time", {"h": ("sum", "inc"), "q": ("sum", "inc2")}, bounds=self.bounds)
        lists = cum.groupBy("time").agg(F.array_sort(F.collect_list(F.struct("model", "h", "q"))).alias("l"))
        return lists.select("time", F.col("l.h").alias("h0"), F.col("l.q").alias("q0")), logs

    def evaluate(self, models: Models, working: list[np.ndarray] | None = None) -> dict[str, list]:
        """Log likelihood, gradient, training rows, and the curvature restricted to ``working`` features, per model.

        The curvature is exact while the per-time sums fit the checked size; otherwise the curves are joined by time
        and its diagonal (in the scores) is used, which needs more steps and reaches the same optimum.
        """
        k, p = models.beta.shape
        working = working if working is not None else [np.arange(0)] * k
        width = sum(2 + len(w) for w in working)
        if self.n_times * width <= self.limit:
            curves, logs, corrections = self._held_curves(models, working)
            held, source = self.df.sparkSession.sparkContext.broadcast(curves), self.df
        else:
            curves, logs = self._joined_curves(models)
            held, source, corrections = None, self.df.join(curves, "time"), None
        sizes = [2 + p + len(w) ** 2 for w in working]
        per_model = max(-(-s // CHUNK) for s in sizes)
        shared = Shared(models, p) if Shared.fits(models, working) else None

        def shared_scan(batches):
            coefficients, own = shared.coefficients(), models.set_of[shared.order]
            first, second = np.triu_indices(shared.width)
            n, died = np.zeros(len(models.sets)), np.zeros(k)
            dead, expected = np.zeros((len(models.sets), shared.width)), np.zeros((k, shared.width))
            curved = np.zeros((k, len(first)))
            for b in _sliced(batches, 4 * k + len(first)):
                if b.num_rows == 0:
                    continue
                t, e, x, folds = _unpack(b)
                inside, design = shared.inside(folds, len(t)), shared.design(x)
                eta, risk = shared.risk(design, coefficients, inside)
                h0 = held.value[1][np.searchsorted(held.value[0], t)] if held is not None else matrix(b, "h0")
                weight = risk * h0[:, shared.order]
                for i, (at, rows) in enumerate(zip(shared.slices, inside)):
                    n[i] += rows.sum()
                    dead[i] += (e * rows) @ design
                    died[at] += (e * rows) @ eta[:, at]
                expected += weight.T @ design
                if len(working[0]):
                    if held is None:
                        weight = np.maximum(weight - risk * risk * matrix(b, "q0")[:, shared.order], 0.0)
                    curved += weight.T @ (design[:, first] * design[:, second])
            grad = np.einsum("mq,mqp->mp", dead[own] - expected, shared.maps)
            full = np.zeros((k, shared.width, shared.width))
            full[:, first, second] = full[:, second, first] = curved
            for j, m in enumerate(shared.order):
                square = shared.maps[j].T @ full[j] @ shared.maps[j] if len(working[m]) else np.zeros(0)
                v = np.concatenate([[died[j], n[own[j]]], grad[j], square.ravel()])
                for c in range(0, len(v), CHUNK):
                    yield _vectors([m * per_model + c // CHUNK], v[None, c:c + CHUNK], pa.int64())

        def scan(batches):
            sums = [np.zeros(s) for s in sizes]
            for b in _sliced(batches, 4 * k + p):
                if b.num_rows == 0:
                    continue
                t, e, x, folds = _unpack(b)
                h0 = held.value[1][np.searchsorted(held.value[0], t)] if held is not None else matrix(b, "h0")
                for s, ids in models.groups():
                    inside = s.rows(folds, len(t)).astype(float)
                    z = s.design(x)
                    eta = np.clip(z @ models.beta[ids].T, -MAX_SCORE, MAX_SCORE)
                    risk = np.exp(eta) * inside[:, None]
                    expected = risk * h0[:, ids]
                    grad = ((e * inside)[:, None] - expected).T @ z
                    weight = expected if held is not None else np.maximum(
                        expected - risk * risk * matrix(b, "q0")[:, ids], 0.0)
                    died = (e * inside) @ eta
                    for j, m in enumerate(ids):
                        w = working[m]
                        sums[m][0] += died[j]
                        sums[m][1] += inside.sum()
                        sums[m][2:2 + p] += grad[j]
                        if len(w):
                            part = z[:, w]
                            sums[m][2 + p:] += ((part * weight[:, [j]]).T @ part).ravel()
            for m, v in enumerate(sums):
                for c in range(0, len(v), CHUNK):
                    yield _vectors([m * per_model + c // CHUNK], v[None, c:c + CHUNK], pa.int64())

        parts = {r["key"]: np.asarray(r["vec"])
                 for r in sum_vectors(source.mapInArrow(shared_scan if shared else scan, "key bigint, vec array<double>"), "bigint").collect()}
        if held is not None:
            held.unpersist()
        out = {"loglik": [], "n": [], "gradient": [], "curvature": []}
        for m in range(k):
            v = np.concatenate([parts[m * per_model + c] for c in range(-(-sizes[m] // CHUNK))])
            w = len(working[m])
            curvature = v[2 + p:].reshape(w, w)
            out["loglik"].append(v[0] - logs[m])
            out["n"].append(v[1])
            out["gradient"].append(v[2:2 + p])
            out["curvature"].append(curvature if corrections is None else curvature - corrections[m])
        return out


def negative_log_likelihood(df: DataFrame, time: str, event: str, score: str, by: list[str] = (),
                            ties: str = "breslow", id_col: str | None = None) -> DataFrame:
    """Mean negative log partial likelihood per group (the training loss of a batch).

    ``breslow`` lets equal times share a risk set; ``rowwise`` orders equal times by ``id_col`` and lets each row see
    the rows before it, as a running sum over a sorted batch does. Scores are shifted by their group maximum.
    """
    by = list(by)
    top = df.groupBy(*by).agg(F.max(score).alias("__top"))
    rows = match_stats(df, top, by).withColumn("__eta", F.col(score) - F.col("__top")).withColumn(
        "__e", F.col(event).cast("int"))
    if ties == "rowwise":
        if id_col is None:
            raise ValueError("rowwise ties need id_col")
        return _rowwise_loss(rows, time, by, id_col)
    sums, n = settle(rows.groupBy(*by, F.col(time).cast("double").alias("time")).agg(
        F.sum("__e").alias("d"), F.sum(F.col("__e") * F.col("__eta")).alias("a"), F.sum(F.exp("__eta")).alias("r")))
    risk = running(sums, by, "time", {"s": ("sum", "r")}, descending=True, bounds=range_bounds(sums, "time", n))
    return _loss(risk, by, F.col("a") - F.when(F.col("d") > 0, F.col("d") * F.ln("s")).otherwise(0.0), F.col("d"))


def _loss(risk: DataFrame, by: list[str], term: Column, deaths: Column) -> DataFrame:
    return risk.groupBy(*by).agg((-F.sum(term) / (F.sum(deaths) + F.lit(1e-8))).alias("loss"))


def _rowwise_loss(rows: DataFrame, time: str, by: list[str], id_col: str) -> DataFrame:
    """Equal times are walked in id order: the later times come from the per-time sums, the rest from a window.

    A time that holds very many rows is cut into ranges of ids, so no window sees more than a range.
    """
    rows, n_rows = settle(rows.select(*by, F.col(time).cast("double").alias("time"), F.col(id_col).alias("__id"), "__e", "__eta")
                       .withColumn("__r", F.exp("__eta")))
    sums, n = settle(rows.groupBy(*by, "time").agg(F.sum("__r").alias("__m")))
    above = running(sums, by, "time", {"__s": ("sum", "__m")}, descending=True, bounds=range_bounds(sums, "time", n))
    above = above.select(*by, "time", (F.col("__s") - F.col("__m")).alias("__later"))
    inside = running(rows, [*by, "time"], "__id", {"__own": ("sum", "__r")}, bounds=range_bounds(rows, "__id", n_rows))
    full = match(inside, above, [*by, "time"])
    term = F.col("__e") * (F.col("__eta") - F.ln(F.greatest(F.col("__later"), F.lit(0.0)) + F.col("__own")))
    return _loss(full, by, term, F.col("__e"))
