"""L1-penalised Cox regression: proximal Newton steps on Spark aggregates, grid search, nested cross-validation."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from hazardframe.functions.scalar import dot
from hazardframe.operators import model_concordance as mc
from hazardframe.operators.cox_likelihood import MAX_CURVE_CELLS, MAX_SCORE, ORDERED_MODELS, Likelihood, Models, TrainSet, _unpack
from hazardframe.operators.curves import breslow_baseline
from hazardframe.operators.fold_statistics import set_medians, set_moments
from hazardframe.operators.metrics import concordance_index
from hazardframe.operators.splits import default_alphas, kfold, part_fold_columns
from hazardframe.session import cut_lineage, settle

WORKING_SET = 256
FAILED_SCORE = 0.5
MODELS_PER_SCORING = 300


class NotConverged(RuntimeError):
    """A penalised fit ran out of steps before it met the optimality conditions."""


def penalty_weights(names: list[str], protected: list[str], protected_substring: str | None = None,
                    rescale: bool = True) -> list[float]:
    """0 for protected columns and for every name that contains the substring, 1 for the rest; rescaled to sum to p."""
    w = [0.0 if n in protected or (protected_substring and protected_substring in n) else 1.0 for n in names]
    total = sum(w)
    return [v * len(names) / total for v in w] if rescale and total else w


def kkt_gap(gradient: np.ndarray, beta: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """Distance from optimality per coefficient; ``gradient`` is that of the mean log likelihood."""
    active = np.abs(gradient - penalty * np.sign(beta))
    return np.where(beta != 0, active, np.maximum(np.abs(gradient) - penalty, 0.0))


def _newton_step(beta, gradient, curvature, penalty, sweeps=500, tol=1e-10):
    """Coordinate descent on the local quadratic model of one coefficient block."""
    new, diag = beta.copy(), np.maximum(np.diag(curvature), 1e-10)
    shift = np.zeros_like(beta)  # curvature @ (new - beta)
    for _ in range(sweeps):
        largest = 0.0
        for j in range(len(beta)):
            z = gradient[j] - shift[j] + diag[j] * new[j]
            value = np.sign(z) * max(abs(z) - penalty[j], 0.0) / diag[j]
            delta = value - new[j]
            if delta:
                shift += curvature[:, j] * delta
                new[j] = value
                largest = max(largest, abs(delta))
        if largest < tol:
            break
    return new


def _working_set(beta, gap, size):
    if len(beta) <= size:
        return np.arange(len(beta))
    active = np.nonzero(beta)[0]
    wanted = [j for j in np.argsort(-gap, kind="stable") if gap[j] > 0 and beta[j] == 0]
    return np.sort(np.concatenate([active, np.asarray(wanted[:max(size - len(active), 16)], dtype=int)]))


def fit_models(df: DataFrame, sets: list[TrainSet], alphas: list[float], weights: list[float], tol: float = 1e-6,
               max_iter: int = 60, working_set: int = WORKING_SET, likelihood: Likelihood | None = None) -> np.ndarray:
    """Coefficients of every (training set, alpha): array of shape (sets, alphas, features).

    All models advance together, two scans per step and batch of models whose hazard curves fit the checked size. A model that has
    not settled after ``max_iter`` steps is an error and never a silent answer.
    """
    pairs = [(g, a) for g in range(len(sets)) for a in alphas]
    return fit_pairs(df, sets, pairs, weights, tol, max_iter, working_set, likelihood).reshape(len(sets), len(alphas), -1)


def fit_pairs(df: DataFrame, sets: list[TrainSet], pairs: list[tuple[int, float]], weights: list[float], tol: float = 1e-6,
              max_iter: int = 60, working_set: int = WORKING_SET, likelihood: Likelihood | None = None) -> np.ndarray:
    """Coefficients of chosen (training set number, alpha) pairs, one row each."""
    w, like = np.asarray(weights, dtype=float), likelihood or Likelihood(df)
    if len(pairs) >= ORDERED_MODELS:
        like.ordered()
    return _advance(like, sets, pairs, w, tol, max_iter, working_set)


def _evaluated(like, sets, set_of, beta, working):
    """Evaluate models in scans of a checked size: number of the model and its values, a scan at a time.

    Models of one set with equal coefficients are evaluated once.
    """
    same: dict[tuple, list[int]] = {}
    for i, (g, b, w) in enumerate(zip(set_of.tolist(), beta, working)):
        same.setdefault((g, b.tobytes(), w.tobytes()), []).append(i)
    alike, step = list(same.values()), like.models_per_scan(max(map(len, working)))
    for lo in range(0, len(alike), step):
        some = [numbers[0] for numbers in alike[lo:lo + step]]
        ids = sorted({int(set_of[i]) for i in some})
        local = {g: at for at, g in enumerate(ids)}
        models = Models([sets[g] for g in ids], np.asarray([local[int(set_of[i])] for i in some]), beta[some])
        got = like.evaluate(models, [working[i] for i in some])
        for at, numbers in enumerate(alike[lo:lo + step]):
            for i in numbers:
                yield i, {name: values[at] for name, values in got.items()}


def _advance(like, sets, chunk, w, tol, max_iter, working_set):
    k, p = len(chunk), len(w)
    set_of = np.asarray([g for g, _ in chunk])
    penalty = np.asarray([alpha for _, alpha in chunk])[:, None] * w[None, :]
    beta, best = np.zeros((k, p)), np.zeros((k, p))
    best_value = np.full(k, np.inf)
    open_models = np.arange(k)
    # Features to include in the curvature; wide models start from the gradient alone.
    working = [np.arange(p) if p <= working_set else np.arange(0) for _ in range(k)]
    for _ in range(max_iter):
        still = []
        for i, got in _evaluated(like, sets, set_of[open_models], beta[open_models], [working[m] for m in open_models]):
            m, n = open_models[i], max(got["n"], 1.0)
            value = -got["loglik"] / n + float(penalty[m] @ np.abs(beta[m]))
            if not np.isfinite(value) or value > best_value[m] + 1e-12 * max(1.0, abs(best_value[m])):
                beta[m] = (beta[m] + best[m]) / 2  # the step was too long
                if np.abs(beta[m] - best[m]).max() > 1e-12:
                    still.append(m)
                else:
                    beta[m] = best[m]
                continue
            best_value[m], best[m] = value, beta[m].copy()
            grad = got["gradient"] / n
            gap = kkt_gap(grad, beta[m], penalty[m])
            if gap.max(initial=0.0) <= tol:
                continue
            block = working[m]
            if len(block):
                beta[m, block] = _newton_step(beta[m, block], grad[block], got["curvature"] / n, penalty[m, block])
            working[m] = _working_set(beta[m], gap, working_set)
            still.append(m)
        open_models = np.asarray(sorted(still), dtype=int)
        if not len(open_models):
            return best
    left = ", ".join(f"set {chunk[m][0]} alpha {chunk[m][1]:.4g}" for m in open_models[:5])
    raise NotConverged(f"{len(open_models)} of {k} models are still moving after {max_iter} steps ({left}); raise max_iter or tol")


@dataclass
class LassoCox:
    """A fitted model: coefficients on the driver, baseline curve as a DataFrame."""

    names: list[str]
    alpha: float
    weights: list[float] | None = None
    coefficients: list[float] | None = None
    baseline: DataFrame | None = None

    def fit(self, df: DataFrame, tol: float = 1e-7, max_iter: int = 100, max_curve_cells: int = MAX_CURVE_CELLS) -> "LassoCox":
        """``df`` has ``time``, ``event`` and a scaled ``features`` array.

        Curves of more than ``max_curve_cells`` numbers are joined by time instead of being held; the optimum is the same.
        """
        weights = self.weights or [1.0] * len(self.names)
        beta = fit_models(df, [TrainSet()], [self.alpha], weights, tol, max_iter, likelihood=Likelihood(df, max_curve_cells))[0, 0]
        self.coefficients = [float(b) for b in beta]
        self.baseline = cut_lineage(breslow_baseline(self.score(df), "time", "event", "risk_score"))
        return self

    def _require(self):
        if self.coefficients is None:
            raise ValueError("No coefficients yet; call fit() or load().")

    def score(self, df: DataFrame, out: str = "risk_score") -> DataFrame:
        """Row-local, so ``df`` may be a stream. An existing score column is reused."""
        self._require()
        if out in df.columns:
            return df
        return df.withColumn(out, dot(F.col("features"), self.coefficients))

    def hazards(self, df: DataFrame) -> DataFrame:
        return self.score(df).withColumn("hazard", F.exp("risk_score"))

    def coefficient_table(self, spark: SparkSession) -> DataFrame:
        self._require()
        rows = [(n, float(c), float(np.exp(c))) for n, c in zip(self.names, self.coefficients)]
        return spark.createDataFrame(rows, "feature string, coefficient double, hazard_ratio double")

    def selected_features(self, spark: SparkSession, top: int | None = None) -> DataFrame:
        """Non-zero coefficients by absolute size; with ``top`` only that many."""
        found = self.coefficient_table(spark).where("coefficient <> 0").orderBy(F.abs("coefficient").desc(), "feature")
        return found.limit(top) if top else found

    def save(self, path: str) -> None:
        self._require()
        spark = self.baseline.sparkSession
        meta = spark.createDataFrame([(self.names, self.coefficients, float(self.alpha), self.weights)],
                                     "names array<string>, coefficients array<double>, alpha double, weights array<double>")
        meta.write.mode("overwrite").parquet(f"{path}/model")
        self.baseline.write.mode("overwrite").parquet(f"{path}/baseline")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "LassoCox":
        m = spark.read.parquet(f"{path}/model").first()
        return cls(list(m.names), m.alpha, m.weights and list(m.weights), list(m.coefficients),
                   spark.read.parquet(f"{path}/baseline"))


@dataclass
class Judged:
    """What the scoring of a table needs to know about it: its rows and, unless there are too many, its distinct times."""

    n: int
    times: np.ndarray | None

    @classmethod
    def of(cls, df: DataFrame) -> "Judged":
        n = df.count()
        known = df.select(F.col("time").cast("double").alias("time")).where("time is not null and not isnan(time)")
        times, n_times = settle(known.distinct())
        held = n_times <= (mc.CELL_ROWS if n <= mc.CELL_ROWS else mc.MOST_TIMES)
        return cls(n, np.sort(times.toPandas()["time"].to_numpy()) if held else None)


def _side_rows(s: TrainSet, side: str, folds, n: int) -> np.ndarray:
    inside = s.rows(folds, n)
    return inside if side == "train" else TrainSet(s.held_out[:-1]).rows(folds, n) & ~inside


def fold_scores(df: DataFrame, sets: list[TrainSet], betas: np.ndarray, sides: tuple[str, ...] = ("test",),
                judged: Judged | None = None) -> DataFrame:
    """Concordance of every (set, alpha) model on the rows its set holds out and, if asked, on its training rows.

    The rows are scored in Arrow batches and the scores of a model stay packed, see :mod:`model_concordance`; equal
    coefficients of a set are judged once. In a large table with very many distinct times every score becomes a row. The
    held-out rows of an inner fold are those of its own outer training part.
    """
    n_sets, n_alphas, _ = betas.shape
    cols = ["time", "event", "features", *(["folds"] if "folds" in df.columns else [])]
    plain = df.select(*cols).withColumns({"time": F.col("time").cast("double"), "event": F.col("event").cast("boolean")})
    judged = judged or Judged.of(df)
    if judged.times is None:
        index = _long_scores(plain, sets, betas, sides)
    else:
        index = _packed_scores(plain, sets, betas, sides, judged)
    return index.select("side", (F.col("model") / n_alphas).cast("int").alias("set"),
                        (F.col("model") % n_alphas).cast("int").alias("alpha_no"), "c_index")


def _etas(s: TrainSet, x: np.ndarray, betas: np.ndarray) -> np.ndarray:
    return np.clip(s.design(x) @ betas.T, -MAX_SCORE, MAX_SCORE)


def _long_scores(plain: DataFrame, sets, betas, sides) -> DataFrame:
    n_alphas = betas.shape[1]

    def scan(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            t, e, x, folds = _unpack(b)
            parts = []
            for g, s in enumerate(sets):
                eta = _etas(s, x, betas[g])
                for side in sides:
                    rows = np.nonzero(_side_rows(s, side, folds, len(t)))[0]
                    parts += [pd.DataFrame({"side": side, "model": g * n_alphas + a, "time": t[rows], "event": e[rows] > 0,
                                            "eta": eta[rows, a]}) for a in range(n_alphas) if len(rows)]
            if parts:
                yield pa.RecordBatch.from_pandas(pd.concat(parts, ignore_index=True), preserve_index=False)

    scored = plain.mapInArrow(scan, "side string, model bigint, time double, event boolean, eta double")
    return concordance_index(cut_lineage(scored), "time", "event", "eta", ["side", "model"])


def _packed_scores(plain: DataFrame, sets, betas, sides, judged: Judged) -> DataFrame:
    n_sets, n_alphas, _ = betas.shape
    first = [np.unique(b, axis=0, return_index=True, return_inverse=True)[1:] for b in betas]
    stands = [[int(at[k]) for k in np.ravel(back)] for at, back in first]  # the first alpha with the same coefficients
    own = [sorted(set(v)) for v in stands]

    def scores(batch):
        t, e, x, folds = _unpack(batch)
        for g, s in enumerate(sets):
            for i, side in enumerate(sides):
                rows = np.flatnonzero(_side_rows(s, side, folds, len(t)))
                if len(rows):
                    yield (i * n_sets + g) * n_alphas, own[g], t[rows], e[rows] > 0, _etas(s, x[rows], betas[g][own[g]])

    edges = {}
    if judged.n > mc.CELL_ROWS:
        share = min(mc.SAMPLED / mc.CELL_ROWS, mc.MOST_SAMPLED / judged.n)
        seen = plain.sample(False, share, 42).toArrow().combine_chunks()  # bounded; it only steers how the scores are dealt
        for b in seen.to_batches():
            for at, alphas, _, _, eta in scores(b):
                edges |= {at + a: mc.cut_scores(eta[:, k], share) for k, a in enumerate(alphas)}
    times = plain.sparkSession.sparkContext.broadcast(judged.times)

    def scan(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            records = []
            for at, alphas, t, event, eta in scores(b):
                code = mc.time_codes(times.value, t, event)
                for k, a in enumerate(alphas):
                    records += mc.pack(at + a, np.ascontiguousarray(eta[:, k]), code, edges.get(at + a, ()))
            if records:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(
                    zip(*records), (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["model", "bin", "kind", "vals", "codes"])

    packed = plain.mapInArrow(scan, "model bigint, bin int, kind int, vals binary, codes binary")
    found = mc.many_concordances(packed, edges, 2 * len(judged.times) + 2)
    alphas = F.array(*[F.array(*[F.lit(a) for a in v]) for v in stands])
    at, double = F.col("model"), lambda name: F.col(name).cast("double")
    same = F.filter(F.sequence(F.lit(0), F.lit(n_alphas - 1)), lambda a: F.element_at(F.element_at(alphas, F.col("set") + 1), a + 1) == F.col("alpha"))
    names = F.array(*[F.lit(v) for v in sides])
    return (found.select(F.element_at(names, F.floor(at / (n_sets * n_alphas)).cast("int") + 1).alias("side"), (F.floor(at / n_alphas) % n_sets).cast("int").alias("set"),
                         (at % n_alphas).cast("int").alias("alpha"), F.try_divide(double("concordant") + 0.5 * double("tied"), double("comparable")).alias("c_index"))
            .select("side", "set", "c_index", F.explode(same).alias("a")).select("side", (F.col("set") * n_alphas + F.col("a")).alias("model"), "c_index"))


@dataclass
class GridSearch:
    """Result of a penalty search: the scores per fold and alpha, their summary and the winner."""

    alphas: list[float]
    fold_scores: dict[tuple[int, int], float]
    n_sets: int

    def _row(self, a: int) -> np.ndarray:
        return np.asarray([self.fold_scores.get((g, a), FAILED_SCORE) for g in range(self.n_sets)])

    @property
    def best_index(self) -> int:
        means = [round(self._row(a).mean(), 12) for a in range(len(self.alphas))]
        return int(np.argmax(means))  # the first of equals

    @property
    def best_alpha(self) -> float:
        return self.alphas[self.best_index]

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(a, float(alpha), float(self._row(a).mean()), float(self._row(a).std())) for a, alpha in enumerate(self.alphas)]
        return spark.createDataFrame(rows, "alpha_no int, alpha double, mean_score double, std_score double")


def _search(df, sets, alphas, weights, tol, max_iter) -> dict[tuple[int, int], float]:
    """Held-out concordance of every (set, alpha); the scores travel for a bounded number of models at a time."""
    betas, judged, out = fit_models(df, sets, alphas, weights, tol, max_iter), Judged.of(df), {}
    step = max(1, MODELS_PER_SCORING // len(alphas))
    for at in range(0, len(sets), step):
        for r in fold_scores(df, sets[at:at + step], betas[at:at + step], judged=judged).collect():
            out[at + r["set"], r["alpha_no"]] = _or_failed(r["c_index"])
    return out


def grid_search(df: DataFrame, names: list[str], alphas: list[float] | None = None, k: int = 5, repeats: int = 3,
                seed: int = 42, id_cols: list[str] = ("sid",), weights: list[float] | None = None,
                tol: float = 1e-5, max_iter: int = 40) -> GridSearch:
    """Repeated K-fold search over alpha on scaled features; a fold that cannot be scored counts 0.5."""
    alphas = alphas or default_alphas()
    folded = cut_lineage(kfold(df, list(id_cols), k, repeats, seed))
    sets = [TrainSet(((r, f),)) for r in range(repeats) for f in range(k)]
    return GridSearch(list(alphas), _search(folded, sets, alphas, weights or [1.0] * len(names), tol, max_iter), len(sets))


def _prepared(df: DataFrame, names: list[str], sets: list[TrainSet]) -> list[TrainSet]:
    """Learn medians, means and deviations on the training rows of each set."""
    medians = set_medians(df, sets, names)
    means, deviations = set_moments(df, sets, medians)
    return [TrainSet(s.held_out, tuple(a), tuple(b), tuple(c)) for s, a, b, c in zip(sets, medians, means, deviations)]


def nested_cv(df: DataFrame, names: list[str], alphas: list[float] | None = None, k: int = 5, repeats: int = 3,
              outer_seed: int = 100, inner_seed: int = 42, id_cols: list[str] = ("sid",),
              weights: list[float] | None = None, tol: float = 1e-5, max_iter: int = 40) -> DataFrame:
    """Nested repeated K-fold on raw features: imputation, scaling and the alpha search are redone in every fold.

    One row per outer fold with the chosen alpha and the train and test concordance; only scores reach the driver.
    """
    alphas, weights, ids = alphas or default_alphas(), weights or [1.0] * len(names), list(id_cols)
    outer = cut_lineage(kfold(df, ids, k, repeats, outer_seed))
    folds = [(r, f) for r in range(repeats) for f in range(k)]
    # Inner fold numbers follow the outer ones in the array; a row outside an outer training part gets numbers as well,
    # and the training sets exclude it by the outer fold.
    parts = [F.col("folds")[r] != f for r, f in folds]
    inner = part_fold_columns(outer, ids, parts, k, repeats, inner_seed)
    part = cut_lineage(outer.withColumn("folds", F.concat("folds", F.array(*inner))))
    place = lambda o, q: repeats + o * repeats + q
    inside = [TrainSet((fold, (place(o, q), g))) for o, fold in enumerate(folds) for q in range(repeats) for g in range(k)]
    prepared = _prepared(part, names, [*inside, *[TrainSet((fold,)) for fold in folds]])
    inside, finals = prepared[:len(inside)], prepared[len(inside):]
    scores, size = _search(part, inside, alphas, weights, tol, max_iter), repeats * k
    best = []
    for o in range(len(folds)):
        own = {(g - o * size, a): v for (g, a), v in scores.items() if o * size <= g < (o + 1) * size}
        best.append(GridSearch(list(alphas), own, size).best_alpha)
    betas = fit_pairs(part, finals, list(enumerate(best)), weights, tol, max_iter)
    got = {(x["set"], x["side"]): _or_failed(x["c_index"])
           for x in fold_scores(part, finals, betas[:, None, :], ("train", "test")).collect()}
    rows = [(r, f, float(best[o]), got.get((o, "train"), FAILED_SCORE), got.get((o, "test"), FAILED_SCORE))
            for o, (r, f) in enumerate(folds)]
    return df.sparkSession.createDataFrame(rows, "repeat int, fold int, alpha double, train_score double, test_score double")


def _or_failed(score) -> float:
    return FAILED_SCORE if score is None else float(score)


def cv_summary(scores: DataFrame, column: str = "test_score") -> DataFrame:
    """Mean and population deviation of fold scores."""
    return scores.agg(F.count("*").alias("n"), F.avg(column).alias("mean_score"), F.stddev_pop(column).alias("std_score"))
