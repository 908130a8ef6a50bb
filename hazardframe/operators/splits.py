"""Train/test splits and cross-validation folds.

Rows are ordered by ``md5(id:seed)``, so a split is the same on every run, cluster size and engine. A split needs only
the md5 strings at a few ranks; membership is then a comparison inside each row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from hazardframe.operators.encode import cohort_counts
from hazardframe.operators.ordered import hash_cuts, median_of


def hash_key(id_cols: list[str], *salts) -> Column:
    return F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in id_cols], *[F.lit(str(s)) for s in salts]))


def default_alphas(low: float = -1.0, high: float = -0.1, n: int = 20) -> list[float]:
    """Logarithmic grid of penalties; the defaults are fixed values."""
    return [float(a) for a in np.logspace(low, high, n)]


def _quotas(sizes: dict, fraction: float) -> dict:
    """Largest-remainder allocation of floor(fraction * n) rows to the strata; ties go to the smaller key."""
    total = sum(sizes.values())
    goal = int(np.floor(fraction * total + 1e-9))
    exact = {k: n * goal / total for k, n in sizes.items()}
    quota = {k: int(v) for k, v in exact.items()}
    order = sorted(sizes, key=lambda k: (-(exact[k] - quota[k]), k))
    for k in order[:goal - sum(quota.values())]:
        quota[k] += 1
    return quota


def stratified_split(df: DataFrame, id_col: str, time: str, event: str, fraction: float = 0.8,
                     seed: int = 42) -> DataFrame:
    """Add ``is_train``. Strata are event by (time above the median); a stratum below two rows falls back to the event."""
    middle = median_of(df, time)
    fine = F.concat_ws("_", F.col(event).cast("int"), (F.col(time) > F.lit(middle)).cast("int"))
    plain = F.col(event).cast("int").cast("string")
    for stratum in (fine, plain):
        sizes = {r["s"]: r["n"] for r in df.groupBy(stratum.alias("s")).agg(F.count("*").alias("n")).collect()}
        if min(sizes.values()) >= 2:
            quota = _quotas(sizes, fraction)
            h = hash_key([id_col], seed)
            cuts = hash_cuts(df.select(stratum.alias("label"), h.alias("h")), {k: [q] for k, q in quota.items()})
            limit = F.lit("")
            for k, q in quota.items():
                limit = F.when(stratum == k, F.lit(cuts[k, q])).otherwise(limit)
            return df.withColumn("is_train", h <= limit)
    raise ValueError("Stratified split failed: an outcome class has fewer than 2 rows.")


def group_split(df: DataFrame, id_col: str, fraction: float = 0.8, seed: int = 42) -> DataFrame:
    """Add ``is_train`` so that all rows of a subject share a side; the fraction counts subjects, not rows."""
    h = hash_key([id_col], seed)
    ids = df.select(F.lit("all").alias("label"), h.alias("h")).distinct()
    goal = int(np.floor(fraction * ids.count() + 1e-9))
    return df.withColumn("is_train", h <= F.lit(hash_cuts(ids, {"all": [goal]})["all", goal]))


def train_test_split(df: DataFrame, id_col: str, time: str, event: str, fraction: float = 0.8,
                     seed: int = 42) -> DataFrame:
    """Stratified when ids are unique, by subject when they repeat."""
    if cohort_counts(df, id_col).first()["has_duplicates"]:
        return group_split(df, id_col, fraction, seed)
    return stratified_split(df, id_col, time, event, fraction, seed)


def kfold(df: DataFrame, id_cols: list[str], k: int = 5, repeats: int = 3, seed: int = 42,
          out: str = "folds") -> DataFrame:
    """Add an array with one fold number per repeat; ``id_cols`` must identify a row.

    Folds are consecutive stretches of the md5 order, as even as possible, the larger ones first.
    """
    return df.withColumn(out, F.array(*fold_columns(df, id_cols, k, repeats, seed)))


def fold_columns(df: DataFrame, id_cols: list[str], k: int, repeats: int, seed: int) -> list[Column]:
    """Row-local fold number of each repeat, learned from the rows of ``df``."""
    return part_fold_columns(df, id_cols, [F.lit(True)], k, repeats, seed)


def part_fold_columns(df: DataFrame, id_cols: list[str], parts: list[Column], k: int, repeats: int, seed: int) -> list[Column]:
    """Fold numbers inside several (overlapping) parts of ``df`` at once: one column per part and repeat."""
    row = df.agg(*[F.sum(p.cast("int")) for p in parts]).first()
    keys = [hash_key(id_cols, seed, r) for r in range(repeats)]
    labels = [(o, r, f"{o}.{r}") for o in range(len(parts)) for r in range(repeats)]
    cells = F.array(*[F.when(parts[o], F.struct(F.lit(name).alias("label"), keys[r].alias("h"))) for o, r, name in labels])
    labelled = df.select(F.explode(F.filter(cells, lambda c: c.isNotNull())).alias("c")).select("c.*")
    ends = [[sum(n // k + (i < n % k) for i in range(f + 1)) for f in range(k - 1)] for n in (v or 0 for v in row)]
    cuts = hash_cuts(labelled, {name: ends[o] for o, _, name in labels})
    return [sum(((keys[r] > F.lit(cuts[name, e])).cast("int") for e in ends[o]), F.lit(0)) for o, r, name in labels]


def kfold_long(df: DataFrame, id_cols: list[str], k: int = 5, repeats: int = 3, seed: int = 42) -> DataFrame:
    """One row per (repeat, row) with its fold."""
    folded = kfold(df, id_cols, k, repeats, seed)
    return folded.select(*id_cols, F.posexplode("folds").alias("repeat", "fold"))
