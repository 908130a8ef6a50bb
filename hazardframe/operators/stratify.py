"""Risk classes: threshold, log-rank separation, confusion matrix, reports."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from hazardframe.functions.scalar import chi2_sf, significance
from hazardframe.operators.ordered import ROWS_PER_RANGE, median_of, range_bounds, running
from hazardframe.session import settle


@dataclass
class RiskClassifier:
    """High risk (1) is a score strictly above the median training score; a tie is low risk (0)."""

    score: str = "risk_score"
    threshold: float | None = None

    def fit(self, train: DataFrame, scorer: Callable[[DataFrame], DataFrame] | None = None) -> "RiskClassifier":
        """``scorer`` is any function that adds the score column; leave it out when the column is there."""
        scored = scorer(train) if scorer else train
        if self.score not in scored.columns:
            raise ValueError("pass a frame that has the score column, or a scorer that adds it")
        self.threshold = median_of(scored, self.score)
        return self

    def transform(self, df: DataFrame, scorer: Callable[[DataFrame], DataFrame] | None = None,
                  out: str = "risk_class") -> DataFrame:
        if self.threshold is None:
            raise ValueError("no threshold yet; call fit() before transform()")
        scored = scorer(df) if scorer else df
        if self.score not in scored.columns:
            raise ValueError("pass a frame that has the score column, or a scorer that adds it")
        return scored.withColumn(out, (F.col(self.score) > F.lit(self.threshold)).cast("int"))


def two_group_table(df: DataFrame, time: str, event: str, group: str, by: list[str] = (),
                    rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Per distinct time: deaths and numbers at risk, overall and in group 1."""
    by = list(by)
    e, g = F.col(event).cast("int"), F.col(group).cast("int")
    counts, n = settle(df.groupBy(*by, F.col(time).cast("double").alias("time")).agg(
        F.sum(e).alias("d"), F.sum(e * g).alias("d1"), F.count("*").alias("__m"), F.sum(g).alias("__m1")))
    bounds = range_bounds(counts, "time", n, rows_per_range)
    return running(counts, by, "time", {"n": ("sum", "__m"), "n1": ("sum", "__m1")}, descending=True,
                   bounds=bounds).drop("__m", "__m1")


def logrank_test(df: DataFrame, time: str, event: str, group: str, by: list[str] = (),
                 rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Two-group log-rank test (group 1 against group 0) with sizes, p-value and significance band."""
    by = list(by)
    table = two_group_table(df, time, event, group, by, rows_per_range)
    d, n, share = F.col("d"), F.col("n"), F.col("n1") / F.col("n")
    spread = F.when(n > 1, d * share * (1 - share) * (n - d) / (n - 1)).otherwise(0.0)
    sums = table.groupBy(*by).agg(
        F.sum("d1").cast("double").alias("observed"), F.sum(d * share).alias("expected"), F.sum(spread).alias("variance"),
        F.max("n1").alias("n_high"), (F.max("n") - F.max("n1")).alias("n_low"))
    gap = F.col("observed") - F.col("expected")
    tested = sums.withColumn("chi2", F.try_divide(gap * gap, F.col("variance")))
    return tested.withColumn("p_value", chi2_sf("chi2")).withColumn("significance", significance(F.col("p_value")))


def evaluate_stratification(df: DataFrame, time: str, event: str, risk_class: str = "risk_class") -> DataFrame:
    """Log-rank between the two risk classes; an empty class is an error, as callers are expected to skip it."""
    sizes = df.agg(F.sum(F.col(risk_class)).alias("high"), F.sum(1 - F.col(risk_class)).alias("low")).first()
    if not sizes["high"] or not sizes["low"]:
        raise ValueError("One of the risk groups is empty: the classes cannot be compared.")
    return logrank_test(df, time, event, risk_class)


def confusion_matrix(df: DataFrame, time: str, event: str, median_time: float,
                     risk_class: str = "risk_class") -> DataFrame:
    """Event rows only: truth is dying before the median training time; always four cells."""
    truth = (F.col(time) < F.lit(float(median_time))).cast("int")
    cells = [F.sum(F.when((truth == t) & (F.col(risk_class) == p), 1).otherwise(0)).alias(f"n{t}{p}")
             for t in (0, 1) for p in (0, 1)]
    rows = F.array(*[F.struct(F.lit(t).alias("truth"), F.lit(p).alias("predicted"),
                              F.coalesce(f"n{t}{p}", F.lit(0)).cast("long").alias("n")) for t in (0, 1) for p in (0, 1)])
    return df.where(F.col(event)).agg(*cells).select(F.inline(rows))


def classification_report(matrix: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy, and macro and weighted means (0 when undefined)."""
    cell = lambda t, p: F.sum(F.when((F.col("truth") == t) & (F.col("predicted") == p), F.col("n")).otherwise(0))
    c = matrix.agg(*[cell(t, p).cast("double").alias(f"n{t}{p}") for t in (0, 1) for p in (0, 1)])
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    n = {(t, p): F.col(f"n{t}{p}") for t in (0, 1) for p in (0, 1)}
    per = {}
    for k in (0, 1):
        support = n[k, 0] + n[k, 1]
        precision = div(n[k, k], n[0, k] + n[1, k])
        recall = div(n[k, k], support)
        per[k] = (precision, recall, div(2 * precision * recall, precision + recall), support)
    total = per[0][3] + per[1][3]
    accuracy = div(n[0, 0] + n[1, 1], total)
    macro = [(per[0][i] + per[1][i]) / 2 for i in range(3)]
    weighted = [div(per[0][i] * per[0][3] + per[1][i] * per[1][3], total) for i in range(3)]
    line = lambda label, p, r, f, s: F.struct(F.lit(label).alias("label"), p.alias("precision"), r.alias("recall"),
                                              f.alias("f1"), s.cast("long").alias("support"))
    rows = F.array(line("low", *per[0]), line("high", *per[1]), line("accuracy", accuracy, accuracy, accuracy, total),
                   line("macro avg", *macro, total), line("weighted avg", *weighted, total))
    return c.select(F.inline(rows))


def prediction_report(df: DataFrame, id_col: str, time: str, event: str, score: str = "risk_score",
                      risk_class: str = "risk_class", predicted: str = "predicted_days") -> DataFrame:
    """One line per subject, riskiest first."""
    return df.select(
        F.col(id_col).alias("subject"), F.col(score).alias("risk_score"), F.col(risk_class).alias("predicted_class"),
        F.col(event).cast("int").alias("event_status"), F.col(time).cast("double").alias("survival_time"),
        F.col(predicted).alias("predicted_time")).orderBy(F.col("risk_score").desc(), "subject")


def class_sizes(df: DataFrame, risk_class: str = "risk_class") -> DataFrame:
    return df.groupBy(F.col(risk_class).alias("risk_class")).agg(F.count("*").alias("n"))
