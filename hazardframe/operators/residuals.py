"""Predictions and residuals derived from a risk score and a baseline hazard curve."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from hazardframe.functions.scalar import DEVIANCE_OUTLIER, MIN_CUMULATIVE_HAZARD, to_months
from hazardframe.operators.curves import curve_lookup, survival_on_grid


def cumulative_hazard(df: DataFrame, baseline: DataFrame, time: str, score: str, side: str = "backward",
                      out: str = "cum_hazard", by: list[str] = ()) -> DataFrame:
    """Cumulative hazard of each subject at its own exit time, never below the fixed floor."""
    found = curve_lookup(df, baseline, time, "time", "cum_hazard", "__h0", side, by)
    return found.withColumn(out, F.greatest(F.col("__h0") * F.exp(F.col(score)),
                                            F.lit(MIN_CUMULATIVE_HAZARD))).drop("__h0")


def median_survival(df: DataFrame, baseline: DataFrame, score: str, by: list[str] = (), **plan) -> DataFrame:
    """First time at which survival is at most one half, in days and months; the last curve time if never.

    S(t) <= 1/2 exactly when H0(t) >= ln 2 / exp(score), so each subject needs one lookup on the monotone
    baseline and no subject-by-time table. ``plan`` (such as ``max_curve_rows``) goes to the lookup.
    """
    ready = df.withColumn("__need", F.lit(math.log(2.0) * (1 - 1e-12)) / F.exp(F.col(score)))
    found = curve_lookup(ready, baseline, "__need", "cum_hazard", "time", "predicted_days", "forward", by, **plan)
    return found.drop("__need").withColumn("predicted_months", to_months(F.col("predicted_days")))


def time_residuals(df: DataFrame, time: str, event: str, id_col: str, score: str) -> DataFrame:
    """Actual against predicted time for the rows with an event; expects the columns of :func:`median_survival`."""
    if "predicted_days" not in df.columns:
        raise ValueError("time_residuals() needs the predicted_days that median_survival() adds.")
    if score not in df.columns:
        raise ValueError("Risk scores missing: score the rows first.")
    days, pred = F.col(time).cast("double"), F.col("predicted_days")
    return df.where(F.col(event)).select(
        id_col, F.col(score).alias("risk_score"), days.alias("actual_days"), pred.alias("predicted_days"),
        F.abs(days - pred).alias("abs_error_days"), (days - pred).alias("residual_days"),
        to_months(days).alias("actual_months"), F.col("predicted_months"),
        F.abs(to_months(days) - F.col("predicted_months")).alias("abs_error_months"),
        (to_months(days) - F.col("predicted_months")).alias("residual_months"))


def error_summary(residuals: DataFrame) -> DataFrame:
    """Mean absolute and root mean squared error in both units; null values when there was no event."""
    rmse = lambda c: F.sqrt(F.avg(F.col(c) * F.col(c)))
    return residuals.agg(F.count("*").alias("n_events"),
                         F.avg("abs_error_days").alias("mae_days"), rmse("residual_days").alias("rmse_days"),
                         F.avg("abs_error_months").alias("mae_months"), rmse("residual_months").alias("rmse_months"))


def martingale(event: Column, cum_hazard: Column) -> Column:
    return event.cast("double") - cum_hazard


def deviance(event: Column, cum_hazard: Column) -> Column:
    """sign(M) * sqrt(-2 (M + e ln H)); rounding may push the radicand just below zero."""
    m = martingale(event, cum_hazard)
    inner = m + F.when(event, F.ln(cum_hazard)).otherwise(F.lit(0.0))
    return F.signum(m) * F.sqrt(F.greatest(-2.0 * inner, F.lit(0.0)))


def diagnostic_residuals(df: DataFrame, baseline: DataFrame, time: str, event: str, id_col: str, score: str,
                         side: str = "backward") -> DataFrame:
    """The full diagnostic table: hazard, predicted medians, cumulative hazard, martingale and deviance."""
    if score not in df.columns:
        raise ValueError("Risk scores missing: score the rows first.")
    full = median_survival(cumulative_hazard(df, baseline, time, score, side), baseline, score)
    h, e = F.col("cum_hazard"), F.col(event)
    return full.select(
        id_col, F.col(score).alias("risk_score"), F.exp(F.col(score)).alias("hazard"), e.alias("event"),
        F.col(time).cast("double").alias("time"), "predicted_days", "predicted_months", "cum_hazard",
        martingale(e, h).alias("martingale"), deviance(e, h).alias("deviance"))


def flag_outliers(residuals: DataFrame, limit: float = DEVIANCE_OUTLIER) -> DataFrame:
    """Residual-plot data: abscissa (risk score, else log cumulative hazard) and the outlier flag."""
    x = F.col("risk_score") if "risk_score" in residuals.columns else F.ln(F.col("cum_hazard"))
    return residuals.withColumn("plot_x", x).withColumn("is_outlier", F.abs(F.col("deviance")) > limit)


def extreme_subjects(df: DataFrame, id_col: str, score: str) -> DataFrame:
    """The highest- and the lowest-risk subject; the smallest id wins a tie."""
    ident = F.col(id_col).alias("id")
    best = df.agg(F.min(F.struct((-F.col(score)).alias("key"), ident)).alias("hi"),
                  F.min(F.struct(F.col(score).alias("key"), ident)).alias("lo"))
    pairs = F.array(F.struct(F.lit("highest").alias("extreme"), F.col("hi.id").alias(id_col),
                             (-F.col("hi.key")).alias("risk_score")),
                    F.struct(F.lit("lowest").alias("extreme"), F.col("lo.id").alias(id_col),
                             F.col("lo.key").alias("risk_score")))
    return best.select(F.inline(pairs))


def extreme_curves(df: DataFrame, baseline: DataFrame, id_col: str, score: str, grid: list[float],
                   side: str = "backward") -> DataFrame:
    """Survival curves of the two extreme subjects on a grid."""
    return survival_on_grid(extreme_subjects(df, id_col, score), baseline, "risk_score", grid,
                            ["extreme", id_col], side)


def largest_errors(residuals: DataFrame, id_col: str, n: int = 5, worst: bool = True) -> DataFrame:
    """The ``n`` worst or best time predictions by absolute error (a top-k, not a full sort)."""
    order = F.col("abs_error_days").desc() if worst else F.col("abs_error_days").asc()
    return residuals.select(id_col, "actual_days", "predicted_days", "abs_error_days").orderBy(order, id_col).limit(n)
