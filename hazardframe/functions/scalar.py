"""Column expressions shared by the operators."""

from __future__ import annotations

import math
from itertools import chain

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType

# Fixed values that must agree with the published definitions.
DAYS_PER_MONTH = 30.437
MIN_CUMULATIVE_HAZARD = 1e-7
RISK_TIE_TOLERANCE = 1e-8
SIGNIFICANT = 0.05
BORDERLINE = 0.10
RANDOM_BRIER = 0.25
DEVIANCE_OUTLIER = 2.0
MIN_TRAIN_ROWS = 15


def mapped(value: Column, mapping: dict, default=None) -> Column:
    """Look ``value`` up in a literal map; anything unmapped or null becomes ``default``."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.coalesce(F.try_element_at(table, value), F.lit(default))


def to_months(days: Column) -> Column:
    return days / F.lit(DAYS_PER_MONTH)


def significance(p: Column) -> Column:
    """Three bands of a p-value."""
    return (F.when(p < SIGNIFICANT, F.lit("significant"))
            .when(p <= BORDERLINE, F.lit("borderline"))
            .otherwise(F.lit("not significant")))


@F.pandas_udf(DoubleType())
def chi2_sf(x: pd.Series) -> pd.Series:
    """Upper tail of a chi-square with one degree of freedom; called on aggregated rows only."""
    return x.map(lambda v: float("nan") if v is None or v != v else math.erfc(math.sqrt(max(v, 0.0) / 2.0)))


def dot(features: Column, beta: list[float]) -> Column:
    """Linear predictor of an ``array<double>`` column, kept in the JVM."""
    weights = F.array(*[F.lit(float(b)) for b in beta])
    return F.aggregate(F.zip_with(features, weights, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def clean(value: Column) -> Column:
    """NaN becomes null, so that sorts and aggregates do not treat it as the largest value."""
    return F.when(~F.isnan(value), value)
