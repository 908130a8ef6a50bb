"""Scoring new subjects with a fitted model, on batch tables and on streams alike."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from hazardframe.operators.encode import MedianImputer, ZScore
from hazardframe.operators.residuals import median_survival
from hazardframe.operators.stratify import RiskClassifier


@dataclass
class Scorer:
    """Impute, scale, score, predict the median survival time and classify. Every step is row-local."""

    imputer: MedianImputer
    scaler: ZScore
    model: object  # LassoCox, DeepCox or anything with ``score`` and ``baseline``
    classifier: RiskClassifier

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` has a raw ``features`` array in the order of the training columns."""
        ready = self.scaler.transform(self.imputer.transform(df))
        scored = self.model.score(ready).withColumn("hazard", F.exp("risk_score"))
        timed = median_survival(scored, self.model.baseline, "risk_score")
        return self.classifier.transform(timed).drop("features")
