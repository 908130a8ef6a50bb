"""The whole study in one call: cohort, split, two models side by side, all reports as DataFrames."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from hazardframe.operators import encode, metrics, residuals, stratify
from hazardframe.operators.deep_cox import DeepCox
from hazardframe.operators.lasso_cox import LassoCox, cv_summary, grid_search, nested_cv, penalty_weights
from hazardframe.operators.ordered import median_of
from hazardframe.operators.splits import train_test_split
from hazardframe.session import cut_lineage
from hazardframe.sources.tables import numeric_features
from hazardframe.streaming.scoring import Scorer

log = logging.getLogger(__name__)


@dataclass
class StudyConfig:
    """Column names and settings of a study; the defaults are those of the clinical table."""

    id_col: str = "PatientID"
    time: str = "Survival.time"
    event: str = "deadstatus.event"
    stage: str = "Overall.Stage"
    gender: str = "gender"
    histology: str = "Histology"
    stage_codes: dict = field(default_factory=lambda: dict(encode.STAGE_CODES))
    gender_codes: dict = field(default_factory=lambda: dict(encode.GENDER_CODES))
    row_id: list[str] | None = None  # identifies a row when subjects repeat
    fraction: float = 0.8
    seed: int = 42
    folds: int = 5
    repeats: int = 3
    alphas: list[float] | None = None
    nested: bool = True
    hidden: list[int] = field(default_factory=lambda: [64, 32])
    dropout: float = 0.1
    lr: float = 5e-4
    epochs: int = 170
    batch_size: int = 32
    extreme_points: int = 50


@dataclass
class Prepared:
    """A cohort after join, encoding, split, imputation and scaling."""

    names: list[str]
    raw: DataFrame
    train: DataFrame
    test: DataFrame
    imputer: encode.MedianImputer
    scaler: encode.ZScore


def prepare(features: DataFrame, clinical: DataFrame, cfg: StudyConfig) -> Prepared:
    merged = cut_lineage(encode.merge_cohort(features, clinical, cfg.id_col))  # read by every step below
    encoder = encode.CohortEncoder(cfg.stage, cfg.gender, cfg.histology, cfg.stage_codes, cfg.gender_codes).fit(merged)
    cohort = encoder.transform(merged)
    ids = cfg.row_id or [cfg.id_col]
    names = numeric_features(cohort, [*ids, cfg.id_col, cfg.time, cfg.event])
    cohort = encode.survival_target(cohort, cfg.time, cfg.event)
    keep = list(dict.fromkeys([cfg.id_col, *ids, "time", "event"]))
    raw = encode.assemble(cohort, names, keep)
    split = cut_lineage(train_test_split(raw, cfg.id_col, "time", "event", cfg.fraction, cfg.seed))
    train, test = split.where("is_train").drop("is_train"), split.where(~F.col("is_train")).drop("is_train")
    encode.require_min_rows(train)
    imputer = encode.MedianImputer(names).fit(train)
    filled = imputer.transform(train)
    scaler = encode.ZScore(names).fit(filled)
    ready = lambda d: cut_lineage(scaler.transform(imputer.transform(d)))
    return Prepared(names, split.drop("is_train"), ready(train), ready(test), imputer, scaler)


def evaluate(model, data: Prepared, id_col: str, prefix: str, side: str, points: int) -> dict[str, DataFrame]:
    """Every report of one fitted model on the test rows; classes are left out when a risk group is empty."""
    train, test = cut_lineage(model.score(data.train)), cut_lineage(model.score(data.test))
    base = model.baseline
    predicted = cut_lineage(residuals.median_survival(test, base, "risk_score"))
    timed = residuals.time_residuals(predicted, "time", "event", id_col, "risk_score")
    diagnosed = residuals.diagnostic_residuals(test, base, "time", "event", id_col, "risk_score", side)
    out = {
        "c_index": metrics.concordance_index(test, "time", "event", "risk_score"),
        "predictions": timed,
        "errors": residuals.error_summary(timed),
        "worst": residuals.largest_errors(timed, id_col),
        "best": residuals.largest_errors(timed, id_col, worst=False),
        "extreme_curves": residuals.extreme_curves(test, base, id_col, "risk_score",
                                                   metrics.time_grid(data.train, data.test, "time", points), side),
        "ibs": metrics.integrated_brier(test, train, base, "time", "event", "risk_score", side=side),
        "residuals": residuals.flag_outliers(diagnosed),
    }
    try:
        classifier = stratify.RiskClassifier().fit(train)
        classed = cut_lineage(classifier.transform(predicted))
        out["separation"] = stratify.evaluate_stratification(classed, "time", "event")
        matrix = stratify.confusion_matrix(classed, "time", "event", median_of(data.train, "time"))
        out["confusion"] = matrix
        out["class_report"] = stratify.classification_report(matrix)
        out["classes"] = stratify.prediction_report(classed, id_col, "time", "event")
    except ValueError as e:
        log.warning("%s risk classes skipped: %s", prefix, e)
    return {f"{prefix}_{k}": v for k, v in out.items()}


def run_study(features: DataFrame, clinical: DataFrame, cfg: StudyConfig | None = None) -> dict[str, object]:
    """Fit and evaluate both models. The result maps report names to DataFrames; ``scorers`` holds one row-local
    scorer per model for new data."""
    cfg = cfg or StudyConfig()
    data = prepare(features, clinical, cfg)
    spark, ids = data.train.sparkSession, cfg.row_id or [cfg.id_col]
    weights = penalty_weights(data.names, [cfg.stage, cfg.gender], cfg.histology)
    out: dict[str, object] = {}
    if cfg.nested:
        out["lasso_nested_cv"] = nested_cv(data.raw, data.names, cfg.alphas, cfg.folds, cfg.repeats, id_cols=ids, weights=weights)
        out["lasso_nested_summary"] = cv_summary(out["lasso_nested_cv"])
    search = grid_search(data.train, data.names, cfg.alphas, cfg.folds, cfg.repeats, cfg.seed, ids, weights)
    out["lasso_search"] = search.table(spark)
    lasso = LassoCox(data.names, search.best_alpha, weights).fit(data.train)
    out["lasso_features"] = lasso.selected_features(spark)
    out.update(evaluate(lasso, data, cfg.id_col, "lasso", "backward", cfg.extreme_points))
    deep = DeepCox(data.names, cfg.hidden, cfg.dropout, cfg.lr, seed=cfg.seed).fit(data.train, cfg.epochs, cfg.batch_size)
    out["deep_loss"] = deep.loss_history(spark)
    out.update(evaluate(deep, data, cfg.id_col, "deep", "forward", cfg.extreme_points))
    out["scorers"] = {k: Scorer(data.imputer, data.scaler, m, stratify.RiskClassifier().fit(m.score(data.train)))
                      for k, m in (("lasso", lasso), ("deep", deep))}
    return out


# Columns that name a row of a report; what else a report holds is a value.
ROW_NAMES = ("sid", "subject", "PatientID", "time", "epoch", "alpha_no", "repeat", "fold", "feature", "actual", "predicted_class", "class")


def report_values(reports: dict[str, object]) -> DataFrame:
    """All reports of a study as one long table: report, row (its names as JSON), metric, value.

    Booleans count 0 and 1; text that does not name a row is left out.
    """
    parts = []
    for name, df in reports.items():
        if not isinstance(df, DataFrame):
            continue
        names = [f.name for f in df.schema.fields if f.name in ROW_NAMES or f.dataType.simpleString() == "string"]
        values = [c for c in df.columns if c not in names]
        row = F.to_json(F.struct(*names)) if names else F.lit("{}")
        cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in values])
        if values:
            parts.append(df.select(F.lit(name).alias("report"), row.alias("row"), F.inline(cells)))
    first, *rest = parts
    for p in rest:
        first = first.unionByName(p)
    return first
