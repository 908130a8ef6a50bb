import pytest
from pyspark.sql import functions as F

from hazardframe.operators import encode
from hazardframe.plans import cohorts as co
from hazardframe.plans.workflow import StudyConfig, report_values, run_study

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def study(spark):
    d = co.churn(spark, SF)
    features = d.select("sid", "n_orders", "mean_price", "start_day", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"))
    clinical = d.select("sid", "time", F.col("event").cast("int").alias("event"), "stage", F.col("segment").alias("histology"),
                        F.when(F.col("c_nationkey") % 2 == 0, "male").otherwise("female").alias("gender"))
    cfg = StudyConfig("sid", "time", "event", "stage", "gender", "histology", stage_codes=co.PRIORITY_CODES, folds=2, repeats=1,
                      alphas=[0.05, 0.2], nested=True, hidden=[4], epochs=3, lr=5e-3, batch_size=32, extreme_points=5)
    return run_study(features, clinical, cfg), features, clinical, cfg


def test_every_report_is_there_for_both_models(study):
    out = study[0]
    for model in ("lasso", "deep"):
        for name in ("c_index", "predictions", "errors", "worst", "best", "extreme_curves", "ibs", "residuals", "separation",
                     "confusion", "class_report", "classes"):
            assert f"{model}_{name}" in out
        assert 0 <= out[f"{model}_c_index"].first().c_index <= 1
        assert out[f"{model}_ibs"].first().ibs >= 0
        assert out[f"{model}_confusion"].count() == 4
        assert out[f"{model}_extreme_curves"].count() == 10
        risks = [r.risk_score for r in out[f"{model}_classes"].collect()]
        assert risks == sorted(risks, reverse=True) and len(risks) == 30
    assert out["lasso_search"].count() == 2 and out["deep_loss"].count() == 3
    assert out["lasso_nested_cv"].count() == 2 and out["lasso_nested_summary"].first().n == 2
    kept = {r.feature for r in out["lasso_features"].collect()}
    assert {"stage", "gender"} <= kept  # never penalised


def test_reports_as_one_table_of_values(study):
    out = study[0]
    rows = report_values(out).collect()
    at = {}
    for r in rows:
        at.setdefault(r.report, []).append(r)
    assert set(at) == {k for k in out if k != "scorers"}
    one = {(r.metric): r.value for r in at["lasso_c_index"]}
    assert one["c_index"] == out["lasso_c_index"].first().c_index and one["comparable"] == float(out["lasso_c_index"].first().comparable)
    assert {r.row for r in at["deep_loss"]} == {f'{{"epoch":{k}}}' for k in (1, 2, 3)}
    assert len(at["lasso_predictions"]) == out["lasso_predictions"].count() * len({r.metric for r in at["lasso_predictions"]})


def test_too_small_a_cohort_stops(spark, study):
    _, features, clinical, cfg = study
    few = features.orderBy("sid").limit(12)
    with pytest.raises(ValueError):
        run_study(few, clinical, cfg)


def test_scoring_a_stream_equals_scoring_a_table(spark, study, tmp_path):
    scorer = study[0]["scorers"]["lasso"]
    names = scorer.imputer.names
    d = co.churn(spark, SF).select("sid", *[(F.col("n_orders") * (i + 1)).cast("double").alias(f"f{i}") for i in range(len(names))])
    rows = encode.assemble(d, [f"f{i}" for i in range(len(names))], ["sid"])
    for kind in ("lasso", "deep"):
        scorer = study[0]["scorers"][kind]
        path = str(tmp_path / kind)
        rows.write.parquet(path)
        stream = scorer.transform(spark.readStream.schema(rows.schema).parquet(path))
        assert stream.isStreaming
        q = stream.writeStream.format("memory").queryName(f"scored_{kind}").start()
        q.processAllAvailable()
        q.stop()
        got = {r.sid: (r.risk_score, r.predicted_days, r.risk_class) for r in spark.table(f"scored_{kind}").collect()}
        assert got == {r.sid: (r.risk_score, r.predicted_days, r.risk_class) for r in scorer.transform(rows).collect()}
