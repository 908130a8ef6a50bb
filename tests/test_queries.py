"""Registered queries on the smallest tables give the values of their SQL; the list takes one or more of each kind."""

import pytest

import __spark_entry__ as registry
from compare import compare, duck

SF = "/root/testdata/sf0.001"
SLOW = {"nested_cross_validation", "study_reports"}  # covered by the model and study tests
# Half-minute theta joins and recursions are fine here: the tables are tiny.
NAMES = ["km_curve", *[n for n in ("km_confidence_band", "median_impute", "stratified_split", "event_table", "curve_lookup_merged",
                                   "diagnostic_residuals", "concordance_index_grouped", "integrated_brier", "stratification",
                                   "cox_gradient", "glcm_features", "glszm_features", "median_survival", "median_survival_merged",
                                   "median_survival_grouped", "lasso_top_features", "first_order_features", "glrlm_features", "event_rows",
                                   "time_bounds", "grouped_quantiles", "logrank_test", "brier_scores", "glcm_counts", "run_counts", "isolated_extraction",
                                   "extraction_outcomes", "laplacian_of_gaussian_all", "deep_cox_whole_loss", "optional_columns", "train_size_status",
                                   "fallback_split")]]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_registry_is_consistent():
    queries, sql = registry.queries(), registry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 100
    assert set(NAMES) <= set(queries) and SLOW <= set(queries)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    assert compare(registry.queries()[name](spark, SF), con, registry.oracle_sql()[name]) is None


def test_entry_has_rows(spark):
    assert registry.entry(spark).count() > 0
