"""Registered queries: curves, lookups, predictions, residuals, metrics and risk classes, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardframe.operators.lasso_cox import cv_summary
from hazardframe.operators import curves, metrics, residuals, splits, stratify
from hazardframe.operators.ordered import median_of
from hazardframe.plans import cohorts as co
from hazardframe.plans.sqltext import CHURN, GAP, SCORED, fixed, rounded_sql, split_cte
from hazardframe.session import cut_lineage

GRID = [250.0, 500.0, 1000.0, 1500.0, 2000.0, 2250.0]


def _sides(spark, sf):
    """Scored churn cut into a training and a test part, and the baseline of the training part."""
    d = cut_lineage(splits.stratified_split(
        cut_lineage(co.scored_churn(spark, sf)), "sid", "time", "event"))
    train, test = d.where("is_train"), d.where(~F.col("is_train"))
    return train, test, cut_lineage(curves.breslow_baseline(train, "time", "event", "eta"))


def km_curve(spark, sf):
    return fixed(curves.km_curve(co.churn(spark, sf), "time", "event", ["segment"]))


def km_band(spark, sf):
    return fixed(curves.km_curve(co.event_gap(spark, sf), "time", "event", ["kind"], confidence=True).select(
        "kind", "time", "survival", "ci_lower", "ci_upper"))


def nelson_aalen(spark, sf):
    d = co.event_gap(spark, sf).withColumn("zero", F.lit(0.0))
    return fixed(curves.breslow_baseline(d, "time", "event", "zero").select("time", "n_event", "cum_hazard"))


def curve_backward(spark, sf):
    train, test, base = _sides(spark, sf)
    return fixed(curves.curve_lookup(test, base, "time", "time", "cum_hazard", "h").select("sid", "time", "h"))


def curve_forward(spark, sf):
    train, test, base = _sides(spark, sf)
    return fixed(curves.curve_lookup(test, base, "time", "time", "cum_hazard", "h", side="forward").select("sid", "time", "h"))


def curve_backward_merged(spark, sf):
    """The same lookup with the running-fill plan that serves curves too large to broadcast."""
    train, test, base = _sides(spark, sf)
    return fixed(curves.curve_lookup(test, base, "time", "time", "cum_hazard", "h", max_curve_rows=0).select("sid", "time", "h"))


def grouped_curve_lookup(spark, sf):
    """Each event read on the survival curve of its own kind."""
    d = co.event_gap(spark, sf)
    km = cut_lineage(curves.km_curve(d, "time", "event", ["kind"]))
    return fixed(curves.curve_lookup(d, km, "time", "time", "survival", "s", by=["kind"]).select("sid", "s"))


def grid_curves(spark, sf):
    train, test, base = _sides(spark, sf)
    return fixed(curves.survival_on_grid(test, base, "eta", GRID, ["sid"]))


def exit_hazard(spark, sf):
    train, test, base = _sides(spark, sf)
    return fixed(residuals.cumulative_hazard(test, base, "time", "eta").select("sid", "cum_hazard"))


def median_survival(spark, sf):
    train, test, base = _sides(spark, sf)
    return fixed(residuals.median_survival(test, base, "eta").select("sid", "predicted_days", "predicted_months"))


def median_survival_merged(spark, sf):
    """The same by the plan for long curves."""
    _, test, base = _sides(spark, sf)
    return fixed(residuals.median_survival(test, base, "eta", max_curve_rows=0).select("sid", "predicted_days", "predicted_months"))


def median_survival_grouped(spark, sf):
    """The same with three grouping columns, all of one value, by the plan for long curves."""
    _, test, base = _sides(spark, sf)
    keys = {"a": F.lit("x"), "b": F.lit(None).cast("int"), "c": F.lit(1)}
    return fixed(residuals.median_survival(test.withColumns(keys), base.withColumns(keys), "eta", list(keys), max_curve_rows=0)
                 .select("sid", "predicted_days", "predicted_months"))


def _timed(spark, sf):
    train, test, base = _sides(spark, sf)
    return residuals.time_residuals(residuals.median_survival(test, base, "eta"), "time", "event", "sid", "eta")


def _diagnosed(spark, sf, side="backward"):
    train, test, base = _sides(spark, sf)
    return residuals.diagnostic_residuals(test, base, "time", "event", "sid", "eta", side)


def extreme_curves(spark, sf):
    train, test, base = _sides(spark, sf)
    return fixed(residuals.extreme_curves(test, base, "sid", "eta", GRID))


def concordance(spark, sf):
    out = metrics.concordance_index(co.scored_churn(spark, sf), "time", "event", "eta")
    return _counts(out)


def _counts(out):
    return fixed(out.withColumns({c: F.col(c).cast("long") for c in ("comparable", "concordant", "tied")}))


def concordance_by_kind(spark, sf):
    """Tie-heavy scores, per event kind, with ranges small enough that the grid plan is used."""
    return _counts(metrics.concordance_index(co.scored_gap(spark, sf), "time", "event", "eta", ["kind"], rows_per_range=4000))


def comparable_pairs(spark, sf):
    d = metrics.comparable_pairs(co.event_gap(spark, sf), "time", "event", ["kind"])
    return d.select("kind", F.col("comparable").cast("long").alias("comparable"))


def brier(spark, sf):
    train, test, base = _sides(spark, sf)
    return fixed(metrics.brier_scores(test, train, base, "time", "event", "eta", GRID))


def integrated_brier(spark, sf):
    train, test, base = _sides(spark, sf)
    return fixed(metrics.integrated_brier(test, train, base, "time", "event", "eta"))


def integrated_brier_plain(spark, sf):
    train, test, base = _sides(spark, sf)
    return fixed(metrics.integrated_brier(test, train, base, "time", "event", "eta", ipcw=False))


def _classed(spark, sf):
    train, test, base = _sides(spark, sf)
    cls = stratify.RiskClassifier("eta").fit(train)
    return train, cls.transform(residuals.median_survival(test, base, "eta"))


def risk_classes(spark, sf):
    return _classed(spark, sf)[1].select("sid", "risk_class")


def logrank(spark, sf):
    d = co.event_gap(spark, sf).withColumn("grp", (F.col("hour") >= 12).cast("int"))
    return fixed(stratify.logrank_test(d, "time", "event", "grp", ["kind"]), 5)


def stratification(spark, sf):
    return fixed(stratify.evaluate_stratification(_classed(spark, sf)[1], "time", "event"), 5)


def two_group_table(spark, sf):
    d = co.churn(spark, sf).withColumn("grp", (F.col("segment") == "BUILDING").cast("int"))
    return stratify.two_group_table(d, "time", "event", "grp")


def _matrix(spark, sf):
    train, d = _classed(spark, sf)
    return stratify.confusion_matrix(d, "time", "event", median_of(train, "time"))


def classification_report(spark, sf):
    return fixed(stratify.classification_report(_matrix(spark, sf)))


def class_sizes(spark, sf):
    return stratify.class_sizes(_classed(spark, sf)[1])


def prediction_report(spark, sf):
    return fixed(stratify.prediction_report(_classed(spark, sf)[1], "sid", "time", "event", "eta"))


QUERIES = {
    "km_curve": km_curve,
    "km_confidence_band": km_band,
    "censoring_curve": lambda s, sf: fixed(curves.censoring_curve(co.churn(s, sf), "time", "event", ["segment"])),
    "event_table": lambda s, sf: curves.event_table(co.event_gap(s, sf), "time", "event", ["kind"]),
    "risk_set_sums": lambda s, sf: fixed(curves.risk_set_sums(co.scored_churn(s, sf), "time", "event", "eta")),
    "breslow_baseline": lambda s, sf: fixed(curves.breslow_baseline(co.scored_churn(s, sf), "time", "event", "eta", ["segment"]).select(
        "segment", "time", "n_event", "risk_sum", "cum_hazard")),
    "nelson_aalen": nelson_aalen,
    "curve_lookup_backward": curve_backward,
    "curve_lookup_forward": curve_forward,
    "curve_lookup_merged": curve_backward_merged,
    "curve_lookup_grouped": grouped_curve_lookup,
    "survival_on_grid": grid_curves,
    "exit_cumulative_hazard": exit_hazard,
    "median_survival": median_survival,
    "median_survival_merged": median_survival_merged,
    "median_survival_grouped": median_survival_grouped,
    "score_summary": lambda s, sf: fixed(cv_summary(co.scored_churn(s, sf), "eta")),
    "time_residuals": lambda s, sf: fixed(_timed(s, sf)),
    "error_summary": lambda s, sf: fixed(residuals.error_summary(_timed(s, sf))),
    "worst_predictions": lambda s, sf: fixed(residuals.largest_errors(_timed(s, sf), "sid")),
    "best_predictions": lambda s, sf: fixed(residuals.largest_errors(_timed(s, sf), "sid", worst=False)),
    "diagnostic_residuals": lambda s, sf: fixed(_diagnosed(s, sf)),
    "diagnostic_residuals_forward": lambda s, sf: fixed(_diagnosed(s, sf, "forward")),
    "deviance_outliers": lambda s, sf: fixed(residuals.flag_outliers(_diagnosed(s, sf)).select("sid", "plot_x", "deviance", "is_outlier")),
    "extreme_subjects": lambda s, sf: fixed(residuals.extreme_subjects(co.scored_gap(s, sf), "sid", "eta")),
    "extreme_curves": extreme_curves,
    "comparable_pairs": comparable_pairs,
    "concordance_index": concordance,
    "concordance_index_grouped": concordance_by_kind,
    "brier_scores": brier,
    "integrated_brier": integrated_brier,
    "integrated_brier_unweighted": integrated_brier_plain,
    "two_group_table": two_group_table,
    "logrank_test": logrank,
    "stratification": stratification,
    "risk_classes": risk_classes,
    "class_sizes": class_sizes,
    "confusion_matrix": _matrix,
    "classification_report": classification_report,
    "prediction_report": prediction_report,
}


def _event_sql(source: str, by: str = "") -> str:
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""
ev AS (SELECT {keys}time, n_event, n_censor, CAST(sum(m) OVER ({part}ORDER BY time DESC) AS BIGINT) AS n_risk FROM (
    SELECT {keys}time, CAST(sum(CAST(event AS INT)) AS BIGINT) AS n_event, CAST(sum(1 - CAST(event AS INT)) AS BIGINT) AS n_censor,
           count(*) AS m FROM {source} GROUP BY {keys}time))"""


def _km_sql(by: str, source: str) -> str:
    return _event_sql(source, by) + f""",
km AS (SELECT {by}, time, n_event, n_censor, n_risk, product(1 - n_event / n_risk) OVER w AS survival,
              sum(CASE WHEN n_risk > n_event THEN n_event / (n_risk * (n_risk - n_event)) ELSE 0 END) OVER w AS v
       FROM ev WINDOW w AS (PARTITION BY {by} ORDER BY time)
       UNION ALL SELECT {by}, 0.0, 0, 0, max(n_risk), 1.0, 0.0 FROM ev GROUP BY {by} HAVING min(time) > 0)"""


def breslow_sql(source: str, name: str = "base", by: str = "") -> str:
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""
{name}_r AS (SELECT {keys}time, CAST(sum(CAST(event AS INT)) AS BIGINT) AS n_event, sum(exp(eta)) AS r FROM {source} GROUP BY {keys}time),
{name}_s AS (SELECT {keys}time, n_event, sum(r) OVER ({part}ORDER BY time DESC) AS risk_sum FROM {name}_r),
{name} AS (SELECT {keys}time, n_event, risk_sum, sum(n_event / risk_sum) OVER ({part}ORDER BY time) AS cum_hazard FROM {name}_s)"""


_SPLIT = SCORED + "," + split_cte("scored") + """,
train AS (SELECT * FROM parts WHERE is_train), test AS (SELECT * FROM parts WHERE NOT is_train),""" + breslow_sql("train")
_BACK = """, hb AS (SELECT test.*, coalesce(b.cum_hazard, (SELECT arg_min(cum_hazard, time) FROM base)) AS h0
    FROM test ASOF LEFT JOIN base b ON test.time >= b.time)"""
_FORWARD = """, hb AS (SELECT test.*, coalesce(b.cum_hazard, (SELECT arg_max(cum_hazard, time) FROM base)) AS h0
    FROM test ASOF LEFT JOIN base b ON test.time <= b.time)"""
_MEDIAN = """, md AS (SELECT hb.*, coalesce((SELECT min(b.time) FROM base b WHERE b.cum_hazard >= ln(2) * (1 - 1e-12) / exp(hb.eta)),
    (SELECT max(time) FROM base)) AS predicted_days FROM hb)"""
_TIMED = """, td AS (SELECT sid, eta AS risk_score, time AS actual_days, predicted_days, abs(time - predicted_days) AS abs_error_days,
    time - predicted_days AS residual_days, time / 30.437 AS actual_months, predicted_days / 30.437 AS predicted_months,
    abs(time / 30.437 - predicted_days / 30.437) AS abs_error_months, time / 30.437 - predicted_days / 30.437 AS residual_months
    FROM md WHERE event)"""
_TD_COLS = """sid risk_score:f actual_days:f predicted_days:f abs_error_days:f residual_days:f actual_months:f predicted_months:f
    abs_error_months:f residual_months:f"""
_DIAG = """, dg AS (SELECT sid, eta AS risk_score, exp(eta) AS hazard, event, time, predicted_days, predicted_days / 30.437 AS predicted_months,
    h AS cum_hazard, m AS martingale, sign(m) * sqrt(greatest(-2 * (m + CASE WHEN event THEN ln(h) ELSE 0 END), 0)) AS deviance
    FROM (SELECT *, CAST(event AS INT) - h AS m FROM (SELECT *, greatest(h0 * exp(eta), 1e-7) AS h FROM md)))"""
_DG_COLS = "sid risk_score:f hazard:f event time:f predicted_days:f predicted_months:f cum_hazard:f martingale:f deviance:f"
_TIMES = "(SELECT unnest([250.0, 500.0, 1000.0, 1500.0, 2000.0, 2250.0])::DOUBLE AS time)"
_CINDEX = """SELECT {k} count(*) AS comparable, count(*) FILTER (WHERE a.eta - b.eta > 1e-8) AS concordant,
    count(*) FILTER (WHERE abs(a.eta - b.eta) <= 1e-8) AS tied,
    (count(*) FILTER (WHERE a.eta - b.eta > 1e-8) + 0.5 * count(*) FILTER (WHERE abs(a.eta - b.eta) <= 1e-8)) / count(*) AS c_index
    FROM {s} a JOIN {s} b ON {j} a.event AND (a.time < b.time OR (a.time = b.time AND NOT b.event)) {g}"""
_CENSOR = _event_sql("train") + """, cg AS (SELECT time, product(CASE WHEN n_risk > n_event THEN 1 - n_censor / (n_risk - n_event) ELSE 1 END)
    OVER (ORDER BY time) AS g FROM ev)"""


def _brier_sql(times: str, weighted: bool = True) -> str:
    gt = "coalesce(c.g, 1)" if weighted else "1.0"
    gg = "coalesce(c.g, 1)" if weighted else "1.0"
    return f"""{_SPLIT}, {_CENSOR}, grid AS {times},
tg AS (SELECT t.*, {gt} AS gt FROM test t ASOF LEFT JOIN cg c ON t.time >= c.time),
gh AS (SELECT grid.time, coalesce(b.cum_hazard, (SELECT arg_min(cum_hazard, time) FROM base)) AS h FROM grid ASOF LEFT JOIN base b ON grid.time >= b.time),
gg AS (SELECT gh.*, {gg} AS g FROM gh ASOF LEFT JOIN cg c ON gh.time >= c.time),
bs AS (SELECT gg.time, avg(CASE WHEN t.time <= gg.time
             THEN CASE WHEN t.event AND gt > 0 THEN pow(exp(-h * exp(eta)), 2) / gt ELSE 0 END
             ELSE CASE WHEN g > 0 THEN pow(1 - exp(-h * exp(eta)), 2) / g ELSE 0 END END) AS brier
       FROM gg, tg t GROUP BY gg.time)"""


_SHARED = """(SELECT lo + 1 + i * ((hi - 1) - (lo + 1)) / 99.0 AS time FROM (SELECT unnest(range(100)) AS i),
    (SELECT greatest((SELECT min(time) FROM train), (SELECT min(time) FROM test)) AS lo,
            least((SELECT max(time) FROM train), (SELECT max(time) FROM test)) AS hi))"""
_IBS = """--main SELECT *, ibs < 0.25 AS better_than_random FROM (SELECT sum((time - tp) * (brier + bp) / 2) / (max(time) - min(time)) AS ibs
    FROM (SELECT *, lag(time) OVER (ORDER BY time) AS tp, lag(brier) OVER (ORDER BY time) AS bp FROM bs))"""
# Upper chi-square tail through the positive series of erf.
_TAIL = """CASE WHEN chi2 = 0 THEN 1 ELSE greatest(0, 1 - (SELECT sum(exp((2 * i + 1) * ln(sqrt(chi2 / 2)) - chi2 / 2 - lgamma(i + 1.5)))
    FROM (SELECT unnest(range(400)) AS i))) END"""


def _logrank_sql(source: str, group: str, by: str = "") -> str:
    keys, part, grp = (f"{by}, ", f"PARTITION BY {by} ", f"GROUP BY {by}") if by else ("", "", "")
    return f"""
lt AS (SELECT {keys}time, d, d1, CAST(sum(m) OVER ({part}ORDER BY time DESC) AS BIGINT) AS n,
              CAST(sum(m1) OVER ({part}ORDER BY time DESC) AS BIGINT) AS n1 FROM (
    SELECT {keys}time, CAST(sum(CAST(event AS INT)) AS BIGINT) AS d, CAST(sum(CAST(event AS INT) * {group}) AS BIGINT) AS d1,
           count(*) AS m, CAST(sum({group}) AS BIGINT) AS m1 FROM {source} GROUP BY {keys}time)),
lr AS (SELECT {keys}CAST(sum(d1) AS DOUBLE) AS observed, sum(d * n1 / n) AS expected,
              sum(CASE WHEN n > 1 THEN d * (n1 / n) * (1 - n1 / n) * (n - d) / (n - 1) ELSE 0 END) AS variance,
              max(n1) AS n_high, max(n) - max(n1) AS n_low FROM lt {grp}),
lx AS (SELECT *, (observed - expected) * (observed - expected) / variance AS chi2 FROM lr),
lp AS (SELECT *, {_TAIL} AS p_value FROM lx),
lf AS (SELECT *, CASE WHEN p_value < 0.05 THEN 'significant' WHEN p_value <= 0.1 THEN 'borderline' ELSE 'not significant' END AS significance FROM lp)"""


_LR_COLS = "observed:f expected:f variance:f n_high:i n_low:i chi2:f p_value:f significance"
_CLASSED = _SPLIT + _BACK + _MEDIAN + ", cl AS (SELECT md.*, CAST(eta > (SELECT median(eta) FROM train) AS INTEGER) AS risk_class FROM md)"
_CONF = _CLASSED + """, cm AS (SELECT CAST(t AS INTEGER) AS truth, CAST(p AS INTEGER) AS predicted, count(sid) AS n
    FROM (SELECT unnest([0, 0, 1, 1]) AS t, unnest([0, 1, 0, 1]) AS p)
    LEFT JOIN (SELECT sid, risk_class, CAST(time < (SELECT median(time) FROM train) AS INT) AS truth FROM cl WHERE event) e
    ON e.truth = t AND e.risk_class = p GROUP BY t, p)"""

ORACLE = {
    "km_curve": rounded_sql(f"WITH {CHURN}, {_km_sql('segment', 'churn')} --main SELECT * FROM km",
                            "segment time:f n_event:i n_censor:i n_risk:i survival:f"),
    "km_confidence_band": rounded_sql(f"""WITH {GAP}, {_km_sql('kind', 'gap')} --main
        SELECT kind, time, survival,
            CASE WHEN survival > 0 AND survival < 1 THEN exp(-exp(ln(-ln(survival)) + 1.959963984540054 * sqrt(v) / ln(survival))) ELSE survival END AS ci_upper,
            CASE WHEN survival > 0 AND survival < 1 THEN exp(-exp(ln(-ln(survival)) - 1.959963984540054 * sqrt(v) / ln(survival))) ELSE survival END AS ci_lower
        FROM km""", "kind time:f survival:f ci_lower:f ci_upper:f"),
    "censoring_curve": rounded_sql(f"""WITH {CHURN}, {_event_sql('churn', 'segment')} --main
        SELECT segment, time, n_risk, n_censor, product(CASE WHEN n_risk > n_event THEN 1 - n_censor / (n_risk - n_event) ELSE 1 END)
            OVER (PARTITION BY segment ORDER BY time) AS censoring_survival FROM ev""",
                                   "segment time:f n_risk:i n_censor:i censoring_survival:f"),
    "event_table": f"WITH {GAP}, {_event_sql('gap', 'kind')} SELECT * FROM ev",
    "risk_set_sums": rounded_sql(f"WITH {SCORED}, {breslow_sql('scored')} --main SELECT * FROM base_s", "time:f n_event:i risk_sum:f"),
    "breslow_baseline": rounded_sql(f"WITH {SCORED}, {breslow_sql('scored', by='segment')} --main SELECT * FROM base",
                                    "segment time:f n_event:i risk_sum:f cum_hazard:f"),
    "nelson_aalen": rounded_sql(f"""WITH {GAP}, {_event_sql('gap')} --main
        SELECT time, n_event, sum(n_event / n_risk) OVER (ORDER BY time) AS cum_hazard FROM ev""", "time:f n_event:i cum_hazard:f"),
    "curve_lookup_backward": rounded_sql(f"WITH {_SPLIT}{_BACK} --main SELECT sid, time, h0 AS h FROM hb", "sid time:f h:f"),
    "curve_lookup_forward": rounded_sql(f"WITH {_SPLIT}{_FORWARD} --main SELECT sid, time, h0 AS h FROM hb", "sid time:f h:f"),
    "curve_lookup_merged": rounded_sql(f"WITH {_SPLIT}{_BACK} --main SELECT sid, time, h0 AS h FROM hb", "sid time:f h:f"),
    "curve_lookup_grouped": rounded_sql(f"""WITH {GAP}, {_km_sql('kind', 'gap')} --main
        SELECT sid, survival AS s FROM gap JOIN km ON gap.kind = km.kind AND gap.time = km.time""", "sid s:f"),
    "survival_on_grid": rounded_sql(f"""WITH {_SPLIT}, grid AS {_TIMES},
        gh AS (SELECT grid.time, coalesce(b.cum_hazard, (SELECT arg_min(cum_hazard, time) FROM base)) AS h FROM grid ASOF LEFT JOIN base b ON grid.time >= b.time)
        --main SELECT sid, gh.time, exp(-h * exp(eta)) AS survival FROM test, gh""", "sid time:f survival:f"),
    "exit_cumulative_hazard": rounded_sql(f"WITH {_SPLIT}{_BACK} --main SELECT sid, greatest(h0 * exp(eta), 1e-7) AS cum_hazard FROM hb",
                                          "sid cum_hazard:f"),
    "median_survival": rounded_sql(f"WITH {_SPLIT}{_BACK}{_MEDIAN} --main SELECT sid, predicted_days, predicted_days / 30.437 AS predicted_months FROM md",
                                   "sid predicted_days:f predicted_months:f"),
    **{name: rounded_sql(f"WITH {_SPLIT}{_BACK}{_MEDIAN} --main SELECT sid, predicted_days, predicted_days / 30.437 AS predicted_months FROM md",
                         "sid predicted_days:f predicted_months:f") for name in ("median_survival_merged", "median_survival_grouped")},
    "score_summary": rounded_sql(f"WITH {SCORED} --main SELECT count(*) AS n, avg(eta) AS mean_score, stddev_pop(eta) AS std_score FROM scored",
                                 "n:i mean_score:f std_score:f"),
    "time_residuals": rounded_sql(f"WITH {_SPLIT}{_BACK}{_MEDIAN}{_TIMED} --main SELECT * FROM td", _TD_COLS),
    "error_summary": rounded_sql(f"""WITH {_SPLIT}{_BACK}{_MEDIAN}{_TIMED} --main SELECT count(*) AS n_events, avg(abs_error_days) AS mae_days,
        sqrt(avg(residual_days * residual_days)) AS rmse_days, avg(abs_error_months) AS mae_months,
        sqrt(avg(residual_months * residual_months)) AS rmse_months FROM td""", "n_events:i mae_days:f rmse_days:f mae_months:f rmse_months:f"),
    "worst_predictions": rounded_sql(f"""WITH {_SPLIT}{_BACK}{_MEDIAN}{_TIMED} --main SELECT sid, actual_days, predicted_days, abs_error_days FROM td
        ORDER BY abs_error_days DESC, sid LIMIT 5""", "sid actual_days:f predicted_days:f abs_error_days:f"),
    "best_predictions": rounded_sql(f"""WITH {_SPLIT}{_BACK}{_MEDIAN}{_TIMED} --main SELECT sid, actual_days, predicted_days, abs_error_days FROM td
        ORDER BY abs_error_days, sid LIMIT 5""", "sid actual_days:f predicted_days:f abs_error_days:f"),
    "diagnostic_residuals": rounded_sql(f"WITH {_SPLIT}{_BACK}{_MEDIAN}{_DIAG} --main SELECT * FROM dg", _DG_COLS),
    "diagnostic_residuals_forward": rounded_sql(f"WITH {_SPLIT}{_FORWARD}{_MEDIAN}{_DIAG} --main SELECT * FROM dg", _DG_COLS),
    "deviance_outliers": rounded_sql(f"""WITH {_SPLIT}{_BACK}{_MEDIAN}{_DIAG} --main
        SELECT sid, risk_score AS plot_x, deviance, abs(deviance) > 2 AS is_outlier FROM dg""", "sid plot_x:f deviance:f is_outlier"),
    "extreme_subjects": rounded_sql(f"""WITH {GAP} --main (SELECT 'highest' AS extreme, sid, eta AS risk_score FROM sgap ORDER BY eta DESC, sid LIMIT 1)
        UNION ALL (SELECT 'lowest', sid, eta FROM sgap ORDER BY eta, sid LIMIT 1)""", "extreme sid risk_score:f"),
    "extreme_curves": rounded_sql(f"""WITH {_SPLIT}, grid AS {_TIMES},
        gh AS (SELECT grid.time, coalesce(b.cum_hazard, (SELECT arg_min(cum_hazard, time) FROM base)) AS h FROM grid ASOF LEFT JOIN base b ON grid.time >= b.time),
        ex AS ((SELECT 'highest' AS extreme, sid, eta FROM test ORDER BY eta DESC, sid LIMIT 1) UNION ALL
               (SELECT 'lowest', sid, eta FROM test ORDER BY eta, sid LIMIT 1))
        --main SELECT extreme, sid, gh.time, exp(-h * exp(eta)) AS survival FROM ex, gh""", "extreme sid time:f survival:f"),
    "comparable_pairs": f"""WITH {GAP}, {_event_sql('gap', 'kind')} SELECT kind, CAST(sum(n_event * (n_risk - n_event)) AS BIGINT) AS comparable
        FROM ev GROUP BY kind""",
    "concordance_index": rounded_sql(f"WITH {SCORED} --main " + _CINDEX.format(k="", s="scored", j="", g=""),
                                     "comparable:i concordant:i tied:i c_index:f"),
    "concordance_index_grouped": rounded_sql(f"WITH {GAP} --main " + _CINDEX.format(k="a.kind AS kind,", s="sgap", j="a.kind = b.kind AND", g="GROUP BY a.kind"),
                                             "kind comparable:i concordant:i tied:i c_index:f"),
    "brier_scores": rounded_sql(f"WITH {_brier_sql(_TIMES)} --main SELECT * FROM bs", "time:f brier:f"),
    "integrated_brier": rounded_sql(f"WITH {_brier_sql(_SHARED)} {_IBS}", "ibs:f better_than_random"),
    "integrated_brier_unweighted": rounded_sql(f"WITH {_brier_sql(_SHARED, False)} {_IBS}", "ibs:f better_than_random"),
    "two_group_table": f"""WITH {CHURN}, g AS (SELECT *, CAST(segment = 'BUILDING' AS INT) AS grp FROM churn), {_logrank_sql('g', 'grp')}
        SELECT * FROM lt""",
    "logrank_test": rounded_sql(f"""WITH {GAP}, g AS (SELECT *, CAST(hour >= 12 AS INT) AS grp FROM gap), {_logrank_sql('g', 'grp', 'kind')}
        --main SELECT * FROM lf""", "kind " + _LR_COLS, 5),
    "stratification": rounded_sql(f"WITH {_CLASSED}, {_logrank_sql('cl', 'risk_class')} --main SELECT * FROM lf", _LR_COLS, 5),
    "risk_classes": f"WITH {_CLASSED} SELECT sid, risk_class FROM cl",
    "class_sizes": f"WITH {_CLASSED} SELECT risk_class, count(*) AS n FROM cl GROUP BY 1",
    "confusion_matrix": f"WITH {_CONF} SELECT * FROM cm",
    "classification_report": rounded_sql(f"""WITH {_CONF},
        c AS (SELECT CAST(sum(n) FILTER (truth = 0 AND predicted = 0) AS DOUBLE) AS a, CAST(sum(n) FILTER (truth = 0 AND predicted = 1) AS DOUBLE) AS b,
                     CAST(sum(n) FILTER (truth = 1 AND predicted = 0) AS DOUBLE) AS x, CAST(sum(n) FILTER (truth = 1 AND predicted = 1) AS DOUBLE) AS y FROM cm),
        p AS (SELECT coalesce(a / nullif(a + x, 0), 0) AS p0, coalesce(a / nullif(a + b, 0), 0) AS r0, coalesce(y / nullif(b + y, 0), 0) AS p1,
                     coalesce(y / nullif(x + y, 0), 0) AS r1, a + b AS s0, x + y AS s1, (a + y) / (a + b + x + y) AS acc FROM c),
        q AS (SELECT *, coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0) AS f0, coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0) AS f1, s0 + s1 AS s FROM p)
        --main SELECT 'low' AS label, p0 AS precision, r0 AS recall, f0 AS f1, s0 AS support FROM q UNION ALL SELECT 'high', p1, r1, f1, s1 FROM q
        UNION ALL SELECT 'accuracy', acc, acc, acc, s FROM q UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, s FROM q
        UNION ALL SELECT 'weighted avg', (p0 * s0 + p1 * s1) / s, (r0 * s0 + r1 * s1) / s, (f0 * s0 + f1 * s1) / s, s FROM q""",
                                         "label precision:f recall:f f1:f support:i"),
    "prediction_report": rounded_sql(f"""WITH {_CLASSED} --main SELECT sid AS subject, eta AS risk_score, risk_class AS predicted_class,
        CAST(event AS INTEGER) AS event_status, time AS survival_time, predicted_days AS predicted_time FROM cl""",
                                     "subject risk_score:f predicted_class event_status survival_time:f predicted_time:f"),
}
