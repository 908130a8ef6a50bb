"""Registered queries: likelihood, penalised and neural Cox models, cross-validation, the whole study."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from hazardframe.operators import cox_likelihood as cl, encode, lasso_cox as lc, metrics, residuals, stratify
from hazardframe.operators.deep_cox import DeepCox, Network
from hazardframe.plans import cohorts as co
from hazardframe.plans.sqltext import CHURN, GAP, SCORED, fixed, rounded_sql
from hazardframe.plans.survival_queries import breslow_sql
from hazardframe.plans.workflow import StudyConfig, report_values, run_study
from hazardframe.session import cut_lineage

NAMES = co.CHURN_FEATURES
ALPHAS = [0.05, 0.1, 0.2, 0.3]
FEW_ALPHAS = [0.05, 0.2]
BETA = [0.1 * (-1) ** j * (j + 1) / len(NAMES) for j in range(len(NAMES))]


def _raw(spark, sf):
    return encode.assemble(co.churn(spark, sf), NAMES, ["sid", "time", "event"])


def _scaled(spark, sf):
    d = cut_lineage(_raw(spark, sf))
    return cut_lineage(encode.ZScore(NAMES).fit(d).transform(d))


def _weights():
    return lc.penalty_weights(NAMES, ["c_acctbal"])


def _lasso(spark, sf, alpha=0.05):
    d = _scaled(spark, sf)
    return lc.LassoCox(NAMES, alpha, _weights()).fit(d, tol=1e-11), d


def cox_loss(spark, sf):
    return fixed(cl.negative_log_likelihood(co.scored_gap(spark, sf), "time", "event", "eta", ["kind"]))


def cox_loss_rowwise(spark, sf):
    return fixed(cl.negative_log_likelihood(co.scored_churn(spark, sf), "time", "event", "eta", ["segment"], "rowwise", "sid"))


def cox_gradient(spark, sf):
    """Derivative of the log partial likelihood at fixed coefficients."""
    got = cl.Likelihood(_scaled(spark, sf)).evaluate(cl.Models([cl.TrainSet()], np.zeros(1, dtype=int), np.asarray([BETA])))
    rows = [(n, float(g), float(got["loglik"][0])) for n, g in zip(NAMES, got["gradient"][0])]
    return fixed(spark.createDataFrame(rows, "feature string, gradient double, loglik double"), 4)


def lasso_coefficients(spark, sf):
    return fixed(_lasso(spark, sf)[0].coefficient_table(spark), 5)


def lasso_selected_features(spark, sf):
    return fixed(_lasso(spark, sf)[0].selected_features(spark), 5)


def lasso_coefficients_joined(spark, sf):
    """The same fit by the plan for more distinct times than may be held."""
    m = lc.LassoCox(NAMES, 0.05, _weights()).fit(_scaled(spark, sf), tol=1e-9, max_iter=400, max_curve_cells=1)
    return fixed(m.coefficient_table(spark), 5)


def lasso_top_features(spark, sf):
    return fixed(_lasso(spark, sf)[0].selected_features(spark, 5), 5)


def lasso_baseline(spark, sf):
    return fixed(_lasso(spark, sf)[0].baseline.select("time", "n_event", "cum_hazard"), 5)


def lasso_report(spark, sf):
    m, d = _lasso(spark, sf)
    cls = stratify.RiskClassifier().fit(m.score(d))
    timed = residuals.median_survival(m.score(d), m.baseline, "risk_score")
    return fixed(stratify.prediction_report(cls.transform(timed), "sid", "time", "event"), 5)


def alpha_search(spark, sf):
    return fixed(lc.grid_search(_scaled(spark, sf), NAMES, ALPHAS, 5, 3, weights=_weights()).table(spark))


def alpha_search_default(spark, sf):
    """The default grid: 20 penalties, 5 folds, 3 repeats, hence 300 fits."""
    return fixed(lc.grid_search(_scaled(spark, sf), NAMES, weights=_weights()).table(spark))


def alpha_search_scores(spark, sf):
    """A search small enough for an iterative solution in SQL: three folds, two penalties."""
    return fixed(lc.grid_search(_scaled(spark, sf), NAMES, FEW_ALPHAS, 3, 1, weights=_weights(), tol=1e-10, max_iter=80).table(spark), 4)


def _with_nulls(spark, sf):
    return _raw(spark, sf).withColumn("features", F.transform("features", lambda v, i: F.when((i == 0) & (v < 0), None).otherwise(v)))


def _nested(spark, sf):
    return lc.nested_cv(_with_nulls(spark, sf), NAMES, FEW_ALPHAS, 3, 1, weights=_weights(), tol=1e-10, max_iter=80)


def nested_default(spark, sf):
    """The nested search at its defaults: 5 x 3 outer folds, each with 5 x 3 inner folds and 20 penalties, hence 4,515 fits."""
    return fixed(lc.nested_cv(_with_nulls(spark, sf), NAMES, weights=_weights()), 4)


def _deep(spark, sf, epochs=5):
    d = _scaled(spark, sf)
    return DeepCox(NAMES, [8, 4], 0.1, 5e-3).fit(d, epochs, 64), d


def deep_scores(spark, sf):
    m, d = _deep(spark, sf)
    return fixed(m.score(d).select("sid", "risk_score"), 4)


def deep_concordance(spark, sf):
    m, d = _deep(spark, sf)
    return fixed(metrics.concordance_index(m.score(d), "time", "event", "risk_score").select("c_index"), 4)


WHOLE_HIDDEN, WHOLE_RATE, WHOLE_EPOCHS = 2, 5e-3, 20


def _whole(spark, sf):
    """A network whose every step spans the whole table, small enough for a recursive query."""
    d = _scaled(spark, sf)
    return DeepCox(NAMES, [WHOLE_HIDDEN], 0.0, WHOLE_RATE).fit(d, WHOLE_EPOCHS, None), d


def deep_whole_scores(spark, sf):
    m, d = _whole(spark, sf)
    return fixed(m.score(d).select("sid", "risk_score"), 4)


def deep_whole_concordance(spark, sf):
    m, d = _whole(spark, sf)
    return fixed(metrics.concordance_index(m.score(d), "time", "event", "risk_score").select("c_index"), 4)


def deep_default(spark, sf):
    """Losses of the published layers, rates, batch size and number of epochs."""
    c = StudyConfig()
    return fixed(DeepCox(NAMES, c.hidden, c.dropout, c.lr, seed=c.seed).fit(_scaled(spark, sf), c.epochs, c.batch_size).loss_history(spark), 4)


def _study(spark, sf, **settings):
    d = co.churn(spark, sf)
    features = d.select("sid", "c_acctbal", "n_orders", "mean_price", "start_day")
    clinical = d.select("sid", "time", F.col("event").cast("int").alias("event"), "stage", F.col("segment").alias("histology"),
                        F.when(F.col("c_nationkey") % 2 == 0, "male").otherwise("female").alias("gender"))
    return run_study(features, clinical, StudyConfig("sid", "time", "event", "stage", "gender", "histology", stage_codes=co.PRIORITY_CODES, **settings))


def study_values(spark, sf):
    """Every value of every report of one study on the churn cohort, for both models, at the published settings.

    Search of 5 folds x 3 repeats x 20 penalties and final fit, 170 epochs, 50 curve points. The nested search is a query of
    its own, ``nested_cross_validation_default``.
    """
    return fixed(report_values(_study(spark, sf, nested=False)), 4)


def study_reports(spark, sf):
    """Row counts of all reports of a short study: few penalties, folds and epochs, no nested search."""
    reports = _study(spark, sf, folds=3, repeats=1, alphas=[0.05, 0.1], nested=False, hidden=[4], epochs=3, lr=5e-3, batch_size=64, extreme_points=10)
    parts = [v.agg(F.count("*").alias("n_rows")).select(F.lit(k).alias("report"), "n_rows") for k, v in reports.items() if k != "scorers"]
    first, *rest = parts
    for p in rest:
        first = first.unionByName(p)
    return first


QUERIES = {
    "cox_loss": cox_loss,
    "cox_loss_rowwise": cox_loss_rowwise,
    "cox_gradient": cox_gradient,
    "lasso_coefficients": lasso_coefficients,
    "lasso_selected_features": lasso_selected_features,
    "lasso_coefficients_joined": lasso_coefficients_joined,
    "lasso_top_features": lasso_top_features,
    "lasso_baseline": lasso_baseline,
    "lasso_prediction_report": lasso_report,
    "alpha_search": alpha_search,
    "alpha_search_default": alpha_search_default,
    "alpha_search_scores": alpha_search_scores,
    "nested_cross_validation": lambda s, sf: fixed(_nested(s, sf), 4),
    "nested_cross_validation_default": nested_default,
    "deep_cox_loss": lambda s, sf: fixed(_deep(s, sf)[0].loss_history(s), 4),
    "deep_cox_scores": deep_scores,
    "deep_cox_baseline": lambda s, sf: fixed(_deep(s, sf)[0].baseline.select("time", "n_event", "cum_hazard"), 4),
    "deep_cox_concordance": deep_concordance,
    "deep_cox_whole_loss": lambda s, sf: fixed(_whole(s, sf)[0].loss_history(s), 4),
    "deep_cox_whole_scores": deep_whole_scores,
    "deep_cox_whole_baseline": lambda s, sf: fixed(_whole(s, sf)[0].baseline.select("time", "n_event", "cum_hazard"), 4),
    "deep_cox_whole_concordance": deep_whole_concordance,
    "deep_cox_default_loss": deep_default,
    "study_reports": study_reports,
    "study_values": study_values,
}

_ZS = ", ".join(f"(CAST({c} AS DOUBLE) - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS z{j}" for j, c in enumerate(NAMES))
_GRAD = f"""{CHURN}, zs AS (SELECT sid, time, event, {_ZS} FROM churn),
ze AS (SELECT *, {' + '.join(f'({b!r}) * z{j}' for j, b in enumerate(BETA))} AS eta FROM zs),
rt AS (SELECT time, sum(CAST(event AS INT)) AS d, sum(exp(eta)) AS r FROM ze GROUP BY time),
rs AS (SELECT time, d, sum(r) OVER (ORDER BY time DESC) AS s FROM rt),
rh AS (SELECT time, d, s, sum(d / s) OVER (ORDER BY time) AS h FROM rs),
mr AS (SELECT ze.*, CAST(event AS INT) - h * exp(eta) AS m FROM ze JOIN rh USING (time)),
ll AS (SELECT (SELECT sum(eta) FROM ze WHERE event) - (SELECT sum(d * ln(s)) FROM rs) AS loglik)"""



def _descent(rows: str, starts: str, steps: int = 400, rate: float = 0.4) -> str:
    """Accelerated proximal gradient as a recursive query: one state row per step and model ``m`` with penalty ``alpha``.

    ``rows`` gives the training rows ``(m, time, event, z0..)`` of each model; the result CTE ``lb`` holds ``(m, alpha, b)``.
    """
    w = _weights()
    cols = range(len(NAMES))
    ahead = ", ".join(f"b[{j + 1}] + i / (i + 3.0) * (b[{j + 1}] - p[{j + 1}])" for j in cols)
    moved = [f"any_value(y)[{j + 1}] + {rate} * sum(r * z{j}) / count(*)" for j in cols]
    new = ", ".join(f"sign({v}) * greatest(abs({v}) - any_value(alpha) * {rate * w[j]!r}, 0)" for j, v in enumerate(moved))
    zs, zero = ", ".join(f"z{j}" for j in cols), ", ".join(["CAST(0 AS DOUBLE)"] * len(NAMES))
    return f"""tr AS ({rows}),
it(i, m, alpha, b, p) AS (SELECT 0, m, CAST(alpha AS DOUBLE), [{zero}], [{zero}] FROM ({starts}) UNION ALL
  SELECT i + 1, m, alpha, nb, b FROM (
    SELECT i, m, any_value(alpha) AS alpha, any_value(b) AS b, [{new}] AS nb FROM (
      SELECT i, m, alpha, b, y, {zs}, CAST(event AS INT) - exp(eta) * sum(CAST(event AS INT) / s) OVER (PARTITION BY m ORDER BY time) AS r FROM (
        SELECT *, sum(exp(eta)) OVER (PARTITION BY m ORDER BY time DESC) AS s FROM (
          SELECT st.*, time, event, {zs}, {' + '.join(f'y[{j + 1}] * z{j}' for j in cols)} AS eta
          FROM (SELECT i, m, alpha, b, [{ahead}] AS y FROM it WHERE i < {steps}) st JOIN tr USING (m))))
    GROUP BY i, m)),
lb AS (SELECT m, alpha, b FROM it WHERE i = {steps})"""


_DOT = " + ".join(f"b[{j + 1}] * z{j}" for j in range(len(NAMES)))
_ZTABLE = f"{CHURN}, zs AS (SELECT sid, time, event, {_ZS} FROM churn)"
_LASSO = f"""{_ZTABLE}, {_descent("SELECT 0 AS m, * FROM zs", "SELECT 0 AS m, 0.05 AS alpha")},
le AS (SELECT sid, time, event, {_DOT} AS eta FROM zs, lb), {breslow_sql("le")}"""
_LASSO_COEFFICIENTS = " UNION ALL ".join(f"SELECT '{c}' AS feature, b[{j + 1}] AS coefficient, exp(b[{j + 1}]) AS hazard_ratio FROM lb"
                                         for j, c in enumerate(NAMES))
_MODELS = " UNION ALL ".join(f"SELECT {f * len(FEW_ALPHAS) + a} AS m, {f} AS f, {a} AS a, {alpha} AS alpha"
                             for f in range(3) for a, alpha in enumerate(FEW_ALPHAS))
_SEARCH = f"""{_ZTABLE}, zf AS (SELECT *, ntile(3) OVER (ORDER BY md5(concat(sid, ':42:0'))) - 1 AS fold FROM zs),
mo AS ({_MODELS}), {_descent("SELECT m, zf.* FROM zf JOIN mo ON fold <> f", "SELECT m, alpha FROM mo", 200)},
ho AS (SELECT mo.m, a, mo.alpha, time, event, {_DOT} AS eta FROM mo JOIN lb USING (m) JOIN zf ON fold = f),
ci AS (SELECT x.m, any_value(x.a) AS a, any_value(x.alpha) AS alpha,
              (count(*) FILTER (x.eta - y.eta > 1e-8) + 0.5 * count(*) FILTER (abs(x.eta - y.eta) <= 1e-8)) / count(*) AS c
       FROM ho x JOIN ho y ON x.m = y.m AND x.event AND (x.time < y.time OR (x.time = y.time AND NOT y.event)) GROUP BY x.m)"""

# Nested search in SQL. Training set g < 3 of outer fold o leaves out its inner fold g; g = 3 is the whole outer training part.
_Z = range(len(NAMES))
_NESTED = f"""{CHURN},
b0 AS (SELECT sid, time, event, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS x0, {', '.join(f'CAST({c} AS DOUBLE) AS x{j}' for j, c in enumerate(NAMES) if j)} FROM churn),
ou AS (SELECT *, ntile(3) OVER (ORDER BY md5(concat(sid, ':100:0'))) - 1 AS fo FROM b0),
os AS (SELECT unnest([0, 1, 2]) AS o), gs AS (SELECT unnest([0, 1, 2, 3]) AS g), al AS (SELECT unnest([0, 1]) AS a, unnest({FEW_ALPHAS}) AS alpha),
inn AS (SELECT ou.*, o, CASE WHEN fo <> o THEN ntile(3) OVER (PARTITION BY o, fo <> o ORDER BY md5(concat(sid, ':42:0'))) - 1 END AS fi FROM ou, os),
se AS (SELECT inn.*, g, fo <> o AND (g = 3 OR fi <> g) AS inside FROM inn, gs),
md AS (SELECT o, g, median(x0) AS q FROM se WHERE inside GROUP BY ALL),
im AS (SELECT se.* EXCLUDE (x0), coalesce(x0, q) AS x0 FROM se JOIN md USING (o, g)),
sc AS (SELECT o, g, {', '.join(f'avg(x{j}) FILTER (inside) AS m{j}, stddev_pop(x{j}) FILTER (inside) AS s{j}' for j in _Z)} FROM im GROUP BY o, g),
zz AS (SELECT sid, time, event, o, g, fo, fi, inside, {', '.join(f'(x{j} - m{j}) / s{j} AS z{j}' for j in _Z)} FROM im JOIN sc USING (o, g)),
mo AS (SELECT o * 100 + g * 10 + a AS m, o, g, a, alpha FROM os, gs, al),
{_descent(f"SELECT m, time, event, {', '.join(f'z{j}' for j in _Z)} FROM zz JOIN mo USING (o, g) WHERE inside", "SELECT m, alpha FROM mo", 150)},
ho AS (SELECT mo.m, mo.o, mo.a, mo.alpha, CASE WHEN mo.g < 3 THEN 'inner' WHEN fo <> mo.o THEN 'train' ELSE 'test' END AS side, time, event, {_DOT} AS eta
       FROM zz JOIN mo USING (o, g) JOIN lb USING (m) WHERE mo.g = 3 OR (fo <> mo.o AND fi = mo.g)),
ci AS (SELECT x.m, x.side, any_value(x.o) AS o, any_value(x.a) AS a, any_value(x.alpha) AS alpha,
              (count(*) FILTER (x.eta - y.eta > 1e-8) + 0.5 * count(*) FILTER (abs(x.eta - y.eta) <= 1e-8)) / count(*) AS c
       FROM ho x JOIN ho y ON x.m = y.m AND x.side = y.side AND x.event AND (x.time < y.time OR (x.time = y.time AND NOT y.event)) GROUP BY x.m, x.side),
be AS (SELECT o, a FROM (SELECT o, a, avg(c) AS c FROM ci WHERE side = 'inner' GROUP BY o, a)
       QUALIFY row_number() OVER (PARTITION BY o ORDER BY round(c, 12) DESC, a) = 1)"""



def _whole_sql() -> str:
    """Adam on the whole table as a recursive query; ``p`` holds the weights in the order of the network, then its running statistics.

    The starting weights are the seeded ones. The result CTE ``fin`` is the last state, ``it`` holds the loss of every epoch.
    """
    n_in, h, net = len(NAMES), WHOLE_HIDDEN, Network(len(NAMES), [WHOLE_HIDDEN])
    ks, js = range(h), range(n_in)
    at = lambda base, k=0: f"p[{base + k + 1}]"
    b, sc, sh, wo = n_in * h, (n_in + 1) * h, (n_in + 2) * h, (n_in + 3) * h
    n_par, mean, var = net.trainable, net.trainable, net.trainable + h
    zs = ", ".join(f"z{j}" for j in js)
    each = lambda f: ", ".join(f(k) for k in ks)
    grads = [f"sum(z{j} * g{k})" for j in js for k in ks] + [f"sum(g{k})" for k in ks] + [f"sum(b{k} * o{k})" for k in ks]
    grads += [f"sum(b{k})" for k in ks] + [f"sum(a{k} * d)" for k in ks] + ["sum(d)"]
    grad = ", ".join(f"{g} + 1e-4 * any_value({at(x)})" for x, g in enumerate(grads))
    running = ", ".join([f"0.9 * any_value({at(mean, k)}) + 0.1 * any_value(mu{k})" for k in ks]
                        + [f"0.9 * any_value({at(var, k)}) + 0.1 * any_value(va{k}) * count(*) / (count(*) - 1)" for k in ks])
    moved = ", ".join(f"p[{x}] - {WHOLE_RATE} * (nm[{x}] / (1 - 0.9 ** (i + 1))) / (sqrt(nv[{x}] / (1 - 0.999 ** (i + 1))) + 1e-8)" for x in range(1, n_par + 1))
    zero = ", ".join(["CAST(0 AS DOUBLE)"] * n_par)
    start = ", ".join(f"CAST({float(v)!r} AS DOUBLE)" for v in net.start(42))
    steps = [f"SELECT st.*, time, CAST(event AS INT) AS e, {zs}, " + each(lambda k: " + ".join(f"{at(j * h, k)} * z{j}" for j in js) + f" + {at(b, k)} AS u{k}")
             + f" FROM (SELECT i, p, m, v FROM it WHERE i < {WHOLE_EPOCHS}) st, zs",
             "SELECT *, " + each(lambda k: f"avg(u{k}) OVER () AS mu{k}, var_pop(u{k}) OVER () AS va{k}"),
             "SELECT *, " + each(lambda k: f"(u{k} - mu{k}) / sqrt(va{k} + 1e-5) AS o{k}"),
             "SELECT *, " + each(lambda k: f"greatest(o{k} * {at(sc, k)} + {at(sh, k)}, 0) AS a{k}"),
             "SELECT *, " + " + ".join(f"a{k} * {at(wo, k)}" for k in ks) + f" + {at(wo, h)} AS eta",
             "SELECT *, sum(exp(eta)) OVER (ORDER BY time DESC) AS s, sum(e) OVER () + 1e-8 AS deaths",
             "SELECT *, -(e - exp(eta) * sum(e / s) OVER (ORDER BY time)) / deaths AS d",
             "SELECT *, " + each(lambda k: f"CASE WHEN a{k} > 0 THEN d * {at(wo, k)} ELSE 0 END AS b{k}"),
             "SELECT *, " + each(lambda k: f"{at(sc, k)} * (b{k} - avg(b{k}) OVER () - o{k} * avg(b{k} * o{k}) OVER ()) / sqrt(va{k} + 1e-5) AS g{k}"),
             f"SELECT any_value(i) AS i, any_value(p) AS p, any_value(m) AS m, any_value(v) AS v, [{grad}] AS g, [{running}] AS r, -sum(e * (eta - ln(s))) / any_value(deaths) AS loss"]
    body = steps[0]
    for step in steps[1:]:
        body = f"{step} FROM ({body})"
    return f"""{_ZTABLE}, it(i, p, m, v, loss) AS (SELECT 0, [{start}], [{zero}], [{zero}], CAST(0 AS DOUBLE) UNION ALL
  SELECT i + 1, list_concat([{moved}], r), nm, nv, loss FROM (
    SELECT *, list_transform(range(1, {n_par + 1}), lambda x: 0.9 * m[x] + 0.1 * g[x]) AS nm, list_transform(range(1, {n_par + 1}), lambda x: 0.999 * v[x] + 0.001 * g[x] * g[x]) AS nv
    FROM ({body}) WHERE i IS NOT NULL)),
fin AS (SELECT p FROM it WHERE i = {WHOLE_EPOCHS}),
le AS (SELECT sid, time, event, {" + ".join(f"greatest(({' + '.join(f'{at(j * h, k)} * z{j}' for j in js)} + {at(b, k)} - {at(mean, k)}) / sqrt({at(var, k)} + 1e-5) * {at(sc, k)} + {at(sh, k)}, 0) * {at(wo, k)}" for k in ks)}
       + {at(wo, h)} AS eta FROM zs, fin)"""


_WHOLE = _whole_sql()

ORACLE = {
    "deep_cox_whole_loss": rounded_sql(f"WITH RECURSIVE {_WHOLE} --main SELECT CAST(i AS INTEGER) AS epoch, loss FROM it WHERE i > 0", "epoch loss:f", 4),
    "deep_cox_whole_scores": rounded_sql(f"WITH RECURSIVE {_WHOLE} --main SELECT sid, eta AS risk_score FROM le", "sid risk_score:f", 4),
    "deep_cox_whole_baseline": rounded_sql(f"WITH RECURSIVE {_WHOLE}, {breslow_sql('le')} --main SELECT time, n_event, cum_hazard FROM base", "time:f n_event:i cum_hazard:f", 4),
    "deep_cox_whole_concordance": rounded_sql(f"""WITH RECURSIVE {_WHOLE} --main SELECT (count(*) FILTER (x.eta - y.eta > 1e-8) + 0.5 * count(*) FILTER (abs(x.eta - y.eta) <= 1e-8)) / count(*) AS c_index
        FROM le x JOIN le y ON x.event AND (x.time < y.time OR (x.time = y.time AND NOT y.event))""", "c_index:f", 4),
    "nested_cross_validation": rounded_sql(f"""WITH RECURSIVE {_NESTED} --main SELECT 0 AS repeat, o AS fold, any_value(alpha) AS alpha,
        max(c) FILTER (side = 'train') AS train_score, max(c) FILTER (side = 'test') AS test_score FROM ci JOIN be USING (o, a) WHERE side <> 'inner' GROUP BY o""",
                                           "repeat fold alpha:f train_score:f test_score:f", 4),
    "lasso_coefficients": rounded_sql(f"WITH RECURSIVE {_LASSO} --main {_LASSO_COEFFICIENTS}", "feature coefficient:f hazard_ratio:f", 5),
    "lasso_selected_features": rounded_sql(f"WITH RECURSIVE {_LASSO} --main SELECT * FROM ({_LASSO_COEFFICIENTS}) WHERE abs(coefficient) > 1e-9",
                                           "feature coefficient:f hazard_ratio:f", 5),
    "lasso_coefficients_joined": rounded_sql(f"WITH RECURSIVE {_LASSO} --main {_LASSO_COEFFICIENTS}", "feature coefficient:f hazard_ratio:f", 5),
    "lasso_top_features": rounded_sql(f"WITH RECURSIVE {_LASSO} --main SELECT * FROM ({_LASSO_COEFFICIENTS}) WHERE abs(coefficient) > 1e-9 ORDER BY abs(coefficient) DESC, feature LIMIT 5",
                                      "feature coefficient:f hazard_ratio:f", 5),
    "lasso_baseline": rounded_sql(f"WITH RECURSIVE {_LASSO} --main SELECT time, n_event, cum_hazard FROM base", "time:f n_event:i cum_hazard:f", 5),
    "lasso_prediction_report": rounded_sql(f"""WITH RECURSIVE {_LASSO} --main SELECT sid AS subject, eta AS risk_score,
        CAST(eta > (SELECT median(eta) FROM le) AS INTEGER) AS predicted_class, CAST(event AS INTEGER) AS event_status, time AS survival_time,
        coalesce((SELECT min(b.time) FROM base b WHERE b.cum_hazard >= ln(2) * (1 - 1e-12) / exp(le.eta)), (SELECT max(time) FROM base)) AS predicted_time
        FROM le""", "subject risk_score:f predicted_class event_status survival_time:f predicted_time:f", 5),
    "alpha_search_scores": rounded_sql(f"WITH RECURSIVE {_SEARCH} --main SELECT a AS alpha_no, alpha, avg(c) AS mean_score, stddev_pop(c) AS std_score FROM ci GROUP BY a, alpha",
                                       "alpha_no alpha:f mean_score:f std_score:f", 4),
    "cox_loss": rounded_sql(f"""WITH {GAP},
        a AS (SELECT kind, time, sum(CAST(event AS INT)) AS d, sum(CASE WHEN event THEN eta ELSE 0 END) AS x, sum(exp(eta)) AS r FROM sgap GROUP BY ALL),
        b AS (SELECT kind, d, x, sum(r) OVER (PARTITION BY kind ORDER BY time DESC) AS s FROM a)
        --main SELECT kind, -sum(x - d * ln(s)) / (sum(d) + 1e-8) AS loss FROM b GROUP BY kind""", "kind loss:f"),
    "cox_loss_rowwise": rounded_sql(f"""WITH {SCORED},
        b AS (SELECT segment, event, eta, sum(exp(eta)) OVER (PARTITION BY segment ORDER BY time DESC, sid ROWS UNBOUNDED PRECEDING) AS s FROM scored)
        --main SELECT segment, -sum(eta - ln(s)) FILTER (event) / (count(*) FILTER (event) + 1e-8) AS loss FROM b GROUP BY segment""", "segment loss:f"),
    "cox_gradient": rounded_sql(f"WITH {_GRAD} --main " + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, (SELECT sum(m * z{j}) FROM mr) AS gradient, (SELECT loglik FROM ll) AS loglik" for j, c in enumerate(NAMES)),
        "feature gradient:f loglik:f", 4),
}
