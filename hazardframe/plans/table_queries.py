"""Registered queries: sources, encoders, joins, splits and plain aggregates, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardframe.functions.scalar import mapped, to_months
from hazardframe.operators import encode, splits
from hazardframe.operators.ordered import quantiles
from hazardframe.plans import cohorts as co
from hazardframe.plans.sqltext import CHURN, GAP, fixed, rounded_sql, split_cte
from hazardframe.sources import tables as st

NEEDED = ["1-URGENT", "2-HIGH"]


def _lines(spark, sf):
    """Line items read as files in folders; a folder whose first file has no kind is in error."""
    return co.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_suppkey").alias("subject"), F.min("l_returnflag").alias("flag")).select(
        F.col("l_orderkey").alias("folder"), F.col("l_linenumber").alias("path"), "subject",
        F.when(F.col("flag") != "N", F.col("flag")).alias("kind"))


def _blank(spark, sf):
    return co.churn(spark, sf).withColumn("c_acctbal", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")))


def _imputed(spark, sf):
    names = ["c_acctbal", "mean_price", "n_orders"]
    wide = encode.assemble(_blank(spark, sf), names, ["sid"])
    return encode.MedianImputer(names).fit(wide).transform(wide), names


def median_impute(spark, sf):
    d, names = _imputed(spark, sf)
    return fixed(d.select("sid", *[F.col("features")[i].alias(n) for i, n in enumerate(names)]))


def z_score(spark, sf):
    d, names = _imputed(spark, sf)
    d = encode.ZScore(names).fit(d).transform(d)
    return fixed(d.select("sid", *[F.col("features")[i].alias(n) for i, n in enumerate(names)]))


def image_status(spark, sf):
    """Orders as images: lines as regions, returned lines as the target region."""
    l = co.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.sum(F.when(F.col("l_returnflag") != "A", 1).otherwise(0)).alias("n_rois"),
        F.max(F.col("l_returnflag") == "R").alias("has_target"),
        F.count("*").alias("image_size"), F.countDistinct("l_suppkey").alias("mask_size"))
    o = co.table(spark, sf, "orders").select("o_orderkey")
    meta = o.join(l, o.o_orderkey == l.l_orderkey, "left").select(
        "o_orderkey", F.col("l_orderkey").isNotNull().alias("has_label"), F.coalesce("n_rois", F.lit(0)).alias("n_rois"),
        F.coalesce("has_target", F.lit(False)).alias("has_target"), "image_size", "mask_size")
    return st.validate_images(meta).select("o_orderkey", "status")


def optional_columns(spark, sf):
    """The cohort's encoders on a table that lacks two of their three columns."""
    d = co.churn(spark, sf).select("sid", "stage")
    return encode.CohortEncoder("stage", "gender", "histology", co.PRIORITY_CODES).fit(d).transform(d)


def train_size_status(spark, sf):
    return encode.size_status(co.churn(spark, sf), ["segment", "c_nationkey"])


def fallback_split(spark, sf):
    """One subject alone outlives the median, so the strata fall back to the event."""
    d = co.churn(spark, sf).select("sid", "event")
    first = d.agg(F.min("sid")).first()[0]
    d = d.withColumn("time", F.when(F.col("sid") == first, 2.0).otherwise(1.0))
    return splits.stratified_split(d, "sid", "time", "event").select("sid", "is_train")


def one_hot(spark, sf):
    d = co.churn(spark, sf).select("sid", F.when(F.col("segment") != "MACHINERY", F.col("segment")).alias("segment"))
    return encode.OneHot("segment").fit(d).transform(d)


def merge_cohort(spark, sf):
    o = co.table(spark, sf, "orders").select(F.col("o_custkey").alias("sid"), "o_orderkey", F.col("o_orderpriority").alias("tag"))
    c = co.table(spark, sf, "customer").select(F.col("c_custkey").alias("sid"), F.col("c_mktsegment").alias("tag"), "c_acctbal")
    return encode.merge_cohort(o, c, "sid")


def group_split(spark, sf):
    return splits.group_split(co.event_gap(spark, sf), "user_id").select("sid", "user_id", "is_train")


def auto_split(spark, sf):
    return splits.train_test_split(co.event_gap(spark, sf), "user_id", "time", "event").groupBy("is_train").agg(
        F.count("*").alias("n_rows"), F.countDistinct("user_id").alias("n_subjects"))


def encode_cohort(spark, sf):
    d = co.churn(spark, sf).select("sid", "stage", F.col("segment").alias("histology"))
    gender = co.table(spark, sf, "customer").select(F.col("c_custkey").alias("sid"), F.when(F.col("c_acctbal") > 0, "male")
                                                    .when(F.col("c_acctbal") < -500, "other").otherwise("female").alias("gender"))
    enc = encode.CohortEncoder("stage", "gender", "histology", stage_codes=co.PRIORITY_CODES)
    d = d.join(gender, "sid")
    return enc.fit(d).transform(d)


def numeric_projection(spark, sf):
    d = co.churn(spark, sf)
    names = st.numeric_features(d, ["sid", "time", "event"])
    wide = encode.assemble(d, names, ["sid"])
    return wide.select("sid", F.size("features").alias("n_features"),
                       F.aggregate("features", F.lit(0.0), lambda s, v: s + F.round(v, 0)).alias("total"))


def event_wide(spark, sf):
    e = co.table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 2).alias("value"))
    return st.features_long_to_wide(e, "user_id", "event_type", "value")


def prefix_dropped(spark, sf):
    d = co.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("diagnostics_status"), "o_custkey")
    return st.drop_prefixed(d)


QUERIES = {
    "optional_columns": optional_columns,
    "train_size_status": train_size_status,
    "fallback_split": fallback_split,
    "scan_clinical": lambda s, sf: st.read_clinical(s, f"{sf}/customer.parquet", schema=None),
    "scan_features": lambda s, sf: st.read_features(s, f"{sf}/supplier.parquet"),
    "select_complete_subjects": lambda s, sf: st.select_complete_subjects(co.manifest(s, sf), "subject", "modality", NEEDED, 1000),
    "subjects_with_all_kinds": lambda s, sf: st.subjects_with_all(co.manifest(s, sf), "subject", "modality", NEEDED),
    "regroup_files": lambda s, sf: st.regroup_manifest(_lines(s, sf), "folder", "path", "subject", "kind")[0],
    "regroup_rejects": lambda s, sf: st.regroup_manifest(_lines(s, sf), "folder", "path", "subject", "kind")[1],
    "complete_pairs": lambda s, sf: st.complete_pairs(co.manifest(s, sf), "subject", "modality", *NEEDED),
    "pending_subjects": lambda s, sf: st.pending_only(
        co.manifest(s, sf), co.manifest(s, sf).where("modality = '1-URGENT'"), "subject"),
    "features_wide": event_wide,
    "report_rounding": lambda s, sf: st.rounded(
        co.churn(s, sf).select("sid", to_months(F.col("time")).alias("months"), "max_price"), 4),
    "cohort_differences": lambda s, sf: st.cohort_differences(
        co.manifest(s, sf).where("modality = '1-URGENT'"), co.manifest(s, sf).where("modality = '2-HIGH'"), "subject"),
    "ordinal_encode": lambda s, sf: encode.map_encode(co.churn(s, sf), "stage", co.PRIORITY_CODES, 3).select("sid", "stage"),
    "binary_encode": lambda s, sf: co.table(s, sf, "orders").select(
        "o_orderkey", mapped(F.col("o_orderstatus"), {"F": 1, "O": 0}, 1).alias("flag")),
    "one_hot": one_hot,
    "encode_cohort": encode_cohort,
    "numeric_projection": numeric_projection,
    "survival_target": lambda s, sf: encode.survival_target(
        co.event_gap(s, sf).withColumn("event", F.col("event").cast("int")), "time", "event").select("sid", "time", "event"),
    "median_impute": median_impute,
    "z_score": z_score,
    "days_to_months": lambda s, sf: fixed(co.churn(s, sf).select("sid", to_months(F.col("time")).alias("months"))),
    "event_rows": lambda s, sf: co.event_gap(s, sf).where("event").select("sid", "time"),
    "drop_prefixed": prefix_dropped,
    "image_status": image_status,
    "merge_cohort": merge_cohort,
    "cohort_counts": lambda s, sf: encode.cohort_counts(co.event_gap(s, sf), "user_id"),
    "column_medians": lambda s, sf: fixed(encode.column_medians(co.churn(s, sf), co.CHURN_FEATURES)),
    "grouped_quantiles": lambda s, sf: fixed(quantiles(
        co.table(s, sf, "lineitem"), "l_extendedprice", {"p10": 0.1, "p25": 0.25, "median": 0.5, "p90": 0.9}, ["l_returnflag"])),
    "time_bounds": lambda s, sf: co.event_gap(s, sf).groupBy("event").agg(
        F.min("time").alias("lo"), F.max("time").alias("hi")).agg(F.max("lo").alias("lo"), F.min("hi").alias("hi")),
    "stratified_split": lambda s, sf: splits.stratified_split(co.churn(s, sf), "sid", "time", "event").select("sid", "is_train"),
    "group_split": group_split,
    "auto_split": auto_split,
    "repeated_kfold": lambda s, sf: splits.kfold_long(co.churn(s, sf), ["sid"], 5, 3),
}

_M = "man AS (SELECT o_custkey AS subject, o_orderpriority AS modality, o_orderkey AS series FROM orders)"
_PAIRS = f"WITH {_M}, f AS (SELECT subject, bool_or(modality = '1-URGENT') AS a, bool_or(modality = '2-HIGH') AS b FROM man GROUP BY subject)"
_LINES = """WITH f AS (SELECT l_orderkey AS folder, l_linenumber AS path, min(l_suppkey) AS subject,
              CASE WHEN min(l_returnflag) <> 'N' THEN min(l_returnflag) END AS kind FROM lineitem GROUP BY 1, 2),
       h AS (SELECT folder, first(subject ORDER BY path) AS subject, first(kind ORDER BY path) AS kind, count(*) AS n FROM f GROUP BY 1)"""
_BLANK = CHURN + ", b AS (SELECT sid, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal, mean_price, n_orders FROM churn)"
_IMP = _BLANK + """, i AS (SELECT sid, coalesce(c_acctbal, (SELECT median(c_acctbal) FROM b)) AS c_acctbal, mean_price,
        CAST(n_orders AS DOUBLE) AS n_orders FROM b)"""
_STAGE = "CASE stage WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 4 ELSE 3 END"
_Z = lambda c: f"({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1 ELSE stddev_pop({c}) OVER () END AS {c}"
_GROUPS = f"""WITH {GAP}, ids AS (SELECT user_id, row_number() OVER (ORDER BY md5(concat(user_id, ':42'))) AS r,
              floor(0.8 * count(*) OVER () + 1e-9) AS goal FROM (SELECT DISTINCT user_id FROM gap))"""

ORACLE = {
    "optional_columns": f"""WITH {CHURN} SELECT sid, CAST(CASE stage WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 4 ELSE 3 END AS INTEGER) AS stage
        FROM churn""",
    "train_size_status": f"""WITH {CHURN} SELECT segment, c_nationkey, count(*) AS n_rows, CASE WHEN count(*) >= 15 THEN 'ok' ELSE 'too small: ' || count(*) END AS status
        FROM churn GROUP BY ALL""",
    "fallback_split": f"""WITH {CHURN}, flat AS (SELECT sid, event, CASE WHEN sid = (SELECT min(sid) FROM churn) THEN 2.0 ELSE 1.0 END AS time FROM churn),
        {split_cte("flat").replace("concat(CAST(event AS INT), '_', CAST(time > (SELECT median(time) FROM flat) AS INT))", "CAST(CAST(event AS INT) AS VARCHAR)")}
        SELECT sid, is_train FROM parts""",
    "scan_clinical": "SELECT * FROM customer",
    "scan_features": "SELECT * FROM supplier",
    "select_complete_subjects": f"""{_PAIRS} SELECT man.* FROM man JOIN
        (SELECT subject FROM f WHERE a AND b ORDER BY subject LIMIT 1000) USING (subject)""",
    "subjects_with_all_kinds": f"{_PAIRS} SELECT subject FROM f WHERE a AND b",
    "regroup_files": f"{_LINES} SELECT h.subject, h.kind, folder, path FROM f JOIN h USING (folder) WHERE h.kind IS NOT NULL",
    "regroup_rejects": f"{_LINES} SELECT folder, n AS n_files, 'first file has no subject or kind' AS reason FROM h WHERE kind IS NULL",
    "complete_pairs": f"""{_PAIRS} SELECT subject, CASE WHEN a AND b THEN 'ok' WHEN a THEN 'label missing'
        WHEN b THEN 'image missing' ELSE 'image and label missing' END AS status FROM f""",
    "pending_subjects": f"WITH {_M} SELECT * FROM man WHERE subject NOT IN (SELECT subject FROM man WHERE modality = '1-URGENT')",
    "features_wide": "SELECT user_id, " + ", ".join(
        f"round(sum(value) FILTER (event_type = '{k}'), 2) AS {k}" for k in ("click", "error", "purchase", "signup", "view"))
        + " FROM events GROUP BY user_id",
    "report_rounding": f"WITH {CHURN} SELECT sid, round(time / 30.437, 4) AS months, round(max_price, 4) AS max_price FROM churn",
    "cohort_differences": f"{_PAIRS} SELECT subject, a AS in_features, b AS in_manifest FROM f WHERE a <> b",
    "ordinal_encode": f"WITH {CHURN} SELECT sid, {_STAGE} AS stage FROM churn",
    "binary_encode": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 ELSE 1 END AS flag FROM orders",
    "one_hot": f"""WITH {CHURN}, g AS (SELECT sid, CASE WHEN segment <> 'MACHINERY' THEN segment ELSE 'Unknown' END AS s FROM churn)
        SELECT sid, """ + ", ".join(f"CAST(s = '{k}' AS INTEGER) AS segment_{k}" for k in ("BUILDING", "FURNITURE", "HOUSEHOLD", "Unknown"))
        + " FROM g",
    "encode_cohort": f"""WITH {CHURN} SELECT sid, {_STAGE} AS stage, CASE WHEN c_acctbal > 0 THEN 1 WHEN c_acctbal < -500 THEN 1 ELSE 0 END AS gender,
        """ + ", ".join(f"CAST(segment = '{k}' AS INTEGER) AS histology_{k}" for k in ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))
        + " FROM churn",
    "numeric_projection": f"""WITH {CHURN} SELECT sid, 8 AS n_features, round(c_acctbal, 0) + n_orders + round(mean_price, 0)
        + round(min_price, 0) + round(max_price, 0) + round(sum_price, 0) + c_nationkey + start_day AS total FROM churn""",
    "survival_target": f"WITH {GAP} SELECT sid, time, event FROM gap",
    "median_impute": rounded_sql(f"WITH {_IMP} --main SELECT * FROM i", "sid c_acctbal:f mean_price:f n_orders:f"),
    "z_score": rounded_sql(f"WITH {_IMP} --main SELECT sid, {_Z('c_acctbal')}, {_Z('mean_price')}, {_Z('n_orders')} FROM i",
                           "sid c_acctbal:f mean_price:f n_orders:f"),
    "days_to_months": rounded_sql(f"WITH {CHURN} --main SELECT sid, time / 30.437 AS months FROM churn", "sid months:f"),
    "event_rows": f"WITH {GAP} SELECT sid, time FROM gap WHERE event",
    "drop_prefixed": "SELECT o_orderkey, o_custkey FROM orders",
    "image_status": """WITH l AS (SELECT l_orderkey, count(*) FILTER (l_returnflag <> 'A') AS n_rois, bool_or(l_returnflag = 'R') AS t,
            count(*) AS a, count(DISTINCT l_suppkey) AS b FROM lineitem GROUP BY 1)
        SELECT o_orderkey, CASE WHEN l_orderkey IS NULL THEN 'no label file' WHEN n_rois = 0 THEN 'no region in the label file'
            WHEN NOT t THEN 'target region missing' WHEN a <> b THEN 'size mismatch' ELSE 'ok' END AS status
        FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""",
    "merge_cohort": """SELECT o_custkey AS sid, o_orderkey, o_orderpriority AS tag_x, c_mktsegment AS tag_y, c_acctbal
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "cohort_counts": """SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_subjects,
        count(DISTINCT user_id) < count(*) AS has_duplicates FROM events""",
    "column_medians": f"WITH {CHURN} " + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(CAST(median({c}) AS DOUBLE), 6) AS median FROM churn" for c in co.CHURN_FEATURES),
    "grouped_quantiles": rounded_sql("""SELECT l_returnflag, quantile_cont(l_extendedprice, 0.1) AS p10, quantile_cont(l_extendedprice, 0.25) AS p25,
        median(l_extendedprice) AS median, quantile_cont(l_extendedprice, 0.9) AS p90 FROM lineitem GROUP BY 1""",
                                     "l_returnflag p10:f p25:f median:f p90:f"),
    "time_bounds": f"""WITH {GAP} SELECT max(lo) AS lo, min(hi) AS hi FROM
        (SELECT event, min(time) AS lo, max(time) AS hi FROM gap GROUP BY event)""",
    "stratified_split": f"WITH {CHURN}, {split_cte('churn')} SELECT sid, is_train FROM parts",
    "group_split": f"{_GROUPS} SELECT sid, user_id, r <= goal AS is_train FROM gap JOIN ids USING (user_id)",
    "auto_split": f"""{_GROUPS} SELECT r <= goal AS is_train, count(*) AS n_rows, count(DISTINCT user_id) AS n_subjects
        FROM gap JOIN ids USING (user_id) GROUP BY 1""",
    "repeated_kfold": f"""WITH {CHURN} SELECT sid, r AS repeat, CAST(ntile(5) OVER (PARTITION BY r
        ORDER BY md5(concat(sid, ':42:', r))) - 1 AS INTEGER) AS fold FROM churn, (SELECT unnest([0, 1, 2]) AS r)""",
}
