"""Pieces of SQL shared by the comparison queries."""

from __future__ import annotations


HALF_BREAKER = 1e-9


def fixed(df, digits: int = 6):
    """Round the floating columns so that two engines print the same value.

    The tiny offset decides exact halves, which the engines would round apart, and removes negative zeros.
    """
    from pyspark.sql import functions as F

    floats = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    return df.select(*[F.round(F.col(f"`{c}`") + F.lit(HALF_BREAKER), digits).alias(c) if c in floats else F.col(f"`{c}`")
                       for c in df.columns])


def rounded_sql(body: str, columns: str, digits: int = 6) -> str:
    """Wrap ``body``; in ``columns`` a name ending in ``:f`` is a float, ``:i`` a bigint, ``:n`` an int."""
    out = []
    for c in columns.split():
        name, _, kind = c.partition(":")
        cast = {"f": f"round(CAST({name} AS DOUBLE) + CAST({HALF_BREAKER} AS DOUBLE), {digits})", "i": f"CAST({name} AS BIGINT)",
                "n": f"CAST({name} AS INTEGER)"}.get(kind, name)
        out.append(f"{cast} AS {name}")
    head, sep, tail = body.rpartition("--main")
    return f"{head}\nSELECT {', '.join(out)} FROM ({tail})" if sep else f"SELECT {', '.join(out)} FROM ({body})"


CHURN = """
churn AS (
  SELECT o_custkey AS sid,
         CAST(date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) AS DOUBLE) AS time,
         max(o_orderdate) < TIMESTAMP '2001-05-01' AS event, any_value(c_mktsegment) AS segment,
         first(o_orderpriority ORDER BY o_orderdate, o_orderkey) AS stage, any_value(c_acctbal) AS c_acctbal,
         count(*) AS n_orders, avg(o_totalprice) AS mean_price, min(o_totalprice) AS min_price,
         max(o_totalprice) AS max_price, sum(o_totalprice) AS sum_price, any_value(c_nationkey) AS c_nationkey,
         CAST(date_diff('day', DATE '1995-01-01', CAST(min(o_orderdate) AS DATE)) AS INTEGER) AS start_day
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey)"""

SCORED = CHURN + """,
scored AS (
  SELECT churn.*, round(0.5 * (c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER ()
                        - 0.3 * (mean_price - avg(mean_price) OVER ()) / stddev_pop(mean_price) OVER (), 6) AS eta
  FROM churn)"""

GAP = """
gap AS (
  SELECT event_id AS sid, user_id,
         CAST(floor((epoch_us(coalesce(lead(ts) OVER w, TIMESTAMP '2024-01-31')) - epoch_us(ts)) / 60000000.0) AS DOUBLE) AS time,
         coalesce(lead(event_type) OVER w = 'purchase', false) AS event, event_type AS kind, value,
         CAST(hour(ts) AS INTEGER) AS hour, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
sgap AS (SELECT gap.*, (floor(value / 5) - hour + floor(k / 10)) / 10 AS eta FROM gap)"""


def split_cte(source: str, name: str = "parts", seed: int = 42, fraction: float = 0.8) -> str:
    """Stratified split of a cohort, as a CTE that adds ``is_train``."""
    return f"""
{name}_s AS (
  SELECT *, concat(CAST(event AS INT), '_', CAST(time > (SELECT median(time) FROM {source}) AS INT)) AS s,
         md5(concat(sid, ':{seed}')) AS h FROM {source}),
{name}_n AS (SELECT s, count(*) AS n FROM {name}_s GROUP BY s),
{name}_g AS (SELECT floor({fraction} * sum(n) + 1e-9) AS goal, sum(n) AS total FROM {name}_n),
{name}_e AS (SELECT s, CAST(n * goal AS DOUBLE) / total AS exact, floor(CAST(n * goal AS DOUBLE) / total) AS q, goal
             FROM {name}_n, {name}_g),
{name}_q AS (SELECT s, q + CASE WHEN row_number() OVER (ORDER BY exact - q DESC, s) <= goal - sum(q) OVER () THEN 1 ELSE 0 END AS quota
             FROM {name}_e),
{name} AS (SELECT t.* EXCLUDE (s, h), row_number() OVER (PARTITION BY t.s ORDER BY h) <= quota AS is_train
           FROM {name}_s t JOIN {name}_q USING (s))"""
