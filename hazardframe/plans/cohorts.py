"""Cohorts derived from the order, customer, event and embedding tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

CHURN_FEATURES = ["c_acctbal", "n_orders", "mean_price", "min_price", "max_price", "sum_price", "c_nationkey",
                  "start_day"]
PRIORITY_CODES = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3, "4-NOT SPECIFIED": 4}
CUBE = 4  # voxels per side of a cube cut from one embedding


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer with an order; the event is a last order before 2001-05-01."""
    o = table(spark, sf_dir, "orders")
    first = F.struct("o_orderdate", "o_orderkey")
    per = o.groupBy(F.col("o_custkey").alias("sid")).agg(
        F.min("o_orderdate").alias("__a"), F.max("o_orderdate").alias("__z"), F.min_by("o_orderpriority", first).alias("stage"),
        F.count("*").alias("n_orders"), F.avg("o_totalprice").alias("mean_price"), F.min("o_totalprice").alias("min_price"),
        F.max("o_totalprice").alias("max_price"), F.sum("o_totalprice").alias("sum_price"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment")
    return per.join(c, per.sid == c.c_custkey).select(
        "sid", F.datediff("__z", "__a").cast("double").alias("time"),
        (F.col("__z") < F.lit("2001-05-01").cast("timestamp")).alias("event"), F.col("c_mktsegment").alias("segment"),
        "stage", "c_acctbal", "n_orders", "mean_price", "min_price", "max_price", "sum_price", "c_nationkey",
        F.datediff("__a", F.lit("1995-01-01").cast("date")).alias("start_day"))


def scored_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Churn with a fixed linear risk score of two standardised columns."""
    d = churn(spark, sf_dir)
    m = d.agg(F.avg("c_acctbal").alias("m1"), F.stddev_pop("c_acctbal").alias("s1"), F.avg("mean_price").alias("m2"),
              F.stddev_pop("mean_price").alias("s2")).first()  # four numbers
    eta = 0.5 * (F.col("c_acctbal") - m.m1) / m.s1 - 0.3 * (F.col("mean_price") - m.m2) / m.s2
    return d.withColumn("eta", F.round(eta, 6))


def event_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: whole minutes to the user's next event, observed when that event is a purchase.

    The next event is looked for inside the (user, hour) slot and then in the user's next slot, so that a user
    with very many events is spread over many tasks.
    """
    e = table(spark, sf_dir, "events").withColumn("slot", F.date_trunc("hour", "ts"))
    inside = W.partitionBy("user_id", "slot").orderBy("ts", "event_id")
    heads = e.groupBy("user_id", "slot").agg(F.min(F.struct("ts", "event_id", "event_type")).alias("head"))
    following = heads.select("user_id", "slot",
                             F.lead("head").over(W.partitionBy("user_id").orderBy("slot")).alias("later"))
    near = F.lead(F.struct("ts", "event_id", "event_type")).over(inside)
    e = e.withColumn("near", near).join(following, ["user_id", "slot"]).withColumn("next", F.coalesce("near", "later"))
    end = F.coalesce(F.col("next.ts"), F.lit("2024-01-31").cast("timestamp"))
    return e.select(
        F.col("event_id").alias("sid"), "user_id",
        F.floor((F.unix_micros(end) - F.unix_micros(F.col("ts").cast("timestamp"))) / 60_000_000).cast("double").alias("time"),
        F.coalesce(F.col("next.event_type") == "purchase", F.lit(False)).alias("event"),
        F.col("event_type").alias("kind"), "value", F.hour("ts").alias("hour"),
        F.get_json_object("props", "$.k").cast("int").alias("k"))


def scored_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event gaps with a fixed coarse risk score, in which ties are frequent."""
    return event_gap(spark, sf_dir).withColumn(
        "eta", (F.floor(F.col("value") / 5) - F.col("hour") + F.floor(F.col("k") / 10)) / 10)


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cubes of 4x4x4 voxels, one per embedding, in long form."""
    e = table(spark, sf_dir, "embeddings")
    p = F.col("p")
    intensity = F.round(F.col("v").cast("double") * 1000).cast("double")
    return e.select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("p", "v")).select(
        "image_id", F.floor(p / (CUBE * CUBE)).cast("int").alias("z"), (F.floor(p / CUBE) % CUBE).cast("int").alias("y"),
        (p % CUBE).cast("int").alias("x"), intensity.alias("intensity"),
        F.when(intensity > -100, 1).otherwise(0).alias("mask"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders read as an image series manifest."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("subject"), F.col("o_orderpriority").alias("modality"), F.col("o_orderkey").alias("series"))
