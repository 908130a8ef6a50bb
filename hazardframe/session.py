"""Session helpers: the shared checkpoint folder and lineage cuts."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by ``spark.checkpoint.dir``; only a local session may fall back to a scratch one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local($|\[)", sc.master):  # local-cluster has executors of its own
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        named = tempfile.mkdtemp(prefix="hazardframe-")
    sc.setCheckpointDir(named)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and continue from the written copy.

    Used where a small aggregate feeds several later steps, and inside loops: an executor lost later
    costs a re-read and not a second pass over the raw table.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settle(df: DataFrame) -> tuple[DataFrame, int]:
    """:func:`cut_lineage` that also counts the rows while they are written."""
    ensure_checkpoint_dir(df.sparkSession)
    seen = Observation()
    written = df.observe(seen, F.count(F.lit(1)).alias("n")).checkpoint(eager=True)
    return written, seen.get["n"]
