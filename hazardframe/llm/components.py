"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hazardframe.llm.common import written

ROWS_PER_FILE = 20_000


def _state(edges: DataFrame) -> tuple[int, int]:
    """The number of links, and of nodes that keep them from being stars around smallest nodes: a node with two
    smaller neighbours, or with a smaller and a larger one."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("v", F.lit(0), F.lit(1)))
    each = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    r = each.agg(F.sum("up").alias("n"), F.count_if((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("down") == 1))).alias("bad")).collect()[0]
    return r["n"] or 0, r["bad"]


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of a link, ``root`` the smallest node of its component.

    Each round ties all larger neighbours of a node to its smallest one, then the node and its smaller neighbours to the
    smallest; the number of rounds grows with the logarithm of the longest path. Minima are aggregated before they are
    shuffled and met again by equi-joins, so a node with very many links is no group in one task. Every round is written.
    """
    edges = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    for _ in range(most_rounds):
        n, bad = _state(edges)
        if not bad:
            break
        files = -(-n // ROWS_PER_FILE)  # links get fewer or stay as many; few links need no more files than this
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.select("u", F.col("m").alias("v"))).distinct())
        edges = written(small.coalesce(files))
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
