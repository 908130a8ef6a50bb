"""Merkle manifest of a table: a root that commits to every row, and for every row the siblings that lead to it.

Leaves are appended in order to a frontier of open subtrees of falling height. Each open subtree keeps the witnesses of its leaves
as far as they go; when its sibling is complete, both sides are extended by the other's digest and become one subtree. At
the end the last subtree climbs alone, as its own hash, until it meets the one before it. The stream is cut into aligned blocks of
``2 ** height`` leaves, each appended by a task of its own; block roots are appended in the same way one storey higher, until a
group has one root, and the roots of the groups are appended once more. Witnesses of a row are those of its storeys in a row.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from hazardframe.llm.common import ranked, small_or_not, written

HEIGHT = 12  # a block has 4,096 leaves
STEPS = "array<struct<left: binary, right: binary>>"


def digest(*columns: Column) -> Column:
    """Leaf of a row: the hash over all ``columns``, each as ``-`` if null, else its UTF-8 byte count, a colon and its value."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


class Frontier:
    """Open subtrees of a stream of at most ``most`` leaves, with the witnesses of all leaves so far."""

    def __init__(self, most: int, height: int):
        self.left, self.right = (np.full((most, height), None, object) for _ in range(2))
        self.open: list[tuple[int, int, int, str]] = []  # height, first leaf, leaf after the last, digest
        self.n = 0

    def append(self, leaf: str) -> None:
        node = (0, self.n, self.n + 1, leaf)
        self.n += 1
        while self.open and self.open[-1][0] == node[0]:
            node = self._joined(self.open.pop(), node)
        self.open.append(node)

    def _joined(self, a: tuple[int, int, int, str], b: tuple[int, int, int, str]) -> tuple[int, int, int, str]:
        """The subtree over two siblings; the leaves of each get the other's digest as their next witness."""
        height = a[0]
        self.right[a[1]:a[2], height] = bytes.fromhex(b[3])
        self.left[b[1]:b[2], height] = bytes.fromhex(a[3])
        return height + 1, a[1], b[2], sha256((a[3] + b[3]).encode()).hexdigest()

    def close(self, least: int) -> tuple[str, int]:
        """Root of all leaves and its height, which is ``least`` at least: subtrees without a sibling climb alone."""
        node = self.open.pop()
        while self.open or node[0] < least:
            if self.open and self.open[-1][0] == node[0]:
                node = self._joined(self.open.pop(), node)
            else:
                node = (node[0] + 1, *node[1:3], sha256(node[3].encode()).hexdigest())
        return node[3], node[0]


def _storey(nodes: DataFrame, height: int) -> DataFrame:
    """Append the nodes of each block; adds ``steps`` up to the block's root, and that root on the block's first row."""
    schema = StructType(nodes.schema.fields + [StructField("steps", StructType.fromDDL(f"s {STEPS}")["s"].dataType), StructField("root", StringType())])

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("pos")
        frontier = Frontier(block.num_rows, height)
        for leaf in block["node"].to_pylist():
            frontier.append(leaf)
        root, tall = frontier.close(height if block["n"][0].as_py() > 1 << height else 0)
        left, right = (pa.array(side[:, :tall].ravel(), pa.binary()) for side in (frontier.left, frontier.right))
        cuts = pa.array(np.arange(block.num_rows + 1) * tall, pa.int32())
        steps = pa.ListArray.from_arrays(cuts, pa.StructArray.from_arrays([left, right], names=["left", "right"]))
        return block.append_column("steps", steps).append_column("root", pa.array([root] + [None] * (block.num_rows - 1), pa.string()))

    return written(nodes.groupBy("group", "block").applyInArrow(run, schema))


def _climb(nodes: DataFrame, height: int) -> DataFrame:
    """Add the steps of each node (group, pos, n, node) to the root of its group, and that root."""
    nodes = nodes.withColumn("block", F.floor(F.col("pos") / (1 << height)).cast(LongType()))
    most = nodes.agg(F.max("n")).first()[0] or 0
    done = _storey(nodes, height)
    blocks = done.filter("root is not null").select("group", F.col("block").alias("pos"), F.ceil(F.col("n") / (1 << height)).alias("n"), F.col("root").alias("node"))
    alone = blocks.filter("n = 1").select("group", "pos", F.array().cast(STEPS).alias("further"), F.col("node").alias("top"))
    if most > 1 << height:
        more = _climb(blocks.filter("n > 1"), height)
        alone = alone.unionByName(more.select("group", "pos", F.col("steps").alias("further"), F.col("root").alias("top")))
    above = small_or_not(alone.withColumnRenamed("pos", "block"))
    return (done.drop("root").join(above, ["group", "block"])
            .withColumn("steps", F.concat("steps", "further")).withColumnRenamed("top", "root").drop("block", "further"))


def witnesses(rows: DataFrame, leaf: str = "leaf", group: str = "lang", order: str = "doc_id", into: str = "merkle", height: int = HEIGHT) -> DataFrame:
    """Add the struct ``into`` (steps, subroot, root) to every row of a table whose column ``leaf`` holds hashes as lowercase hex.

    In a group, rows ascend by ``order``; null comes first, rows that share a value follow each other by their leaves, and equal
    rows take any order. Two consecutive nodes become their hash, a last one without a neighbour its own, until one remains: the
    subroot (a lone leaf itself). Subroots, ordered by the bytes of the group's string and null first, give the root in the same way. ``steps``
    leads from the leaf to the root: the digests left and right of a node, both null where it climbs alone. The leaf must not be null.
    An empty table gives no rows; all other columns stay, one named ``into`` is replaced.

    Rows are range-partitioned, so a group may hold any share of them; a task appends one block at a time. Storeys are written, so
    a lost executor costs the blocks that it held.
    """
    kept = [c for c in rows.columns if c != into]
    name = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    packed = rows.select(F.struct(*kept).alias("row"), name.alias("group"), F.col(order).alias("order"), F.col(leaf).alias("node"))
    leaves = _climb(ranked(packed, "group", ["order", "node"]).drop("order"), height)
    leaves = leaves.select("row", "group", "steps", F.col("root").alias("subroot"))
    tops = written(leaves.groupBy("group").agg(F.first("subroot").alias("node")))
    whole = _climb(ranked(tops.select(F.lit("").alias("all"), "group", "node"), "all", ["group"])
                   .select(F.col("all").alias("group"), "pos", "n", "node", F.col("group").alias("of")), height)
    above = small_or_not(whole.select(F.col("of").alias("group"), F.col("steps").alias("further"), "root"))
    merkle = F.struct(F.concat("steps", "further").alias("steps"), "subroot", "root")
    return leaves.join(above, "group").select("row.*", merkle.alias(into))


def _hex(side: Column) -> Column:
    return F.coalesce(F.lower(F.hex(side)), F.lit(""))


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf leads to by its steps: equal to the table's root only if the leaf is the one that was appended."""
    return F.aggregate(steps, leaf, lambda node, s: F.sha2(F.concat(_hex(s["left"]), node, _hex(s["right"])), 256))


def proof_digest(steps: Column) -> Column:
    """Hash over all siblings, from the leaf's to those below the root."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(_hex(s["left"]), _hex(s["right"]))), ""), 256)
