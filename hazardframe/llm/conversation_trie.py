"""Prefix trie of conversations and sums over its subtrees by centroid decomposition.

A node is a distinct sequence of first turns; the smallest conversation that starts with it owns it, so (owner, depth) names it,
and the nodes of an owner are a chain that ends with its last turn. Sequences are named by sums of hashes of their turns, which
add up over stretches of a conversation, so one of any length is cut into stretches.

Sums over subtrees are rolled up along the parent edges without walking levels. A component is a subtree without the subtrees
that were cut off; its mass is what its nodes' conversations still have to come. The deepest node that has half of the
component's mass below it is its centroid. The total below the centroid is added to every node from the centroid up to the
component's top; then the centroid is taken out, and the parts above and below it, none with more than half of the mass, go on.
Whatever its depth, a tree takes as many rounds as its mass has binary digits. Components of bounded mass are finished side by
side within tasks, by the same rounds over arrays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import StructField, StructType

from hazardframe.llm.common import BLANK, ranked, small_or_not, text_or_empty, written

STRETCH = 4096  # turns of one conversation that a task sums up
MOST = 50_000  # mass of a component that one task finishes
HOT = 10_000  # conversations below a node, above which the joins send it to the executors if that is small
IDS = 10_000  # range of ids that are joined into one string before they are hashed
KEY = ["depth", "a", "b"]


def _halves(digest: Column) -> tuple[Column, Column]:
    """A hexadecimal digest of 32 digits as two numbers below 2 ** 60; sums of them are kept exact as decimals."""
    return tuple(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)") for at in (1, 17))


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, pos, n, turn_md5, words): the turns of each conversation in order, null turn numbers first.

    A null role or text is empty. Turns with one number follow each other by the md5 of role and text; rows without a conv_id
    belong to no conversation. Other columns are left out.
    """
    role, text = text_or_empty("role"), text_or_empty("text")
    words = F.regexp_count(text, F.lit(rf"[^{BLANK}]+")).cast("long")
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("turn_md5"), words.alias("words"))
    return written(ranked(rows, "conv_id", ["turn", "turn_md5"]).select("conv_id", "pos", "n", "turn_md5", "words"))


def rebuilt_turns(turns: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Rows (conv, depth, length, turn_md5, words): conversation c opens with the first turns of conversation c - c % group.

    It takes ``crc32(c) % most`` of them, as many as there are, and goes on with its own turns after that number. Depth 0 is there
    once for every conversation, with no turn.
    """
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    each = written(turns.filter("pos = 0").select("conv_id", "n", taken.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base")))
    sizes = each.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    k = F.least("h", F.coalesce("base_n", F.lit(0)))
    each = written(each.join(sizes, "base", "left").select("conv_id", "n", "h", "base", k.alias("k"), (k + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")))
    opening = turns.filter((F.col("conv_id") % group == 0) & (F.col("pos") < most - 1)).select(F.col("conv_id").alias("base"), "pos", "turn_md5", "words")
    opening = (opening.join(each.filter("k > 0"), "base").filter(F.col("pos") < F.col("k"))
               .select(F.col("conv_id").alias("conv"), (F.col("pos") + 1).alias("depth"), "length", "turn_md5", "words"))
    # A long conversation has one row here for each stretch of it, so that no task joins all of its turns.
    stretch = F.floor(F.col("pos") / STRETCH).alias("stretch")
    per_stretch = each.select("conv_id", "k", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / STRETCH))).alias("stretch"))
    own = (turns.filter(F.col("pos") >= taken).select("*", stretch).join(per_stretch, ["conv_id", "stretch"])
           .select(F.col("conv_id").alias("conv"), (F.col("pos") - taken + F.col("k") + 1).alias("depth"), "length", "turn_md5", "words"))
    start = each.select(F.col("conv_id").alias("conv"), F.lit(0).cast("long").alias("depth"), "length", F.lit(None).cast("string").alias("turn_md5"), F.lit(0).cast("long").alias("words"))
    return opening.unionByName(own).unionByName(start)


def prefixes(rebuilt: DataFrame) -> DataFrame:
    """Add the name of the sequence up to each row (a, b) and that of the sequence before it (up_a, up_b); written."""
    x, y = _halves(F.md5(F.concat_ws(":", "depth", "turn_md5")))
    has = F.col("turn_md5").isNotNull()
    zero = F.lit(0).cast("decimal(38,0)")
    rows = rebuilt.select("conv", "depth", "length", "words", F.floor(F.col("depth") / STRETCH).alias("stretch"),
                          F.when(has, x).otherwise(zero).alias("x"), F.when(has, y).otherwise(zero).alias("y"))
    inside = W.partitionBy("conv", "stretch").orderBy("depth").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = written(rows.withColumns({"a": F.sum("x").over(inside).cast("decimal(38,0)"), "b": F.sum("y").over(inside).cast("decimal(38,0)")}))
    before = W.partitionBy("conv").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    long_ones = rows.filter("length >= %d" % STRETCH).groupBy("conv", "stretch").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    carried = small_or_not(long_ones.select("conv", "stretch", F.sum("x").over(before).alias("u"), F.sum("y").over(before).alias("v")).filter("stretch > 0"))
    later = rows.filter("stretch > 0").join(carried, ["conv", "stretch"])
    later = later.withColumns({"a": (F.col("a") + F.col("u")).cast("decimal(38,0)"), "b": (F.col("b") + F.col("v")).cast("decimal(38,0)")}).drop("u", "v")
    return written(rows.filter("stretch = 0").unionByName(later).select(
        "conv", "depth", "length", "words", "a", "b", (F.col("a") - F.col("x")).cast("decimal(38,0)").alias("up_a"), (F.col("b") - F.col("y")).cast("decimal(38,0)").alias("up_b")))


def _hot_join(many: DataFrame, nodes: DataFrame, on: list[str]) -> DataFrame:
    """Inner join of rows with the nodes that they name: nodes that very many rows name go to the executors, if they are few."""
    hot = small_or_not(nodes.filter(F.col("n_convs") >= HOT))
    cold = nodes.filter(F.col("n_convs") < HOT)
    return many.join(hot.drop("n_convs"), on).unionByName(many.join(cold.drop("n_convs"), on))


def _ends(paths: DataFrame) -> DataFrame:
    """Hash of the ascending ids of the conversations that end at each node (depth, a, b).

    Ids are joined within ranges first, by many tasks; the hash itself has no partial form, so one task reads the joined
    strings of a node one after another.
    """
    ends = paths.filter("depth = length").select(*KEY, "conv", F.floor(F.col("conv") / IDS).alias("chunk"))
    joined = ends.groupBy(*KEY, "chunk").agg(F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))
    rows = joined.select(*KEY, "chunk", "ids").repartition(*KEY).sortWithinPartitions(*KEY, "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for *now, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
                if now != key:
                    if key:
                        out.append((*key, state.hexdigest()))
                    key, state = now, sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 4, kinds)], names=names)
        if key:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((*key, state.hexdigest()), kinds)], names=names)

    names, kinds = [*KEY, "ends_sha256"], [pa.int64(), pa.decimal128(38, 0), pa.decimal128(38, 0), pa.string()]
    return rows.mapInArrow(run, "depth bigint, a decimal(38,0), b decimal(38,0), ends_sha256 string")


def _finish(parts: list[np.ndarray], sums: list[np.ndarray]) -> list[np.ndarray]:
    """Subtree sums within components, all components side by side; parts are (top, own) of each node, see :func:`rollup`.

    Nodes get intervals so that a subtree is a stretch of them: a node starts after its parent and the masses of its earlier
    siblings. Whether a node is below or above a centroid is then a comparison.
    """
    parent, depth, mass, weight = parts
    n = len(parent)
    tops = parent < 0
    place = np.zeros(n, np.int64)
    base = np.concatenate([[0], np.cumsum(mass[tops])])
    place[tops] = base[:-1]
    siblings = np.lexsort((parent, depth))
    siblings = siblings[~tops[siblings]]
    upto = np.cumsum(mass[siblings])
    for level in np.split(np.arange(len(siblings)), np.flatnonzero(np.diff(depth[siblings])) + 1) if len(siblings) else []:
        at = siblings[level]
        first = np.searchsorted(parent[at], parent[at])
        earlier = upto[level] - mass[at]
        place[at] = place[parent[at]] + weight[parent[at]] + earlier - earlier[first]
    order = np.argsort(place)
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    parent, depth, place, whole, left = np.where(parent < 0, -1, back[parent])[order], depth[order], place[order], mass[order], mass[order].copy()
    own, out = [s[order] for s in sums], [np.zeros(n, np.int64) for _ in sums]
    comp = np.maximum.accumulate(np.where(parent < 0, np.arange(n), 0))  # the top of each node
    live = np.arange(n)
    while len(live):
        live = live[np.lexsort((live, comp[live]))]  # components side by side, each in the order of places
        first = np.flatnonzero(np.diff(comp[live], prepend=-1))
        size = np.diff(np.append(first, len(live)))
        total = np.repeat(left[comp[live[first]]], size)
        heavy = np.where(2 * left[live] >= total, depth[live], -1)
        deepest = np.repeat(np.maximum.reduceat(heavy, first), size)
        centroid = np.repeat(live[heavy == deepest], size)  # one in each component: nodes with half of the mass are a path
        below = (place[live] >= place[centroid]) & (place[live] < place[centroid] + whole[centroid])
        above = (place[live] <= place[centroid]) & (place[centroid] < place[live] + whole[live])
        for mine, total_of in zip(own, out):
            gathered = np.repeat(np.add.reduceat(np.where(below, mine[live], 0), first), size)
            total_of[live[above]] += gathered[above]
        left[live[above]] -= left[centroid][above]
        # What lies below a centroid goes on under its children, the last one that starts before a node.
        child = below & (parent[live] == centroid)
        last = np.maximum.accumulate(np.where(child, np.arange(len(live)), 0))
        comp[live] = np.where(below, live[last], comp[live])
        live = live[live != centroid]
    return [o[back] for o in out]


def rollup(nodes: DataFrame, paths: DataFrame, sums: list[str], most: int = MOST) -> DataFrame:
    """Replace each column of ``sums`` by its sum over the node's subtree.

    ``nodes`` has owner, depth, up (the owner of the parent, null for the root), weight (conversations below) and mass (their
    turns still to come, this node's included); ``paths`` has, for every owner and depth on its way from the root, the owner of
    the node there and that of the node before (conv, depth, owner, up). Components of more than ``most`` mass are split by joins.
    """
    root = nodes.filter("up is null").select("owner", "mass").first()
    todo = nodes.withColumns({"top": F.lit(root["owner"]), "top_depth": F.lit(0).cast("long"), "left": F.col("mass"), "total": F.lit(root["mass"]),
                              **{f"sum_{c}": F.lit(0).cast("long") for c in sums}})
    todo = written(todo.withColumns({c: F.col(c).cast("long") for c in ("top", "total")}))
    columns = todo.columns
    small, done = [todo.filter(F.col("total") <= most)], []
    big = todo.filter(F.col("total") > most)
    name = ["top", "top_depth"]
    while not big.isEmpty():
        heavy = F.when(2 * F.col("left") >= F.col("total"), F.col("depth"))
        cents = small_or_not(big.groupBy(*name).agg(F.max_by(F.struct("owner", "depth", "left"), heavy).alias("c"))
                             .select(*name, F.col("c.owner").alias("c_owner"), F.col("c.depth").alias("c_depth"), F.col("c.left").alias("c_left")))
        # The node that a row's way leads through just below the centroid's depth says whether it lies below the centroid, and under which child.
        step = paths.select(F.col("conv").alias("owner"), F.col("depth").alias("at"), F.col("owner").alias("child"), F.col("up").alias("over"))
        placed = big.join(cents, name).withColumn("at", F.least(F.col("c_depth") + 1, "depth")).join(step, ["owner", "at"])
        is_c = (F.col("owner") == F.col("c_owner")) & (F.col("depth") == F.col("c_depth"))
        under = (F.col("depth") > F.col("c_depth")) & (F.col("over") == F.col("c_owner"))
        placed = written(placed.withColumns({"is_c": is_c, "under": under}).drop("at", "over"))
        totals = placed.filter("under or is_c").groupBy(*name).agg(*[F.sum(c).alias(f"add_{c}") for c in sums])
        found = small_or_not(cents.join(totals, name))
        way = paths.select(F.col("conv").alias("c_owner"), "depth", "owner")
        way = (way.join(found, "c_owner").filter((F.col("depth") <= F.col("c_depth")) & (F.col("depth") >= F.col("top_depth")))
               .select("owner", "depth", F.col("c_left").alias("less"), *[f"add_{c}" for c in sums]))
        fresh = placed.join(way, ["owner", "depth"], "left")
        more = {f"sum_{c}": F.col(f"sum_{c}") + F.coalesce(F.col(f"add_{c}"), F.lit(0)) for c in sums}
        fresh = written(fresh.withColumns(more | {"left": F.col("left") - F.coalesce(F.col("less"), F.lit(0))}))
        done.append(fresh.filter("is_c").select(*columns))
        upper = fresh.filter("not under and not is_c").withColumn("total", F.col("total") - F.col("c_left"))
        lower = fresh.filter("under").withColumns({"top": F.col("child"), "top_depth": F.col("c_depth") + 1})
        sizes = lower.filter((F.col("owner") == F.col("top")) & (F.col("depth") == F.col("top_depth"))).select(*name, F.col("left").alias("total"))
        lower = lower.drop("total").join(small_or_not(sizes), name)
        again = written(upper.select(*columns).unionByName(lower.select(*columns)))
        small.append(again.filter(F.col("total") <= most))
        big = again.filter(F.col("total") > most)
    rest = written(_union(small))
    bins = max(1, math.ceil((rest.agg(F.sum("weight")).first()[0] or 0) / most))
    schema = StructType(rest.schema.fields + [StructField("bin", rest.schema["depth"].dataType)])

    def run(rows: pa.Table) -> pa.Table:
        column = lambda c: rows[c].to_numpy().astype(np.int64)
        owner, depth = column("owner"), column("depth")
        at = np.lexsort((owner, depth))
        far = {k: i for i, k in enumerate(zip(owner[at].tolist(), depth[at].tolist()))}
        is_top = (owner == column("top")) & (depth == column("top_depth"))
        up = rows["up"].fill_null(0).to_numpy()
        parent = np.array([-1 if t else at[far[u, d - 1]] for t, u, d in zip(is_top.tolist(), up.tolist(), depth.tolist())], np.int64)
        got = _finish([parent, depth, column("left"), column("weight")], [column(c) for c in sums])
        for c, extra in zip(sums, got):
            i = rows.schema.get_field_index(f"sum_{c}")
            rows = rows.set_column(i, rows.schema.field(i), pa.array(column(f"sum_{c}") + extra))
        return rows

    done.append(rest.withColumn("bin", F.pmod(F.xxhash64(*name), F.lit(bins))).groupBy("bin").applyInArrow(run, schema).drop("bin").select(*columns))
    return _union(done).select(*[c for c in nodes.columns if c not in sums], *[F.col(f"sum_{c}").alias(c) for c in sums])


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def prefix_trie(conversations: DataFrame, most: int = MOST, rebuilt: DataFrame | None = None) -> DataFrame:
    """Nodes of the trie of (role, text) sequences, after every conversation was rebuilt: see :func:`rebuilt_turns`.

    Columns: conv_id (its smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves (childless nodes
    in its subtree), saved_tokens (over its subtree, (n_convs - 1) times the words of the last text), ends_sha256 (of the members that
    end here). Order, nulls and ties: see :func:`turns_in_order`. A repeated row is a turn of its own. An empty table gives no
    nodes. Columns other than conv_id, turn, role and text are left out.
    """
    if rebuilt is None:
        rebuilt = rebuilt_turns(turns_in_order(conversations))
    paths = prefixes(rebuilt)
    turns_left = F.sum("length") - F.count(F.lit(1)) * F.col("depth") + F.count(F.lit(1))
    named = written(paths.groupBy(*KEY).agg(
        F.min("conv").alias("owner"), F.count(F.lit(1)).alias("n_convs"), turns_left.alias("mass"), F.max("words").alias("words"),
        F.max("length").alias("longest"), F.max("up_a").alias("up_a"), F.max("up_b").alias("up_b")))
    parents = named.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("owner").alias("up"), "n_convs")
    children = named.filter("depth > 0").select(*KEY, "up_a", "up_b", "owner")
    edges = written(_hot_join(children, parents, ["depth", "up_a", "up_b"]).select(*KEY, "owner", "up"))
    n_children = edges.groupBy(F.col("up").alias("owner"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = named.join(edges.select("owner", "depth", "up"), ["owner", "depth"], "left").join(n_children, ["owner", "depth"], "left")
    nodes = written(nodes.select(*KEY, "owner", "up", "n_convs", "mass", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
                                 (F.col("longest") == F.col("depth")).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")))
    if nodes.isEmpty():
        return nodes.select(F.col("owner").alias("conv_id"), "depth", F.col("up").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.lit("").alias("ends_sha256"))
    ways = written(_hot_join(paths.select("conv", *KEY), nodes.select(*KEY, "owner", "up", "n_convs"), KEY).select("conv", "depth", "owner", "up"))
    summed = rollup(nodes.select("owner", "depth", "up", F.col("n_convs").alias("weight"), "mass", "n_children", "n_leaves", "saved_tokens"),
                    ways, ["n_leaves", "saved_tokens"], most)
    ends = nodes.select(*KEY, "owner").join(_ends(paths), KEY).select("owner", "depth", "ends_sha256")
    return summed.join(ends, ["owner", "depth"], "left").select(
        F.col("owner").alias("conv_id"), "depth", F.col("up").alias("parent_conv_id"), F.col("weight").alias("n_convs"), "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
