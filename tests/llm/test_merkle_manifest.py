import random
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from hazardframe.llm import merkle_manifest as mm
from hazardframe.llm.common import ranked

HEX = lambda *parts: sha256("".join(parts).encode()).hexdigest()


def brute(nodes):
    """Root of a list of digests, and the (left, right) siblings of each on its way up."""
    steps, here = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, k in zip(steps, here):
            sibling = nodes[k ^ 1] if k ^ 1 < len(nodes) else None
            path.append((None, sibling) if k % 2 == 0 else (sibling, None))
        nodes = [HEX(*nodes[k:k + 2]) for k in range(0, len(nodes), 2)]
        here = [k // 2 for k in here]
    return nodes[0], steps


def table(rows):
    """Expected (doc_id, leaf, subroot, root, steps) of rows (doc_id, lang, leaf)."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    out, tops = [], []
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        subroot, steps = brute([r[2] for r in groups[g]])
        tops.append(subroot)
        out += [[r[0], r[2], subroot, s, g] for r, s in zip(groups[g], steps)]
    root, above = brute(tops)
    return sorted(repr((i, leaf, sub, root, s + above[order.index(g)])) for i, leaf, sub, s, g in out)


def found(df):
    text = lambda b: None if b is None else bytes(b).hex()
    return sorted(repr((r.doc_id, r.leaf, r.merkle.subroot, r.merkle.root, [(text(s.left), text(s.right)) for s in r.merkle.steps])) for r in df.collect())


@pytest.mark.parametrize("n, height", [(1, 2), (2, 1), (5, 2), (9, 3), (64, 2), (65, 2), (101, 3), (40, 12)])
def test_frontier_gives_roots_and_witnesses(n, height):
    leaves = [HEX(str(i)) for i in range(n)]
    tall = max(height, (n - 1).bit_length())
    frontier = mm.Frontier(n, tall)
    for leaf in leaves:
        frontier.append(leaf)
    root, top = frontier.close(0)
    assert (root, top) == (brute(leaves)[0], (n - 1).bit_length())
    text = lambda b: b and b.hex()
    assert [[(text(a), text(b)) for a, b in zip(x, y)] for x, y in zip(frontier.left[:, :top], frontier.right[:, :top])] == brute(leaves)[1]


@pytest.mark.parametrize("height", [1, 3, 12])
def test_witnesses_of_groups_of_all_sizes(spark, height):
    rnd = random.Random(height)
    sizes = {None: 9, "": 1, "de": 33, "en": 120, "z": 8, "é": 2, "\U0001f600": 3, "￿": 5}
    rows = [(rnd.choice([None, rnd.randint(-50, 50)]), g, HEX(str(rnd.random()))) for g, n in sizes.items() for _ in range(n)]
    rows += [(7, "de", HEX("same"))] * 4 + [(None, "en", HEX("same"))] * 2
    df = spark.createDataFrame(rows, "doc_id long, lang string, leaf string").repartition(5)
    proven = mm.witnesses(df, height=height)
    assert found(proven) == table(rows)
    assert proven.filter(mm.fold(F.col("leaf"), F.col("merkle.steps")) != F.col("merkle.root")).count() == 0
    assert proven.filter(mm.fold(F.sha2(F.col("leaf"), 256), F.col("merkle.steps")) == F.col("merkle.root")).count() == 0


def test_one_row_and_none(spark):
    one = mm.witnesses(spark.createDataFrame([(None, None, HEX("x"))], "doc_id long, lang string, leaf string")).collect()
    assert len(one) == 1 and one[0].merkle.root == one[0].merkle.subroot == HEX("x") and one[0].merkle.steps == []
    assert mm.witnesses(spark.createDataFrame([], "doc_id long, lang string, leaf string")).collect() == []


def test_columns_with_clashing_names_stay(spark):
    df = spark.createDataFrame([(i, "g", HEX(str(i)), 1, "b", 2, "s", "r", "m") for i in range(6)],
                               "doc_id long, lang string, leaf string, pos int, block string, n int, steps string, root string, merkle string")
    rows = mm.witnesses(df, height=1).collect()
    assert [(r.pos, r.block, r.n, r.steps, r.root) for r in rows] == [(1, "b", 2, "s", "r")] * 6
    assert {r.merkle.root for r in rows} == {brute([HEX(str(i)) for i in range(6)])[0]}


def test_digest_of_nulls_empty_and_long_values(spark):
    df = spark.createDataFrame([(None, None), ("", 0), ("é" * 100_000, -5)], "text string, n long")
    got = [r[0] for r in df.select(mm.digest(F.col("text"), F.col("n"))).collect()]
    assert got == [HEX("--"), HEX("0:1:0"), HEX("200000:", "é" * 100_000, "2:-5")]


def test_ranks_in_groups_that_span_ranges(spark):
    rows = [("a" if i % 3 else "b", None if i % 7 == 0 else i) for i in range(500)]
    got = ranked(spark.createDataFrame(rows, "g string, v int").repartition(7), "g", ["v"]).collect()
    for g in "ab":
        mine = sorted((r for r in got if r.g == g), key=lambda r: r.pos)
        assert [r.pos for r in mine] == list(range(len(mine))) and {r.n for r in mine} == {len(mine)}
        assert [r.v for r in mine] == sorted((v for x, v in rows if x == g), key=lambda v: (v is not None, v))
