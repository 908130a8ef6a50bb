import random
import re
import zlib
from collections import defaultdict
from hashlib import md5, sha256

import numpy as np
import pytest
from conftest import SF

from hazardframe.llm import conversation_trie as ct
from hazardframe.llm import queries


def brute(rows):
    """Nodes of rows (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0), tie, (role, text)))
    own = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    members = defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        whole = own.get(base, [])[:h] + turns[h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append((c, d == len(whole)))
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = {}
    for node in sorted(members, key=len, reverse=True):
        ids = sorted(c for c, _ in members[node])
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        below = [out[x] for x in children[node]]
        ends = ",".join(str(c) for c in sorted(c for c, end in members[node] if end))
        out[node] = [ids[0], len(node), min(c for c, _ in members[node[:-1]]) if node else None, len(ids), len(below),
                     sum(b[5] for b in below) or 1, (len(ids) - 1) * words + sum(b[6] for b in below), sha256(ends.encode()).hexdigest()]
    return sorted(map(repr, map(tuple, out.values())))


SCHEMA = "conv_id long, turn long, role string, text string"


def nodes(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def some_rows(n=120, seed=1, most=7):
    """Conversations that share openings, with nulls, ties, repeated rows, gaps in the ids and negative ids."""
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(-40, 3 * n), n):
        for t in range(rnd.randint(1, most)):
            rows.append((c, rnd.choice([t, t, t, t, None, 3]), rnd.choice(["user", "user", "user", None]), rnd.choice(["hi there", "hi there", "hi  there you", "", None, "ok\tthen"])))
    rows += [rows[5], rows[6], (None, 0, "user", "of nobody"), (100_000, None, None, None)]
    return rows


@pytest.mark.parametrize("most", [5, 60, 100_000])
def test_nodes_are_those_of_brute_force(spark, most):
    rows = some_rows(seed=most)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert nodes(ct.prefix_trie(df, most=most)) == brute(rows)


def test_a_long_chain_and_a_hot_opening(spark, monkeypatch):
    monkeypatch.setattr(ct, "STRETCH", 8)
    monkeypatch.setattr(ct, "HOT", 20)
    monkeypatch.setattr(ct, "IDS", 16)
    rows = [(20, t, "user", f"turn {t}") for t in range(70)] + [(40, t, "user", f"turn {t}" if t < 60 else "else") for t in range(66)]
    rows += [(c, t, "user", "hello" if t == 0 else f"{c // 7}") for c in range(100, 220) for t in range(3)]
    assert nodes(ct.prefix_trie(spark.createDataFrame(rows, SCHEMA), most=30)) == brute(rows)


def test_copies_of_one_conversation(spark):
    rows = [(c * 20, t, "user", f"word {t}") for c in range(50) for t in range(5)]
    got = ct.prefix_trie(spark.createDataFrame(rows, SCHEMA), most=40)
    assert got.count() == 6 and nodes(got) == brute(rows)


def test_empty_table_and_other_columns(spark):
    assert ct.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = some_rows(20, 9)
    wide = spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], SCHEMA + ", depth int, owner string, n int, a string")
    assert nodes(ct.prefix_trie(wide)) == brute(rows)


def test_sums_of_a_random_forest_by_centroids():
    rnd = np.random.default_rng(4)
    for n in (1, 2, 50, 400):
        parent = np.array([-1 if i == 0 or rnd.random() < 0.05 else rnd.integers(max(0, i - 9), i) for i in range(n)])
        depth, weight, value = np.zeros(n, np.int64), rnd.integers(1, 9, n), rnd.integers(-5, 50, n)
        for i in range(n):
            depth[i] = 0 if parent[i] < 0 else depth[parent[i]] + 1
        mass, want = weight.copy(), value.copy()
        for i in range(n - 1, 0, -1):
            if parent[i] >= 0:
                mass[parent[i]] += mass[i]
                want[parent[i]] += want[i]
        assert ct._finish([parent, depth, mass, weight], [value])[0].tolist() == want.tolist()


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert nodes(queries.op12_conversation_trie(spark, SF)) == brute(rows)
