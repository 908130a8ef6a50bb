import random
import re

import numpy as np
import pytest

from hazardframe.llm import jaccard_join as jj
from hazardframe.llm.components import components


def shingles(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= 80 * len(x | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        r = find(i)
        least[r] = min((x for x in (least.get(r), k) if x is not None), default=None)
    return [(k, len(sets[i]), least[find(i)]) for i, (k, _) in enumerate(rows)]


def order(r):
    return tuple((x is not None, x or 0) for x in r)


def check(docs, rows):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jj.similar_components(docs(rows)).collect()]
    assert sorted(got, key=order) == sorted(brute(rows), key=order)


def corpus(seed, n=120):
    rnd = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(300)]
    line = [rnd.choice(vocabulary) for _ in range(60)]
    texts = []
    for _ in range(n):
        kind = rnd.random()
        if kind < 0.45 and texts:
            w = rnd.choice(texts).split()
            for _ in range(rnd.randint(0, max(1, len(w) // 25))):
                if w:
                    w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            texts.append(" ".join(w))
        elif kind < 0.7:
            own = [rnd.choice(vocabulary) for _ in range(rnd.choice([0, 3, 8, 15, 100]))]
            texts.append(" ".join(own + line))  # one passage in many documents
        else:
            texts.append(" ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([1, 2, 4, 5, 6, 9, 30, 120]))))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_a_brute_force_version(docs, seed):
    texts = corpus(seed)
    check(docs, [(i * 3, t) for i, t in enumerate(texts)] + [(1, None), (2, ""), (4, " \n"), (5, texts[0].upper()), (None, texts[1]), (None, "alone here"), (7, texts[2]), (7, texts[2])])


def test_large_families_and_small_frequency_limit(docs, monkeypatch):
    """With a frequency limit of 2 nearly everything is indexed by pairs."""
    monkeypatch.setattr(jj, "FREQUENT", 2)
    check(docs, list(enumerate(corpus(5, 150))))


def test_families_compared_in_small_blocks(docs, monkeypatch):
    """One pivot and tiny blocks, so that most links are found by the full comparison."""
    monkeypatch.setattr(jj, "PIVOTS", 1)
    monkeypatch.setattr(jj, "OUTSIDERS", 2)
    monkeypatch.setattr(jj, "OTHERS", 3)
    rnd = random.Random(9)
    base = [f"v{rnd.randrange(300)}" for _ in range(80)]
    texts = []
    for _ in range(90):  # around the threshold of similarity to each other
        w = list(base)
        for _ in range(rnd.randint(1, 3)):
            w[rnd.randrange(len(w))] = f"n{rnd.randrange(10**6)}"
        texts.append(" ".join(w))
    check(docs, list(enumerate(texts)))


@pytest.mark.parametrize("own", [8, 7])
def test_a_shared_passage_with_words_of_their_own(docs, own):
    """Just below and just above the threshold with each other; a few also share more, or are the passage alone."""
    line = [f"line{i}" for i in range(60)]
    texts = [" ".join([f"w{d}x{i}" for i in range(own)] + line) for d in range(70)]
    texts += [" ".join([f"s{d // 3}x{i}" for i in range(9)] + [f"e{d}"] * (d % 4) + line + [f"t{d % 5}"] * 6) for d in range(40)]
    check(docs, list(enumerate(texts)))
    check(docs, list(enumerate([*texts, " ".join(line), " ".join(line[:50])])))


def test_comparisons_of_a_shared_passage_grow_with_the_documents(docs, monkeypatch):
    """The rows that the full comparison deals out, and the pairs it looks at, are linear in the documents."""
    seen = {}

    def sides(outside, nodes, percent, real=jj._sides):
        left, right = real(outside, nodes, percent)
        group = ["pool", "heads", "band"]
        pairs = left.groupBy(*group).count().join(right.groupBy(*group).count().withColumnRenamed("count", "m"), group)
        seen["pairs"] = sum(r["count"] * r["m"] for r in pairs.collect())
        return left, right

    monkeypatch.setattr(jj, "_sides", sides)
    line = " ".join(f"line{i}" for i in range(60))
    for n in (200, 800):
        rows = [(d, " ".join(f"w{d}x{i}" for i in range(8)) + " " + line) for d in range(n)]
        got = jj.similar_components(docs(rows)).collect()
        assert all(r.doc_id == r.component_id for r in got) and len(got) == n
        assert seen["pairs"] <= 4 * n


def test_full_class_maps_lose_nothing(docs, monkeypatch):
    monkeypatch.setattr(jj, "MAX_BITS", 16)
    monkeypatch.setattr(jj, "class_maps", lambda d, t, n: (np.full(1 << 13, 255, np.uint8), np.full(1 << 13, 255, np.uint8), 16))
    check(docs, list(enumerate(corpus(6, 100))))


def test_signatures_meet_for_every_linked_pair():
    """Over random pairs at the threshold and random classes."""
    rng = np.random.default_rng(3)
    bits = 16
    for trial in range(400):
        shared, frequent = (rng.integers(0, 256, 1 << 13, dtype=np.uint8) for _ in range(2))
        if trial % 2:
            frequent |= rng.integers(0, 256, 1 << 13, dtype=np.uint8) | rng.integers(0, 256, 1 << 13, dtype=np.uint8)
        n = int(rng.integers(1, 120))
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) << np.uint64(1))
        gone, new = rng.integers(0, max(1, len(x) // 8 + 1)), rng.integers(0, max(1, len(x) // 8 + 1))
        y = np.unique(np.concatenate([rng.permutation(x)[gone:], rng.integers(0, 2**63, new, dtype=np.uint64)]))
        both = np.intersect1d(x, y)
        if not len(both) or 100 * len(both) < 80 * len(np.union1d(x, y)):
            continue
        place = both >> np.uint64(64 - bits)
        np.bitwise_or.at(shared, (place >> np.uint64(3)).astype(int), (np.uint8(128) >> (place & np.uint64(7)).astype(np.uint8)))
        assert len(np.intersect1d(jj.signatures(x, shared, frequent, 80), jj.signatures(y, shared, frequent, 80)))


def test_one_of_each(docs):
    texts = corpus(8, 80)
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (200, None), (201, None), (None, "quite alone in here we are")]
    kept = jj.one_of_each(docs(rows)).collect()
    want = {(k, c) for k, _, c in brute(rows) if k == c}
    assert sorted([r.doc_id for r in kept], key=lambda x: (x is not None, x or 0)) == sorted([k for k, _ in want], key=lambda x: (x is not None, x or 0))
    assert all(r.quality == "x" for r in kept)


def test_empty_and_wordless_tables(docs):
    check(docs, [])
    check(docs, [(1, None), (2, "")])


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)] + [(200, 201), (201, 200), (300, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{k: 100 for k in range(100, 160)}, 200: 200, 201: 200}
