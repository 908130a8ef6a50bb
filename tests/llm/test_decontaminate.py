import random
import re

import pytest

from hazardframe.llm import decontaminate as dc


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        m = min(10, len(w))
        for k in range(len(w) - m + 1 if w else 0):
            windows.setdefault(tuple(w[k:k + m]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                if (g := tuple(w[k:k + m])) in windows:
                    hit.update(range(k, k + m))
                    found |= windows[g]
        out.append((i, len(w), len(hit), sorted(str(x) for x in found if x is not None), bool(hit)))
    return out


def check(spark, rows, items, low=None):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_hit long, item string")
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, class string")
    got = [(r.doc_id, r.n_words, r.n_hit, r.items, r.contaminated) for r in dc.contamination(docs, bench).collect()]
    order = lambda r: (r[0] is not None, r[0] or 0, *map(str, r[1:]))
    want = brute(rows, items)
    assert sorted(got, key=order) == sorted(want, key=order)
    kept = dc.decontaminate(docs, bench).collect()
    assert len(kept) == sum(not w[4] for w in want) and all(r.item == "x" for r in kept)


def cases():
    rnd = random.Random(1)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([10, 11, 14, 30, 60])))) for i in range(25)]
    items += [(100, items[0][1].upper()), (101, items[0][1]), (102, "É été, Noël!"), (103, "one"), (104, None), (105, " ,;"), (106, "a " * 40), (None, items[1][1])]
    rows = []
    for i in range(120):
        own = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 60))]
        if i % 3 == 0:
            w = words(rnd.choice(items[:25])[1])
            n = rnd.choice([9, 10, 12, len(w)])
            k = rnd.randint(0, max(0, len(w) - n))
            at = rnd.randint(0, len(own))
            own[at:at] = w[k:k + n]
        rows.append((i, " ".join(own)))
    return rows, items


def test_matches_a_brute_force_version(spark):
    rows, items = cases()
    extra = [(1, None), (2, ""), (None, items[0][1]), (7, items[0][1]), (7, items[0][1]), (500, "a " * 300), (501, "ÉTÉ été noël É été noël one"),
             (502, "It. was! one-of " + items[3][1].replace(" ", ", ") + " " + items[3][1])]
    check(spark, rows + extra, items)


def test_without_short_items_and_with_shuffled_joins(spark, monkeypatch):
    rows, items = cases()
    monkeypatch.setattr(dc, "small_or_not", lambda df: dc.written(df))
    check(spark, rows, items[:25])


@pytest.mark.parametrize("items", [[], [(1, None)]])
def test_empty_benchmark(spark, items):
    check(spark, [(1, "some words here"), (2, None)], items)


def test_empty_documents(spark):
    check(spark, [], [(1, "one two three")])
