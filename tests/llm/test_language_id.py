import random

from pyspark.sql import functions as F

from hazardframe.llm import language_id as li
from hazardframe.llm.queries import QUERIES

WORDS = {"aa": ["lorem", "ipsum", "dolor", "sitam", "amet"], "bb": ["kreko", "zuvok", "prazk", "zzyk", "vokz"], "cc": ["éàü", "ôéè", "àüô", "èéà"]}


def sample(n=60, seed=1):
    rnd = random.Random(seed)
    return [(i, " ".join(rnd.choice(WORDS[x]) for _ in range(20)), x) for i in range(n) for x in [rnd.choice(list(WORDS))]]


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 0.5) for r in rows], "doc_id long, text string, lang string, words string, score double")


def test_known_words_unseen_words_and_edges(spark):
    train = table(spark, sample() + [(900, None, "aa"), (901, "ignored", None), (902, "", "bb")])
    model = li.fit(train)
    assert model.languages == ["aa", "bb", "cc"]
    rows = [(1, "lorem ipsum", None), (2, "zuvokk prazkk", None), (3, "loremipsum doloramet", "bb"), (4, None, "aa"), (5, "", None), (6, "123 --- 4!", None),
            (7, "éàüô", None), (8, "LOREM " * 20000, None), (8, "LOREM " * 20000, None), (9, "x" * 100000, None)]
    got = {r.doc_id: r for r in li.predict(table(spark, rows), model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 7, 8)] == ["aa", "bb", "aa", "cc", "aa"]
    assert all(got[i].lang_pred == "und" and got[i].score == 0.0 for i in (4, 5, 6))
    assert all(0.0 <= r.score <= 1.0 and r.words == "clash" for r in got.values()) and got[9].lang_pred in model.languages


def test_scores_match_a_direct_version(spark):
    model = li.fit(table(spark, sample()), max_words=5)
    scorer = li.Scorer(model)
    for w in ["lorem", "zuvok", "lore", "qqq", "éà"]:
        if w in model.words:
            want = model.word_scores[model.words[w]]
        else:
            found, padded = [], f" {w} "
            for i in range(len(padded) - 1):
                keys = [padded[i:i + n] for n in range(5, 0, -1) if i + n <= len(padded) and padded[i:i + n] in model.grams]
                found += [model.gram_scores[model.grams[keys[0]]]] if keys else []
            want = sum(found) / len(found) if found else model.unseen
        assert abs(scorer.word(w) - want).max() < 1e-12


def test_empty_tables(spark):
    model = li.fit(table(spark, []))
    assert model.languages == [] and li.predict(table(spark, [(1, "words", None)]), model).first().lang_pred == "und"
    assert li.predict(table(spark, []), li.fit(table(spark, sample()))).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op5_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").filter("held_out")
    n, right = got.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 150 and right / n > 0.97


def test_runs_of_letters_count_at_their_whole_length(spark):
    model = li.fit(table(spark, sample()))
    rows = [(1, "lorem" * 13 + "zuvok" * 100, None), (2, "zuvok" * 13 + "lorem" * 4000, None), (3, "lorem" * 13, None)]
    assert {r.doc_id: r.lang_pred for r in li.predict(table(spark, rows), model).collect()} == {1: "bb", 2: "aa", 3: "aa"}
    w = "loremzuvok" * 1000 + "q"
    found, padded = [], f" {w} "
    for i in range(len(padded) - 1):
        keys = [padded[i:i + n] for n in range(5, 0, -1) if i + n <= len(padded) and padded[i:i + n] in model.grams]
        found += [model.gram_scores[model.grams[keys[0]]]] if keys else []
    assert abs(li.Scorer(model).word(w) - sum(found) / len(found)).max() < 1e-9


def test_fit_counts_n_grams_behind_the_64th_letter(spark, monkeypatch):
    rows = [(i, "ab" * 40 + ("xyxyx" if x == "aa" else "zwzwz") * 2000 + "cdefg"[:i % 4 + 1], x) for i, x in enumerate(["aa", "bb"] * 4)]
    model = li.fit(table(spark, rows))
    assert {"xyxyx", "zwzwz"} <= set(model.grams)
    assert [r.lang_pred for r in li.predict(table(spark, [(1, "xyxyxx", None), (2, "zwzwzz", None)]), model).orderBy("doc_id").collect()] == ["aa", "bb"]
    padded = f" {'ab' * 40 + 'xyxyx' * 2000} "
    want = li.Counter(("aa", padded[i:i + n]) for n in range(1, 6) for i in range(len(padded) - n + 1))
    for most in (li.MOST_GRAMS, 3):  # held to the end, or given out in parts
        monkeypatch.setattr(li, "MOST_GRAMS", most)
        got = li.Counter()
        for b in li._counts(iter([li.pa.RecordBatch.from_pydict({"text": [padded], "lang": ["aa"]})]), 10):
            for r in b.filter(li.pc.equal(b["kind"], "gram")).to_pylist():
                got[r["lang"], r["key"]] += r["n"]
        assert got == want
