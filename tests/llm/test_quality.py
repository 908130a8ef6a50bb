import re

from hazardframe.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    words = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    many = {g for g in grams if grams.count(g) > 1}
    covered = {i + k for i, g in enumerate(grams) if g in many for k in range(5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed)


def rows_of(docs, texts, **options):
    out = quality.line_first_cleaning(docs(list(enumerate(texts))), **options).orderBy("doc_id").collect()
    return [r.quality for r in out], out


PROSE = "The small boat came back to the harbour late and nobody had seen where it went that day.\n"
TEXTS = [None, "", " \n\t ", "one", "a b c d e a b c d e f g h i j", PROSE, PROSE * 3, "x y\x0bz été \U0001f600 " * 4, "a " * 3000,
         "same line here\nsame line here\n\nsame line here \n", " ".join(f"w{i % 700}" for i in range(3000)), "a\x1cb   c"]


def test_counts_match_a_brute_force_version(docs):
    got, rows = rows_of(docs, TEXTS)
    for text, q in zip(TEXTS, got):
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words, q.base_failed) == brute(text), text
    assert all(r.url_rule == "x" and r.n == 1 for r in rows)  # other columns pass, the one named like the result is replaced


def test_noise_is_rejected_and_clean_text_kept(docs):
    clean = PROSE + "It was only the next morning that somebody asked.\nAll rights reserved."
    noise = ["Home | About | News | Contact | Shop | Help | Login | Cart | Terms | Jobs", "BUY!! NOW!! THE!! BEST!! OF!! ALL!! OFFERS!! HERE!! TODAY!! ONLY!!",
             "this### is*** not%%% at$$$ all&&& clean### prose*** but%%% some$$$ junk&&& here###"]
    got, _ = rows_of(docs, [clean, *noise, clean + "\n" + noise[0]])
    assert [q.kept for q in got] == [True, False, False, False, True]
    assert not any(q.base_failed for q in got)
    assert got[0].clean_text == clean.rsplit("\n", 1)[0] and got[4].clean_text == clean.rsplit("\n", 1)[0]


def test_repeated_rows_and_empty_table(docs, spark):
    got, _ = rows_of(docs, [PROSE] * 5)
    assert len(got) == 5 and len(set(got)) == 1
    assert quality.line_first_cleaning(docs([])).count() == 0


def test_the_verdict_alone_is_that_of_the_whole_struct(spark, docs):
    texts = [None, "", "a " * 30, "one two three four five six seven eight nine ten", "Read more\n" * 4 + "w " * 3, "! ! !\n" + " ".join(f"w{i}" for i in range(40))]
    sf = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for df in (docs(list(enumerate(texts))), sf):
        judged = quality.line_first_cleaning(df).withColumn("alone", quality.passes())
        assert judged.filter("not (alone <=> quality.kept)").count() == 0
