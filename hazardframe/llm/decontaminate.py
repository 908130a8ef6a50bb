"""Benchmark decontamination by winnowing: shared fingerprints are found by a join and extended to whole shared windows.

Both sides keep, of every stretch of SPAN words, the smallest hash of its K-grams. Equal stretches keep equal hashes, so
every shared span of SPAN words is found; what the fingerprints find is then compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hazardframe.llm.common import ascii_lower, let, small_or_not, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # fixed value
SPAN = 10  # words of a window
K = 5  # words of a gram; SPAN - K + 1 neighbouring grams make a stretch


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(WORD), F.lit(0))


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _stretches(hashes: Column) -> Column:
    """The fingerprint of the stretch at each place: the smallest gram hash in it; empty for fewer than SPAN words."""
    n = F.size(hashes)
    grams = F.transform(F.sequence(F.lit(0), n - K), lambda i: F.xxhash64(*[hashes[i + j] for j in range(K)]))
    least = let(grams, lambda g: F.transform(F.sequence(F.lit(0), n - SPAN), lambda i: F.least(*[g[i + j] for j in range(SPAN - K + 1)])))
    return F.when(n >= SPAN, least).otherwise(F.array().cast("array<bigint>"))


def _short(hashes: Column, m: int) -> Column:
    """Hashes of all m-grams, for items of m < SPAN words, which no stretch of SPAN words can find."""
    n = F.size(hashes)
    return F.when(n >= m, F.transform(F.sequence(F.lit(0), n - m), lambda i: F.xxhash64(F.lit(m), *[hashes[i + j] for j in range(m)]))
                  ).otherwise(F.array().cast("array<bigint>"))


def _fingerprints(hashes: Column, lengths: list[int]) -> Column:
    return F.array_distinct(F.concat(_stretches(hashes), *[_short(hashes, m) for m in lengths]))


def _windows(words: Column, hashes: Column, lengths: list[int], wanted: Column | None) -> Column:
    """Windows as (start, words, text); with ``wanted``, only those whose fingerprint is one of these."""
    def of(marks: Column, m: int) -> Column:
        placed = F.transform(marks, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        if wanted is not None:
            placed = F.filter(placed, lambda p: F.array_contains(wanted, p["h"]))
        return F.transform(placed, lambda p: F.struct(p["i"].alias("start"), F.lit(m).alias("words"), F.array_join(F.slice(words, p["i"] + 1, m), " ").alias("text")))
    return F.concat(of(_stretches(hashes), SPAN), *[of(_short(hashes, m), m) for m in lengths])


def contamination(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                  item_text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, text_hash, n_words, n_hit, spans, items, contaminated.

    A window is SPAN consecutive words of an item, or the whole item if it is shorter but not empty. ``spans`` are the
    stretches of document words (start, end, end exclusive) inside occurrences of windows, ``n_hit`` their words, ``items``
    the sorted ids, as strings, of items with an occurring window. Null and empty texts have no words and no hits;
    repeated rows get equal rows; an empty benchmark hits nothing. Null item ids are left out of ``items``.

    The texts are read once for the fingerprints, which are written. The benchmark's side of each join is broadcast only
    if it is small; Spark can split the documents' side of either join where one passage is in very many documents. Items
    with equal words are one class until the end, and a document's windows meet a class once for each distinct window.
    """
    items = written(bench.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(item_text)).alias("w"))
                    .filter(F.size("w") > 0).withColumn("class", F.sha2(F.array_join("w", " "), 256)))
    classes = items.groupBy("class").agg(F.first("w").alias("w"))
    lengths = sorted(r[0] for r in items.select(F.least(F.size("w"), F.lit(SPAN)).alias("m")).distinct().collect() if r[0] < SPAN)

    def own(hashes: Column) -> Column:  # an item's fingerprints: of its stretches, or of the whole if it is short
        return F.when(F.size(hashes) >= SPAN, _stretches(hashes)).otherwise(F.coalesce(
            *[F.when(F.size(hashes) == m, _short(hashes, m)) for m in lengths], F.array().cast("array<bigint>")))

    marks = small_or_not(classes.select(F.explode(let(_hashes(F.col("w")), own)).alias("mark")).distinct())
    bench_windows = small_or_not(classes.select("class", F.explode(let(F.struct(F.col("w").alias("w"), _hashes(F.col("w")).alias("h")), lambda s: F.when(
        F.size(s["w"]) >= SPAN, _windows(s["w"], s["h"], [], None)).otherwise(F.array(F.struct(
            F.lit(0).alias("start"), F.size(s["w"]).alias("words"), F.array_join(s["w"], " ").alias("text")))))).alias("o"))
        .select("class", F.col("o.text").alias("window")).distinct())

    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    scanned = written(base.select("doc_id", "text_hash", let(words_of(F.col("text")), lambda w: let(_hashes(w), lambda h: F.struct(
        F.size(h).cast("long").alias("n_words"), _fingerprints(h, lengths).alias("marks")))).alias("s")).select("doc_id", "text_hash", "s.*"))
    found = small_or_not(scanned.select("doc_id", "text_hash", F.explode("marks").alias("mark")).join(marks, "mark")
                         .groupBy("doc_id", "text_hash").agg(F.collect_set("mark").alias("wanted")))
    # Extension: every stretch with a shared fingerprint is a window to compare; no other place can hold one.
    extended = written(base.distinct().alias("b").join(found.alias("f"), F.col("b.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("b.text_hash") == F.col("f.text_hash")))
                       .select("b.doc_id", "b.text_hash", F.explode(let(F.struct(words_of(F.col("b.text")).alias("w"), F.col("f.wanted").alias("wanted")), lambda s: let(
                           _hashes(s["w"]), lambda h: _windows(s["w"], h, lengths, s["wanted"])))).alias("o"))
                       .select("doc_id", "text_hash", "o.start", (F.col("o.start") + F.col("o.words")).alias("end"), F.col("o.text").alias("window")))
    hits = extended.join(bench_windows.select("window").distinct(), "window", "left_semi")
    # A document's hit windows, joined to the stretches they cover.
    spans = hits.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("o")).select("doc_id", "text_hash", F.aggregate(
        "o", F.array().cast("array<struct<start:int,end:int>>"), lambda a, x: F.when(
            (F.size(a) > 0) & (F.coalesce(F.get(a, F.size(a) - 1)["end"], F.lit(-1)) >= x["start"]),
            F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(
                F.get(a, F.size(a) - 1)["start"].alias("start"), F.greatest(F.get(a, F.size(a) - 1)["end"], x["end"]).alias("end"))))
        ).otherwise(F.concat(a, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end")))))).alias("spans"))
    named = (hits.select("doc_id", "text_hash", "window").distinct().join(bench_windows, "window").select("doc_id", "text_hash", "class").distinct()
             .join(items.select("class", "item"), "class").groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("item")).alias("items")))
    keyed = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.text_hash") == F.col(f"{b}.text_hash"))
    verdicts = (spans.alias("s").join(named.alias("i"), keyed("s", "i"), "left")
                .select("s.doc_id", "s.text_hash", "s.spans", "i.items"))
    return (scanned.select("doc_id", "text_hash", "n_words").alias("d").join(verdicts.alias("v"), keyed("d", "v"), "left")
            .select("d.doc_id", "d.text_hash", "d.n_words",
                    F.coalesce(F.aggregate("v.spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]), F.lit(0).cast("long")).alias("n_hit"),
                    F.coalesce("v.spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
                    F.coalesce("v.items", F.array().cast("array<string>")).alias("items"), F.col("v.spans").isNotNull().alias("contaminated")))


def decontaminate(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text", **names) -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark, all columns as they are."""
    bad = small_or_not(contamination(docs, bench, doc_id, text, **names).filter("contaminated").select("doc_id", "text_hash").distinct())
    return docs.alias("d").join(bad.alias("x"), F.col(f"d.`{doc_id}`").eqNullSafe(F.col("x.doc_id"))
                                & (F.xxhash64(F.col(f"d.`{text}`").cast("string")) == F.col("x.text_hash")), "left_anti")
