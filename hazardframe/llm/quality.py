"""Quality rules, line first: lines are judged and removed before the document is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hazardframe.llm.common import BLANK, let, text_or_empty

SYMBOLS = r"[#*$%&|<>]"  # fixed value
WINDOW = 5
# Phrases of page furniture; a line is boilerplate only when it is short as well.
BOILERPLATE = ("(?i)(all rights reserved|terms of (use|service)|privacy policy|cookie (policy|settings)|uses? cookies|enable javascript|"
               "sign (in|up)\\b|log ?in\\b|subscribe|newsletter|read more|click here|skip to (main )?content|back to top|share (this|on)|"
               "powered by|copyright \\(?c?\\)?)")


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 5-word window found at least twice in the text.

    Windows are compared by 64-bit hashes. Sorting the hashes finds the repeated ones; positions are only carried for
    texts that have some, so nothing here is quadratic in the length of a text.
    """
    n = F.size(words)
    windows = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.transform(
        F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])))
    same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))

    def covered(g: Column) -> Column:
        placed = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        starts = let(placed, lambda p: F.sort_array(F.transform(F.filter(
            p, lambda s, i: same(F.get(p, i - 1), s) | same(F.get(p, i + 1), s)), lambda s: s["i"])))
        return let(starts, lambda s: F.aggregate(
            F.transform(s, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(s, i + 1) - p, F.lit(WINDOW)))),
            F.lit(0), lambda a, b: a + b))

    def repeated(g: Column) -> Column:
        any_twice = let(F.sort_array(g), lambda s: F.exists(
            F.transform(s, lambda x, i: F.coalesce(F.get(s, i + 1) == x, F.lit(False))), lambda b: b))
        return F.when(any_twice, covered(g)).otherwise(0)

    return F.when(n >= WINDOW, let(windows, repeated)).otherwise(0)


def line_fails(line: Column, max_symbols: float = 0.2, max_shouts: float = 0.3, short_line: int = 15) -> Column:
    """Whether a line that has a word is noise: odd punctuation, navigation, or boilerplate."""
    n = F.regexp_count(line, F.lit(f"[^{BLANK}]+"))
    symbols = F.regexp_count(line, F.lit(SYMBOLS)) > max_symbols * n
    shouts = F.regexp_count(line, F.lit("[!?]")) > F.greatest(F.lit(1), max_shouts * n)
    navigation = (F.regexp_count(line, F.lit("[»›•·→]|(^|[ ])[/>|-]([ ]|$)")) * 3 > n) & (n > 2)
    boilerplate = (n <= short_line) & line.rlike(BOILERPLATE)
    return symbols | shouts | navigation | boilerplate


def _judged(t: Column, min_words: int, max_repeat: float, max_lost: float, whole: bool) -> Column:
    """The struct of all fields of a text, or only ``kept``, for which the lines that pass are not carried on."""
    words = F.regexp_extract_all(t, F.lit(f"[^{BLANK}]+"), F.lit(0))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(f"[^{BLANK}]"))
    length = lambda ls: F.aggregate(ls, F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    fails = lambda n, repeated: (n < min_words) | (100 * repeated > round(100 * max_repeat) * n)
    if not whole:
        bad = let(words, lambda w: fails(F.size(w), _repeat_words(w)))
        left = let(lines, lambda ls: F.aggregate(ls, F.lit(0).cast("long"), lambda a, x: a + F.when(line_fails(x), 0).otherwise(F.length(x))) >= (1 - max_lost) * length(ls))
        return F.struct((~bad & left).alias("kept"))
    counts = let(words, lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        _repeat_words(w).cast("long").alias("n_repeat_words")))
    by_line = let(lines, lambda ls: F.struct(
        (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"), length(ls).alias("chars"),
        F.filter(ls, lambda x: ~line_fails(x)).alias("good")))
    return let(F.struct(counts.alias("c"), by_line.alias("l")), lambda s: let(
        F.struct(s["c"].alias("c"), s["l"].alias("l"), fails(s["c"]["n_words"], s["c"]["n_repeat_words"]).alias("bad"), length(s["l"]["good"]).alias("left")),
        lambda r: F.struct(
            r["c"]["n_words"].alias("n_words"), r["c"]["word_chars"].alias("word_chars"),
            F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            r["l"]["n_dup_lines"].alias("n_dup_lines"), r["c"]["n_repeat_words"].alias("n_repeat_words"),
            r["bad"].alias("base_failed"),
            (~r["bad"] & (r["left"] >= (1 - max_lost) * r["l"]["chars"])).alias("kept"),
            F.array_join(r["l"]["good"], "\n").alias("clean_text"))))


def line_first_cleaning(docs: DataFrame, text: str = "text", into: str = "quality", min_words: int = 10,
                        max_repeat: float = 0.2, max_lost: float = 0.5) -> DataFrame:
    """Add a struct ``into`` with counts, verdicts and the cleaned text; all other columns stay.

    Fields: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, kept (boolean) and
    clean_text (the lines that pass, joined by a line feed). A document is kept when it has ``min_words`` words, at most
    ``max_repeat`` of them in repeated windows, and its failing lines hold at most ``max_lost`` of the characters.

    A null or empty text has no words, fails and has an empty clean_text. Repeated rows are judged one by one and alike. A
    column that is already named ``into`` is replaced. Work per row is n log n in its words; no row meets another one,
    so there is no shuffle and no hot key.
    """
    return docs.withColumn(into, let(text_or_empty(text), lambda t: _judged(t, min_words, max_repeat, max_lost, True)))


def passes(text: str = "text", min_words: int = 10, max_repeat: float = 0.2, max_lost: float = 0.5) -> Column:
    """Whether :func:`line_first_cleaning` keeps the document; nothing else is built. Never null."""
    return let(text_or_empty(text), lambda t: _judged(t, min_words, max_repeat, max_lost, False)["kept"])
