"""Language identification, words first: known words by their frequency in each language, the others by ever shorter n-grams."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from hazardframe.llm.common import row_blocks, written

WORD = re.compile(r"[^\W\d_]+")
LONGEST, SHORTEST = 5, 1
UNDETERMINED = "und"
MAX_CACHE = 300_000
MAX_CACHE_CHARS = 10_000_000
# Places of a word that are worked on at a time, and n-grams that a task holds: long words take more steps and not more memory.
STRETCH, MOST_GRAMS = 4096, 2_000_000


@dataclass
class LanguageModel:
    """Log frequencies of words and n-grams: a row of each table for a key, a column for a language."""

    languages: list[str]
    words: dict[str, int]
    word_scores: np.ndarray
    grams: dict[str, int]
    gram_scores: np.ndarray
    unseen: np.ndarray


def _counts(batches: Iterator[pa.RecordBatch], most: int, most_chars: int = 20_000_000) -> Iterator[pa.RecordBatch]:
    """Words and n-grams of a partition with their counts in each language; n-grams are counted from the distinct words, each
    at its whole length."""
    words: Counter = Counter()
    grams: Counter = Counter()
    chars = 0

    def out(kind: str, table: Counter) -> Iterator[pa.RecordBatch]:
        if table:
            yield pa.RecordBatch.from_pydict({
                "kind": pa.array([kind] * len(table)), "key": pa.array([k for _, k in table]), "lang": pa.array([x for x, _ in table]),
                "n": pa.array(list(table.values()), pa.int64())})
        table.clear()

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, w), n in words.items():
            padded = f" {w} "
            for start in range(0, len(padded), STRETCH):
                for size in range(SHORTEST, LONGEST + 1):
                    for i in range(start, min(start + STRETCH, len(padded) - size + 1)):
                        grams[lang, padded[i:i + size]] += n
                if len(grams) > MOST_GRAMS:
                    yield from out("gram", grams)
        yield from out("word", words)
        yield from out("gram", grams)

    for part, texts in row_blocks(batches, 0):
        for text, lang in zip(texts, part.column(1).to_pylist()):
            for w in WORD.findall(text.lower()):
                words[lang, w] += 1
            chars += len(text)
        if len(words) > most or chars > most_chars:
            yield from flush()
            chars = 0
    yield from flush()


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_rows: int = 10_000,
        max_words: int = 60_000, max_grams: int = 100_000, min_count: int = 2, max_languages: int = 300) -> LanguageModel:
    """Learn from a bounded sample: the ``sample_rows`` labelled rows whose hashed ``key`` is smallest.

    Of the sample's words and n-grams the most frequent ``max_words`` and ``max_grams`` make up the model, so what reaches the
    driver and the executors is bounded by parameters and not by the corpus. Rows without a language teach nothing; a
    null key hashes like any other value. No labelled row gives an empty model, which answers ``und`` to everything.
    """
    rows = labelled.filter(F.col(lang).isNotNull()).select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"),
                                                           F.xxhash64(F.col(key)).alias("h"))
    last = rows.select("h").orderBy("h").limit(sample_rows).agg(F.max("h")).collect()[0][0]
    empty = LanguageModel([], {}, np.zeros((0, 0)), {}, np.zeros((0, 0)), np.zeros(0))
    if last is None:
        return empty
    counts = written(rows.filter(F.col("h") <= F.lit(last)).select("text", "lang")
                     .mapInArrow(lambda it: _counts(it, 200_000), "kind string, key string, lang string, n bigint")
                     .groupBy("kind", "key", "lang").agg(F.sum("n").alias("n"))
                     .groupBy("kind", "key").agg(F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("lang", "n"))).alias("by"))
                     .filter(F.col("total") >= min_count))
    tables = {}
    for kind, most in (("word", max_words), ("gram", max_grams)):
        top = counts.filter(F.col("kind") == kind).orderBy(F.desc("total"), "key").limit(most)
        tables[kind] = top.select("key", F.col("by.lang").alias("lang"), F.col("by.n").alias("n")).toArrow().combine_chunks()
    languages = sorted({x for t in tables.values() for x in pc.unique(pc.list_flatten(t["lang"])).to_pylist()})
    if not languages:
        return empty
    if len(languages) > max_languages:
        raise ValueError(f"{len(languages)} languages; raise max_languages if that is meant")

    def scores(table: pa.Table, spread: float = 0.5) -> tuple[dict[str, int], np.ndarray]:
        n = np.zeros((table.num_rows, len(languages)))
        column = pc.index_in(pc.list_flatten(table["lang"]), pa.array(languages)).to_numpy()
        n[np.repeat(np.arange(table.num_rows), pc.list_value_length(table["lang"]).to_numpy()), column] = pc.list_flatten(table["n"]).to_numpy()
        total = n.sum(axis=0, keepdims=True) + spread * (table.num_rows + 1)
        return {k: i for i, k in enumerate(table["key"].to_pylist())}, np.log((n + spread) / total)

    words, word_scores = scores(tables["word"])
    grams, gram_scores = scores(tables["gram"])
    return LanguageModel(languages, words, word_scores, grams, gram_scores, np.full(len(languages), -20.0))


class Scorer:
    """Scores of words, each worked out once; the table of them is a cache of bounded size."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.chars = 0
        self.scores = np.zeros((0, len(self.model.languages)))

    def word(self, w: str) -> np.ndarray:
        """A known word's own scores; otherwise the mean over all its places of the longest known n-gram that starts there."""
        m = self.model
        at = m.words.get(w)
        if at is not None:
            return m.word_scores[at]
        padded, total, n = f" {w} ", 0.0, 0
        grams, last = m.grams, len(padded) - 1
        for start in range(0, last, STRETCH):
            found = []
            for i in range(start, min(start + STRETCH, last)):
                for size in range(min(LONGEST, len(padded) - i), SHORTEST - 1, -1):
                    at = grams.get(padded[i:i + size])
                    if at is not None:
                        found.append(at)
                        break
            if found:
                total = total + m.gram_scores[found].sum(axis=0)
                n += len(found)
        return total / n if n else m.unseen

    def texts(self, lists: list[list[str]]) -> np.ndarray:
        """Mean scores of lists of words; a list without words has zeros."""
        words = list(chain.from_iterable(lists))
        if len(self.index) > MAX_CACHE or self.chars > MAX_CACHE_CHARS:
            self.clear()
        new = list(set(words).difference(self.index))
        if new:
            first = len(self.index)
            self.index.update(zip(new, range(first, first + len(new))))
            self.chars += sum(map(len, new))
            self.scores = np.concatenate([self.scores, np.array([self.word(w) for w in new]).reshape(len(new), -1)])
        codes = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        n = np.array([len(x) for x in lists])
        out = np.zeros((len(lists), len(self.model.languages)))
        full = np.flatnonzero(n)
        if len(full):
            out[full] = np.add.reduceat(self.scores[codes], (np.cumsum(n) - n)[full], axis=0) / n[full][:, None]
        return out


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", lang_into: str = "lang_pred", score_into: str = "score",
            sharpness: float = 10.0) -> DataFrame:
    """Add the language of every whole text and a score from 0 to 1 (the softmax of ``sharpness`` times the mean word score).

    Only the text is looked at. A text that is null or without a letter is ``und`` with score 0, as is everything under an
    empty model. Equal texts get equal answers; ties go to the alphabetically first language. The other columns pass
    through; columns already named like the new ones are replaced.
    """
    docs = docs.drop(lang_into, score_into)
    kept, at = docs.columns, docs.columns.index(text)
    schema = StructType([*docs.schema.fields, StructField(lang_into, StringType()), StructField(score_into, DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        names = np.array([*scorer.model.languages, UNDETERMINED], object)
        for part, texts in row_blocks(batches, at):
            words = [WORD.findall(t.lower()) for t in texts]
            has = np.array([bool(w) for w in words])
            if len(names) == 1:
                best, score = np.zeros(len(texts), int), np.zeros(len(texts))
            else:
                mean = scorer.texts(words)
                best = np.where(has, mean.argmax(axis=1), len(names) - 1)
                share = np.exp(sharpness * (mean - mean.max(axis=1, keepdims=True)))
                score = np.where(has, 1.0 / share.sum(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names[best], pa.string()), pa.array(score)], names=[*kept, lang_into, score_into])

    return docs.mapInArrow(run, schema)
