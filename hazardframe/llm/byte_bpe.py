"""Byte-level BPE: encoding and decoding by the ranks of a public vocabulary file.

Texts are cut without regular expressions. Every code point has a class; with the class of its neighbour it makes a
symbol, and a symbol is a function from the state before a character to the state after it. Such functions compose, and
only a few dozen different ones arise, so a text is a sequence of small numbers with a composition table, and an
associative scan over fixed stretches gives the state at every character of many texts at once. Where the state says so
a slice begins. Distinct slices are merged once, and every token keeps the place in the text where it starts.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from hazardframe.llm.common import text_slices
from hazardframe.llm.word_ids import WordIds

LETTER, NUMBER, OTHER, BLANK = range(4)

# What the pattern calls white space, as ranges of code points.
BLANKS = [(0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F),
          (0x205F, 0x205F), (0x3000, 0x3000)]
# Letters and numbers of Unicode 16 that Python's own tables (15.1) do not have yet.
NEW_LETTERS = [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
               (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1),
               (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF),
               (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9),
               (0x1E5F1, 0x1E5FA)]
# The endings that make a slice of their own with the apostrophe before them.
SHORT_ENDINGS, LONG_ENDINGS = "stmd", ("re", "ve", "ll")


@lru_cache(maxsize=1)
def codepoint_classes() -> np.ndarray:
    """The class of every code point."""
    of = {"L": LETTER, "N": NUMBER}
    classes = np.fromiter((of.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    for ranges, kind in ((NEW_LETTERS, LETTER), (NEW_NUMBERS, NUMBER), (BLANKS, BLANK)):
        for a, b in ranges:
            classes[a:b + 1] = kind
    return classes


# Symbols: the four classes, where a blank stands for one that is followed by a blank or the end; then an apostrophe with a
# short or long ending, a space that joins what follows, and another blank before something else. FIRST is added at the start of a text.
SHORT, LONG, JOINS, TAIL, FIRST = 4, 5, 6, 7, 8
# States: the slice is closed, a run of a class, a space that waits for what it joins, one or two characters of an ending to come.
CLOSED, RUN, WAITING, ONE_MORE, TWO_MORE = 0, 1, 5, 6, 7
STATES = 8


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The state after a character, and whether a slice begins at it."""
    if symbol >= FIRST:
        return _step(CLOSED, symbol - FIRST)[0], True
    if symbol == LETTER and state in (ONE_MORE, TWO_MORE):
        return (CLOSED if state == ONE_MORE else ONE_MORE), False
    if symbol in (SHORT, LONG):
        if state in (RUN + OTHER, WAITING):
            return RUN + OTHER, False
        return (ONE_MORE if symbol == SHORT else TWO_MORE), True
    if symbol == JOINS:
        return WAITING, True
    if symbol == TAIL:
        return CLOSED, True
    return RUN + symbol, state != RUN + symbol and (state != WAITING or symbol == BLANK)


@lru_cache(maxsize=1)
def _machine() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Element of each symbol, composition of elements, element applied to a state, and whether a slice begins."""
    functions = [tuple(_step(s, symbol)[0] for s in range(STATES)) for symbol in range(2 * FIRST)]
    known = {tuple(range(STATES)): 0}  # the identity pads the last stretch
    for f in functions:
        known.setdefault(f, len(known))
    queue = list(known)
    while queue:
        f = queue.pop()
        for g in list(known):
            for h in (tuple(g[s] for s in f), tuple(f[s] for s in g)):
                if h not in known:
                    known[h] = len(known)
                    queue.append(h)
    elements = list(known)
    compose = np.array([[known[tuple(g[s] for s in f)] for g in elements] for f in elements], np.uint8)
    begins = np.array([[_step(s, symbol)[1] for symbol in range(2 * FIRST)] for s in range(STATES)])
    return np.array([known[f] for f in functions], np.uint8), compose, np.array(elements, np.uint8), begins


STRETCH = 256


def _scan(elements: np.ndarray) -> np.ndarray:
    """Inclusive prefix compositions: stretches advance side by side, then their totals are scanned in the same way."""
    _, compose, _, _ = _machine()
    k, flat = len(compose), compose.ravel()
    n = len(elements)
    rows = -(-n // STRETCH)
    grid = np.zeros(rows * STRETCH, np.uint8)
    grid[:n] = elements
    grid = np.ascontiguousarray(grid.reshape(rows, STRETCH).T)
    for j in range(1, STRETCH):
        grid[j] = flat[grid[j - 1].astype(np.uint16) * k + grid[j]]
    if rows > 1:
        before = np.concatenate([[0], _scan(grid[-1])[:-1]]).astype(np.uint16) * k
        grid = flat[before[None, :] + grid]
    return grid.T.ravel()[:n]


def slice_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where slices begin in code points; ``first`` marks the first character of every text."""
    if not len(points):
        return np.empty(0, np.int64)
    symbols = codepoint_classes()[points]
    ends_text = np.append(first[1:], True)
    blank = symbols == BLANK
    tail = blank & ~(np.append(blank[1:], True) | ends_text)
    symbols[tail] = np.where(points[tail] == ord(" "), JOINS, TAIL)
    at = np.flatnonzero(points == ord("'"))
    if len(at):
        one, two = (np.append(points, [0, 0])[at + k] for k in (1, 2))
        inside = ~np.append(ends_text, [True, True])[at]
        further = inside & ~np.append(ends_text, [True, True])[at + 1]
        symbols[at[inside & np.isin(one, [ord(c) for c in SHORT_ENDINGS])]] = SHORT
        for a, b in LONG_ENDINGS:
            symbols[at[further & (one == ord(a)) & (two == ord(b))]] = LONG
    symbols += (first * FIRST).astype(np.uint8)
    element, _, apply, begins = _machine()
    after = apply[_scan(element[symbols]), CLOSED]
    return np.flatnonzero(begins[np.concatenate([[CLOSED], after[:-1]]), symbols])


SLICE_BYTES = 1_000_000
MAX_WORDS = 200_000
NONE = 1 << 40  # the rank of pairs that do not merge


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one slice: neighbours of the lowest rank are merged, the leftmost first, until no pair has a rank."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > 100:
        return _merge_long(word, ranks)
    cuts = list(range(len(word) + 1))
    pairs = [ranks.get(word[i:i + 2], NONE) for i in range(len(word) - 1)]
    while pairs:
        least = min(pairs)
        if least == NONE:
            break
        i = pairs.index(least)
        del cuts[i + 1], pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(word[cuts[i]:cuts[i + 2]], NONE)
        if i:
            pairs[i - 1] = ranks.get(word[cuts[i - 1]:cuts[i + 1]], NONE)
    return [ranks[word[a:b]] for a, b in zip(cuts, cuts[1:])]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap, in n log n: for runs of letters or signs without a blank."""
    n = len(word)
    end, left = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts at each place; 0 ends it if it was merged
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop:
            continue  # one of the two has been merged since
        end[i], end[middle] = stop, 0
        if stop < n:
            left[stop] = i
            if (r := ranks.get(word[i:end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if left[i] >= 0 and (r := ranks.get(word[left[i]:stop])) is not None:
            heapq.heappush(heap, (r, left[i], stop))
    return [ranks[word[a:b]] for a, b in enumerate(end) if b]


class Vocabulary:
    """The ranks of a file, a bounded table of merged slices, and the bytes of every id."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        by_id = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            by_id[rank] = token
        self.tokens = pa.array(by_id, pa.binary())
        self.widths = np.array([len(t) for t in by_id], np.int32)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {self.ranks[t[:i]] << 32 | self.ranks[t[i:]]: r for t, r in self.ranks.items() for i in range(1, len(t))
                 if t[:i] in self.ranks and t[i:] in self.ranks}
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.fromiter(pairs.values(), np.int64, len(pairs))[order]
        self.words = WordIds(self._merge_all, MAX_WORDS)

    def _merge_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct slices: those of one length advance together, long ones and whole tokens are done one by one."""
        alike, done = defaultdict(list), []
        for i, w in enumerate(words):
            if w in self.ranks or len(w) > 40:
                done.append((np.array([i]), np.array([merge(w, self.ranks)])))
            else:
                alike[len(w)].append(i)
        for at in alike.values():
            done += self._merge_alike(np.array(at), b"".join([words[i] for i in at]))
        lens = np.empty(len(words), np.int64)
        for at, ids in done:
            lens[at] = ids.shape[1]
        flat, starts = np.empty(lens.sum(), np.int32), np.cumsum(lens) - lens
        for at, ids in done:
            flat[starts[at][:, None] + np.arange(ids.shape[1])] = ids
        return flat, lens

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank that each pair of ids merges to, or NONE."""
        keys = left << 32 | right
        spot = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[spot] == keys, self.pair_ranks[spot], NONE)

    def _merge_alike(self, at: np.ndarray, data: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
        """Slices of one length, one merge a step in all of them; a slice leaves when no pair of it has a rank."""
        ids, out = self.byte_ids[np.frombuffer(data, np.uint8)].reshape(len(at), -1), []
        ranks = self._ranks_of(ids[:, :-1], ids[:, 1:])
        while True:
            width = ids.shape[1]
            best = ranks.min(axis=1, initial=NONE)
            live = best < NONE
            out.append((at[~live], ids[~live]))
            if not live.any():
                return out
            at, ids, ranks, best = at[live], ids[live], ranks[live], best[live]
            rows, spot = np.arange(len(at)), ranks.argmin(axis=1)
            ids[rows, spot] = best
            ids = ids[np.arange(width) != (spot + 1)[:, None]].reshape(len(at), width - 1)
            ranks = ranks[np.arange(width - 1) != spot[:, None]].reshape(len(at), width - 2)
            r = np.flatnonzero(spot < width - 2)
            ranks[r, spot[r]] = self._ranks_of(ids[r, spot[r]], ids[r, spot[r] + 1])
            r = np.flatnonzero(spot > 0)
            ranks[r, spot[r] - 1] = self._ranks_of(ids[r, spot[r] - 1], ids[r, spot[r]])

    def encode(self, data: memoryview, ends: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of texts in UTF-8, given by their last bytes and lengths in characters: all ids, the places of their first bytes, ids of each text."""
        points = np.frombuffer(str(data, "utf-8").encode("utf-32-le"), np.uint32)
        first = np.zeros(len(points) + 1, bool)
        first[np.cumsum(chars) - chars] = True
        starts = slice_starts(points, first[:-1])
        if len(points) < len(data):
            width = np.uint8(1) + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
            starts = (np.cumsum(width, dtype=np.int32) - width)[starts]
        cuts = np.append(starts, len(data)).astype(np.int32)
        slices = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(data)]).dictionary_encode()
        ids, lens = self.words.gather(slices.dictionary.to_pylist(), slices.indices.to_numpy())
        upto = np.concatenate([[0], np.cumsum(lens)])
        n = np.diff(upto[np.concatenate([[0], np.searchsorted(starts, ends)])])
        wide = self.widths[ids].astype(np.int64)
        return ids, np.cumsum(wide) - wide, n


@lru_cache(maxsize=1)
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


TOKENS = "struct<ids: array<int>, starts: array<int>>"


def _added(df: DataFrame | StructType, name: str, kind: str) -> StructType:
    fields = df.fields if isinstance(df, StructType) else df.schema.fields
    return StructType([f for f in fields if f.name != name] + [StructField(name, StructType.fromDDL(f"t {kind}")["t"].dataType)])


def _encoded(batches: Iterator[pa.RecordBatch], ranks: str, kept: list[str], into: str) -> Iterator[pa.RecordBatch]:
    """The first columns of each batch and the tokens of its texts."""
    vocabulary = _vocabulary(ranks)
    for part, data, ends, chars in text_slices(batches, "__text", SLICE_BYTES):
        ids, places, n = vocabulary.encode(data, ends, chars)
        cuts = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
        starts = places - np.repeat(np.concatenate([[0], ends[:-1]]), n)
        tokens = pa.StructArray.from_arrays([pa.ListArray.from_arrays(cuts, pa.array(ids, pa.int32())),
                                             pa.ListArray.from_arrays(cuts, pa.array(starts, pa.int32()))], names=["ids", "starts"])
        yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(kept))), tokens], names=[*kept, into])


def _decoded(batches: Iterator[pa.RecordBatch], ranks: str, kept: list[str], into: str) -> Iterator[pa.RecordBatch]:
    """The first columns of each batch and the bytes of its tokens, whose two lists follow."""
    vocabulary = _vocabulary(ranks)
    for batch in batches:
        ids, starts = batch.column(len(kept)), batch.column(len(kept) + 1)
        cuts = ids.offsets.to_numpy().astype(np.int64)
        flat, places = (x.values.slice(cuts[0], cuts[-1] - cuts[0]).to_numpy().astype(np.int64) for x in (ids, starts))
        cuts -= cuts[0]
        upto = np.concatenate([[0], np.cumsum(vocabulary.widths[flat], dtype=np.int64)])
        if not np.array_equal(upto[:-1] - np.repeat(upto[cuts[:-1]], np.diff(cuts)), places):
            raise ValueError("the places of the tokens do not fit their ids")
        data = vocabulary.tokens.take(pa.array(flat)).buffers()[2] if len(flat) else None
        rows = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(upto[cuts].astype(np.int32)), data or pa.py_buffer(b"")])
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), rows], names=[*kept, into])


def encode(docs: DataFrame, ranks: str, text: str = "text", into: str = "tokens") -> DataFrame:
    """Add the struct ``into``: the ids of every whole text, and of each token the byte of the text at which it starts.

    ``ranks`` is a rank file (base64 token and rank a line) that every executor can read; it must hold all single bytes. Texts are
    cut as the public pattern says, without special tokens. A null or empty text has no ids. Rows do not influence each other, so
    order, ties and repeated rows make no difference. A column named ``into`` is replaced, all others stay. A lost executor's
    partitions are encoded again.
    """
    kept = [c for c in docs.columns if c != into]
    rows = docs.select(*kept, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    return rows.mapInArrow(lambda batches: _encoded(batches, ranks, kept, into), _added(docs, into, TOKENS))


def decode(encoded: DataFrame, ranks: str, tokens: str = "tokens", into: str = "decoded") -> DataFrame:
    """Add the bytes that the ids stand for (binary column ``into``; it need not be UTF-8 if ids were made by hand).

    All tokens of a batch are gathered at once, and the places kept at encoding give the bytes of each row: a row whose places do
    not fit its ids is an error. Null tokens and empty lists give no bytes. A column named ``into`` is replaced, all others stay.
    """
    kept = [c for c in encoded.columns if c != into]
    empty = F.array().cast("array<int>")
    lists = [F.coalesce(F.col(f"{tokens}.{c}"), empty).alias(f"__{c}") for c in ("ids", "starts")]
    return encoded.select(*kept, *lists).mapInArrow(lambda batches: _decoded(batches, ranks, kept, into), _added(encoded, into, "binary"))


def round_trip(docs: DataFrame, ranks: str, text: str = "text", into: str = "tokens", decoded: str = "decoded") -> DataFrame:
    """:func:`encode` and :func:`decode` in one pass over the texts, which are not among the result's columns."""
    kept = [c for c in docs.columns if c not in (into, text, decoded)]
    rows = docs.select(*kept, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _encoded(batches, ranks, kept, into):
            lists = batch.column(len(kept)).flatten()
            wider = pa.RecordBatch.from_arrays([*batch.columns, *lists], names=[*kept, into, "__ids", "__starts"])
            yield from _decoded(iter([wider]), ranks, [*kept, into], decoded)

    return rows.mapInArrow(run, _added(_added(rows.drop("__text"), into, TOKENS), decoded, "binary"))
