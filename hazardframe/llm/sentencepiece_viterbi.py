"""SentencePiece encoding by batched Viterbi over distinct words, and decoding.

The model is a merge model. Its encoding of a text is the only segmentation in which every two neighbours are
compatible, that is, merging their joined text from single characters ends in just these two pieces; and every prefix of a
word has exactly one such segmentation. So a Viterbi pass finds it: the score of a step is 0 when the piece is
compatible with the last piece of the best path to its start and minus infinity otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hazardframe.llm.common import text_or_empty, text_slices
from hazardframe.llm.word_ids import WordIds

SPACE = "▁"  # fixed value: how the model writes a blank
BASE = np.uint64(0x9E3779B97F4A7C15)
UNKNOWN, NEVER = -1, -2
NORMAL, BYTE = 1, 6  # fixed values: the model file's types of pieces
SLICE_BYTES, MAX_WORDS = 1_000_000, 300_000
PAIR_BITS = 21  # slots of the table of pairs judged so far; a newer pair takes the slot of an older one


def read_model(path: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Pieces, scores and types of a model file."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = m.get_piece_size()
    kind = np.array([BYTE if m.is_byte(i) else 0 if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else NORMAL for i in range(n)])
    return [m.id_to_piece(i) for i in range(n)], np.array([m.get_score(i) for i in range(n)]), kind


def _codes(words: list[str], width: int) -> np.ndarray:
    """Code points of the words, one row each, filled up with zeros."""
    return np.array(words, f"<U{width}").view(np.uint32).reshape(len(words), width)


class Pieces:
    """Sorted piece keys, merge trees and compatibilities of a model's pieces."""

    def __init__(self, path: str):
        self.text, score, kind = read_model(path)
        self.bytes = np.full(256, -1)
        for i in np.flatnonzero(kind == BYTE):
            self.bytes[int(self.text[i][1:-1], 16)] = i
        self.raw = [bytes([int(t[1:-1], 16)]) if k == BYTE else t.replace(SPACE, " ").encode() if k == NORMAL else b""
                    for t, k in zip(self.text, kind)]
        normal = [int(i) for i in np.flatnonzero(kind == NORMAL)]
        self.width = max(len(self.text[i]) for i in normal)
        self.runs = {len(self.text[i]): i for i in normal if set(self.text[i]) == {SPACE}}
        ids = {self.text[i]: i for i in normal}
        # A run of blanks is handled apart, so only the single blank takes part in merging.
        ids = {t: i for t, i in ids.items() if len(t) == 1 or set(t) != {SPACE}}
        n = len(self.text)
        self.born, self.left, self.right = np.full(n, -1.0), np.arange(n), np.arange(n)
        joined = set()
        usable = []
        for t, i in ids.items():
            joined.update(zip(t, t[1:]))
            parts = list(t)
            tree = None
            while len(parts) > 1:
                found = [(score[ids[a + b]], -k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ids]
                if not found:
                    break
                k = -max(found)[1]
                tree = (parts[k], parts[k + 1])
                parts[k:k + 2] = [parts[k] + parts[k + 1]]
            if len(parts) == 1 and all(c in ids for c in t):
                usable.append(i)
                if tree:
                    self.born[i], self.left[i], self.right[i] = -score[i], ids[tree[0]], ids[tree[1]]
        self.usable_text = {self.text[i] for i in usable}
        self.lines_break = not any("\n" in t for t in ids)
        self.breaks = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+") if self.lines_break else re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.joined = np.unique(np.array([(ord(a) << 32) | ord(b) for a, b in joined], np.uint64))
        words = [self.text[i] for i in usable]
        size = np.array([len(w) for w in words], np.int64)
        codes = _codes(words, self.width)
        keys = np.zeros(len(words), np.uint64)
        for k in range(self.width):
            keys = np.where(k < size, self._grow(keys, codes[:, k]), keys)
        self.size = np.zeros(n, np.int64)
        self.size[usable] = size
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], np.array(usable, np.int64)[order]
        assert len(np.unique(keys)) == len(keys), "piece keys collide"
        self.hash = np.zeros(n, np.uint64)
        self.hash[self.key_ids] = self.keys
        self.power = np.power(BASE, np.arange(self.width + 1, dtype=np.uint64))
        self.maybe = np.zeros(1 << 20, bool)  # of the upper bits of a key: most substrings are no piece and stop here
        self.maybe[self.keys >> np.uint64(44)] = True
        self.pair_keys, self.pair_ok = np.full(1 << PAIR_BITS, -1), np.zeros(1 << PAIR_BITS, bool)

    @staticmethod
    def _grow(keys: np.ndarray, code: np.ndarray) -> np.ndarray:
        return keys * BASE + code.astype(np.uint64) + np.uint64(1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(keys.shape, NEVER)
        some = self.maybe[keys >> np.uint64(44)]
        wanted = keys[some]
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        out[some] = np.where(self.keys[at] == wanted, self.key_ids[at], NEVER)
        return out

    def _fresh(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces ``a`` and ``b`` stay apart: their last merges are undone, the latest first, and at no time may the
        two pieces that meet at the border be merged before either of them is used up by its own side."""
        ok = np.ones(len(a), bool)
        x, y = a.copy(), b.copy()
        gone_x, gone_y = np.full(len(a), np.inf), np.full(len(a), np.inf)
        live = np.arange(len(a))
        while len(live):
            both = self.find(self.hash[x] * self.power[np.minimum(self.size[y], self.width)] + self.hash[y])
            both = np.where(self.size[x] + self.size[y] <= self.width, both, NEVER)
            when = np.where(both >= 0, self.born[np.maximum(both, 0)], np.inf)
            bad = (when < gone_x) & (when <= gone_y) & (both >= 0)
            ok[live[bad]] = False
            go = ~bad & ((self.born[x] >= 0) | (self.born[y] >= 0))
            live, x, y, gone_x, gone_y = live[go], x[go], y[go], gone_x[go], gone_y[go]
            undo = self.born[x] > self.born[y]
            gone_x, gone_y = np.where(undo, self.born[x], gone_x), np.where(undo, gone_y, self.born[y])
            x, y = np.where(undo, self.right[x], x), np.where(undo, y, self.left[y])
        return ok

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of arrays of pairs; an unknown character is compatible with everything."""
        ok = np.ones(len(a), bool)
        known = np.flatnonzero((a >= 0) & (b >= 0))
        if not len(known):
            return ok
        pairs = (a[known] << 32) | b[known]
        slot = ((pairs.astype(np.uint64) * BASE) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        met = self.pair_ok[slot]
        new = np.flatnonzero(self.pair_keys[slot] != pairs)
        if len(new):
            distinct, back = np.unique(pairs[new], return_inverse=True)
            met[new] = fresh = self._fresh(distinct >> 32, distinct & 0xFFFFFFFF)[back]
            # The last writer of a slot wins in both arrays: one index array, and equal pairs have equal verdicts.
            last = np.unique(slot[new][::-1], return_index=True)[1]
            last = len(new) - 1 - last
            self.pair_keys[slot[new[last]]], self.pair_ok[slot[new[last]]] = pairs[new[last]], fresh[last]
        ok[known] = met
        return ok

    def viterbi(self, words: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of words of at most ``width`` characters, flat, and their number in each word.

        All words advance together, one character a step."""
        codes = _codes(words, width)
        n = len(words)
        size = np.array([len(w) for w in words])
        found = np.full((n, width + 1, self.width + 1), NEVER)  # piece that ends here and has this length
        grown = np.zeros((n, width), np.uint64)  # keys of the substrings, one character longer in each round
        for long in range(1, min(self.width, width) + 1):
            starts = width - long + 1
            grown = self._grow(grown[:, :starts], codes[:, long - 1:])
            found[:, long:, long] = self.find(grown)
        found[:, 1:, 1] = np.where(found[:, 1:, 1] == NEVER, UNKNOWN, found[:, 1:, 1])
        last, back = np.full((n, width + 1), NEVER), np.zeros((n, width + 1), np.int64)
        for end in range(1, width + 1):
            longest = min(self.width, end)
            step = found[:, end, 1:longest + 1]
            row, col = np.nonzero(step != NEVER)
            piece, start = step[row, col], end - col - 1
            score = np.full(step.shape, -np.inf)
            fits = (start == 0) | self.compatible(np.where(start == 0, UNKNOWN, last[row, start]), piece)
            score[row[fits], col[fits]] = 0.0
            best = score.argmax(axis=1)
            back[:, end] = best + 1
            last[:, end] = np.where(score[np.arange(n), best] == 0.0, step[np.arange(n), best], NEVER)
        at, rows, parts = size.copy(), np.arange(n), []
        while len(rows := rows[at[rows] > 0]):
            parts.append((rows, last[rows, at[rows]], at[rows]))
            at[rows] -= back[rows, at[rows]]
        row, piece, place = (np.concatenate(x) for x in zip(*parts))
        if (piece == NEVER).any():
            raise ValueError("a word has no segmentation")
        order = np.argsort(row * (width + 1) + place)
        row, piece, place = row[order], piece[order], place[order]
        if (piece == UNKNOWN).any():
            row, piece = self._spelled(row, piece, codes[row, place - 1].astype(np.int64))
        return piece, np.bincount(row, minlength=n)

    def _spelled(self, row: np.ndarray, piece: np.ndarray, char: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unknown characters become the pieces of their UTF-8 bytes."""
        unknown = piece == UNKNOWN
        n = np.where(unknown, 1 + (char >= 0x80) + (char >= 0x800) + (char >= 0x10000), 1)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        row, piece, char, n, unknown = (np.repeat(x, n) for x in (row, piece, char, n, unknown))
        head = np.array([0, 0, 0xC0, 0xE0, 0xF0])[n]
        octet = (char >> (6 * (n - 1 - nth))) & np.where((nth == 0) & (n > 1), 0x1F, np.where(n > 1, 0x3F, 0xFF))
        return row, np.where(unknown, self.bytes[np.where(unknown, octet | np.where(nth == 0, head, 0x80 * (n > 1)), 0)], piece)

    def split(self, word: str) -> list[str]:
        """Cut where two characters stand together in no piece, so that texts without blanks stay short words too."""
        if len(word) < 24:
            return [word]
        c = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
        pair = (c[:-1] << np.uint64(32)) | c[1:]
        at = np.minimum(np.searchsorted(self.joined, pair), len(self.joined) - 1)
        cuts = [0, *(np.flatnonzero(self.joined[at] != pair) + 1).tolist(), len(word)]
        return [word[a:b] for a, b in zip(cuts, cuts[1:])]

    def run(self, n: int) -> list[int]:
        """A run of n blanks that no other piece takes: the longest runs first."""
        most = max(self.runs)
        return [self.runs[most]] * (n // most) + ([self.runs[n % most]] if n % most else [])

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and their number for distinct words (leading blanks, then anything without blanks)."""
        parts, at, special = [], [], {}  # what goes through the Viterbi pass, and which word it belongs to
        for i, w in enumerate(words):
            if len(w) < 24 and w[1:2] != SPACE and w != SPACE:
                parts.append(w)
                at.append(i)
            else:
                rest = w.lstrip(SPACE)
                pieces = self.split(SPACE + rest if len(rest) < len(w) else rest) if rest else []
                parts.extend(pieces)
                at.extend([i] * len(pieces))
                if w[1:2] == SPACE or not rest:
                    special[i] = (len(w) - len(rest), rest)
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        width = np.where(size <= 24, size, -(-size // 64) * 64)
        order = np.argsort(width, kind="stable")
        flat, lens = [], []
        cuts = np.flatnonzero(np.diff(width[order], prepend=-1, append=-1)) if len(parts) else []
        for a, b in zip(cuts, cuts[1:]):
            wide = int(width[order[a]])
            step = max(1, 200_000 // wide)
            for k in range(a, b, step):
                ids, n = self.viterbi([parts[j] for j in order[k:min(b, k + step)]], wide)
                flat.append(ids)
                lens.append(n)
        none = np.empty(0, np.int64)
        flat, lens = np.concatenate([none, *flat]), np.concatenate([none, *lens])
        # Back into the order of the words.
        starts = np.cumsum(lens) - lens
        back = np.argsort(order, kind="stable")
        starts, lens = starts[back], lens[back]
        ids = flat[np.repeat(starts - np.cumsum(lens) + lens, lens) + np.arange(lens.sum())]
        n = np.bincount(np.array(at, np.int64), weights=lens, minlength=len(words)).astype(np.int64)
        if not special:
            return ids, n
        pieces = np.split(ids, np.cumsum(n)[:-1])
        for i, (blanks, rest) in special.items():
            if blanks and not rest:
                pieces[i] = np.array(self.run(blanks), np.int64)
            elif blanks > 1 and pieces[i][0] == self.runs[1]:  # the last blank was left alone, so it belongs to the run
                pieces[i] = np.concatenate([np.array(self.run(blanks), np.int64), pieces[i][1:]])
            elif blanks > 1:
                pieces[i] = np.concatenate([np.array(self.run(blanks - 1), np.int64), pieces[i]])
        return np.concatenate(pieces), np.array([len(x) for x in pieces], np.int64)

    def words(self, text: str) -> list[str]:
        return self.breaks.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def decode(self, ids: list[int]) -> str:
        raw = self.raw
        return b"".join([raw[i] for i in ids]).decode("utf-8", "replace")[1:]


@lru_cache(maxsize=2)
def _encoder(path: str) -> tuple[Pieces, WordIds, pa.Array]:
    pieces = Pieces(path)
    table = WordIds(lambda words: pieces.encode_words([w.replace(" ", SPACE) for w in words]), MAX_WORDS)
    return pieces, table, pa.array(pieces.raw, pa.binary())


def _slice_ids(pieces: Pieces, table: WordIds, data: memoryview, ends: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ids of texts that begin with a blank, given as in :func:`text_slices`, and the ids of each.

    A word is a run of blanks and what follows it, a line feed alone, or what follows that; Arrow numbers the distinct ones.
    """
    if not len(data):
        return np.empty(0, np.int32), np.zeros(len(ends), np.int64)
    points = np.frombuffer(str(data, "utf-8").encode("utf-32-le"), np.uint32)
    blank = (points == ord(" ")) | (points == ord(SPACE))
    begins = blank.copy()
    begins[1:] &= ~blank[:-1]
    if pieces.lines_break:
        feed = points == ord("\n")
        begins |= feed
        begins[1:] |= feed[:-1]
    starts = np.cumsum(chars) - chars
    begins[starts[chars > 0]] = True
    starts = np.flatnonzero(begins)
    if len(points) < len(data):
        width = np.uint8(1) + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        starts = (np.cumsum(width, dtype=np.int32) - width)[starts]
    cuts = np.append(starts, len(data)).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(data)]).dictionary_encode()
    ids, lens = table.gather(words.dictionary.to_pylist(), words.indices.to_numpy())
    upto = np.concatenate([[0], np.cumsum(lens)])
    return ids, np.diff(upto[np.concatenate([[0], np.searchsorted(starts, ends)])])


def _encoded(batches: Iterator[pa.RecordBatch], path: str, kept: list[str], into: str) -> Iterator[pa.RecordBatch]:
    """The first columns of each batch and the ids of its texts."""
    pieces, table, _ = _encoder(path)
    for part, data, ends, chars in text_slices(batches, "__text", SLICE_BYTES):
        ids, n = _slice_ids(pieces, table, data, ends, chars)
        out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(ids, pa.int32()))
        yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(kept))), out], names=[*kept, into])


def _texts(pieces: Pieces, raw: pa.Array, ids: pa.ListArray) -> pa.Array:
    """The text of each row's ids, without the blank that every text begins with."""
    cuts = ids.offsets.to_numpy().astype(np.int64)
    flat = ids.values.slice(cuts[0], cuts[-1] - cuts[0])
    if len(flat):
        taken = raw.take(flat)
        places = np.frombuffer(taken.buffers()[1], np.int32)[:len(flat) + 1][cuts - cuts[0]]
        data, full = np.frombuffer(taken.buffers()[2], np.uint8), np.diff(places) > 0
        if (data[places[:-1][full]] == ord(" ")).all():
            kept = np.ones(len(data), bool)
            kept[places[:-1][full]] = False
            upto = (places - np.concatenate([[0], np.cumsum(full)])).astype(np.int32)
            texts = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(upto), pa.py_buffer(data[kept])])
            try:
                return texts.cast(pa.string())
            except pa.ArrowInvalid:  # bytes that are no characters, from ids made by hand
                pass
    return pa.array([pieces.decode(x) if x else "" for x in ids.to_pylist()], pa.string())


def _with_blank(text: str) -> Column:
    whole = text_or_empty(text)
    return F.when(whole == "", "").otherwise(F.concat(F.lit(" "), whole)).alias("__text")


def encode(docs: DataFrame, path: str, text: str = "text", into: str = "pieces") -> DataFrame:
    """Add the column ``into`` (array<int>): the ids that the model at ``path`` gives for the whole text.

    ``path`` must be readable on every executor. A null or empty text has no ids. Each row is encoded by itself, so repeated
    rows get equal ids; the other columns pass through, and a column already named ``into`` is replaced. Texts are
    worked off in slices of bounded size (a longer text is a slice of its own, with work arrays in proportion); the table of
    words met so far and of pairs is bounded as well.
    """
    docs = docs.drop(into)
    kept = docs.columns
    schema = docs.withColumn(into, F.lit(None).cast("array<int>")).schema
    return docs.select(*kept, _with_blank(text)).mapInArrow(lambda batches: _encoded(batches, path, kept, into), schema)


def decode(docs: DataFrame, path: str, pieces: str = "pieces", into: str = "text") -> DataFrame:
    """Add the column ``into``: the text of the ids; the counterpart of :func:`encode`.

    Byte pieces are put together to characters again. The only character that does not come back is U+2581 itself, which
    the model uses for a blank. Null and empty arrays give an empty text.
    """
    docs = docs.drop(into)
    kept = docs.columns
    schema = docs.withColumn(into, F.lit(None).cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, _, raw = _encoder(path)
        for batch in batches:
            # A slice of rows at a time: the texts of a whole batch would be large.
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                lists = pa.concat_arrays([part.column(len(kept))])
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(kept))), _texts(model, raw, lists)], names=[*kept, into])

    return docs.select(*kept, F.coalesce(pieces, F.array().cast("array<int>")).alias("__ids")).mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, text: str = "text", into: str = "pieces", decoded: str = "decoded") -> DataFrame:
    """:func:`encode` and :func:`decode` in one pass and one worker; all columns stay but those named ``into`` and ``decoded``."""
    kept = [c for c in docs.columns if c not in (into, decoded)]
    rows = docs.select(*kept, _with_blank(text))
    schema = rows.drop("__text").withColumn(into, F.lit(None).cast("array<int>")).withColumn(decoded, F.lit(None).cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, _, raw = _encoder(path)
        for part in _encoded(batches, path, kept, into):
            yield pa.RecordBatch.from_arrays([*part.columns, _texts(model, raw, part.column(len(kept)))], names=[*kept, into, decoded])

    return rows.mapInArrow(run, schema)
