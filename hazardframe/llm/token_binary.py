"""Token ids in a binary format: Simple-8b words, escapes, and offsets per block for vectorised decoding.

File format. A file set is a folder of Parquet files whose rows are chunks: ``part``, ``seq`` (the order), ``first`` (ids of the
part before the chunk), ``doc_ids``, ``n_tokens`` (one entry for each document), ``n_ids``, ``block_words`` (start of every block in
the payload, in words) and ``payload``. The payload is a row of little-endian 64-bit words. Every word has a 4-bit selector
on top and 60 bits of data, the first value lowest. Blocks of ``BLOCK`` values start at a word of their own, so all blocks
can be packed and unpacked side by side. A value of more than 30 bits is an escape: a word of selector 15 that is
followed by the value as it is.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from hazardframe.llm.byte_bpe import NUMBER, codepoint_classes
from hazardframe.llm.common import text_slices
from hazardframe.llm.word_ids import WordIds

# How many values of how many bits a word of each selector holds. Selector 15 is the escape.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 64])
ESCAPE = 15
BLOCK = 1024


def _levels(values: np.ndarray) -> np.ndarray:
    """The first field wide enough for each value: 0 bits is level 0, BITS[2] level 1 and so on."""
    if values.max(initial=0) < 1 << 16 < values.size:
        return _levels(np.arange(1 << 16, dtype=np.uint64))[values.astype(np.uint16)]
    level = (values > 0).astype(np.int8)
    for bits in BITS[2:15]:
        level += values >= (np.uint64(1) << np.uint64(bits))
    return level


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of unsigned values, and the word at which each block starts.

    Every block is packed greedily: at each place the selector that holds the most of the next values. What follows a
    block counts as zeros, so a last word may be part empty. All blocks advance together, one word a step.
    """
    values = np.asarray(values, np.uint64)
    n = len(values)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    n_blocks = -(-n // BLOCK)
    flat = np.zeros(n_blocks * BLOCK, np.uint64)
    flat[:n] = values
    grid = np.zeros((n_blocks, BLOCK + 240), np.uint64)
    grid[:, :BLOCK] = flat.reshape(n_blocks, BLOCK)
    level = _levels(grid)
    choice = np.full((n_blocks, BLOCK), ESCAPE, np.int8)
    most, have = level, 1  # the largest level of the next ``have`` values
    for s in range(14, -1, -1):
        while have < COUNTS[s]:
            step = min(have, int(COUNTS[s]) - have)
            most, have = np.maximum(most[:, :most.shape[1] - step], most[:, step:]), have + step
        np.putmask(choice, most[:, :BLOCK] <= max(0, s - 1), s)
    at, ends = np.zeros(n_blocks, np.int64), np.minimum(BLOCK, n - np.arange(n_blocks) * BLOCK)
    live, block, place, chosen = np.arange(n_blocks), [], [], []
    while len(live):
        s = choice[live, at[live]]
        block.append(live)
        place.append(at[live])
        chosen.append(s)
        at[live] += COUNTS[s]
        live = live[at[live] < ends[live]]
    block, place, chosen = (np.concatenate(x) for x in (block, place, chosen))
    order = np.argsort(block * BLOCK + place)
    block, place, chosen = block[order], place[order], chosen[order]
    size = 1 + (chosen == ESCAPE)
    spot = np.cumsum(size) - size
    words = np.zeros(size.sum(), np.uint64)
    words[spot] = chosen.astype(np.uint64) << np.uint64(60)
    flat, at = grid.ravel(), block * grid.shape[1] + place
    for s in np.unique(chosen):
        rows = np.flatnonzero(chosen == s)
        if s == ESCAPE:
            words[spot[rows] + 1] = flat[at[rows]]
            continue
        word, first = words[spot[rows]], at[rows]
        for k in range(COUNTS[s] if s > 1 else 0):
            word |= flat[first + k] << np.uint64(k * BITS[s])
        words[spot[rows]] = word
    return words, spot[np.searchsorted(block, np.arange(n_blocks))]


def unpack(words: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values of :func:`pack`'s words; all words of one selector are decoded together."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    selector = (words >> np.uint64(60)).astype(np.int64)
    data = np.ones(len(words), bool)  # the others are raw values of escapes
    # A raw value may look like an escape itself, so escapes are settled from the left; they are rare.
    for e in np.flatnonzero(selector == ESCAPE):
        if data[e]:
            data[e + 1] = False
    where = np.flatnonzero(data)
    block = np.searchsorted(starts, where, side="right") - 1
    count = COUNTS[selector[where]]
    before = np.cumsum(count) - count
    first = np.searchsorted(block, np.arange(len(starts)))
    place = block * BLOCK + before - before[first][block]
    ends = np.minimum((block + 1) * BLOCK, n)
    for sel in np.unique(selector[where]):
        rows = np.flatnonzero(selector[where] == sel)
        if sel == ESCAPE:
            out[place[rows]] = words[where[rows] + 1]
        elif sel > 1:
            spot = place[rows][:, None] + np.arange(COUNTS[sel])
            grid = (words[where[rows]][:, None] >> (np.arange(COUNTS[sel], dtype=np.uint64) * np.uint64(BITS[sel]))) & np.uint64((1 << int(BITS[sel])) - 1)
            inside = spot < ends[rows][:, None]
            out[spot[inside]] = grid[inside]
    return out


# Below this code point nothing combines with what stands before it, and classes of letters and numbers are the same in all versions.
COMBINING, DOTTED_I = 0x300, 0x130
TOGETHER = 200  # pieces that one call of the library encodes as one text
MAX_PIECES, SLICE_BYTES = 650_000, 1_500_000


def _sure(piece: str) -> bool:
    """Whether the pre-tokenizer leaves the piece whole: letters without marks, a digit, or ASCII signs without an apostrophe."""
    if piece.isalpha():
        return max(piece) < chr(COMBINING) and chr(DOTTED_I) not in piece
    return piece.isascii() and (piece.isdigit() and len(piece) == 1 or piece.isprintable() and not any(c.isalnum() or c in "' " for c in piece))


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordIds:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to Spark's tasks
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    plain = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    parts = ["mix", "of", ",", "é", "1", "2", "-", "words", "..."]
    if any(plain(f"MIX{gap}Of,é12-{gap}words...") != [i for p in parts for i in plain(p)] for gap in (" ", "\n", " \n ")):
        raise ValueError(f"{path}: the tokenizer does not fold case and part words at blanks, line feeds, signs and digits")
    last = np.zeros(tokenizer.get_vocab_size(), bool)
    last[[i for t, i in tokenizer.get_vocab().items() if t.endswith("</w>")]] = True

    def together(pieces: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of pieces encoded as one text; where each ends its last id says so, else the pieces have to go alone."""
        flat = []
        for a in range(0, len(pieces), 100 * TOGETHER):
            texts = [pieces[k:k + TOGETHER] for k in range(a, min(len(pieces), a + 100 * TOGETHER), TOGETHER)]
            for text, e in zip(texts, tokenizer.encode_batch_fast([" ".join(t) for t in texts], add_special_tokens=False)):
                ids = np.array(e.ids, np.int32)
                if not len(ids) or not last[ids[-1]] or int(last[ids].sum()) != len(text):
                    return None
                flat.append(ids)
        whole = np.concatenate(flat)
        return whole, np.diff(np.flatnonzero(last[whole]), prepend=-1)

    def alone(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [np.array(e.ids, np.int32) for a in range(0, len(words), 5_000)
                 for e in tokenizer.encode_batch_fast(words[a:a + 5_000], add_special_tokens=False)]
        return np.concatenate([np.empty(0, np.int32), *parts]), np.array([len(p) for p in parts], np.int64)

    def encode_words(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sure = np.fromiter(map(_sure, words), bool, len(words))
        many = together([w for w, s in zip(words, sure.tolist()) if s]) if sure.any() else None
        if many is None:
            return alone(words)
        flat, lens = many
        rest, rest_lens = alone([w for w, s in zip(words, sure.tolist()) if not s])
        n = np.empty(len(words), np.int64)
        n[sure], n[~sure] = lens, rest_lens
        out = np.empty(n.sum(), np.int32)
        mine = np.repeat(sure, n)
        out[mine], out[~mine] = flat, rest
        return out, n

    return WordIds(encode_words, MAX_PIECES)


def _encode_slice(table: WordIds, data: memoryview, text_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts that end at ``text_ends``, and the ids of each.

    Bytes are cut into words and gaps, and words further into runs of letters, digits and signs, with A-Z folded, so that there are few
    distinct pieces. A word stays as it is where a cut or fold could matter: with an apostrophe, a special token's ``<|``, controls, or
    characters that combine or change in number.
    """
    if not len(data):
        return np.empty(0, np.int32), np.zeros(len(text_ends), np.int64)
    raw = np.frombuffer(data, np.uint8).copy()
    points = np.frombuffer(str(data, "utf-8").encode("utf-32-le"), np.uint32)
    at = None  # the byte of each character, where they differ
    if len(points) < len(raw):
        width = np.uint8(1) + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        at = np.cumsum(width, dtype=np.int32) - width
    text_starts = text_ends[text_ends < len(raw)]
    gap = (points == ord(" ")) | (points == ord("\n"))
    begins = gap.copy()
    begins[1:] |= gap[:-1]
    begins[0] = True
    begins[text_starts if at is None else np.searchsorted(at, text_starts)] = True
    odd = (points >= COMBINING) | (points == DOTTED_I) | (points == ord("'")) | (points < 0x20) & ~gap | (points >= 0x7F) & (points <= 0xA0)
    odd[:-1] |= (points[:-1] == ord("<")) & (points[1:] == ord("|"))
    words = np.flatnonzero(begins)
    whole = np.repeat(np.logical_or.reduceat(odd, words), np.diff(np.append(words, len(points))))
    kind = codepoint_classes()[points]
    begins[1:] |= ~whole[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == NUMBER))
    starts, upper = np.flatnonzero(begins), np.flatnonzero((points - ord("A") < 26) & ~whole)
    if at is not None:
        starts, upper = at[starts], at[upper]
    raw[upper] += 32
    cuts = np.append(starts, len(raw)).astype(np.int32)
    pieces = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(raw)]).dictionary_encode()
    ids, lens = table.gather(pieces.dictionary.to_pylist(), pieces.indices.to_numpy())
    upto = np.concatenate([[0], np.cumsum(lens)])
    return ids, np.diff(upto[np.concatenate([[0], np.searchsorted(starts, text_ends)])])


CHUNK = "part int, seq int, first bigint, doc_ids array<bigint>, n_tokens array<int>, n_ids bigint, block_words array<int>, payload binary"


def write_tokens(docs: DataFrame, to: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode every text, append ``end_id``, and write the file set ``to`` in ascending order of ``doc_id``.

    The texts are dealt into ranges of ids; ``tokenizer`` is a file of the tokenizers library that every executor can read.
    It must fold case, part words at blanks, line feeds, signs and digits, and drop blanks (a file that does not is an error), so
    that distinct pieces can be encoded once: Arrow cuts the bytes of a slice and numbers its distinct pieces, and only these
    become Python strings. Null and empty texts are the end id alone. Null ids come first; rows that share an id follow each other in
    the order of their texts, and a range may end between them. Other columns are left out. The folder ``to`` must not exist. A lost executor's range is encoded again; Spark's committer keeps whole files only.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, first, table = TaskContext.get().partitionId(), 0, 0, _encoder(tokenizer)
        for part_rows, data, text_ends, _ in text_slices(batches, "text", SLICE_BYTES):
            ids, n = _encode_slice(table, data, text_ends)
            ids = np.insert(ids, np.cumsum(n), end_id)
            words, starts = pack(ids)
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "first": pa.array([first], pa.int64()),
                "doc_ids": pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), part_rows.column(0)),
                "n_tokens": pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), pa.array(n + 1, pa.int32())),
                "n_ids": pa.array([len(ids)], pa.int64()),
                "block_words": pa.ListArray.from_arrays(pa.array([0, len(starts)], pa.int32()), pa.array(starts, pa.int32())),
                "payload": pa.array([words.astype("<u8").tobytes()], pa.binary())})
            seq += 1
            first += len(ids)

    ranges = rows.repartitionByRange("doc_id", F.substring("text", 1, 64))
    ranges.sortWithinPartitions("doc_id", "text").mapInArrow(run, CHUNK).write.parquet(to)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Read a file set: doc_id, start (ids of all documents before it), n_tokens, ids (array<int>) for each document.

    Only one total for each part of the file set reaches the driver.
    """
    chunks = spark.read.schema(CHUNK).parquet(path)
    totals = sorted((r["part"], r["n"]) for r in chunks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    before, bases = 0, {}
    for part, n in totals:
        bases[part] = before
        before += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, first, doc_ids, n_tokens, n_ids, starts, payload = (c[i].as_py() for c in batch.columns)
                ids = unpack(np.frombuffer(payload, "<u8"), np.array(starts, np.int64), n_ids).astype(np.int32)
                cuts = np.concatenate([[0], np.cumsum(n_tokens, dtype=np.int64)])
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array(bases[part] + first + cuts[:-1], pa.int64()),
                    "n_tokens": pa.array(n_tokens, pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids))})

    return chunks.drop("seq").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids array<int>")


def with_checksum(tokens: DataFrame, ids: str = "ids", into: str = "ids_crc32") -> DataFrame:
    """Add the unsigned crc32 of the ids as little-endian unsigned 32-bit integers, in place of the ids."""
    kept = [c for c in tokens.columns if c != ids]
    schema = tokens.select(*kept).withColumn(into, F.lit(0).cast("long")).schema
    at = tokens.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            flat, cuts = column.values.to_numpy(zero_copy_only=False).astype("<u4"), column.offsets.to_numpy()
            sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(sums, pa.int64())], names=[*kept, into])

    return tokens.mapInArrow(run, schema)
