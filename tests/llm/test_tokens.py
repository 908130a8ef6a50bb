import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from hazardframe.llm import sentencepiece_viterbi as sv
from hazardframe.llm import token_binary as tb
from hazardframe.llm.common import shared_folder
from hazardframe.llm.word_ids import WordIds

MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def some_texts(n=300, seed=2):
    rnd = random.Random(seed)
    letters = "abcthe ionering▁  \n\t0123éñ一是\U0001f600Ω.,'\"-()"
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 70))) for _ in range(n)]


EDGE = [None, "", " ", "  ", "\n\n", "a" * 300, " " * 70, "b" + " " * 37 + "c", "的一是" * 300, "abababab" * 30, "x" * 5000, "ththth " * 20, "A  B", "　 "]


def test_encoding_is_the_librarys_and_decoding_gives_the_text_back(docs, library):
    texts = EDGE + some_texts()
    encoded = sv.encode(docs(list(enumerate(texts))), MODEL)
    rows = sv.decode(encoded, MODEL, into="back").orderBy("doc_id").collect()
    for r, t in zip(rows, texts):
        assert r.pieces == library.encode(t or ""), t
        assert r.back == (t or "").replace("▁", " ") == library.decode(r.pieces) or "▁" in (t or "")
        assert r.n == 1 and r.quality == "x"


def test_one_pass_gives_the_same_as_two_and_foreign_ids_decode(docs, library):
    texts = EDGE + ["▁", "▁ a", "a▁b\n▁", "\n x"] + some_texts(80, 12)
    rows = docs(list(enumerate(texts))).repartition(3)
    two = sv.decode(sv.encode(rows, MODEL), MODEL, into="decoded").drop("n")
    assert sorted(map(repr, sv.round_trip(rows, MODEL).drop("n").select(two.columns).collect())) == sorted(map(repr, two.collect()))
    pieces = sv.Pieces(MODEL)
    by_hand = [[int(pieces.bytes[0xC3])], [29871, int(pieces.bytes[0xC3]), 5], [], None, library.encode("né")[1:]]
    df = rows.sparkSession.createDataFrame(list(enumerate(by_hand)), "doc_id int, pieces array<int>")
    assert [r.text for r in sv.decode(df, MODEL).orderBy("doc_id").collect()] == [pieces.decode(x) if x else "" for x in by_hand]


def test_words_are_the_same_alone_and_in_a_batch(library):
    pieces = sv.Pieces(MODEL)
    words = sorted({w for t in some_texts(100, 4) for w in pieces.words(t)})
    flat, n = pieces.encode_words(words)
    for w, ids in zip(words, np.split(flat, np.cumsum(n)[:-1])):
        alone, _ = pieces.encode_words([w])
        assert alone.tolist() == ids.tolist()


def test_the_word_table_may_start_anew_at_any_time():
    table = WordIds(lambda ws: (np.array([len(w) for w in ws]), np.ones(len(ws), np.int64)), most=3)
    for _ in range(4):
        ids, n = table.encode([["a", "bb", "ccc"], [], ["dddd", "a"]])
        assert ids.tolist() == [1, 2, 3, 4, 1] and n.tolist() == [3, 0, 2]


@pytest.mark.parametrize("n", [0, 1, 5, 1023, 1024, 1025, 5000])
def test_simple8b_round_trip(n):
    rng = np.random.default_rng(n)
    wide = rng.integers(0, 2**64 - 1, n, dtype=np.uint64)
    wide[1::3] = 0xF000000000000001  # looks like an escape itself
    for values in (rng.integers(0, 49408, n), rng.integers(0, 2, n), np.zeros(n), 2 ** rng.integers(0, 63, n), wide):
        words, starts = tb.pack(values.astype(np.uint64))
        assert (tb.unpack(words, starts, n) == values.astype(np.uint64)).all()


def test_simple8b_takes_few_words():
    assert len(tb.pack(np.zeros(1024))[0]) == 5 and len(tb.pack(np.full(1024, 32767))[0]) == 256


def test_file_set(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    texts = [None, "", "Hello, World's  end\nIt's <|endoftext|> 42é́ ΣΣ xΣ", "tab\there", "a" * 3000] + some_texts(60, 9)
    rows = [(i * 7 % 65, t) for i, t in enumerate(texts)] + [(None, "null id"), (5, "a second row of five")]
    to = shared_folder(spark)
    tb.write_tokens(docs(rows).repartition(5), to, WORDS, end_id=2)
    got = sorted((tuple(r) for r in tb.with_checksum(tb.read_tokens(spark, to)).collect()), key=lambda r: r[1])
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_empty_tables(spark, docs):
    to = shared_folder(spark)
    tb.write_tokens(docs([]), to, WORDS, end_id=2)
    assert tb.with_checksum(tb.read_tokens(spark, to)).count() == 0
    assert sv.decode(sv.encode(docs([]), MODEL), MODEL, into="back").count() == 0
