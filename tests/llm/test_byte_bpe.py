import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from conftest import SF

from hazardframe.llm import byte_bpe, queries

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
EDGE = [None, "", " ", "  ", "\n", " \n x", "'", "''s", " 's", "\n's", "it's he'll we've I'm 're'ré", "'S'T", "a'", "'l", "x'l", "'v\n", "x" * 5000,
        "=" * 3000, " " * 2000 + "y", "的一是" * 300, "á 　b", "12²Ⅷ½", "\U0001f600\U0001f1e9\U0001f1ea é", "\x1c\x85", "Ᲊx"]


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def some_texts(n=500, seed=5):
    rnd = random.Random(seed)
    parts = ["'", "s", "t", "re", "ve", "ll", "d", " ", "  ", "\n", "\t", "1", "23", "the ", " of", "é", "的", "!", "…", "'s", "　", "\x85", "²", "\U0001f600", "ing"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


def test_ids_are_the_librarys_and_decoding_gives_the_text_back(docs, library):
    texts = EDGE + some_texts()
    coded = byte_bpe.encode(docs(list(enumerate(texts))), RANKS)
    rows = byte_bpe.decode(coded, RANKS, into="pieces").orderBy("doc_id").collect()
    assert len(rows) == len(texts)
    for r, t in zip(rows, texts):
        t = t or ""
        assert r.tokens.ids == library.encode_ordinary(t), t
        assert bytes(r.pieces) == t.encode()
        ends = r.tokens.starts[1:] + [len(t.encode())] if t else []
        assert [t.encode()[a:b] for a, b in zip(r.tokens.starts, ends)] == [library.decode_single_token_bytes(i) for i in r.tokens.ids]
        assert r.n == 1 and r.quality == "x"


def test_slices_begin_where_the_pattern_says_in_many_texts_at_once():
    import regex

    texts = [t for t in EDGE if t] + some_texts(300, 7)
    pattern = regex.compile(public_tokenizers.PATTERN)
    points = np.array([ord(c) for t in texts for c in t], np.uint32)
    ends = np.cumsum([len(t) for t in texts])
    first = np.zeros(len(points) + 1, bool)
    first[np.concatenate([[0], ends[:-1]])] = True
    want = [m.start() + e - len(t) for t, e in zip(texts, ends) for m in pattern.finditer(t)]
    assert byte_bpe.slice_starts(points, first[:-1]).tolist() == want


def test_classes_of_all_code_points_are_the_librarys():
    """One rank for each pair of a class's member and a first byte: the pair merges only inside a slice."""
    import tiktoken

    ranks = {bytes([i]): i for i in range(256)}
    for head in b"a1!":
        ranks |= {bytes([head, b]): len(ranks) + b for b in range(256)}
    own = tiktoken.Encoding("classes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    classes = byte_bpe.codepoint_classes()
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for kind, head in ((byte_bpe.LETTER, "a"), (byte_bpe.NUMBER, "1"), (byte_bpe.OTHER, "!")):
        assert [own.encode_ordinary(head + chr(c))[0] >= 256 for c in points] == (classes[points] == kind).tolist()


def test_composition_of_transition_functions_is_associative():
    _, compose, elements, _ = byte_bpe._machine()
    k = range(len(compose))
    assert all(compose[compose[a, b], c] == compose[a, compose[b, c]] for a in k for b in k for c in k)
    assert all(elements[compose[a, b]].tolist() == elements[b][elements[a]].tolist() for a in k for b in k)


def test_merging_alone_and_side_by_side(library):
    vocabulary = byte_bpe.Vocabulary(RANKS)
    rnd = random.Random(3)
    words = sorted({bytes(rnd.choice(b"aeinrst \xc3\xa9") for _ in range(rnd.randint(1, 60))) for _ in range(3000)} | {b"ab" * 200, b"-" * 333, b"q" * 101})
    flat, lens = vocabulary._merge_all(words)
    for w, ids in zip(words, np.split(flat, np.cumsum(lens)[:-1])):
        assert ids.tolist() == byte_bpe.merge(w, vocabulary.ranks) == byte_bpe._merge_long(w, vocabulary.ranks) or w in vocabulary.ranks, w
        assert b"".join(vocabulary.tokens[int(i)].as_py() for i in ids) == w


def test_tokens_that_do_not_fit_their_places_are_an_error(docs):
    coded = byte_bpe.encode(docs([(1, "some words here")]), RANKS)
    broken = coded.selectExpr("doc_id", "named_struct('ids', reverse(tokens.ids), 'starts', tokens.starts) AS tokens")
    with pytest.raises(Exception, match="do not fit"):
        byte_bpe.decode(broken, RANKS).collect()


def test_null_tokens_and_empty_tables(docs):
    coded = byte_bpe.encode(docs([(1, "x")]), RANKS)
    none = coded.selectExpr("doc_id", "IF(doc_id < 0, tokens, NULL) AS tokens")
    assert [bytes(r.decoded) for r in byte_bpe.decode(none, RANKS).collect()] == [b""]
    assert byte_bpe.decode(byte_bpe.encode(docs([]), RANKS), RANKS).collect() == []


def test_one_pass_gives_the_same_as_two(docs):
    rows = docs(list(enumerate(EDGE + some_texts(50, 11)))).repartition(3)
    two = byte_bpe.decode(byte_bpe.encode(rows, RANKS).drop("text"), RANKS)
    assert sorted(map(repr, byte_bpe.round_trip(rows, RANKS).collect())) == sorted(map(repr, two.collect()))


def test_query(spark, library):
    rows = queries.op13_byte_bpe(spark, SF).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
