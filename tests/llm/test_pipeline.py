"""The pipeline's rows against a brute-force version, and the registered queries against their SQL."""

import pytest
import public_tokenizers

import corpus_pipeline
from compare import compare, duck
from hazardframe.llm import queries
from test_decontaminate import brute as windows_of
from test_jaccard_join import brute as components_of

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    import re

    import sentencepiece

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.quality_rules(spark, docs, SF)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    rows = [(r.doc_id, r.text) for r in kept.orderBy("doc_id").collect()]
    first = {k for k, _, c in components_of(rows) if k == c}
    rows = [r for r in rows if r[0] in first]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [r for r, w in zip(rows, windows_of(rows, items)) if not w[4]]
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    kinds = r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8,}|AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}"""
    want = {i: model.encode(re.sub(kinds, "[SECRET]", t)) for i, t in rows}
    got = {r.doc_id: r.pieces for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want


def test_stages_keep_the_columns_and_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0


def test_the_last_stage_decodes_its_pieces(spark):
    rows = [(1, "two words"), (2, ""), (3, None), (4, "é\n\tx  y \U0001f600")]
    name, stage = corpus_pipeline.STAGES[-1]
    got = {r.doc_id: (r.n_pieces, len(r.pieces), r.round_trip) for r in stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()}
    assert name == "SentencePiece encoding and decoding" and sorted(got) == [1, 2, 3, 4]
    assert all(n == k and back for n, k, back in got.values())


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SF), duck(SF), queries.ORACLE[name]) is None


def test_all_thirteen_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
