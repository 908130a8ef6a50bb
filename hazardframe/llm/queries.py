"""Registered queries of the text operators and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hazardframe.llm import byte_bpe, conversation_trie, decontaminate, html_text, jaccard_join, language_id, merkle_manifest, pii, quality, secrets, sentencepiece_viterbi, token_binary, url_filter
from hazardframe.llm.common import shared_folder

QUERIES = {}
ORACLE = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# Fixed values of the contract: host, path, verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]


@query
def op1_url_filters(spark, sf_dir):
    """Every page's url against the list of rules."""
    listed = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = url_filter.url_filter(_read(spark, sf_dir, "pages").select("page_id", "url"), listed)
    return judged.select("page_id", "url_rule.*")


ORACLE["op1_url_filters"] = """
WITH u AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                            ('net', '/es/', 'block'), ('net', '/fr/', 'block')) AS t(rh, rp, v)),
f AS (SELECT h.page_id, h.host, h.path, r.rh || r.rp AS rule, r.v,
             row_number() OVER (PARTITION BY h.page_id ORDER BY length(r.rh || r.rp) DESC NULLS LAST) AS k
      FROM h LEFT JOIN r ON (h.host = r.rh OR ends_with(h.host, '.' || r.rh)) AND starts_with(h.path, r.rp))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM f WHERE k = 1
"""


@query
def op10_quality_rules(spark, sf_dir):
    """Counts and verdicts of the line-first quality rules for every document."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.line_first_cleaning(docs).select(
        "doc_id", *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


ORACLE["op10_quality_rules"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM (
        SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5))),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM g, range(0, 5) AS o(k) WHERE c >= 2 GROUP BY doc_id),
c AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
             coalesce(r.n, 0)::BIGINT AS n_repeat_words, l,
             list_filter(l, lambda x: NOT (
               len(regexp_extract_all(x, '[#*$%&|<>]')) > 0.2 * len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))
               OR len(regexp_extract_all(x, '[!?]')) > greatest(1, 0.3 * len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')))
               OR (len(regexp_extract_all(x, '[»›•·→]|(^|[ ])[/>|-]([ ]|$)')) * 3 > len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))
                   AND len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) > 2)
               OR (len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) <= 15 AND regexp_matches(x, '(?i)(all rights reserved|terms of (use|service)|privacy policy|cookie (policy|settings)|uses? cookies|enable javascript|sign (in|up)\b|log ?in\b|subscribe|newsletter|read more|click here|skip to (main )?content|back to top|share (this|on)|powered by|copyright \(?c?\)?)')))) AS good
      FROM w LEFT JOIN r USING (doc_id)),
v AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
             coalesce(list_sum(list_transform(l, lambda x: length(x))), 0) AS chars, coalesce(list_sum(list_transform(good, lambda x: length(x))), 0) AS kept_chars FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND kept_chars >= 0.5 * chars) AS kept FROM v
"""


@query
def op4_token_binary(spark, sf_dir):
    """All documents as token ids in the binary format, written, read back and summed up."""
    import public_tokenizers

    to = shared_folder(spark)
    token_binary.write_tokens(_read(spark, sf_dir, "documents"), to, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_binary.with_checksum(token_binary.read_tokens(spark, to))


@query
def op9_sentencepiece(spark, sf_dir):
    """Pieces of every document, their number and hash, and whether decoding gives the text back."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    back = sentencepiece_viterbi.round_trip(docs, path)
    return back.select("doc_id", F.size("pieces").cast("long").alias("n_pieces"), F.xxhash64("pieces").alias("pieces_xxh64"),
                       F.length("decoded").cast("long").alias("n_chars"), F.col("decoded").eqNullSafe(F.coalesce("text", F.lit(""))).alias("round_trip"))


@query
def op5_language_id(spark, sf_dir):
    """Language of every document; a quarter of the documents is held out of the fit."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = language_id.fit(docs.filter(~held_out))
    return language_id.predict(docs.select("doc_id", "text", held_out.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


@query
def op6_decontamination(spark, sf_dir):
    """Benchmark windows in every document."""
    found = decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE["op6_decontamination"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS g
       FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)),
h AS (SELECT DISTINCT doc_id, dw.m, i, item_id FROM dw JOIN bw USING (m, g)),
n AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT doc_id, m, i FROM h), range(0, 10) AS o(k) WHERE k < m GROUP BY doc_id),
t AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM h GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query
def op2_secret_scans(spark, sf_dir):
    """Secrets in every document: counts and places of the base kinds, and the places of all kinds."""
    found = secrets.scan(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [r.kind for r in secrets.BASE]
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, base), F.sha2(_listed(F.filter("secrets", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
                        _listed(F.col("secrets")).alias("spans"))


@query
def op7_pii(spark, sf_dir):
    """Personal data in every document: counts and places of the plain kinds, and the places of all."""
    found = pii.personal_data(_read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("pii", lambda s: s["base"])
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("pii")).alias("spans"))


@query
def op8_html_text(spark, sf_dir):
    """Main text of every page."""
    pages = html_text.main_text(_read(spark, sf_dir, "pages"), into="text").drop("html")
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op3_jaccard_join(spark, sf_dir):
    """Component of every document under links of Jaccard similarity 0.8 on 5-word shingles."""
    found = jaccard_join.similar_components(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id")


@query
def op13_byte_bpe(spark, sf_dir):
    """Byte-level BPE ids of every document, their number and hash, and the hash of the bytes that decoding them gives."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    back = byte_bpe.round_trip(docs, path)
    return back.select("doc_id", F.size("tokens.ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("tokens.ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op11_merkle_manifest(spark, sf_dir):
    """Leaf, subroot, root and proof of every document, and whether a copy with some rows tampered with still leads to the root."""
    docs = _read(spark, sf_dir, "documents")
    columns = ("doc_id", "source", "lang", "n_chars", "text")
    digest = lambda n_chars: merkle_manifest.digest(*[n_chars if c == "n_chars" else F.col(c) for c in columns])
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    rows = docs.select("doc_id", "lang", digest(F.col("n_chars")).alias("leaf"), F.when(tampered, digest(F.col("n_chars") + 1)).alias("tampered"))
    proven = merkle_manifest.witnesses(rows)
    folded = merkle_manifest.fold(F.coalesce("tampered", "leaf"), F.col("merkle.steps"))
    return (proven.select("doc_id", "leaf", "merkle.subroot", "merkle.root", merkle_manifest.proof_digest(F.col("merkle.steps")).alias("proof_sha256"),
                          folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root")))


_ITEM = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_ITEM.format(c) for c in ("doc_id", "source", "lang", "{n}", "text")) + ")"
# The sibling of node i (from 0) of a level is node xor(i, 1); the last node of an odd level has none.
ORACLE["op11_merkle_manifest"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, {_LEAF.format(n="n_chars")} AS leaf, {_LEAF.format(n="(n_chars + 1)")} AS changed,
    xor(list_reduce(list_transform(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda x: x::BIGINT),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) % 7 = 0 AS tampered FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
low AS (SELECT lang, 0 AS h, list(leaf ORDER BY i) AS nodes FROM p GROUP BY lang
  UNION ALL SELECT lang, h + 1, list_transform(range(1, len(nodes) + 1, 2), lambda k: sha256(nodes[k] || coalesce(nodes[k + 1], ''))) FROM low WHERE len(nodes) > 1),
sub AS (SELECT lang, nodes[1] AS subroot, h AS tall, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS j FROM low WHERE len(nodes) = 1),
high AS (SELECT 0 AS h, list(subroot ORDER BY j) AS nodes FROM sub
  UNION ALL SELECT h + 1, list_transform(range(1, len(nodes) + 1, 2), lambda k: sha256(nodes[k] || coalesce(nodes[k + 1], ''))) FROM high WHERE len(nodes) > 1),
walk AS (SELECT p.doc_id, p.leaf, p.lang, p.i, s.j, s.tall, s.subroot, 0 AS h, '' AS proof, CASE WHEN tampered THEN coalesce(changed, leaf) ELSE leaf END AS node
         FROM p JOIN sub s ON p.lang IS NOT DISTINCT FROM s.lang
  UNION ALL SELECT w.doc_id, w.leaf, w.lang, w.i, w.j, w.tall, w.subroot, w.h + 1, w.proof || coalesce(x.sib, ''),
         sha256(CASE WHEN x.k % 2 = 0 THEN w.node || coalesce(x.sib, '') ELSE x.sib || w.node END)
  FROM walk w, LATERAL (SELECT k, nodes[xor(k, 1) + 1] AS sib FROM (
      SELECT (w.i >> w.h)::BIGINT AS k, nodes FROM low WHERE w.h < w.tall AND low.lang IS NOT DISTINCT FROM w.lang AND low.h = w.h
      UNION ALL SELECT (w.j >> (w.h - w.tall))::BIGINT, nodes FROM high WHERE w.h >= w.tall AND high.h = w.h - w.tall AND len(nodes) > 1)) x)
SELECT doc_id, leaf, subroot, r.root, sha256(proof) AS proof_sha256, node AS folded_root, node = r.root AS verified
FROM walk, (SELECT nodes[1] AS root, h FROM high WHERE len(nodes) = 1) r WHERE walk.h = tall + r.h
"""


@query
def op12_conversation_trie(spark, sf_dir):
    """Nodes of the trie of all rebuilt conversations, with sums over their subtrees."""
    return conversation_trie.prefix_trie(_read(spark, sf_dir, "conversations"))


ORACLE["op12_conversation_trie"] = r"""
WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos,
    strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS words
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % 20 AS base,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) % 4 AS h FROM t GROUP BY conv_id),
k AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS k FROM c LEFT JOIN c b ON b.conv_id = c.base),
r AS (SELECT k.conv_id, t.pos AS depth, t.t, t.words FROM k JOIN t ON t.conv_id = k.base AND t.pos <= k.k
  UNION ALL SELECT k.conv_id, t.pos - k.h + k.k, t.t, t.words FROM k JOIN t ON t.conv_id = k.conv_id AND t.pos > k.h),
l AS (SELECT k.conv_id, k.k + greatest(0, k.n - k.h) AS length FROM k),
p AS (SELECT conv_id, 0::BIGINT AS depth, '' AS up, '' AS key, 0::BIGINT AS words FROM l
  UNION ALL SELECT p.conv_id, p.depth + 1, p.key, sha256(p.key || ':' || r.t), r.words FROM p JOIN r ON r.conv_id = p.conv_id AND r.depth = p.depth + 1),
g AS (SELECT key, depth, any_value(up) AS up, min(p.conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved,
    sha256(coalesce(string_agg(CASE WHEN depth = length THEN p.conv_id::VARCHAR END, ',' ORDER BY p.conv_id), '')) AS ends_sha256
  FROM p JOIN l ON l.conv_id = p.conv_id GROUP BY key, depth),
n AS (SELECT g.*, (SELECT count(*) FROM g x WHERE x.up = g.key AND x.depth = g.depth + 1) AS n_children FROM g),
w AS (SELECT key AS top, depth AS d, up, (n_children = 0)::BIGINT AS leaf, saved FROM n
  UNION ALL SELECT n.key, n.depth, n.up, w.leaf, w.saved FROM w JOIN n ON n.key = w.up AND n.depth = w.d - 1),
s AS (SELECT top, d, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM w GROUP BY top, d)
SELECT n.conv_id, n.depth, m.conv_id AS parent_conv_id, n.n_convs, n.n_children::BIGINT AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM n JOIN s ON s.top = n.key AND s.d = n.depth LEFT JOIN n m ON m.key = n.up AND m.depth = n.depth - 1
"""
