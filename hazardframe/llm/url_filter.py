"""URL filters: a blocked Bloom filter lets possible hits through to an exact join with the list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hazardframe.llm.common import ascii_lower

MAX_BLOCKS = 1 << 15  # of 256 bits: the filter is 1 MB at most; longer lists only raise its false-positive rate
KEYS_PER_BLOCK = 16
BROADCAST_ROWS = 100_000  # a longer list is joined by a shuffle with salted keys; the rows are the same
SALTS = 32


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _place(key: Column, n_blocks: int) -> list[Column]:
    """The block of a key and its four bits, one in each of the block's four words."""
    spots = F.xxhash64(key, F.lit("bits"))
    return [F.pmod(F.xxhash64(key), F.lit(n_blocks)).alias("block"),
            *[F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(spots, 6 * j).bitwiseAND(F.lit(63)).cast("int")).alias(f"b{j}") for j in range(4)]]


def blocked_bloom(keys: DataFrame, key: str, n_keys: int) -> DataFrame:
    """(block, w0..w3): one row for each used block; at most ``MAX_BLOCKS`` rows whatever the list's length."""
    n_blocks = _n_blocks(n_keys)
    return (keys.select(*_place(F.col(key), n_blocks)).groupBy("block")
            .agg(*[F.bit_or(f"b{j}").alias(f"w{j}") for j in range(4)]))


def _n_blocks(n_keys: int) -> int:
    return min(MAX_BLOCKS, max(1, 1 << max(0, (n_keys // KEYS_PER_BLOCK)).bit_length()))


def url_filter(pages: DataFrame, listed: DataFrame, url: str = "url", into: str = "url_rule", default: str = "allow",
               broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Judge every row of ``pages`` by the list (host, path, verdict); adds a struct (host, path, rule, verdict).

    A listed url fits its host and all subdomains when the row's path starts with the listed path; the longest one wins (on
    equal length the one with the longer host). Urls that fit nothing get ``default``. The keys a url could be listed
    under are made only in the shapes (labels of the host, length of the path) that occur in the list, probed against
    the Bloom filter, and the possible hits meet the list in an exact equi-join.

    Distinct (host, path) pairs are judged once, so a hot url is one row there; the pairs are then joined back, a join
    whose hot keys Spark can split. A null url or one without ``://`` has empty host and path. Rows repeated in the list
    count once, and of contradicting verdicts the alphabetically last one (block) holds. An empty list judges all rows
    by ``default``. A column already named ``into`` is replaced.
    """
    rules = (listed.select(ascii_lower(F.coalesce(F.col("host"), F.lit(""))).alias("rule_host"), F.coalesce(F.col("path"), F.lit("")).alias("rule_path"), "verdict")
             .filter(F.col("rule_host") != "").groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict"))
             .withColumn("rule", F.concat("rule_host", "rule_path"))
             .withColumn("labels", F.size(F.split("rule_host", r"\."))).withColumn("path_chars", F.length("rule_path")))
    # A handful of aggregates: how long the list is and in which shapes it comes (lengths of urls, hence few).
    shapes = rules.groupBy("labels", "path_chars").agg(F.count(F.lit(1)).alias("n")).collect()
    n_rules = sum(s["n"] for s in shapes)
    base = pages.drop(into).withColumn(into, F.struct(host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")))
    pairs = base.select(F.col(f"{into}.host").alias("host"), F.col(f"{into}.path").alias("path")).distinct()
    if not shapes:
        verdicts = pairs.select("host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    else:
        labels = F.split("host", r"\.")
        key = lambda n, c: F.when((F.size("labels") >= n) & (F.length("path") >= c), F.concat(
            F.array_join(F.slice("labels", F.size("labels") - n + 1, n), "."), F.substring("path", 1, c)))
        shaped = F.filter(F.array(*[F.struct(key(s["labels"], s["path_chars"]).alias("key"), F.lit(s["labels"]).alias("labels"))
                                    for s in shapes]), lambda k: k["key"].isNotNull())
        n_blocks = _n_blocks(n_rules)
        bloom = blocked_bloom(rules, "rule", n_rules)
        possible = (pairs.withColumn("labels", labels).select("host", "path", F.explode(shaped).alias("k"))
                    .select("host", "path", F.col("k.key").alias("rule"), F.col("k.labels").alias("labels"), *_place(F.col("k.key"), n_blocks))
                    .join(F.broadcast(bloom), "block")
                    .filter(" AND ".join(f"(w{j} & b{j}) != 0" for j in range(4))).select("host", "path", "rule", "labels"))
        exact = rules.select("rule", "labels", "verdict")
        if n_rules <= broadcast_rows:
            hits = possible.join(F.broadcast(exact), ["rule", "labels"])
        else:
            salted = exact.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            hits = (possible.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int"))
                    .join(salted, ["rule", "labels", "salt"]))
        verdicts = (hits.groupBy("host", "path")
                    .agg(F.max(F.struct(F.length("rule").alias("n"), "labels", "rule", "verdict")).alias("m"))
                    .select("host", "path", "m.rule", "m.verdict"))
    verdicts = verdicts.select(F.struct("host", "path", "rule", "verdict").alias("judged"))
    joined = base.alias("b").join(verdicts.alias("v"), (F.col(f"b.{into}.host") == F.col("v.judged.host"))
                                  & (F.col(f"b.{into}.path") == F.col("v.judged.path")), "left")
    return joined.select(*[F.col(f"b.`{c}`") for c in base.columns if c != into], F.struct(
        F.col(f"b.{into}.host").alias("host"), F.col(f"b.{into}.path").alias("path"), F.col("v.judged.rule").alias("rule"),
        F.coalesce(F.col("v.judged.verdict"), F.lit(default)).alias("verdict")).alias(into))
