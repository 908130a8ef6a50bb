"""Jaccard join of documents on word shingles by token-combination prefixes.

Tokens are shingles. Their frequency puts them in three classes: single (in one document), rare and frequent; a document's
tokens are ordered by class and then by hash, the same order for all. Linked documents of n tokens share at least o = 0.8 n of
them, so their first n - o + 1 tokens have one in common; and with the prefix made longer by m, 1 + m. Single tokens are
shared by nobody and are not indexed. Rare tokens are indexed one by one. Where the prefix reaches frequent tokens, it is made
longer by m, the frequent ones in it are dealt into m bins by hash, and every pair of them in one bin is indexed: documents that
share more than m of them share two in some bin.

Single tokens meet no other set, so the shared tokens of a set, its core, decide every overlap. Sets with equal cores overlap
in exactly that core: the smallest of them is their head, which links with whatever any of them links with. Candidates are
verified on whole cores, and only pairs with a head in them, so documents that have a passage in common and differ in words
of their own are compared with one head each and not with each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from hazardframe.llm.common import row_blocks, small_or_not, written
from hazardframe.llm.components import components

SHINGLE = 5
FREQUENT = 16  # a token in more documents is frequent; groups of a rare token are never larger
MAX_BITS = 27  # of the map of shared tokens: 16 MB at most; a full map only makes prefixes longer
COARSER = 3  # the map of frequent tokens has so many bits less: 2 MB at most
BUCKET_TOKENS = 2_000_000
FLUSH_TOKENS = 2_000_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
PIVOTS = 8  # members of a component that a set outside it is tried against before the full comparison
OUTSIDERS, OTHERS = 64, 512  # sets on either side of one block of the full comparison
MAX_CACHE = 400_000
MAX_MET = 100_000


class _Hashes(dict):
    """Hashes of words, as a cache of bounded size."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], cache: _Hashes) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's 5-word shingles; a shorter text is one shingle, one without words has none.

    Words are what stands between white space, A-Z lower-cased: both are byte operations on UTF-8.
    """
    if len(cache) > MAX_CACHE:
        cache.clear()
    words = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    n = [len(w) for w in words]
    flat = np.fromiter(map(cache.__getitem__, (w for ws in words for w in ws)), np.uint64, sum(n))
    del words
    power = np.power(MULTIPLIER, np.arange(SHINGLE, dtype=np.uint64))
    grams = np.zeros(max(0, len(flat) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        grams += flat[k:k + len(grams)] * power[k]
    grams = _mixed(grams)
    at = 0
    for m in n:
        if m >= SHINGLE:
            yield np.unique(grams[at:at + m - SHINGLE + 1])
        elif m:
            yield _mixed((flat[at:at + m] * power[:m]).sum(keepdims=True) + np.uint64(m))
        else:
            yield np.empty(0, np.uint64)
        at += m


def _key(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def _distinct_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, np.ndarray]]:
    """Key and tokens of the sets in a partition; of equal sets among the last MAX_MET only the first."""
    cache, met = _Hashes(), set()
    for _, texts in row_blocks(batches, 0):
        if len(met) > MAX_MET:
            met.clear()
        for tokens in shingle_sets(texts, cache):
            if len(tokens) and (key := _key(tokens)) not in met:
                met.add(key)
                yield key, tokens


def set_keys(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text_hash, n_shingles, key): equal sets have equal keys; the empty set has none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Hashes()
        for part, texts in row_blocks(batches, 2):
            sets = [(len(s), _key(s) if len(s) else None) for s in shingle_sets(texts, cache)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([n for n, _ in sets], pa.int64()), pa.array([k for _, k in sets], pa.binary())],
                                             names=["doc_id", "text_hash", "n_shingles", "key"])
    text_of = F.col(text).cast("string")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text_of).alias("text_hash"), text_of.alias("text")).mapInArrow(
        run, "doc_id bigint, text_hash bigint, n_shingles bigint, key binary")


def class_maps(docs: DataFrame, text: str, n_tokens: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Two bit maps over the upper ``bits`` of a token: it is (or may be) in two documents at least, and it is frequent.

    Both are of bounded size. A set bit can come from another token with the same upper bits; the class is then a later
    one for everybody, which costs work and loses nothing. Tokens travel as packed 32-bit remainders, dealt by their upper
    bits into buckets of bounded size; one met more often than FREQUENT times before a flush goes out FREQUENT + 1 times.
    """
    bits = min(MAX_BITS, max(16, math.ceil(math.log2(max(1, n_tokens) * 2))))
    bucket_bits = min(bits - COARSER - 8, max(0, math.ceil(math.log2(max(1, n_tokens) / BUCKET_TOKENS))))
    below = bits - bucket_bits

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0

        def flush() -> pa.RecordBatch:
            tokens, count = np.unique(np.concatenate(waiting), return_counts=True)
            tokens = np.repeat(tokens, np.minimum(count, FREQUENT + 1))
            rest = ((tokens << np.uint64(bucket_bits)) >> np.uint64(32)).astype("<u4")
            bucket = (tokens >> np.uint64(64 - bucket_bits)).astype(np.int32) if bucket_bits else np.zeros(len(tokens), np.int32)
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
            return pa.RecordBatch.from_pydict({"bucket": pa.array(bucket[cuts[:-1]]), "tokens": pa.array(
                [rest[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())})

        for _, tokens in _distinct_sets(batches):
            waiting.append(tokens)
            n += len(tokens)
            if n >= FLUSH_TOKENS:
                yield flush()
                waiting, n = [], 0
        if waiting:
            yield flush()

    def classify(table: pa.Table) -> pa.Table:
        rest = np.sort(np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in table.column("tokens")]))
        starts = np.flatnonzero(np.diff(rest, prepend=rest[0] ^ np.uint32(1)))
        count = np.diff(starts, append=len(rest))
        maps = []
        for least, wide in ((2, below), (FREQUENT + 1, below - COARSER)):
            mark = np.zeros(1 << wide, bool)
            mark[(rest[starts[count >= least]] >> np.uint32(32 - wide)).astype(np.int64)] = True
            maps.append(np.packbits(mark).tobytes())
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "shared": pa.array([maps[0]], pa.binary()), "frequent": pa.array([maps[1]], pa.binary())})

    rows = written(docs.select(F.col(text).cast("string").alias("text")).mapInArrow(send, "bucket int, tokens binary")
                   .groupBy("bucket").applyInArrow(classify, "bucket int, shared binary, frequent binary"))
    shared, frequent = np.zeros(1 << (bits - 3), np.uint8), np.zeros(1 << (bits - 3 - COARSER), np.uint8)
    for r in rows.toLocalIterator():  # a bucket or a few at a time beside the maps themselves
        for whole, part in ((shared, r["shared"]), (frequent, r["frequent"])):
            whole[r["bucket"] * len(part):(r["bucket"] + 1) * len(part)] = np.frombuffer(part, np.uint8)
    return shared, frequent, bits


def _bit(bitmap: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """The bit that a map of a power of two of bits has for the upper bits of each token."""
    place = (tokens >> np.uint64(64 - (len(bitmap).bit_length() + 2))).astype(np.int64)
    return (bitmap[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1


def _bins(n: int) -> int:
    """Bins for the frequent tokens of a set of n: a power of two near a fifth of n; none for sets too small to have two."""
    return 1 << ((n // 5).bit_length() - 1) if n >= 5 else 0


def core(tokens: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """The tokens that are, or may be, in another set too."""
    return tokens[_bit(shared, tokens) == 1]


def signatures(tokens: np.ndarray, shared: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """What a set is indexed by: rare tokens of its prefix, and pairs of frequent ones where the prefix reaches those."""
    n = len(tokens)
    least = -(-percent * n // 100)  # of its tokens that any linked set shares
    prefix = n - least + 1
    kind = _bit(shared, tokens).astype(np.int8)
    kind[(kind == 1) & (_bit(frequent, tokens) == 1)] = 2
    single = int((kind == 0).sum())
    if single >= prefix:
        return np.empty(0, np.int64)
    rare = tokens[kind == 1]
    often = tokens[kind == 2]
    left = prefix - single
    if len(rare) >= left:
        return rare[:left].view(np.int64)
    left -= len(rare)
    out = [rare.view(np.int64)]
    # Linked sets may be of another size and hence of a neighbouring number of bins; both then index by both.
    for m in sorted({_bins(s) for s in range(least, n * 100 // percent + 1)} if n < 64 else {_bins(least), _bins(n), _bins(n * 100 // percent)}):
        if m == 0:
            out.append(often[:left].view(np.int64))
            continue
        chosen = often[:left + m]
        bin_of = (chosen >> np.uint64(3)) & np.uint64(m - 1)
        order = np.argsort(bin_of, kind="stable")
        chosen, bin_of = chosen[order], bin_of[order]
        ends = np.searchsorted(bin_of, bin_of, side="right")
        for gap in range(1, len(chosen)):
            first = np.flatnonzero(np.arange(len(chosen)) + gap < ends)
            if not len(first):
                break
            x, y = chosen[first], chosen[first + gap]
            out.append(_mixed(x * MULTIPLIER + _mixed(y + np.uint64(m))).view(np.int64))
    return np.concatenate(out)


def index(docs: DataFrame, text: str, shared: np.ndarray, frequent: np.ndarray, percent: int) -> DataFrame:
    """(key, n, c, core, signatures, tokens) of the sets that can have a partner at all: the tokens are the c of the core, and
    equal cores have equal values of ``core``."""
    maps = docs.sparkSession.sparkContext.broadcast((shared, frequent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            key, n, c, same, sigs, sets = zip(*rows)
            return pa.RecordBatch.from_pydict({"key": pa.array(key, pa.binary()), "n": pa.array(n, pa.int64()), "c": pa.array(c, pa.int64()),
                                               "core": pa.array(same, pa.binary()), "sigs": pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sigs])]), pa.int32()), pa.array(np.concatenate(sigs))), "tokens": pa.array(sets, pa.binary())})

        for key, tokens in _distinct_sets(batches):
            sigs = signatures(tokens, *maps.value, percent)
            if len(sigs):
                inner = core(tokens, maps.value[0])
                rows.append((key, len(tokens), len(inner), _key(inner), np.unique(sigs), inner.tobytes()))
                size += len(inner) + len(sigs)
                if size > 1_000_000:
                    yield flush()
                    rows, size = [], 0
        if rows:
            yield flush()

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(
        run, "key binary, n bigint, c bigint, core binary, sigs array<bigint>, tokens binary")


def heads(indexed: DataFrame, percent: int) -> DataFrame:
    """(key, n, c, head, loose, bound) of every set once. ``head`` is the smallest set with the same core (by size, then key);
    a set is ``bound`` if it links with its head, ``loose`` if it is neither bound nor the head.

    Let x and y link and their cores be those of the heads g and h. No head is larger than its sets, so x and h, g and y, and g and h
    link as well. Links of loose sets and heads with heads, and of bound sets with their heads, hence give all components.
    """
    first = indexed.groupBy("core").agg(F.min(F.struct("n", "key")).alias("h"))
    own = indexed.select("key", "n", "c", "core").distinct().join(first, "core")
    bound = (F.col("key") != F.col("h.key")) & (100 * F.col("c") >= percent * (F.col("n") + F.col("h.n") - F.col("c")))
    return own.select("key", "n", "c", F.col("h.key").alias("head"), ((F.col("key") != F.col("h.key")) & ~bound).alias("loose"), bound.alias("bound"))


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, shared, linked) of pairs of keys: the cores are met by two equi-joins and compared as sorted arrays."""
    left = pairs.join(sets.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta")), "a")
    both = left.join(sets.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb")), "b").select("a", "b", "ta", "tb", (F.col("na") + F.col("nb")).alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common, linked = [], []
            for x, y, sizes in zip(batch.column(2), batch.column(3), batch.column(4).to_pylist()):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                n = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                common.append(n)
                linked.append(100 * n >= percent * (sizes - n))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common, pa.int64()), pa.array(linked, pa.bool_())], names=["a", "b", "shared", "linked"])

    return both.mapInArrow(run, "a binary, b binary, shared bigint, linked boolean")


def _possible(p: str, q: str, percent: int) -> str:
    """Whether sets of n tokens, c of them in the core, could link if the smaller core lay in the other."""
    return f"100 * least({p}c, {q}c) >= {percent} * ({p}n + {q}n - least({p}c, {q}c))"


def _outsiders(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (sig, key, root): the rows of signatures that still have several components, and (key, root, pool) of their sets
    outside the signature's largest component, which is the pool. Counts are summed before they are shuffled."""
    largest = (placed.groupBy("sig", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("sig")
               .agg(F.max(F.struct("c", "root")).alias("m"), F.count(F.lit(1)).alias("k")).filter("k > 1").select("sig", F.col("m.root").alias("pool")))
    split = written(placed.join(largest, "sig"))
    return split.select("sig", "key"), written(split.filter("root <> pool").select("key", "root", "pool").distinct())


def _sides(outside: DataFrame, nodes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Both sides (pool, heads, band, key, root) of the full comparison of outsiders of a pool with its members and other outsiders.

    Outsiders meet the heads, and outsiders that are heads meet the pool's loose members; two loose sets need no comparison.
    Sizes of linked sets are in one band or in neighbouring ones.
    """
    band = F.floor(F.log("n") / math.log(100.1 / percent)).cast("int")
    inside = nodes.join(outside.select(F.col("pool").alias("root")).distinct(), "root").select(F.col("root").alias("pool"), "key", "root", "loose", band.alias("band"))
    out = outside.join(nodes.select("key", "loose", band.alias("band")), "key").select("pool", "key", "root", "loose", "band")
    right = (inside.unionByName(out.filter("NOT loose")).withColumn("heads", ~F.col("loose"))).select("pool", "heads", "band", "key", "root")
    left = (out.withColumn("heads", F.explode(F.when(F.col("loose"), F.array(F.lit(True))).otherwise(F.array(F.lit(True), F.lit(False)))))
            .withColumn("band", F.explode(F.array(*[F.col("band") + i for i in (-1, 0, 1)]))).select("pool", "heads", "band", "key", "root"))
    return left, right


def _compare_blocks(outside: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the two sides of :func:`_sides`, one for each set on the left and component met.

    Both sides are dealt by hash into blocks of bounded size and each pair of blocks is one group, so a pool of any size is
    compared without a row for each pair and without a large group.
    """
    group = ["pool", "heads", "band"]
    outsiders, others = (written(side) for side in _sides(outside, nodes, percent))
    sizes = (others.groupBy(*group).agg(F.count(F.lit(1)).alias("all")).join(outsiders.groupBy(*group).agg(F.count(F.lit(1)).alias("out")), group)
             .select(*group, F.ceil(F.col("out") / OUTSIDERS).cast("int").alias("rows"), F.ceil(F.col("all") / OTHERS).cast("int").alias("cols")))

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        place = F.pmod(F.xxhash64("key", F.lit(own)), F.col(own)).cast("int")
        return (rows.join(sizes, group).select(*group, "key", "root", place.alias("own"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("other"))
                .join(sets, "key").select(*group, F.col("own").alias(own), F.col("other").alias(other), "key", "root", "n", "tokens"))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = [], []
        if left.num_rows and right.num_rows:
            parts = [np.frombuffer(x.as_buffer(), np.uint64) for x in right["tokens"]]
            n_tokens = right["n"].to_numpy()
            flat = np.concatenate(parts)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], np.repeat(np.arange(len(parts)), [len(x) for x in parts])[order]
            keys, roots = right["key"].to_pylist(), right["root"].to_pylist()
            for key, root, size, tokens in zip(left["key"].to_pylist(), left["root"].to_pylist(), left["n"].to_pylist(), left["tokens"]):
                tokens = np.frombuffer(tokens.as_buffer(), np.uint64)
                lo, hi = np.searchsorted(flat, tokens, side="left"), np.searchsorted(flat, tokens, side="right")
                n = hi - lo
                met = owner[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
                common = np.bincount(met, minlength=len(parts))
                found = {}
                for i in np.flatnonzero(100 * common >= percent * (n_tokens + size - common)).tolist():
                    if roots[i] != root:
                        found.setdefault(roots[i], keys[i])
                a += [key] * len(found)
                b += list(found.values())
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    by = [*group, "rows", "cols"]
    names = [*by, "key", "root", "n", "tokens"]
    left, right = dealt(outsiders, "rows", "cols").select(*names).toDF(*names), dealt(others, "cols", "rows").select(*names).toDF(*names)
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(compare, "a binary, b binary")


def similar_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """One row for each row of ``docs``: doc_id, text_hash, n_shingles, component_id (the smallest id reachable by links) and
    whether it is the first of its component (by id, nulls last, then text hash).

    Documents link when their sets of 5-word shingles have a Jaccard similarity of ``percent`` / 100 or more. Texts that
    are null or without words have no shingles and link with nothing, not even each other. Equal sets are one node from
    the start, so copies are never paired; a null id takes part like any other, but names a component only if no other
    member has an id. Repeated rows get equal rows.

    Sets that link with the head of their core are settled at once (:func:`heads`). Three steps find all links of heads with
    heads and loose sets that matter for the components. First every signature's sets are compared with one head among them.
    Then the sets that are not in the largest component of one of their signatures are tried against a few heads of it.
    Both join most members of a family of near copies. What is then still outside is compared, in blocks, with that
    component and the others outside it, as far as a head takes part. Two linked sets share a signature, so they are in one
    component, or one is outside the component of the other, or both are outside the same one: no link between components
    is left out, and no pair within a component is looked for.
    """
    keys = written(set_keys(docs, doc_id, text))
    n_tokens = keys.agg(F.sum("n_shingles")).collect()[0][0] or 0
    empty = keys.filter("key IS NULL").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("first"))
    if not n_tokens:
        return empty
    shared, frequent, _ = class_maps(docs, text, n_tokens)
    indexed = written(index(docs, text, shared, frequent, percent))
    kinds = written(heads(indexed, percent))
    bound = kinds.filter("bound").select(F.col("head").alias("a"), F.col("key").alias("b"))
    free = small_or_not(kinds.filter("NOT bound").select("key", "loose"))
    entries = indexed.join(free, "key").select("key", "n", "c", "loose", F.explode("sigs").alias("sig"))
    # A signature without a head or of one set is of no use. Min and max see through equal sets from different batches.
    pivots = (entries.groupBy("sig").agg(F.min(F.struct("loose", "key", "n", "c")).alias("p"), F.min("key").alias("l"), F.max("key").alias("q"))
              .filter("l <> q AND NOT p.loose").select("sig", "p"))
    useful = written(entries.join(pivots, "sig").distinct())
    sets = written(indexed.select("key", "n", "tokens").join(useful.select("key").distinct(), "key", "left_semi").groupBy("key", "n").agg(F.first("tokens").alias("tokens")))
    stars = useful.filter("key <> p.key").filter(_possible("", "p.", percent)).select(F.col("p.key").alias("a"), F.col("key").alias("b")).distinct()
    checked = written(verify(stars, sets, percent))
    links = checked.filter("linked").select("a", "b")
    sizes = written(useful.select("key", "n", "c", "loose").distinct())
    placed = lambda links: written(sizes.join(components(links).withColumnRenamed("node", "key"), "key", "left")
                                   .select("key", "n", "c", "loose", F.coalesce("root", "key").alias("root")))
    nodes = placed(links)
    split, outside = _outsiders(useful.select("sig", "key").join(nodes.select("key", "root"), "key"))
    pivots = nodes.filter("NOT loose").groupBy("root").agg(F.array_distinct(F.array(*[F.min_by(F.struct("key", "n", "c"), F.xxhash64("key", F.lit(i))) for i in range(PIVOTS)])).alias("p"))
    tries = (outside.join(sizes.select("key", "n", "c"), "key").join(pivots.select(F.col("root").alias("pool"), F.explode("p").alias("p")), "pool")
             .filter(_possible("", "p.", percent)).select(F.least("key", "p.key").alias("a"), F.greatest("key", "p.key").alias("b")).distinct())
    links = written(links.union(verify(tries, sets, percent).filter("linked").select("a", "b")))
    nodes = placed(links)
    _, outside = _outsiders(split.join(nodes.select("key", "root"), "key"))
    links = links.union(_compare_blocks(outside, nodes, sets, percent)).union(bound)
    own = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "text_hash")
    members = keys.filter("key IS NOT NULL").groupBy("key").agg(F.min(own).alias("first"))
    named = written(members.join(components(links).withColumnRenamed("node", "key"), "key", "left")
                    .select("key", F.coalesce("root", "key").alias("root"), "first"))
    firsts = named.join(named.groupBy("root").agg(F.min("first").alias("of_all")), "root").select("key", "of_all")
    return (keys.filter("key IS NOT NULL").join(firsts, "key")
            .select("doc_id", "text_hash", "n_shingles", F.col("of_all.doc_id").alias("component_id"), own.eqNullSafe(F.col("of_all")).alias("first"))
            .union(empty))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near duplicates: the first document of each component stays, all columns as they are.

    Rows that repeat both id and text are one document, of which one row stays. Documents without words all stay.
    """
    found = written(similar_components(docs, doc_id, text, percent))
    repeated = small_or_not(found.filter("first").groupBy("doc_id", "text_hash").count().filter("count > 1").select("doc_id", "text_hash"))
    gone = small_or_not(found.filter("NOT first").select("doc_id", "text_hash").union(repeated).distinct())
    is_in = lambda t: F.col(f"d.`{doc_id}`").cast("long").eqNullSafe(F.col(f"{t}.doc_id")) & (
        F.xxhash64(F.col(f"d.`{text}`").cast("string")) == F.col(f"{t}.text_hash"))
    kept = docs.alias("d").join(gone.alias("g"), is_in("g"), "left_anti")
    if repeated.isEmpty():
        return kept
    return kept.union(docs.alias("d").join(repeated.alias("r"), is_in("r"), "left_semi").dropDuplicates([doc_id, text]))
