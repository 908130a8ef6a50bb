"""Running totals, ranks and exact quantiles over orderings that may not fit in one task.

A window without ``partitionBy`` (or over one huge group) runs in a single task. The functions here cut the
ordering key into value ranges that hold a bounded number of rows each, run the window inside a range, and
add what the earlier ranges contribute. Tables are expected to hold **one row per (group, key)**: aggregate
first, then order.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from hazardframe.session import cut_lineage, settle

ROWS_PER_RANGE = 200_000
BROADCAST_ROWS = 100_000  # a few numbers per row: some megabytes


def match(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which nulls match nulls; the keys come from the left side.

    Without keys ``right`` is a one-row aggregate, and its values become literals.
    """
    if not keys:
        row = right.first()
        return left.withColumns({f.name: F.lit(row[f.name]).cast(f.dataType) for f in right.schema.fields})
    renamed = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys],
                           *[F.col(c) for c in right.columns if c not in keys])
    maybe = {f.name for d in (left, right) for f in d.schema.fields if f.nullable}
    # Plain equality keeps the hash partitioning reusable by what follows, so it is used wherever nulls are ruled out.
    same = lambda k: left[k].eqNullSafe(renamed[f"__r_{k}"]) if k in maybe else left[k] == renamed[f"__r_{k}"]
    on = reduce(lambda a, b: a & b, [same(k) for k in keys])
    return left.join(renamed, on, how).drop(*[f"__r_{k}" for k in keys])


def match_stats_left(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """:func:`match_stats` that keeps the rows of ``left`` without a partner."""
    table, n = settle(right)
    return match(left, F.broadcast(table) if n <= BROADCAST_ROWS else table, keys, "left")


def match_stats(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """:func:`match` with a table of per-group statistics, so that ``left`` need not be shuffled by its group.

    The statistics are written and counted first and sent to all executors only up to ``BROADCAST_ROWS`` rows. Beyond
    that there are many groups and the shuffled join, split by Spark where a group is hot, takes over.
    """
    if not keys:
        return match(left, right, keys)
    table, n = settle(right)
    return match(left, F.broadcast(table) if n <= BROADCAST_ROWS else table, keys)


@dataclass(frozen=True)
class Places:
    """Ranges of ``size`` places in each group's own order, for ``n`` rows; false when one range holds them all."""

    n: int
    size: int

    def __bool__(self) -> bool:
        return self.n > self.size


def range_bounds(df: DataFrame, key: str, n: int, rows_per_range: int = ROWS_PER_RANGE) -> Places:
    """How :func:`running` has to cut ``n`` rows; nothing is looked up, as the cuts are places and not values."""
    return Places(n, rows_per_range)


def range_of(key: Column, bounds: list[float]) -> Column:
    """Number of boundaries ``<= key``: two probes of about sqrt(len(bounds)) comparisons each."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds) - 1) + 1
    chunks = [bounds[i:i + step] for i in range(0, len(bounds), step)]
    heads = F.array(*[F.lit(c[0]) for c in chunks])
    body = F.array(*[F.array(*[F.lit(v) for v in c]) for c in chunks])
    coarse = F.size(F.filter(heads, lambda b: b <= key))
    fine = F.size(F.filter(F.element_at(body, F.greatest(coarse, F.lit(1))), lambda b: b <= key))
    return F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * step + fine)


def running(df: DataFrame, by: list[str], key: str, outputs: dict[str, tuple[str, str]],
            descending: bool = False, bounds: Places | list[float] | None = None) -> DataFrame:
    """Add inclusive running values in ``key`` order, per group.

    ``outputs`` maps a new column to ``(kind, source)``: ``sum``, ``product``, ``last`` (latest non-null) or
    ``max``. ``bounds`` come from :func:`range_bounds`; without them a group must be known to be small. Windows run inside
    ranges of bounded size, and the totals of the ranges are carried on by this function itself, range over range. A list of
    values that cut the key may be given instead, where they are known.
    """
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    local = {"sum": F.sum, "product": F.product, "max": F.max,
             "last": lambda c: F.last(c, ignorenulls=True)}
    slot = "__ranges" if "__range" in df.columns else "__range"  # ranges of ranges take turns
    if not bounds:
        whole = W.partitionBy(*by).orderBy(direction(key)).rowsBetween(W.unboundedPreceding, W.currentRow)
        return df.select(*df.columns, *[local[k](F.col(s)).over(whole).alias(o) for o, (k, s) in outputs.items()])

    if isinstance(bounds, Places):
        turned = df.withColumn("__turned", -F.col(key) if descending else F.col(key))
        work = positions(turned, by, ["__turned"]).withColumn(slot, F.floor(F.col("__pos") / bounds.size)).select(*df.columns, slot)
    else:
        number = range_of(F.col(key), bounds).cast("long")
        work = df.withColumn(slot, len(bounds) - number if descending else number)
    inside = W.partitionBy(*by, slot).orderBy(direction(key)).rowsBetween(W.unboundedPreceding, W.currentRow)
    newest = F.min_by if descending else F.max_by
    whole = {"sum": F.sum, "product": F.product, "max": F.max,
             "last": lambda c: newest(c, F.when(c.isNotNull(), F.col(key)))}
    totals = work.groupBy(*by, slot).agg(*[whole[k](F.col(s)).alias(f"__t_{o}") for o, (k, s) in outputs.items()])
    if isinstance(bounds, Places):
        totals, n_ranges = settle(totals)
        upto = running(totals, by, slot, {f"__c_{o}": (k, f"__t_{o}") for o, (k, _) in outputs.items()}, bounds=Places(n_ranges, bounds.size))
        carried = upto.select(*by, (F.col(slot) + 1).alias(slot), *[f"__c_{o}" for o in outputs])
    else:  # a few ranges, some of which may be empty
        before = W.partitionBy(*by).orderBy(slot).rowsBetween(W.unboundedPreceding, -1)
        carried = totals.select(*by, slot, *[local[k](F.col(f"__t_{o}")).over(before).alias(f"__c_{o}") for o, (k, _) in outputs.items()])
    combine = {
        "sum": lambda c, v: F.coalesce(c, F.lit(0)) + v,
        "product": lambda c, v: F.coalesce(c, F.lit(1.0)) * v,
        "max": lambda c, v: F.greatest(c, v),
        "last": lambda c, v: F.coalesce(v, c),
    }
    joined = match(work, carried, [*by, slot], "left")
    return joined.select(*df.columns, *[combine[k](F.col(f"__c_{o}"), local[k](F.col(s)).over(inside)).alias(o)
                                        for o, (k, s) in outputs.items()])


def positions(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Add ``__pos``, the place of each row in its group from 0 (nulls first), and ``__size``, the rows of the group.

    Rows are dealt into ranges of (group, order) and sorted there, so no group is ever in one task; what is added up over the
    ranges is one count for each group and range. Rows that tie take any order among themselves.
    """
    at = [F.col(c).asc_nulls_first() for c in [*by, *order]]
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = cut_lineage(df.repartitionByRange(*at).sortWithinPartitions(*at)
                        .withColumns({"__part": F.spark_partition_id(), "__place": place}))
    counts = dealt.groupBy(*by, "__part").agg(F.count("*").alias("__rows"), F.min("__place").alias("__first"))
    whole = W.partitionBy(*by)
    before = F.coalesce(F.sum("__rows").over(whole.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = counts.select(*by, "__part", (before - F.col("__first")).alias("__shift"), F.sum("__rows").over(whole).alias("__size"))
    return (match_stats(dealt, parts, [*by, "__part"])
            .select(*df.columns, (F.col("__place") + F.col("__shift")).alias("__pos"), "__size"))


def hash_cuts(labelled: DataFrame, wanted: dict[str, list[int]], digit: int = 4, most: int = ROWS_PER_RANGE) -> dict[tuple[str, int], str]:
    """The md5 strings at given 1-based ranks, per label; ``labelled`` has columns ``label`` and ``h``.

    A radix selection: one scan counts the rows per label and prefix, and only prefixes that hold a wanted rank are looked at
    again, with ``digit`` more characters, for as long as one holds more than ``most`` rows. So rows are never sorted or
    shuffled as a whole, no task sorts more than ``most``, and what depends on a rank becomes a row-local comparison with the
    returned strings. A rank of zero gives the empty string.
    """
    found = {(k, int(r)): "" for k, ranks in wanted.items() for r in ranks if r <= 0}
    open_ranks = {(k, int(r)): ("", int(r)) for k, ranks in wanted.items() for r in ranks if r > 0}  # prefix so far, rank inside it
    length = 0
    while open_ranks:
        open_ranks, ready = _narrowed(labelled, open_ranks, length, digit)
        length += digit
        small = {k: (prefix, rank) for k, (prefix, rank, n) in ready.items() if n <= most and length < 32}
        found.update({k: prefix for k, (prefix, _, _) in ready.items() if length >= 32})  # the whole string
        open_ranks = {k: (prefix, rank) for k, (prefix, rank, n) in ready.items() if k not in small and k not in found}
        if small:
            found.update(_picked(labelled, small, length))
    return found


def _at_prefixes(labelled: DataFrame, wanted: dict, length: int) -> DataFrame:
    """Rows below the wanted prefixes, with ``parent``, the label and prefix as one string."""
    rows = labelled.withColumn("parent", F.concat_ws(":", "label", F.substring("h", 1, length)))
    return rows.where(F.col("parent").isin(sorted({f"{k[0]}:{v[0]}" for k, v in wanted.items()})))


def _narrowed(labelled: DataFrame, wanted: dict, length: int, digit: int) -> tuple[dict, dict]:
    """For each wanted rank the longer prefix that holds it, the rank inside that, and the rows there."""
    rows = _at_prefixes(labelled, wanted, length).withColumn("prefix", F.substring("h", 1, length + digit))
    sizes = rows.groupBy("label", "parent", "prefix").agg(F.count("*").alias("n"))
    upto = sizes.withColumn("upto", F.sum("n").over(W.partitionBy("parent").orderBy("prefix")))
    asks = F.array(*[F.struct(F.lit(f"{k}:{prefix}").alias("parent"), F.lit(k).alias("label"), F.lit(r).cast("long").alias("rank"),
                              F.lit(rank).cast("long").alias("inside")) for (k, r), (prefix, rank) in wanted.items()])
    here = lambda a: (a["parent"] == F.col("parent")) & (a["inside"] <= F.col("upto")) & (a["inside"] > F.col("upto") - F.col("n"))
    hits = upto.select("prefix", "n", (F.col("upto") - F.col("n")).alias("before"), F.explode(F.filter(asks, here)).alias("a")).collect()
    return {}, {(r["a"]["label"], r["a"]["rank"]): (r["prefix"], r["a"]["inside"] - r["before"], r["n"]) for r in hits}


def _picked(labelled: DataFrame, wanted: dict, length: int) -> dict[tuple[str, int], str]:
    """The strings at ranks inside prefixes that are known to be small."""
    rows = _at_prefixes(labelled, wanted, length)
    place = F.concat_ws(":", "parent", F.row_number().over(W.partitionBy("parent").orderBy("h")))
    at: dict[str, list] = {}
    for k, (prefix, rank) in wanted.items():
        at.setdefault(f"{k[0]}:{prefix}:{rank}", []).append(k)
    picked = rows.withColumn("place", place).where(F.col("place").isin(sorted(at))).select("place", "h").collect()
    return {k: r["h"] for r in picked for k in at[r["place"]]}


SKETCH = 10_000  # accuracy of the sketch that brackets a quantile; its ranks are off by n / SKETCH at most


def quantiles(df: DataFrame, value: str, probs: dict[str, float], by: list[str] = (),
              rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Exact interpolated quantiles per group: ``probs`` maps output column to probability.

    A sketch of each group brackets every quantile between two values. One more scan counts what lies below a bracket, and
    only the values inside it, less than a thousandth of the group for each quantile, are shuffled and ranked. Equal
    values collapse first, so a group of any size is spread over many tasks. Nulls and NaN are left out.
    """
    by, names = list(by), list(probs)
    v = F.col(value).cast("double")
    rows = df.select(*by, v.alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    ends = [min(1.0, max(0.0, p + side * 4 / SKETCH)) for p in probs.values() for side in (-1, 1)]
    sketch = rows.groupBy(*by).agg(F.count("*").alias("__total"), F.percentile_approx("__v", ends, SKETCH).alias("__cuts"),
                                   F.min("__v").alias("__min"), F.max("__v").alias("__max"))
    # Below 2 * SKETCH rows a bracket would be a few ranks wide, less than interpolation needs: there the whole group is ranked.
    few = F.col("__total") < 2 * SKETCH
    edge = lambda k: F.when(few | F.lit(ends[k] == (k % 2)), F.col("__max" if k % 2 else "__min")).otherwise(F.col("__cuts")[k])
    numbered = [(i, p) for i, p in enumerate(probs.values())]
    brackets, _ = settle(sketch.select(*by, *[c for i, p in numbered for c in (
        edge(2 * i).alias(f"__lo{i}"), edge(2 * i + 1).alias(f"__up{i}"), (F.lit(float(p)) * (F.col("__total") - 1)).alias(f"__pos{i}"))]))
    near = match_stats(rows, brackets, by)
    of = F.array(*[F.when((F.col("__v") >= F.col(f"__lo{i}")) & (F.col("__v") <= F.col(f"__up{i}")), F.lit(i)) for i, _ in numbered])
    inside = near.withColumn("__i", F.explode(F.filter(of, lambda i: i.isNotNull())))
    counts, n = settle(inside.groupBy(*by, "__i", "__v").agg(F.count("*").alias("__n")))
    below = near.groupBy(*by).agg(*[F.sum((F.col("__v") < F.col(f"__lo{i}")).cast("long")).alias(f"__below{i}") for i, _ in numbered],
                                  *[F.first(f"__pos{i}").alias(f"__pos{i}") for i, _ in numbered])
    ranked = match_stats(running(counts, [*by, "__i"], "__v", {"__hi": ("sum", "__n")}, bounds=Places(n, rows_per_range)), below, by)
    mine = lambda name: F.get(F.array(*[F.col(f"{name}{i}") for i, _ in numbered]), F.col("__i"))
    ranked = ranked.withColumns({"__hi": F.col("__hi") + mine("__below"), "__pos": mine("__pos")})
    picks, outs = [], []
    for i, name in enumerate(names):
        for side, rank in (("lo", F.floor("__pos")), ("up", F.ceil("__pos"))):
            hit = (F.col("__i") == i) & (rank < F.col("__hi")) & (rank >= F.col("__hi") - F.col("__n"))
            picks.append(F.max(F.when(hit, F.col("__v"))).alias(f"__{side}{i}"))
        picks.append(F.max(F.when(F.col("__i") == i, F.col("__pos") - F.floor("__pos"))).alias(f"__f{i}"))
        lo, up, frac = F.col(f"__lo{i}"), F.col(f"__up{i}"), F.col(f"__f{i}")
        lost = frac.isNotNull() & (lo.isNull() | up.isNull())
        sure = F.when(lost, F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double")).otherwise(lo + (up - lo) * frac)
        outs.append(sure.alias(name))
    return ranked.groupBy(*by).agg(*picks).select(*by, *outs)


def median_of(df: DataFrame, value: str) -> float | None:
    """Exact median of one column as a Python number."""
    row = quantiles(df, value, {"m": 0.5}).first()
    return None if row is None else row["m"]
