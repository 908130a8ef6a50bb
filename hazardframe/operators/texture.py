"""Texture features of masked voxels: first order, shape, co-occurrence, runs, zones, dependence, tone difference.

Inputs carry grouping columns ``by`` (an image, or an image and a filter). Every class first shrinks to a small count
table per image and then works on that. Results are long: ``(by..., class, feature, value)``. From a packed table (see
``packed``) every step makes a row for each image, and the features of a class are one array until ``extract_features`` unfolds them.
"""

from __future__ import annotations

import math
from functools import reduce
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import DoubleType

from hazardframe.operators.arrow_groups import whole_groups
from hazardframe.operators.ordered import BROADCAST_ROWS, ROWS_PER_RANGE, match, range_bounds, running
from hazardframe.operators.neighbourhood import (DIRECTIONS, _blocks, _counted, crossing_links, dependence_counts, glcm_cells, glcm_counts, glcm_matrices, neighbourhoods,
                                                 packed_zones, positions, run_counts, slab_roots, tone_table, top_levels, zone_edges)
from hazardframe.operators.packed import REASON, elements, is_packed, lists, per_image, unpacked
from hazardframe.operators.voxel_grid import AXES, discretize
from hazardframe.session import cut_lineage, settle

ARRAY_SHIFT = 1000.0  # added before energies, fixed value


def _long(df: DataFrame, by: list[str], kind: str, features: dict[str, Column]) -> DataFrame:
    if is_packed(df):  # (by, class, values, reason); the names go with the schema
        values = F.when(F.col(REASON).isNull(), F.array(*[c.cast("double") for c in features.values()]))
        return df.select(*by, F.lit(kind).alias("class"), values.alias("values", metadata={"class": kind, "features": list(features)}), REASON)
    cells = F.array(*[F.struct(F.lit(n).alias("feature"), c.cast("double").alias("value")) for n, c in features.items()])
    return df.select(*by, F.lit(kind).alias("class"), F.inline(cells))


def _div(a: Column, b: Column, default=0.0) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(float(default)))


# What the formulas of the features need beyond arithmetic, on columns and on arrays.
COLUMNS = SimpleNamespace(where=lambda test, a, b: F.when(test, a).otherwise(b), div=_div, sqrt=F.sqrt, exp=F.exp, log2=F.log2,
                          positive=lambda a: F.greatest(a, F.lit(0.0)))
ARRAYS = SimpleNamespace(where=np.where, div=lambda a, b: np.divide(a, b, out=np.zeros(len(a)), where=b != 0), sqrt=np.sqrt, exp=np.exp, log2=np.log2,
                         positive=lambda a: np.maximum(a, 0.0))


def _means(image: np.ndarray, images: int, features: dict[str, np.ndarray]) -> list[pa.Array]:
    """The number of rows of each image, and the means of the features over them."""
    n = np.bincount(image, minlength=images)
    return [pa.array(n.astype(np.int64)), *(pa.array(np.bincount(image, f, minlength=images) / np.maximum(n, 1)) for f in features.values())]


def _mean_columns(names) -> str:
    return ", ".join(["__rows bigint", *(f"__f{k} double" for k in range(len(names)))])


def _long_means(means: DataFrame, by: list[str], kind: str, names) -> DataFrame:
    """Features from :func:`_means`; an image without a row has none."""
    found = means.where((F.col("__rows") > 0) | F.col(REASON).isNotNull())
    return _long(found, by, kind, {n: F.col(f"__f{k}") for k, n in enumerate(names)})


def _entropy(p: Column) -> Column:
    """Summand of an entropy in bits."""
    return F.when(p > 0, -p * F.log2(p)).otherwise(0.0)


# ---------------------------------------------------------------- first order and shape

STATISTICS = ("total", "lo", "hi", "mean", "energy", "p10", "p25", "p50", "p75", "p90", "s1", "s2", "s3", "s4", "rn", "rs", "entropy", "uniformity")


def _group_statistics(start: np.ndarray, v: np.ndarray, n: np.ndarray, width: float, shift: float) -> dict[str, np.ndarray]:
    """The statistics of groups of values (sorted, with their counts) that follow each other; ``start`` has their first places."""
    size = np.diff(start, append=len(v))
    row = np.repeat(np.arange(len(start)), size)
    total = lambda x: np.bincount(row, x, minlength=len(start))
    out = {"total": total(n), "lo": v[start], "hi": v[start + size - 1], "energy": total(n * (v + shift) * (v + shift))}
    out["mean"] = total(n * v) / out["total"]
    upto = np.cumsum(n)
    before = upto[start] - n[start]
    for name, p in (("p10", 0.1), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p90", 0.9)):
        pos = p * (out["total"] - 1)
        a, b = (v[np.searchsorted(upto, before + f(pos), side="right")] for f in (np.floor, np.ceil))
        out[name] = a + (b - a) * (pos - np.floor(pos))
    d = v - out["mean"][row]
    out |= {"s1": total(n * np.abs(d)), "s2": total(n * d * d), "s3": total(n * d * d * d), "s4": total(n * d * d * d * d)}
    core = np.where((v >= out["p10"][row]) & (v <= out["p90"][row]), n, 0.0)
    out["rn"] = total(core)
    rm = total(core * v) / np.maximum(out["rn"], 1.0)
    out["rs"] = total(core * np.abs(v - rm[row]))
    bins = np.floor(v / width)
    fresh = np.flatnonzero((np.diff(bins, prepend=np.nan) != 0) | (np.diff(row, prepend=-1) != 0))
    share = np.add.reduceat(n, fresh) / out["total"][row[fresh]]
    out["entropy"] = np.bincount(row[fresh], -share * np.log2(share), minlength=len(start))
    out["uniformity"] = np.bincount(row[fresh], share * share, minlength=len(start))
    return out


def _statistics_of_small(counts: DataFrame, by: list[str], width: float, shift: float) -> DataFrame:
    """The statistics of groups that hold at most ROWS_PER_RANGE values, none of them missing, in arrays side by side."""
    types = dict(counts.dtypes)
    keys = ", ".join(f"`{c}` {types[c]}" for c in by)

    def scan(batches):
        for b, _, first in whole_groups(batches, by):
            got = _group_statistics(first, b.column("v").to_numpy(), b.column("n").to_numpy(), width, shift)
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(first)) for c in by), *(pa.array(got[c]) for c in STATISTICS)], names=[*by, *STATISTICS])

    # A group without a value between its outer percentiles has no robust deviation and no features.
    return (counts.select(*by, "v", "n").repartition(*by).sortWithinPartitions(*by, "v")
            .mapInArrow(scan, f"{keys}, {', '.join(f'{c} double' for c in STATISTICS)}").where("rn > 0"))


def _statistics_of_packed(df: DataFrame, by: list[str], width: float, shift: float) -> DataFrame:
    def kernel(part):
        row, v = elements(part, "v")
        order = np.lexsort((v, row))
        row, v = row[order], v[order] + 0.0  # no negative zero
        fresh = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(v, prepend=np.nan) != 0))
        n = np.diff(fresh, append=len(v)).astype(float)
        got = _group_statistics(np.flatnonzero(np.diff(row[fresh], prepend=-1)), v[fresh], n, width, shift)
        return [pa.array(got[c]) for c in STATISTICS]

    return per_image(df, by, kernel, ", ".join(f"{c} double" for c in STATISTICS)).where((F.col("rn") > 0) | F.col(REASON).isNotNull())


def first_order(df: DataFrame, by: list[str] = ("image_id",), width: float = 25.0, voxel_volume: float = 1.0,
                shift: float = ARRAY_SHIFT) -> DataFrame:
    """Eighteen intensity statistics, all from the distinct values and their counts."""
    by = list(by)
    full = _statistics_of_packed(df, by, width, shift) if is_packed(df) else _statistics_of_rows(df, by, width, shift)
    total, c = F.col("total"), F.col
    var = c("s2") / total
    return _long(full, by, "firstorder", {
        "Energy": c("energy"), "TotalEnergy": c("energy") * voxel_volume, "Entropy": c("entropy"), "Minimum": c("lo"),
        "10Percentile": c("p10"), "90Percentile": c("p90"), "Maximum": c("hi"), "Mean": c("mean"), "Median": c("p50"),
        "InterquartileRange": c("p75") - c("p25"), "Range": c("hi") - c("lo"), "MeanAbsoluteDeviation": c("s1") / total,
        "RobustMeanAbsoluteDeviation": c("rs") / c("rn"), "RootMeanSquared": F.sqrt(c("energy") / total),
        "Skewness": _div(c("s3") / total, F.pow(var, 1.5)), "Kurtosis": _div(c("s4") / total, var * var), "Variance": var,
        "Uniformity": c("uniformity")})


def _statistics_of_rows(df: DataFrame, by: list[str], width: float, shift: float) -> DataFrame:
    """The statistics of voxel rows: of small groups in arrays, of others by ranges."""
    counts, n_values = settle(df.where("mask = 1").groupBy(*by, F.col("intensity").cast("double").alias("v")).agg(
        F.count("*").cast("double").alias("n")))
    odd = F.max(F.col("v").isNull() | F.isnan("v"))
    large, n_large = settle(counts.groupBy(*by).agg(F.count("*").alias("k"), odd.alias("odd")).where((F.col("k") > ROWS_PER_RANGE) | F.col("odd"))
                            .select(*[F.col(b).alias(f"__b_{b}") for b in by]))
    if not n_large:
        return _statistics_of_small(counts, by, width, shift)
    table = F.broadcast(large) if n_large <= BROADCAST_ROWS else large
    of = lambda how: counts.join(table, reduce(lambda a, b: a & b, [counts[b].eqNullSafe(table[f"__b_{b}"]) for b in by]), how)
    small = _statistics_of_small(of("left_anti"), by, width, shift)
    return small.unionByName(_statistics_of_large(*settle(of("left_semi")), by, width, shift).select(*by, *STATISTICS))


def _statistics_of_large(counts: DataFrame, n_values: int, by: list[str], width: float, shift: float) -> DataFrame:
    """The same statistics by joins and ranges of values, for groups of any size."""
    v, n = F.col("v"), F.col("n")
    base = counts.groupBy(*by).agg(
        F.sum(n).alias("total"), F.min("v").alias("lo"), F.max("v").alias("hi"), (F.sum(n * v) / F.sum(n)).alias("mean"),
        F.sum(n * (v + shift) * (v + shift)).alias("energy"))
    ranked = match(running(counts, by, "v", {"upto": ("sum", "n")}, bounds=range_bounds(counts, "v", n_values)), base, by)
    picks, probs = [], {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}
    for name, p in probs.items():
        pos = F.lit(p) * (F.col("total") - 1)
        for side, rank in (("a", F.floor(pos)), ("b", F.ceil(pos))):
            picks.append(F.max(F.when((rank < F.col("upto")) & (rank >= F.col("upto") - n), v)).alias(f"{name}{side}"))
        picks.append(F.max(pos - F.floor(pos)).alias(f"{name}f"))
    found = ranked.groupBy(*by, "total", "lo", "hi", "mean", "energy").agg(*picks)
    found = found.select(*by, "total", "lo", "hi", "mean", "energy", *[
        (F.col(f"{q}a") + (F.col(f"{q}b") - F.col(f"{q}a")) * F.col(f"{q}f")).alias(q) for q in probs])
    rows = match(counts, found, by)
    d, core = v - F.col("mean"), (v >= F.col("p10")) & (v <= F.col("p90"))
    keep = ["total", "lo", "hi", "mean", "energy", *probs]
    moments = rows.groupBy(*by, *keep).agg(
        F.sum(n * F.abs(d)).alias("s1"), F.sum(n * d * d).alias("s2"), F.sum(n * d * d * d).alias("s3"),
        F.sum(n * d * d * d * d).alias("s4"), F.sum(F.when(core, n)).alias("rn"),
        (F.sum(F.when(core, n * v)) / F.sum(F.when(core, n))).alias("rm"))
    robust = match(counts, moments.select(*by, "p10", "p90", "rm"), by).where("v >= p10 AND v <= p90").groupBy(*by).agg(
        F.sum(n * F.abs(v - F.col("rm"))).alias("rs"))
    bins = counts.groupBy(*by, F.floor(v / F.lit(float(width))).alias("bin")).agg(F.sum(n).alias("bn"))
    bins = match(bins, base.select(*by, "total"), by).withColumn("p", F.col("bn") / F.col("total")).groupBy(*by).agg(
        F.sum(_entropy(F.col("p"))).alias("entropy"), F.sum(F.col("p") * F.col("p")).alias("uniformity"))
    return match(match(moments, robust, by), bins, by)


def shape(df: DataFrame, by: list[str] = ("image_id",), spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Voxel volume and the axis lengths of the covariance ellipsoid, by closed-form 3x3 eigenvalues."""
    by = list(by)
    q = {a: F.col(a) * F.lit(float(s)) for a, s in zip(AXES, spacing)}
    pairs = [("z", "z"), ("y", "y"), ("x", "x"), ("z", "y"), ("z", "x"), ("y", "x")]
    inside = (unpacked(df, by) if is_packed(df) else df).where("mask = 1")
    sums = inside.groupBy(*by).agg(F.count("*").alias("n"), *[F.covar_pop(q[a], q[b]).alias(a + b) for a, b in pairs])
    c = F.col
    m = (c("zz") + c("yy") + c("xx")) / 3
    off = c("zy") ** 2 + c("zx") ** 2 + c("yx") ** 2
    p = F.sqrt(((c("zz") - m) ** 2 + (c("yy") - m) ** 2 + (c("xx") - m) ** 2 + 2 * off) / 6)
    a, b, d = c("zz") - m, c("yy") - m, c("xx") - m
    det = a * (b * d - c("yx") ** 2) - c("zy") * (c("zy") * d - c("yx") * c("zx")) + c("zx") * (c("zy") * c("yx") - b * c("zx"))
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _div(det, 2 * p * p * p)))
    angle = F.acos(r) / 3
    e = sums.withColumns({"m": m, "p": p, "angle": angle}).select(
        *by, "n", F.greatest(c("m") + 2 * c("p") * F.cos("angle"), F.lit(0.0)).alias("e1"),
        F.greatest(c("m") + 2 * c("p") * F.cos(c("angle") + 2 * math.pi / 3), F.lit(0.0)).alias("e3"), "m")
    e = e.withColumn("e2", F.greatest(3 * c("m") - c("e1") - c("e3"), F.lit(0.0)))
    e = e.withColumn(REASON, F.lit(None).cast("string")) if is_packed(df) else e
    return _long(e, by, "shape", {
        "VoxelVolume": c("n") * float(np.prod(spacing)), "MajorAxisLength": 4 * F.sqrt("e1"), "MinorAxisLength": 4 * F.sqrt("e2"),
        "LeastAxisLength": 4 * F.sqrt("e3"), "Elongation": F.sqrt(_div(c("e2"), c("e1"))), "Flatness": F.sqrt(_div(c("e3"), c("e1")))})


# ---------------------------------------------------------------- co-occurrence

@F.pandas_udf(DoubleType())
def second_eigenvalue(i: pd.Series, j: pd.Series, p: pd.Series) -> pd.Series:
    """Maximal correlation coefficient of one symmetric co-occurrence matrix, given as lists of its cells."""
    def one(i, j, p):
        levels, idx = np.unique(np.concatenate([i, j]), return_inverse=True)
        a = np.zeros((len(levels), len(levels)))
        a[idx[:len(i)], idx[len(i):]] = p
        scale = np.sqrt(a.sum(axis=1))
        values = np.sort(np.abs(np.linalg.eigvalsh(a / scale[:, None] / scale[None, :])))
        return float(values[-2]) if len(values) > 1 else 1.0
    return pd.Series([one(np.asarray(a), np.asarray(b), np.asarray(c)) for a, b, c in zip(i, j, p)], dtype=float)


def _mean_long(rows: DataFrame, by: list[str], kind: str, features: dict[str, Column]) -> DataFrame:
    """Features averaged over the rows of an image (its directions) while they are columns, then as long rows."""
    names = {n: f"__f{i}" for i, n in enumerate(features)}
    wide = rows.select(*by, *[features[n].cast("double").alias(c) for n, c in names.items()])
    means = wide.groupBy(*by).agg(*[F.avg(c).alias(c) for c in names.values()])
    return _long(means, by, kind, {n: F.col(c) for n, c in names.items()})


def _glcm_features(c, op, mcc: bool) -> dict:
    """The features from the sums ``c`` over the cells of one matrix (columns), or of several (arrays)."""
    feats = {
        "Autocorrelation": c("auto"), "JointAverage": c("u"), "ClusterProminence": c("prom"), "ClusterShade": c("shade"),
        "ClusterTendency": c("tend"), "Contrast": c("contrast"),
        "Correlation": op.where(c("var") > 1e-12, op.div(c("cov"), c("var")), 1.0),
        "DifferenceAverage": c("da"), "DifferenceEntropy": c("de"), "DifferenceVariance": c("contrast") - c("da") ** 2,
        "JointEnergy": c("energy"), "JointEntropy": c("hxy"), "Imc1": op.div(c("hxy") - 2 * c("hx"), c("hx")),
        "Imc2": op.sqrt(op.positive(1 - op.exp(-2 * (2 * c("hx") - c("hxy"))))),
        "Idm": c("idm"), "Idmn": c("idmn"), "Id": c("id"), "Idn": c("idn"), "InverseVariance": c("inv"),
        "MaximumProbability": c("pmax"), "SumAverage": c("sa"), "SumEntropy": c("se"), "SumSquares": c("var")}
    return feats | ({"MCC": c("mcc")} if mcc else {})


def glcm(counts: DataFrame, levels: DataFrame, by: list[str], mcc: bool = True) -> DataFrame:
    """Co-occurrence features, averaged over the directions that have a pair. ``levels`` gives the top grey level.

    The cells of a matrix (at most grey levels squared) are partitioned once by (image, direction); marginal, sum and
    difference distributions are windows inside that partitioning, so nothing is joined back.
    """
    key = [*by, "dir"]
    over = lambda *more: W.partitionBy(*key, *more)
    i, j, p, u, ng = F.col("i"), F.col("j"), F.col("p"), F.col("u"), F.col("ng")
    k, t = F.abs(i - j), i + j
    top = levels.groupBy(*by).agg(F.max("level").cast("double").alias("ng"))
    cells = (match(counts, top, by).withColumn("p", F.col("n") / F.sum("n").over(over()))
             .withColumn("px", F.sum("p").over(over("i"))).withColumn("k", k).withColumn("t", t)
             .withColumn("pk", F.sum("p").over(over("k"))).withColumn("pt", F.sum("p").over(over("t")))
             .withColumn("u", F.sum(i * p).over(over())))
    k, t, dev = F.col("k"), F.col("t"), i + j - 2 * u
    bits = lambda q: F.sum(-p * F.log2(q))  # sum over cells of -p log2(marginal) is the entropy of the marginal
    lists = [F.collect_list(c).alias(f"l{c}") for c in ("i", "j", "p")] if mcc else []
    m = cells.groupBy(*key).agg(
        F.first("u").alias("u"), bits(F.col("px")).alias("hx"), F.sum(i * j * p).alias("auto"), F.sum(dev ** 2 * p).alias("tend"),
        F.sum(dev ** 3 * p).alias("shade"), F.sum(dev ** 4 * p).alias("prom"), F.sum(k * k * p).alias("contrast"),
        F.sum((i - u) ** 2 * p).alias("var"), F.sum((i - u) * (j - u) * p).alias("cov"), F.sum(p * p).alias("energy"),
        bits(p).alias("hxy"), F.max("p").alias("pmax"), F.sum(k * p).alias("da"), bits(F.col("pk")).alias("de"),
        F.sum(p / (1 + k * k)).alias("idm"), F.sum(p / (1 + k * k / (ng * ng))).alias("idmn"), F.sum(p / (1 + k)).alias("id"),
        F.sum(p / (1 + k / ng)).alias("idn"), F.sum(F.when(k > 0, p / (k * k)).otherwise(0.0)).alias("inv"),
        F.sum(t * p).alias("sa"), bits(F.col("pt")).alias("se"), *lists)
    if mcc:
        m = m.withColumn("mcc", second_eigenvalue("li", "lj", "lp"))
    return _mean_long(m, by, "glcm", _glcm_features(F.col, COLUMNS, mcc))


SUMS = ("u", "hx", "auto", "tend", "shade", "prom", "contrast", "var", "cov", "energy", "hxy", "pmax", "da", "de", "idm", "idmn", "id", "idn",
        "inv", "sa", "se")
WIDE = 4096  # grey levels of an image up to which a matrix is one row
CELLS = 1_000_000  # cells of matrices that are summed at a time


def _matrix_sums(row: np.ndarray, i: np.ndarray, j: np.ndarray, n: np.ndarray, ng: np.ndarray) -> dict[str, np.ndarray]:
    """The sums over the cells of whole symmetric matrices; ``row`` numbers the matrix of each cell, ``ng`` has the top level of each."""
    rows = len(ng)
    total = lambda v: np.bincount(row, v, minlength=rows)

    def marginal(c: np.ndarray) -> np.ndarray:
        """Probability of the cells of the same matrix with the same ``c``, for each cell."""
        at = row * (int(c.max()) + 1) + c
        if rows * (int(c.max()) + 1) > 4 * CELLS:  # too many places for a table of all of them
            at = np.unique(at, return_inverse=True)[1]
        return np.bincount(at, p)[at]

    p = n / total(n)[row]
    k, t = np.abs(i - j), i + j
    px, pk, pt = marginal(i), marginal(k), marginal(t)
    i, j, k, t, ng = i.astype(float), j.astype(float), k.astype(float), t.astype(float), ng.astype(float)[row]
    u = total(i * p)
    dev, away = t - 2 * u[row], i - u[row]
    top = np.zeros(rows)
    np.maximum.at(top, row, p)
    return {
        "u": u, "hx": total(-p * np.log2(px)), "auto": total(i * j * p), "tend": total(dev ** 2 * p), "shade": total(dev ** 3 * p),
        "prom": total(dev ** 4 * p), "contrast": total(k * k * p), "var": total(away ** 2 * p), "cov": total(away * (j - u[row]) * p),
        "energy": total(p * p), "hxy": total(-p * np.log2(p)), "pmax": top, "da": total(k * p), "de": total(-p * np.log2(pk)),
        "idm": total(p / (1 + k * k)), "idmn": total(p / (1 + k * k / (ng * ng))), "id": total(p / (1 + k)), "idn": total(p / (1 + k / ng)),
        "inv": total(np.where(k > 0, p / np.maximum(k * k, 1), 0.0)), "sa": total(t * p), "se": total(-p * np.log2(pt))}


def _second_eigenvalues(row: np.ndarray, i: np.ndarray, j: np.ndarray, n: np.ndarray, rows: int) -> np.ndarray:
    """:func:`second_eigenvalue` of many matrices: those with equally many levels are decomposed side by side."""
    width = int(i.max()) + 1
    levels, at = np.unique(row * width + i, return_inverse=True)  # every level of a symmetric matrix is an i
    first = np.searchsorted(levels, np.arange(rows + 1) * width)
    size, share = np.diff(first), np.bincount(at, n) ** 0.5
    other = np.searchsorted(levels, row * width + j)
    share, out = n / share[at] / share[other], np.ones(rows)
    a, b = at - first[row], other - first[row]
    order = np.argsort(size, kind="stable")
    place = np.empty(rows, np.int64)
    place[order] = np.arange(rows)
    cells = np.argsort(place[row], kind="stable")
    ends = np.searchsorted(place[row[cells]], np.arange(rows + 1))
    for m in np.unique(size[size > 1]):
        low, high = np.searchsorted(size[order], [m, m + 1])
        step = max(1, CELLS // int(m * m))
        for s in range(low, high, step):
            some = order[s:min(s + step, high)]
            mine = cells[ends[s]:ends[s + len(some)]]
            dense = np.zeros((len(some), m, m))
            dense[place[row[mine]] - s, a[mine], b[mine]] = share[mine]
            out[some] = np.sort(np.abs(np.linalg.eigvalsh(dense)), axis=1)[:, -2]
    return out


def _symmetric_sums(row: np.ndarray, i: np.ndarray, j: np.ndarray, n: np.ndarray, top: np.ndarray, mcc: bool) -> dict[str, np.ndarray]:
    """The sums of matrices of which the cells with i <= j are given; ``top`` has the top level of each."""
    off = i != j
    row, i, j, n = (np.concatenate(v) for v in ((row, row[off]), (i, j[off]), (j, i[off]), (np.where(off, n, 2 * n), n[off])))
    sums = _matrix_sums(row, i, j, n.astype(float), top)
    return sums | ({"mcc": _second_eigenvalues(row, i, j, n.astype(float), len(top))} if mcc else {})


def _glcm_of_packed(near: DataFrame, by: list[str], mcc: bool, rejects: list[DataFrame] | None) -> DataFrame:
    names = list(_glcm_features(lambda c: np.zeros(0), ARRAYS, mcc))

    def kernel(part):
        blocks = _blocks(part)
        (g, k, i, j), n = glcm_cells(blocks)
        if not len(n):
            return _means(g, part.num_rows, dict.fromkeys(names, np.zeros(0)))
        matrices, row = np.unique(g * len(DIRECTIONS) + k, return_inverse=True)
        image = matrices // len(DIRECTIONS)
        sums = _symmetric_sums(row, i, j, n, top_levels(blocks)[image], mcc)
        return _means(image, part.num_rows, _glcm_features(sums.__getitem__, ARRAYS, mcc))

    return _long_means(per_image(near, by, kernel, _mean_columns(names), rejects is not None), by, "glcm", names)


def glcm_packed(matrices: DataFrame, by: list[str], mcc: bool = True) -> DataFrame:
    """:func:`glcm` from :func:`glcm_matrices`: whole matrices are summed side by side in arrays, and no cell becomes a row."""
    types = dict(matrices.dtypes)
    names = [*SUMS, *(["mcc"] if mcc else [])]

    def whole(part: pa.RecordBatch):
        lists = part.column("parts")
        inner = lists.flatten()
        cells = {c: inner.field(c) for c in ("i", "j", "n")}
        per_part = np.diff(cells["i"].offsets.to_numpy())
        row = np.repeat(np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), per_part)
        i, j, n = (cells[c].flatten().to_numpy().astype(np.int64) for c in ("i", "j", "n"))
        width = int(j.max()) + 1
        if len(per_part) > len(lists):  # several batches met an image: equal cells are added up
            keys, at = np.unique((row * width + i) * width + j, return_inverse=True)
            row, i, j, n = keys // (width * width), keys // width % width, keys % width, np.bincount(at, n).astype(np.int64)
        sums = _symmetric_sums(row, i, j, n, part.column("top").to_numpy(), mcc)
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in by), *(pa.array(sums[c]) for c in names)], names=[*by, *names])

    def run(batches):
        for b in batches:
            lists = b.column("parts")
            ends = lists.flatten().field("i").offsets.to_numpy()[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
            at = 0
            while at < b.num_rows:
                stop = max(at + 1, int(np.searchsorted(ends, ends[at] + CELLS, side="right")) - 1)
                yield whole(pa.RecordBatch.from_arrays([c.take(pa.array(np.arange(at, stop))) for c in b.columns], names=b.schema.names))
                at = stop

    keys = ", ".join(f"`{c}` {types[c]}" for c in by)
    sums = matrices.select(*by, "top", "parts").mapInArrow(run, f"{keys}, {', '.join(f'{c} double' for c in names)}")
    return _mean_long(sums, by, "glcm", _glcm_features(F.col, COLUMNS, mcc))


def glcm_of_images(near: DataFrame, levels: DataFrame, by: list[str], mcc: bool = True, rejects: list[DataFrame] | None = None) -> DataFrame:
    """Co-occurrence features from neighbourhoods: by packed matrices, and by rows of cells for images with more than ``WIDE`` levels,
    whose matrices may be too large for one row."""
    if is_packed(near):
        return _glcm_of_packed(near, by, mcc, rejects)
    wide, n = settle(levels.groupBy(*by).agg(F.max("level").alias("__top")).where(F.col("__top") > WIDE).select(*[F.col(b).alias(f"__b_{b}") for b in by]))
    if not n:
        return glcm_packed(glcm_matrices(near, by, rejects), by, mcc)
    table = F.broadcast(wide) if n <= BROADCAST_ROWS else wide
    own = lambda df, how: df.join(table, reduce(lambda a, b: a & b, [df[b].eqNullSafe(table[f"__b_{b}"]) for b in by]), how)
    few = glcm_packed(glcm_matrices(own(near, "left_anti"), by, rejects), by, mcc)
    return few.unionByName(glcm(glcm_counts(own(near, "left_semi"), by, rejects=rejects), own(levels, "left_semi"), by, mcc))


# ---------------------------------------------------------------- level-by-size matrices

# Feature names: run length, zone size, dependence. ``None`` where the class has no such feature.
# Published feature names.
RUN_NAMES = dict(small="ShortRunEmphasis", large="LongRunEmphasis", gln="GrayLevelNonUniformity",
                 glnn="GrayLevelNonUniformityNormalized", sn="RunLengthNonUniformity", snn="RunLengthNonUniformityNormalized",
                 share="RunPercentage", glv="GrayLevelVariance", sv="RunVariance", entropy="RunEntropy",
                 low="LowGrayLevelRunEmphasis", high="HighGrayLevelRunEmphasis", sl="ShortRunLowGrayLevelEmphasis",
                 sh="ShortRunHighGrayLevelEmphasis", ll="LongRunLowGrayLevelEmphasis", lh="LongRunHighGrayLevelEmphasis")
# Published feature names.
ZONE_NAMES = dict(small="SmallAreaEmphasis", large="LargeAreaEmphasis", gln="GrayLevelNonUniformity",
                  glnn="GrayLevelNonUniformityNormalized", sn="SizeZoneNonUniformity", snn="SizeZoneNonUniformityNormalized",
                  share="ZonePercentage", glv="GrayLevelVariance", sv="ZoneVariance", entropy="ZoneEntropy",
                  low="LowGrayLevelZoneEmphasis", high="HighGrayLevelZoneEmphasis", sl="SmallAreaLowGrayLevelEmphasis",
                  sh="SmallAreaHighGrayLevelEmphasis", ll="LargeAreaLowGrayLevelEmphasis", lh="LargeAreaHighGrayLevelEmphasis")
# Published feature names.
DEPENDENCE_NAMES = dict(small="SmallDependenceEmphasis", large="LargeDependenceEmphasis", gln="GrayLevelNonUniformity",
                        glnn=None, sn="DependenceNonUniformity", snn="DependenceNonUniformityNormalized", share=None,
                        glv="GrayLevelVariance", sv="DependenceVariance", entropy="DependenceEntropy",
                        low="LowGrayLevelEmphasis", high="HighGrayLevelEmphasis",
                        sl="SmallDependenceLowGrayLevelEmphasis", sh="SmallDependenceHighGrayLevelEmphasis",
                        ll="LargeDependenceLowGrayLevelEmphasis", lh="LargeDependenceHighGrayLevelEmphasis")


SIZE_SUMS = ("total", "np", "small", "large", "low", "high", "sl", "sh", "ll", "lh", "g1", "nlog", "sq_level", "sq_size")


def _size_matrices(codes: np.ndarray, matrices: int, level: np.ndarray, size: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """The sums over the cells of matrices; ``codes`` has the number of the matrix of each cell."""
    total = lambda v: np.bincount(codes, v, minlength=matrices)

    def squared(c: np.ndarray) -> np.ndarray:
        """Sum of the squared totals of the cells with the same ``c``."""
        at = np.unique(codes * (int(c.max()) + 1) + c.astype(np.int64), return_inverse=True)[1]
        return total(n * np.bincount(at, n)[at])

    g2, s2 = level * level, size * size
    return dict(zip(SIZE_SUMS, (
        total(n), total(n * size), total(n / s2), total(n * s2), total(n / g2), total(n * g2), total(n / (s2 * g2)), total(n * g2 / s2),
        total(n * s2 / g2), total(n * s2 * g2), total(n * level), total(n * np.log2(n)), squared(level), squared(size))))


def _size_sums(counts: DataFrame, key: list[str]) -> DataFrame:
    """Sums over the cells of each ``(level, size, n)`` matrix, many matrices side by side; a matrix has one row for each cell."""
    types = dict(counts.dtypes)
    keys = ", ".join(f"`{c}` {types[c]}" for c in key)

    def scan(batches):
        for b, codes, first in whole_groups(batches, key):
            got = _size_matrices(codes, len(first), *(b.column(c).to_numpy().astype(float) for c in ("level", "size", "n"))).values()
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(first)) for c in key), *map(pa.array, got)], names=[*key, *SIZE_SUMS])

    return (counts.select(*key, "level", "size", "n").repartition(*key).sortWithinPartitions(*key)
            .mapInArrow(scan, f"{keys}, {', '.join(f'{c} double' for c in SIZE_SUMS)}"))


def _size_features(c, op, names: dict) -> dict:
    """The features from the sums ``c`` of one matrix (columns), or of several (arrays)."""
    N = c("total")
    feats = {
        "small": c("small") / N, "large": c("large") / N, "gln": c("sq_level") / N, "glnn": c("sq_level") / (N * N),
        "sn": c("sq_size") / N, "snn": c("sq_size") / (N * N), "share": N / c("np"),
        "glv": c("high") / N - (c("g1") / N) ** 2, "sv": c("large") / N - (c("np") / N) ** 2,
        "entropy": op.log2(N) - c("nlog") / N, "low": c("low") / N, "high": c("high") / N, "sl": c("sl") / N,
        "sh": c("sh") / N, "ll": c("ll") / N, "lh": c("lh") / N}
    return {names[f]: v for f, v in feats.items() if names[f]}


def _size_features_of_packed(counts: DataFrame, by: list[str], kind: str, names: dict, over: list[str]) -> DataFrame:
    """Features of the lists ``(level, size, n)`` of packed images, averaged over the values of the lists ``over``."""
    wanted = [n for n in names.values() if n]

    def kernel(part):
        row, level, size, n, *more = elements(part, "level", "size", "n", *over)
        matrix, times = row, 1
        for c in more:
            matrix, times = matrix * (int(c.max()) + 1) + c, times * (int(c.max()) + 1)
        matrices, codes = np.unique(matrix, return_inverse=True)
        sums = _size_matrices(codes, len(matrices), *(c.astype(float) for c in (level, size, n)))
        feats = _size_features(sums.__getitem__, ARRAYS, names)
        return _means(matrices // times, part.num_rows, {n: feats[n] for n in wanted})

    return _long_means(per_image(counts, by, kernel, _mean_columns(wanted)), by, kind, wanted)


def size_matrix_features(counts: DataFrame, by: list[str], kind: str, names: dict, over: list[str] = ()) -> DataFrame:
    """Features of a ``(level, size, n)`` table; averaged over the extra keys ``over`` (the directions of runs)."""
    if is_packed(counts):
        return _size_features_of_packed(counts, by, kind, names, list(over))
    full = _size_sums(counts, [*by, *over])
    feats = _size_features(F.col, COLUMNS, names)
    return _mean_long(full, by, kind, feats) if over else _long(full, by, kind, feats)


def zone_labels(levels: DataFrame, near: DataFrame, by: list[str], rejects: list[DataFrame] | None = None, max_rounds: int = 200) -> DataFrame:
    """Smallest position of each 26-connected zone of equal level: ``(by, pos, zone)``.

    Links inside a slab of bounded size are settled in one pass over all slabs. What crosses the faces of slabs links their
    roots, far fewer, and is settled by alternating star contraction: every vertex links its larger neighbours to its smallest one, then its smaller
    neighbours to the smallest. The number of rounds grows with the logarithm of the zone in slabs, not with its diameter.
    Neighbour minima are aggregated before they are joined back, and voxels take their zone through their slab's root, which
    has at most a slab's voxels: a zone of any size makes no hot group.
    """
    if is_packed(near):
        return packed_zones(near, by, rejects)
    links = cut_lineage(zone_edges(near, by, rejects))
    roots = cut_lineage(slab_roots(links, by))
    edges, n = settle(crossing_links(links, roots, by))
    before = None
    for _ in range(max_rounds if n else 0):
        edges, now = _checked(_small_star(_large_star(edges, by), by), by)
        if now == before:
            break
        before = now
    else:
        if n:
            raise RuntimeError("zones did not settle")
    placed = match(positions(levels, by), roots, [*by, "pos"], "left").withColumn("root", F.coalesce("root", "pos"))
    if n:
        zones = edges.groupBy(*by, F.col("u").alias("root")).agg(F.min("v").alias("zone"))
        placed = match(placed, zones, [*by, "root"], "left")
    return placed.select(*by, "pos", "level", (F.coalesce("zone", "root") if n else F.col("root")).alias("zone"))


def _checked(edges: DataFrame, by: list[str]) -> tuple[DataFrame, tuple]:
    """The links of a finished round, written once, and a fingerprint of them."""
    written, n = settle(edges)
    return written, (n, written.agg(F.sum(F.xxhash64(*by, "u", "v").cast("decimal(38,0)"))).first()[0])


def _large_star(edges: DataFrame, by: list[str]) -> DataFrame:
    """Link every larger neighbour of a vertex to the smallest vertex around it."""
    ends = F.array(F.struct(F.col("u").alias("c"), F.col("v").alias("o")), F.struct(F.col("v").alias("c"), F.col("u").alias("o")))
    both = edges.select(*by, F.explode(ends).alias("e")).select(*by, "e.c", "e.o")
    low = both.groupBy(*by, "c").agg(F.min("o").alias("m")).withColumn("m", F.least("m", "c"))
    return (match(both.where("o > c"), low, [*by, "c"]).select(*by, F.col("o").alias("u"), F.col("m").alias("v"))
            .where("u <> v"))  # repeats go with the next distinct


def _small_star(edges: DataFrame, by: list[str]) -> DataFrame:
    """Link the smaller neighbours of a vertex, and the vertex, to the smallest of them (edges point down: u > v)."""
    low = edges.groupBy(*by, "u").agg(F.min("v").alias("m"))
    linked = match(edges, low, [*by, "u"]).select(*by, F.col("v").alias("x"), "m").where("x <> m")
    own = low.select(*by, F.col("u").alias("x"), "m")
    return linked.unionByName(own).select(*by, F.col("x").alias("u"), F.col("m").alias("v")).distinct()


def _zone_counts_of_packed(labels: DataFrame, by: list[str]) -> DataFrame:
    def kernel(part):
        row, zone, level = elements(part, "zone", "level")
        order = np.lexsort((zone, row))
        fresh = np.flatnonzero((np.diff(row[order], prepend=-1) != 0) | (np.diff(zone[order], prepend=-1) != 0))
        (image, level, size), n = _counted([row[order][fresh], level[order][fresh], np.diff(fresh, append=len(row))])
        return lists(image, part.num_rows, level.astype(np.int32), size.astype(np.int64), n.astype(np.int64))

    return per_image(labels, by, kernel, "level array<int>, size array<bigint>, n array<bigint>")


def zone_counts(labels: DataFrame, by: list[str]) -> DataFrame:
    if is_packed(labels):
        return _zone_counts_of_packed(labels, by)
    zones = labels.groupBy(*by, "zone", "level").agg(F.count("*").alias("size"))
    return zones.groupBy(*by, "level", "size").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- tone difference

TONE_NAMES = ("Coarseness", "Contrast", "Busyness", "Complexity", "Strength")


def _ngtdm_of_packed(table: DataFrame, by: list[str]) -> DataFrame:
    """The same features from the lists ``(level, n, s)`` of packed images; levels meet each other one after another."""
    def kernel(part):
        row, level, n, s = elements(part, "level", "n", "s")
        rows = part.num_rows
        total = lambda v: np.bincount(row, v, minlength=rows)
        i, nv, ng = level.astype(float), total(n), total(np.ones(len(row)))
        p = n / nv[row]
        ps, ss, pi, pii, i1, i2 = (total(v) for v in (p * s, s, p * i, p * i * i, i, i * i))
        start = np.cumsum(ng).astype(np.int64) - ng.astype(np.int64)
        order = np.lexsort((i * p, row))
        rank = np.empty(len(row))
        rank[order] = np.arange(1, len(row) + 1) - start[row]
        gaps = total(2 * i * p * (2 * rank - ng[row] - 1))  # sum over pairs of |i p_i - j p_j|
        walk = np.zeros(rows)
        for k in np.unique(ng[ng > 0]).astype(np.int64):
            alike = np.flatnonzero(ng == k)
            own_i, own_p, own_s = (c[start[alike][:, None] + np.arange(k)] for c in (i, p, s))
            for a in range(k):
                one = [c[:, a:a + 1] for c in (own_i, own_p, own_s)]
                walk[alike] += (np.abs(one[0] - own_i) * (one[1] * one[2] + own_p * own_s) / (one[1] + own_p)).sum(axis=1)
        div, several = ARRAYS.div, ng > 1
        coarse = np.divide(1.0, ps, out=np.full(rows, 1e6), where=ps != 0)
        got = (np.minimum(coarse, 1e6), np.where(several, div(2 * (pii - pi ** 2), ng * (ng - 1)) * div(ss, nv), 0.0), np.where(several, div(ps, gaps), 0.0),
               div(walk, nv), div(2 * (ng * pii - 2 * pi * i1 + i2), ss))
        return [pa.array(ng.astype(np.int64)), *map(pa.array, got)]

    return _long_means(per_image(table, by, kernel, _mean_columns(TONE_NAMES)), by, "ngtdm", TONE_NAMES)


def ngtdm(table: DataFrame, by: list[str]) -> DataFrame:
    """Coarseness, contrast, busyness, complexity and strength from the per-level table.

    Double sums over levels use closed forms; only complexity walks the levels of an image against each other, inside
    one array whose length is the number of grey levels.
    """
    if is_packed(table):
        return _ngtdm_of_packed(table, by)
    t = table.withColumn("nv", F.sum("n").over(W.partitionBy(*by))).withColumn("p", F.col("n") / F.col("nv"))
    i, p, s = F.col("level").cast("double"), F.col("p"), F.col("s")
    rank = F.row_number().over(W.partitionBy(*by).orderBy(i * p))
    count = F.count("*").over(W.partitionBy(*by))
    t = t.withColumn("gap", 2 * i * p * (2 * rank - count - 1))  # sum over pairs of |i p_i - j p_j|
    sums = t.groupBy(*by, "nv").agg(
        F.count("*").cast("double").alias("ng"), F.sum(p * s).alias("ps"), F.sum("s").alias("ss"), F.sum(p * i).alias("pi"),
        F.sum(p * i * i).alias("pii"), F.sum(i).alias("i1"), F.sum(i * i).alias("i2"), F.sum("gap").alias("gaps"),
        F.collect_list(F.struct(i.alias("i"), p.alias("p"), s.alias("s"))).alias("l"))
    c = F.col
    pair = lambda a, b: F.abs(a["i"] - b["i"]) * (a["p"] * a["s"] + b["p"] * b["s"]) / (a["p"] + b["p"])
    walk = F.aggregate("l", F.lit(0.0), lambda acc, a: acc + F.aggregate("l", F.lit(0.0), lambda x, b: x + pair(a, b)))
    strength = 2 * (c("ng") * c("pii") - 2 * c("pi") * c("i1") + c("i2"))
    return _long(sums, by, "ngtdm", {
        "Coarseness": F.least(_div(F.lit(1.0), c("ps"), 1e6), F.lit(1e6)),
        "Contrast": F.when(c("ng") > 1, _div(2 * (c("pii") - c("pi") ** 2), c("ng") * (c("ng") - 1)) * c("ss") / c("nv")).otherwise(0.0),
        "Busyness": F.when(c("ng") > 1, _div(c("ps"), c("gaps"))).otherwise(0.0),
        "Complexity": walk / c("nv"), "Strength": _div(strength, c("ss"))})


# ---------------------------------------------------------------- all classes

CLASSES = ("firstorder", "shape", "glcm", "glrlm", "glszm", "gldm", "ngtdm")


def extract_features(df: DataFrame, by: list[str] = ("image_id",), classes: tuple[str, ...] = CLASSES, width: float = 25.0,
                     spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), rejects: list[DataFrame] | None = None) -> DataFrame:
    """All enabled classes as one long table; the neighbourhoods are built once and shared, those of a packed table inside the tasks.

    With a list for ``rejects`` an image that makes a kernel fail is added to it as ``(by, reason)`` and does not end the job.
    """
    by, packed = list(by), is_packed(df)
    out = []
    if "firstorder" in classes:
        out.append(first_order(df, by, width, float(np.prod(spacing))))
    if "shape" in classes:
        plain = df.where("filter = 'original'") if "filter" in by else df
        out.append(shape(plain, by, spacing))
    if set(classes) - {"firstorder", "shape"}:
        levels = df.withColumn("width", F.lit(float(width))) if packed else cut_lineage(discretize(df, by, width).select(*by, *AXES, "level"))
        near = levels if packed else cut_lineage(neighbourhoods(levels, by))
        if "glcm" in classes:
            out.append(glcm_of_images(near, levels, by, rejects=rejects))
        if "glrlm" in classes:
            out.append(size_matrix_features(run_counts(near, by, rejects=rejects), by, "glrlm", RUN_NAMES, ["dir"]))
        if "glszm" in classes:
            out.append(size_matrix_features(zone_counts(zone_labels(levels, near, by, rejects), by), by, "glszm", ZONE_NAMES))
        if "gldm" in classes:
            out.append(size_matrix_features(dependence_counts(near, by, rejects=rejects), by, "gldm", DEPENDENCE_NAMES))
        if "ngtdm" in classes:
            out.append(ngtdm(tone_table(near, by, rejects=rejects), by))
    if packed:
        return _unfolded(out, by, rejects)
    first, *others = out
    for o in others:
        first = first.unionByName(o)
    return first


def _unfolded(classes: list[DataFrame], by: list[str], rejects: list[DataFrame] | None) -> DataFrame:
    """Long rows from the arrays of features, which are written once; images with a reason go to ``rejects``."""
    about = [p.schema["values"].metadata for p in classes]
    names = F.create_map(*[c for m in about for c in (F.lit(m["class"]), F.array(*map(F.lit, m["features"])))])
    done = cut_lineage(reduce(DataFrame.unionByName, classes))
    if rejects is not None:
        rejects.append(done.where(F.col(REASON).isNotNull()).select(*by, F.col(REASON).alias("reason")).distinct())
    cells = F.inline(F.arrays_zip(names[F.col("class")].alias("feature"), "values"))
    return done.where(F.col(REASON).isNull()).select(*by, "class", cells).toDF(*by, "class", "feature", "value")


def named_features(long: DataFrame, id_col: str = "image_id") -> DataFrame:
    """``(id, feature, value)`` with names such as ``wavelet-LHL_glcm_Correlation``."""
    prefix = F.col("filter") if "filter" in long.columns else F.lit("original")
    return long.select(id_col, F.concat_ws("_", prefix, "class", "feature").alias("feature"), "value")


def empty_masks(df: DataFrame, id_col: str = "image_id") -> DataFrame:
    """Images without a masked voxel, with the reason they have no features."""
    return (df.groupBy(id_col).agg(F.max("mask").alias("__m")).where("__m = 0")
            .select(id_col, F.lit("mask is empty").alias("reason")))


def extraction_summary(long: DataFrame, id_col: str = "image_id") -> DataFrame:
    """Images processed and features per image."""
    return named_features(long, id_col).agg(F.countDistinct(id_col).alias("n_images"), F.countDistinct("feature").alias("n_features"))
