"""Extraction of all feature classes from all image types, in which a broken image costs only itself.

An image can be broken in its rows, which one aggregation per image finds before anything is computed, or make a counting
kernel fail; the kernel then returns a reject row for it and goes on with the others. Either way its id and the reason go to a
table of their own, and none of its features are reported.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from hazardframe.operators.neighbourhood import SIDE
from hazardframe.operators.ordered import BROADCAST_ROWS, match_stats
from hazardframe.operators.packed import by_size, is_packed
from hazardframe.operators.texture import CLASSES, extract_features
from hazardframe.operators.voxel_grid import AXES, BIN_WIDTH, LOG_SIGMAS, image_types, normalize, packed_image_types
from hazardframe.session import cut_lineage, settle

MAX_LEVELS = 1 << 20  # grey levels that the packed counts hold


def _row_reason() -> Column:
    """What is wrong with one voxel, or null."""
    coordinates = [F.col(a) for a in AXES]
    missing = reduce(lambda a, b: a | b, [c.isNull() for c in coordinates])
    outside = reduce(lambda a, b: a | b, [(c < 0) | (c >= SIDE) for c in coordinates])
    unreal = F.col("intensity").isNull() | F.isnan(F.col("intensity").cast("double")) | (F.abs(F.col("intensity").cast("double")) == float("inf"))
    return (F.when(missing, "a coordinate is missing").when(outside, "a coordinate is out of range")
            .when(F.col("mask").isNull(), "a mask value is missing").when(unreal, "an intensity is not a finite number"))


def broken_images(df: DataFrame, by: list[str] = ("image_id",)) -> DataFrame:
    """``(by, reason)`` of images whose rows cannot be used; of several reasons the first in alphabetical order.

    Partial aggregates per image and, for voxels that occur twice, per voxel; no image is collected.
    """
    by = list(by)
    rows = df.withColumn("__reason", _row_reason())
    per_image = rows.groupBy(*by).agg(F.min("__reason").alias("__reason"), F.max("mask").alias("__mask"))
    whole = F.coalesce(F.col("__reason"), F.when(F.coalesce(F.col("__mask"), F.lit(0)) != 1, "mask is empty"))
    twice = (rows.where("__reason is null").groupBy(*by, *AXES).agg(F.count("*").alias("__n")).where("__n > 1")
             .select(*by, F.lit("a voxel occurs twice").alias("reason")).distinct())
    found = per_image.select(*by, whole.alias("reason")).where("reason is not null").unionByName(twice)
    return found.groupBy(*by).agg(F.min("reason").alias("reason"))


def too_many_levels(images: DataFrame, by: list[str], width: float = BIN_WIDTH, most: int = MAX_LEVELS) -> DataFrame:
    """``(by, reason)`` of images whose masked intensities span more grey levels than the counts hold, or are not finite."""
    ends = lambda hi, lo: (F.floor(hi / width).cast("double").alias("hi"), F.floor(lo / width).cast("double").alias("lo"))
    if is_packed(images):
        span = images.select(*by, *ends(F.array_max("v"), F.array_min("v")))
    else:
        x = F.col("intensity").cast("double")
        span = images.where("mask = 1").groupBy(*by).agg(*ends(F.max(x), F.min(x)))
    fits = (F.col("hi") - F.col("lo") < most) & ~F.isnan("hi")
    return span.where(~F.coalesce(fits, F.lit(False))).select(*by, F.lit("too many grey levels").alias("reason"))


def without(df: DataFrame, broken: DataFrame, by: list[str]) -> DataFrame:
    """Rows of the images that are not in ``broken``, which is written and counted, and sent to the executors only if it is small."""
    table, n = settle(broken.select(*[F.col(b).alias(f"__b_{b}") for b in by]).distinct())
    if not n:
        return df
    same = reduce(lambda a, b: a & b, [df[b].eqNullSafe(table[f"__b_{b}"]) for b in by])
    return df.join(F.broadcast(table) if n <= BROADCAST_ROWS else table, same, "left_anti")


def extract_isolated(df: DataFrame, by: list[str] = ("image_id",), classes: tuple[str, ...] = CLASSES, width: float = BIN_WIDTH,
                     spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), normalized: bool = True, derived: bool = True,
                     sigmas: tuple[float, ...] = LOG_SIGMAS, bands: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(features, rejects)`` of a voxel table: ``(by, filter, class, feature, value)`` and ``(by, reason)``.

    By default images are normalised and all sixteen image types are made: the original, four pointwise ones, a Laplacian
    for each sigma and eight wavelet bands; all classes are computed from each, shape from the original alone. An empty
    table gives two empty ones. Images of bounded size are packed, many side by side in a task; voxels of larger ones stay rows.
    """
    by = list(by)
    key = [*by, "filter"]
    scaled = lambda d: normalize(d, by=by) if normalized else d
    broken = cut_lineage(broken_images(df, by))
    small, large = by_size(without(df, broken, by), by)
    images = [cut_lineage(packed_image_types(scaled(small), by, sigmas if derived else (), bands and derived, derived))]
    if large is not None:
        large = cut_lineage(scaled(large))
        images.append(cut_lineage(image_types(large, by, sigmas, bands) if derived else large.withColumn("filter", F.lit("original"))))
    wide = cut_lineage(reduce(DataFrame.unionByName, [too_many_levels(i, key, width).select(*by, "reason") for i in images]).distinct())
    failed: list[DataFrame] = []
    features = [extract_features(without(i, wide, by), key, classes, width, spacing, failed) for i in images]
    features = reduce(DataFrame.unionByName, [features[0], *map(cut_lineage, features[1:])])
    rejects = reduce(DataFrame.unionByName, [d.select(*by, "reason") for d in failed], broken.unionByName(wide))
    rejects = cut_lineage(rejects.groupBy(*by).agg(F.min("reason").alias("reason")))
    return without(features, rejects, by) if failed else features, rejects


def outcomes(df: DataFrame, features: DataFrame, rejects: DataFrame, by: list[str] = ("image_id",)) -> DataFrame:
    """One row for each image: the number of its features, and the reason if it has none."""
    by = list(by)
    counts = features.groupBy(*by).agg(F.count("*").alias("n_features"))
    every = match_stats(df.select(*by).distinct(), counts.withColumn("reason", F.lit(None).cast("string")).unionByName(
        rejects.withColumn("n_features", F.lit(0).cast("long"))), by)
    return every.select(*by, "n_features", "reason")
