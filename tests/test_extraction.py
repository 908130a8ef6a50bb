import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hazardframe.operators import extraction as ex, neighbourhood as nb, texture as tx, voxel_grid as vg

VOXELS = "image_id int, z int, y int, x int, intensity double, mask int"


def cube(image, side=3, seed=0, mask=1):
    rng = np.random.default_rng(seed + image)
    return [(image, z, y, x, float(rng.integers(0, 200)), mask) for z in range(side) for y in range(side) for x in range(side)]


def changed(rows, at, **new):
    names = ["image_id", "z", "y", "x", "intensity", "mask"]
    return [tuple(new.get(n, v) if k == at else v for n, v in zip(names, r)) for k, r in enumerate(rows)]


BROKEN = {
    10: (changed(cube(10), 4, x=1 << 20), "a coordinate is out of range"), 11: (changed(cube(11), 4, y=-1), "a coordinate is out of range"),
    12: (changed(cube(12), 0, z=None), "a coordinate is missing"), 13: (changed(cube(13), 2, intensity=math.nan), "an intensity is not a finite number"),
    14: (changed(cube(14), 2, intensity=math.inf), "an intensity is not a finite number"), 15: (changed(cube(15), 2, intensity=None), "an intensity is not a finite number"),
    16: (changed(cube(16), 9, mask=None), "a mask value is missing"), 17: (cube(17, mask=0), "mask is empty"),
    18: (cube(18) + cube(18)[:1], "a voxel occurs twice"), 19: (changed(cube(19), 2, intensity=1e15), "too many grey levels")}


def long(df):
    return {(r.image_id, r["filter"], r["class"], r.feature): r.value for r in df.collect()}


def test_broken_images_are_refused_and_the_others_are_as_without_them(spark):
    good = cube(1) + cube(2)
    rows = good + [r for rows, _ in BROKEN.values() for r in rows]
    classes = ("firstorder", "shape", "gldm")
    features, rejects = ex.extract_isolated(spark.createDataFrame(rows, VOXELS), classes=classes, normalized=False, derived=False)
    assert {r.image_id: r.reason for r in rejects.collect()} == {k: reason for k, (_, reason) in BROKEN.items()}
    alone, none = ex.extract_isolated(spark.createDataFrame(good, VOXELS), classes=classes, normalized=False, derived=False)
    assert none.count() == 0 and long(features) == pytest.approx(long(alone), nan_ok=True)
    per = {r.image_id: (r.n_features, r.reason) for r in ex.outcomes(spark.createDataFrame(rows, VOXELS), features, rejects).collect()}
    assert per[1] == (18 + 6 + 14, None) and per[17] == (0, "mask is empty") and len(per) == 12


def test_an_image_that_makes_a_kernel_fail_gives_a_reject_row(spark):
    df = spark.createDataFrame([r for i in range(6) for r in cube(i)], VOXELS).repartition(2)
    near = nb.neighbourhoods(vg.discretize(df).select("image_id", *vg.AXES, "level"), ["image_id"])

    def kernel(batch):
        if 3 in batch.column("image_id").to_pylist():
            raise ValueError("no")
        yield pa.RecordBatch.from_arrays([batch.column("image_id"), pa.array([1] * batch.num_rows, pa.int64())], names=["image_id", "n"])

    with pytest.raises(Exception, match="no"):
        nb._run(near, ["image_id"], kernel, "n bigint").collect()
    rejects = []
    rows = nb._run(near, ["image_id"], kernel, "n bigint", rejects).groupBy("image_id").agg(F.sum("n").alias("n")).collect()
    assert {r.image_id: r.n for r in rows} == {i: 9 for i in range(6) if i != 3}
    assert [tuple(r) for r in rejects[0].collect()] == [(3, "ValueError: no")]


def test_failures_in_any_class_remove_the_whole_image(spark, monkeypatch):
    """A tone kernel that fails for one image: its other classes are not reported either."""
    real = tx.tone_table

    def failing(near, by, rejects=None):
        rejects.append(near.where("image_id = 2").select("image_id", F.lit("broken").alias("reason")).distinct())
        return real(near, by)

    monkeypatch.setattr(tx, "tone_table", failing)
    features, rejects = ex.extract_isolated(spark.createDataFrame(cube(1) + cube(2), VOXELS), classes=("shape", "ngtdm"), derived=False)
    assert {r.image_id for r in features.collect()} == {1} and [tuple(r) for r in rejects.collect()] == [(2, "broken")]


def test_full_extraction_is_each_class_of_each_image_type(spark):
    df = spark.createDataFrame(cube(1, 4) + cube(2, 4), VOXELS)
    features, rejects = ex.extract_isolated(df)
    got = long(features)
    assert rejects.count() == 0
    images = vg.image_types(vg.normalize(df))
    kinds = {r[0] for r in images.select("filter").distinct().collect()}
    assert len(kinds) == 16 and {"log-sigma-1-0-mm-3D", "log-sigma-2-0-mm-3D", "log-sigma-3-0-mm-3D", "wavelet-LHL"} <= kinds
    assert {k[1] for k in got} == kinds and {k[2] for k in got if k[1] != "original"} == set(tx.CLASSES) - {"shape"}
    per_type = 18 + 24 + 16 + 16 + 14 + 5
    assert len(got) in (2 * (16 * per_type + 6), 2 * (16 * (per_type - 1) + 6))  # with or without the eigenvalue of the co-occurrence matrix
    for kind in ("log-sigma-3-0-mm-3D", "wavelet-HHL"):
        one = images.where(F.col("filter") == kind)
        first = {(r.image_id, r.feature): r.value for r in tx.first_order(one, ["image_id"]).collect()}
        assert {(k[0], k[3]): v for k, v in got.items() if k[1:3] == (kind, "firstorder")} == pytest.approx(first)


def test_empty_table(spark):
    features, rejects = ex.extract_isolated(spark.createDataFrame([], VOXELS), classes=("firstorder", "gldm"), derived=False)
    assert features.count() == 0 and rejects.count() == 0
