import numpy as np
import pytest
from pyspark.sql import functions as F

from hazardframe.operators import neighbourhood as nb, texture as tx, voxel_grid as vg

VOXELS = "image_id string, z int, y int, x int, intensity double, mask int"


def images(spark, n=3, shape=(4, 5, 6), seed=0):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(f"i{k}", *map(int, p), float(rng.integers(0, 200)), 1) for k in range(n) for p in np.ndindex(shape)], VOXELS)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def near_of(df):
    levels = vg.discretize(df).select("image_id", *vg.AXES, "level")
    return levels, nb.neighbourhoods(levels, ["image_id"])


def test_packed_matrices_equal_rows_of_cells(spark):
    """One image over several slabs, so that its matrices come in parts, beside small ones; no cell becomes a row."""
    df = images(spark).unionByName(images(spark, 1, (2, 20, 40), 1).withColumn("image_id", F.lit("large"))).unionByName(
        images(spark, 1, (2, 2, 2), 2).withColumn("image_id", F.lit(None).cast("string")))
    levels, near = near_of(df)
    got = tx.glcm_packed(nb.glcm_matrices(near, ["image_id"]), ["image_id"])
    assert "Window" not in plan(got)
    want = tx.glcm(nb.glcm_counts(near, ["image_id"]), levels, ["image_id"])
    values = lambda d: {(r.image_id, r.feature): r.value for r in d.collect()}
    assert values(got) == pytest.approx(values(want), rel=1e-9, abs=1e-9)
    parts = nb.glcm_matrices(near.repartition(7, "y"), ["image_id"])
    assert parts.agg(F.max(F.size("parts"))).first()[0] > 1
    assert values(tx.glcm_packed(parts, ["image_id"])) == pytest.approx(values(want), rel=1e-9, abs=1e-9)


def test_images_of_very_many_levels_keep_rows_of_cells(spark, monkeypatch):
    levels, near = near_of(images(spark))
    want = {(r.image_id, r.feature): r.value for r in tx.glcm_of_images(near, levels, ["image_id"]).collect()}
    monkeypatch.setattr(tx, "WIDE", int(levels.groupBy("image_id").agg(F.max("level").alias("m")).agg(F.max("m")).first()[0]) - 1)
    got = {(r.image_id, r.feature): r.value for r in tx.glcm_of_images(near, levels, ["image_id"]).collect()}
    assert len(want) == 3 * 24 and got == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_rows_are_as_wide_as_the_image(spark):
    _, near = near_of(images(spark))
    assert near.agg(F.max(F.size("near"))).first()[0] <= 9 * 8


def test_small_groups_are_not_ordered_by_ranges(spark, monkeypatch):
    df = images(spark, 5).unionByName(spark.createDataFrame([("odd", 0, 0, k, float("nan") if k == 2 else 1.0 * k, 1) for k in range(9)], VOXELS))
    want = {(r.image_id, r.feature): r.value for r in tx.first_order(df).collect()}
    monkeypatch.setattr(tx, "ROWS_PER_RANGE", 0)  # every group by joins and ranges
    assert {(r.image_id, r.feature): r.value for r in tx.first_order(df).collect()} == pytest.approx(want, rel=1e-9, abs=1e-9, nan_ok=True)
    monkeypatch.undo()
    monkeypatch.setattr(tx, "running", None)
    assert tx.first_order(images(spark, 5)).count() == 5 * 18


def test_sigmas_share_their_passes(spark):
    df = images(spark)
    got = vg.laplacians_of_gaussian(df, (1.0, 2.0))
    assert plan(got).count("hashpartitioning") == 3
    one = {(r.image_id, r.z, r.y, r.x): r.intensity for r in vg.laplacian_of_gaussian(df, 2.0).collect()}
    two = {(r.image_id, r.z, r.y, r.x): r.intensity for r in got.where("filter = 'log-sigma-2-0-mm-3D'").collect()}
    assert len(one) == 360 and two == pytest.approx(one)


@pytest.mark.parametrize("boundary, mode", [("nearest", "edge"), ("periodic", "wrap"), ("zero", "constant")])
def test_borders_of_short_and_long_lines(spark, boundary, mode):
    for n in (3, 64, 150):
        vol = np.random.default_rng(n).normal(size=(1, 1, n))
        df = spark.createDataFrame([("a", 0, 0, x, float(vol[0, 0, x]), 1) for x in range(n)], VOXELS)
        taps = {-5: 0.5, 0: 1.0, 7: -2.0}
        rows = vg.stencil(vg.with_sizes(df, ["image_id"]), "x", {"m": taps}, boundary=boundary).orderBy("x").collect()
        padded = np.pad(vol[0, 0], 7, mode=mode)
        np.testing.assert_allclose([r.intensity for r in rows], sum(w * padded[7 + o:7 + o + n] for o, w in taps.items()), atol=1e-12)


def test_a_repeated_voxel_is_one_row_of_the_laplacian(spark):
    df = images(spark, 1)
    twice = df.unionByName(df.where("x = 2")).unionByName(df.where("x = 3").withColumn("mask", F.lit(0)))
    once = {(r.z, r.y, r.x): r.intensity for r in vg.laplacian_of_gaussian(df, 1.0).collect()}
    got = {(r.z, r.y, r.x, r.mask): r.intensity for r in vg.laplacian_of_gaussian(twice, 1.0).collect()}
    assert len(got) == 120 + 20
    assert got == pytest.approx({(*p, m): v * (2 if p[2] == 2 else 1) for p, v in once.items() for m in ((1, 0) if p[2] == 3 else (1,))})
