import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hazardframe.operators import extraction as ex, packed, texture as tx, voxel_grid as vg

VOXELS = "image_id long, z int, y int, x int, intensity double, mask int"


def image(k, shape, seed=0, holes=0.0, outside=0.2):
    rng = np.random.default_rng(seed)
    return [(k, *map(int, p), float(rng.integers(-200, 200)), int(rng.random() >= outside)) for p in np.ndindex(shape) if rng.random() >= holes]


def images():
    """Cubes, one of one voxel and a flat one, one over two blocks, one with voxels that are missing, a constant one, and one without an id."""
    rows = [r for k in range(3) for r in image(k, (4, 4, 4), k)]
    rows += [(3, 0, 0, 0, 5.0, 1)] + [(4, z, y, x, 7.0, 1) for z in range(2) for y in range(2) for x in range(3)]
    return rows + image(5, (2, 3, 40), 5) + image(6, (5, 4, 3), 6, holes=0.3) + image(None, (3, 3, 3), 7) + image(2**60 + 1, (1, 6, 2), 8)


def long(df):
    return {(r.image_id, r["filter"], r["class"], r.feature): r.value for r in df.collect()}


def test_packed_images_have_the_features_of_voxel_rows(spark, monkeypatch):
    df = spark.createDataFrame(images(), VOXELS)
    got, refused = ex.extract_isolated(df)
    monkeypatch.setattr(packed, "WHOLE", 50)  # the two larger ones and the cubes stay rows
    mixed, refused_mixed = ex.extract_isolated(df)
    monkeypatch.setattr(packed, "WHOLE", 0)
    want, refused_rows = ex.extract_isolated(df)
    assert sorted(map(tuple, refused.collect())) == sorted(map(tuple, refused_rows.collect())) == sorted(map(tuple, refused_mixed.collect()))
    want = long(want)
    assert {k[2] for k in want} == set(tx.CLASSES) and len({k[1] for k in want}) == 16
    for rows in (long(got), long(mixed)):
        assert rows.keys() == want.keys() and rows == pytest.approx(want, rel=1e-8, abs=1e-8, nan_ok=True)


def test_packed_image_types_are_those_of_rows(spark):
    df = spark.createDataFrame(images(), VOXELS)
    rows = vg.packed_image_types(df)
    cells = rows.select("image_id", "filter", "ny", "nx", F.inline(F.arrays_zip("at", "v"))).collect()
    got = {(r.image_id, r["filter"], r["at"] // (r.ny * r.nx), r["at"] // r.nx % r.ny, r["at"] % r.nx): r.v for r in cells}
    want = {(r.image_id, r["filter"], r.z, r.y, r.x): r.intensity for r in vg.image_types(df).where("mask = 1").collect()}
    assert len(got) == len(cells) and got == pytest.approx(want, rel=1e-12, abs=1e-12)


def written_bytes(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder) for f in files)


def test_a_full_extraction_writes_little_more_than_its_features(spark, tmp_path):
    """All that is written for a cube of 64 voxels: under 64 KB, where 1,494 features of eight bytes are 12 KB."""
    n = 300
    df = spark.createDataFrame([r for k in range(n) for r in image(k, (4, 4, 4), k)], VOXELS)
    before = spark.sparkContext.getCheckpointDir()
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    try:
        features, _ = ex.extract_isolated(df)
        assert features.count() >= n * 1400
        assert written_bytes(tmp_path) < n * 64_000
    finally:
        spark.sparkContext.setCheckpointDir(before or str(tmp_path))


def test_a_packed_image_that_makes_a_kernel_fail_has_a_reason(spark):
    table = vg.packed_image_types(spark.createDataFrame([r for k in range(5) for r in image(k, (2, 2, 2), k, outside=0)], VOXELS), sigmas=(), bands=False, points=False)

    def kernel(part):
        if 3 in part.column("image_id").to_pylist():
            raise ValueError("no")
        return [pa.array(np.diff(part.column("at").offsets.to_numpy()).astype(np.int64))]

    with pytest.raises(Exception, match="no"):
        packed.per_image(table, ["image_id"], kernel, "n bigint").collect()
    first = packed.per_image(table, ["image_id"], kernel, "n bigint", isolate=True)
    again = packed.per_image(first, ["image_id"], lambda part: [part.column("n")], "n bigint")
    for rows in (first, again):
        assert {r.image_id: (r.n, r[packed.REASON]) for r in rows.collect()} == {k: (8, None) if k != 3 else (None, "ValueError: no") for k in range(5)}
