from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazardframe.operators import neighbourhood as nb, texture as tx, voxel_grid as vg


def table(spark, volumes, masks=None):
    rows = []
    for k, v in volumes.items():
        for (z, y, x), value in np.ndenumerate(v):
            rows.append((k, z, y, x, float(value), 1 if masks is None else int(masks[k][z, y, x])))
    return spark.createDataFrame(rows, "image_id string, z int, y int, x int, intensity double, mask int")


def cube(df, shape, col="intensity"):
    out = np.zeros(shape)
    for r in df.collect():
        out[r.z, r.y, r.x] = r[col]
    return out


@pytest.fixture(scope="module")
def wide_image(spark):
    """Wider than two blocks, so that runs, zones and neighbours cross block borders."""
    rng = np.random.default_rng(0)
    vol = rng.integers(0, 3, (3, 4, 70)) * 25.0
    vol[1, 2, 5:60] = 50.0  # one long run
    mask = rng.random((3, 4, 70)) < 0.9
    mask[1, 2, 5:60] = True
    df = table(spark, {"a": vol, "b": vol[:, :, ::-1]}, {"a": mask, "b": mask[:, :, ::-1]})
    levels = vg.discretize(df, ["image_id"]).select("image_id", "z", "y", "x", "level").cache()
    lv = np.where(mask, vol // 25 + 1, 0).astype(int)
    lv = np.where(mask, lv - lv[mask].min() + 1, 0)
    return df, levels, nb.neighbourhoods(levels, ["image_id"]).cache(), lv


def near_cells(lv):
    for p in zip(*np.nonzero(lv)):
        for d in product((-1, 0, 1), repeat=3):
            q = tuple(a + b for a, b in zip(p, d))
            if any(d) and all(0 <= c < s for c, s in zip(q, lv.shape)) and lv[q]:
                yield p, d, q


def test_cooccurrence_against_loops(wide_image):
    _, _, near, lv = wide_image
    want = {}
    for p, d, q in near_cells(lv):
        if d in nb.DIRECTIONS:
            k = nb.DIRECTIONS.index(d)
            for a, b in ((lv[p], lv[q]), (lv[q], lv[p])):
                want[k, a, b] = want.get((k, a, b), 0) + 1
    got = {(r.dir, r.i, r.j): r.n for r in nb.glcm_counts(near, ["image_id"]).where("image_id = 'a'").collect()}
    assert got == want


def test_runs_against_loops(wide_image):
    _, _, near, lv = wide_image
    want = {}
    at = lambda p: lv[p] if all(0 <= c < s for c, s in zip(p, lv.shape)) else 0
    for k, d in enumerate(nb.DIRECTIONS):
        for p in zip(*np.nonzero(lv)):
            if at(tuple(a - b for a, b in zip(p, d))) == lv[p]:
                continue
            size, q = 1, tuple(a + b for a, b in zip(p, d))
            while at(q) == lv[p]:
                size, q = size + 1, tuple(a + b for a, b in zip(q, d))
            want[k, lv[p], size] = want.get((k, lv[p], size), 0) + 1
    got = {(r.dir, r.level, r.size): r.n for r in nb.run_counts(near, ["image_id"]).where("image_id = 'a'").collect()}
    assert got == want and max(s for _, _, s in got) >= 55


def flood(lv):
    zone = {}
    links = {}
    for p, d, q in near_cells(lv):
        if lv[p] == lv[q]:
            links.setdefault(p, []).append(q)
    for p in zip(*np.nonzero(lv)):
        if p in zone:
            continue
        todo, zone[p] = [p], p
        while todo:
            for q in links.get(todo.pop(), []):
                if q not in zone:
                    zone[q] = p
                    todo.append(q)
    return zone


def test_zones_against_flood_fill(wide_image):
    _, levels, near, lv = wide_image
    zone = flood(lv)
    pos = lambda p: (int(p[0]) * nb.SIDE + int(p[1])) * nb.SIDE + int(p[2])
    got = {r.pos: r.zone for r in tx.zone_labels(levels, near, ["image_id"]).where("image_id = 'a'").collect()}
    assert got == {pos(p): pos(z) for p, z in zone.items()}


def test_zones_through_several_slabs(spark):
    """One zone through all slabs, others inside one or across one face, single voxels, and a second image of one slab."""
    rng = np.random.default_rng(4)
    big = np.where(rng.random((20, 36, 70)) < 0.12, rng.integers(2, 4, (20, 36, 70)), 0)
    big[::7, 18, :] = big[:, 18, 5] = big[7, :, 40] = big[19, 18, :] = 1
    small = np.where(rng.random((3, 4, 5)) < 0.5, 1, 0)
    rows = [(name, int(z), int(y), int(x), int(cube[z, y, x])) for name, cube in (("big", big), ("small", small)) for z, y, x in zip(*np.nonzero(cube))]
    levels = spark.createDataFrame(rows, "image_id string, z int, y int, x int, level int")
    near = nb.neighbourhoods(levels, ["image_id"])
    pos = lambda p: (int(p[0]) * nb.SIDE + int(p[1])) * nb.SIDE + int(p[2])
    got = {(r.image_id, r.pos): r.zone for r in tx.zone_labels(levels, near, ["image_id"]).collect()}
    assert got == {(name, pos(p)): pos(q) for name, cube in (("big", big), ("small", small)) for p, q in flood(cube).items()}
    main = got["big", pos((0, 18, 5))]
    through = {p & nb.SLAB for (name, p), zone in got.items() if name == "big" and zone == main}
    assert len(through) >= 8
    links = nb.zone_edges(near, ["image_id"]).cache()
    assert nb.crossing_links(links, nb.slab_roots(links, ["image_id"]), ["image_id"]).count() < links.count() / 5
    links.unpersist()


def test_zones_without_links(spark):
    levels = spark.createDataFrame([("a", 0, 0, 0, 1), ("a", 0, 0, 1, 2), ("a", 5, 5, 5, 2), (None, 1, 1, 1, 1)], "image_id string, z int, y int, x int, level int")
    got = tx.zone_labels(levels, nb.neighbourhoods(levels, ["image_id"]), ["image_id"]).collect()
    assert len(got) == 4 and all(r.pos == r.zone for r in got)


def test_a_winding_zone_settles_in_few_rounds(spark):
    """A snake of several hundred voxels: the diameter is far above the allowed number of rounds."""
    mask = np.zeros((1, 41, 40), bool)
    mask[0, ::2, :] = True
    mask[0, 1::4, -1] = True
    mask[0, 3::4, 0] = True
    df = table(spark, {"s": np.full(mask.shape, 10.0)}, {"s": mask})
    levels = vg.discretize(df, ["image_id"]).select("image_id", "z", "y", "x", "level")
    labels = tx.zone_labels(levels, nb.neighbourhoods(levels, ["image_id"]), ["image_id"], max_rounds=30)
    assert labels.select("zone").distinct().count() == 1 and labels.count() == mask.sum()


def test_dependence_and_tone_against_loops(wide_image):
    _, _, near, lv = wide_image
    alike, around = {}, {}
    for p, d, q in near_cells(lv):
        alike[p] = alike.get(p, 0) + (lv[p] == lv[q])
        around.setdefault(p, []).append(lv[q])
    dep, tone = {}, {}
    for p in zip(*np.nonzero(lv)):
        key = (lv[p], alike.get(p, 0) + 1)
        dep[key] = dep.get(key, 0) + 1
        if p in around:
            n, s = tone.get(lv[p], (0, 0.0))
            tone[lv[p]] = (n + 1, s + abs(lv[p] - np.mean(around[p])))
    got = {(r.level, r.size): r.n for r in nb.dependence_counts(near, ["image_id"]).where("image_id = 'a'").collect()}
    assert got == dep
    for r in nb.tone_table(near, ["image_id"]).where("image_id = 'a'").collect():
        assert r.n == tone[r.level][0] and r.s == pytest.approx(tone[r.level][1])


def test_maximal_correlation(wide_image):
    _, levels, near, lv = wide_image
    counts = nb.glcm_counts(near, ["image_id"]).where("image_id = 'a'")
    got = {r.feature: r.value for r in tx.glcm(counts, levels, ["image_id"]).collect()}
    values = []
    for k in range(13):
        cells = [r for r in counts.collect() if r.dir == k]
        p = np.zeros((4, 4))
        for r in cells:
            p[r.i, r.j] = r.n
        p = p[1:, 1:] / p.sum()
        q = (p / p.sum(1)[:, None]) @ (p / p.sum(0)[None, :]).T
        values.append(np.sqrt(np.sort(np.linalg.eigvals(q).real)[-2]))
    assert got["MCC"] == pytest.approx(np.mean(values))
    assert len(got) == 24


@pytest.mark.parametrize("spacing, size", [((2.0, 0.8, 0.8), (10, 8, 8)), ((1.0, 1.0, 1.0), (5, 10, 10))])
def test_regrid_sizes_and_labels(spark, spacing, size):
    vol = np.arange(500.0).reshape(5, 10, 10)
    mask = np.zeros_like(vol, bool)
    mask[2:4, 3:7, 3:7] = True
    df = table(spark, {"a": vol}, {"a": mask})
    for fn in (vg.regrid_nearest, vg.regrid_linear):
        out = fn(df, spacing)
        top = out.agg(*[(F.max(a) + 1).alias(a) for a in "zyx"]).first()
        assert tuple(top) == size and out.count() == np.prod(size)
        assert {r.mask for r in out.select("mask").distinct().collect()} == {0, 1}
    if spacing == (1.0, 1.0, 1.0):
        np.testing.assert_allclose(cube(vg.regrid_linear(df, spacing), size), vol)


def test_linear_regrid_against_interpolation(spark):
    vol = np.random.default_rng(1).normal(size=(3, 4, 5))
    spacing = (1.6, 0.7, 1.3)
    got = vg.regrid_linear(table(spark, {"a": vol}), spacing)
    size = tuple(int(np.rint(n * s)) for n, s in zip(vol.shape, spacing))
    want = np.zeros(size)
    for t in product(*[range(n) for n in size]):
        at = [i / s for i, s in zip(t, spacing)]
        if any(a >= n - 0.5 for a, n in zip(at, vol.shape)):
            continue
        for corner in product((0, 1), repeat=3):
            idx = [min(int(a) + c, n - 1) for a, c, n in zip(at, corner, vol.shape)]
            want[t] += np.prod([(a - int(a)) if c else 1 - (a - int(a)) for a, c in zip(at, corner)]) * vol[tuple(idx)]
    np.testing.assert_allclose(cube(got, size), want, atol=1e-9)


def test_wavelet_bands_against_direct_filtering(spark):
    vol = np.random.default_rng(2).normal(size=(6, 6, 8))
    bands = vg.wavelet(table(spark, {"a": vol}))
    assert bands.select("filter").distinct().count() == 8
    k = vg.wavelet_kernels()
    want = vol
    for axis, name in ((2, "L"), (1, "H"), (0, "L")):
        want = sum(w * np.roll(want, -o, axis=axis) for o, w in k[name].items())
    got = cube(bands.where("filter = 'wavelet-LHL'"), vol.shape)
    np.testing.assert_allclose(got, want, atol=1e-10)
    assert sum(k["L"].values()) == pytest.approx(np.sqrt(2), abs=1e-9) and sum(k["H"].values()) == pytest.approx(0, abs=1e-9)


def test_laplacian_against_direct_filtering(spark):
    vol = np.random.default_rng(3).normal(size=(4, 5, 6))
    k = vg.gaussian_kernels(1.0)
    r = max(k["G"])

    def along(a, axis, taps):
        pad = np.pad(a, [(r, r) if i == axis else (0, 0) for i in range(3)], mode="edge")
        n = a.shape[axis]
        return sum(w * np.take(pad, range(r + o, r + o + n), axis=axis) for o, w in taps.items())

    want = 0
    for d in range(3):
        part = vol
        for axis in range(3):
            part = along(part, axis, k["D" if axis == d else "G"])
        want = want + part
    got = vg.laplacian_of_gaussian(table(spark, {"a": vol}), 1.0)
    np.testing.assert_allclose(cube(got, vol.shape), want, atol=1e-10)
    assert got.first()["filter"] == "log-sigma-1-0-mm-3D"
    flat = vg.laplacian_of_gaussian(table(spark, {"a": np.full((4, 4, 4), 9.0)}), 2.0)
    assert max(abs(r.intensity) for r in flat.collect()) < 1e-9


def test_zero_boundary_stencil(spark):
    vol = np.ones((1, 1, 4))
    out = vg.stencil(vg.with_sizes(table(spark, {"a": vol}), ["image_id"]), "x", {"m": {-1: 1.0, 1: 1.0}}, boundary="zero")
    assert [r.intensity for r in out.orderBy("x").collect()] == [1.0, 2.0, 2.0, 1.0]


def test_full_extraction_width_names_and_rejects(spark):
    rng = np.random.default_rng(4)
    vols = {"a": rng.normal(size=(5, 5, 5)) * 60, "b": rng.normal(size=(5, 5, 5)) * 60, "empty": np.ones((3, 3, 3))}
    masks = {k: np.zeros(v.shape, bool) for k, v in vols.items()}
    for k in "ab":
        masks[k][1:4, 1:4, 1:4] = True
    df = table(spark, vols, masks)
    assert [r.image_id for r in tx.empty_masks(df).collect()] == ["empty"]
    images = vg.image_types(vg.normalize(df), ["image_id"], sigmas=(1.0,), bands=False)
    long = tx.extract_features(images, ["image_id", "filter"]).cache()
    names = tx.named_features(long)
    summary = tx.extraction_summary(long).first()
    # Six image types with 93 intensity and texture features each, and 6 shape features of the mask.
    assert (summary.n_images, summary.n_features) == (2, 6 * 93 + 6)
    assert names.count() == 2 * summary.n_features and names.where("value is null").count() == 0
    have = {r.feature for r in names.select("feature").distinct().collect()}
    assert {"original_shape_VoxelVolume", "log-sigma-1-0-mm-3D_glcm_Correlation", "square_glszm_ZoneEntropy"} <= have
    vol = {r.image_id: r.value for r in names.where("feature = 'original_shape_VoxelVolume'").collect()}
    assert vol == {"a": 27.0, "b": 27.0}


def test_flat_region_has_defined_features(spark):
    df = table(spark, {"flat": np.full((3, 3, 3), 7.0), "dot": np.full((1, 1, 1), 7.0)})
    got = {(r.image_id, r["class"], r.feature): r.value for r in tx.extract_features(df).collect()}
    assert got["flat", "firstorder", "Entropy"] == 0 and got["flat", "firstorder", "Kurtosis"] == 0
    assert got["flat", "glcm", "Correlation"] == 1 and got["flat", "glcm", "MCC"] == 1 and got["flat", "ngtdm", "Coarseness"] == 1e6
    assert got["dot", "glszm", "ZonePercentage"] == 1 and got["dot", "shape", "MajorAxisLength"] == 0
    assert ("dot", "glcm", "Contrast") not in got  # one voxel has no pair
