"""Registered queries: voxel grids and texture features on cubes cut from the embeddings, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardframe.operators import extraction as ex, neighbourhood as nb, texture as tx, voxel_grid as vg
from hazardframe.plans import cohorts as co
from hazardframe.plans.sqltext import fixed, rounded_sql
from hazardframe.session import cut_lineage
from hazardframe.sources.tables import features_long_to_wide

BY = ["image_id"]
SPACING = (2.0, 0.8, 0.8)


def _levels(spark, sf):
    return cut_lineage(vg.discretize(co.voxels(spark, sf), BY).select(*BY, *vg.AXES, "level"))


def _near(spark, sf):
    levels = _levels(spark, sf)
    return levels, cut_lineage(nb.neighbourhoods(levels, BY))


def glcm(spark, sf, mcc=False):
    levels, near = _near(spark, sf)
    return fixed(tx.glcm_of_images(near, levels, BY, mcc), 4)


def glcm_mcc(spark, sf):
    return glcm(spark, sf, True).where("feature = 'MCC'")


def glrlm(spark, sf):
    return fixed(tx.size_matrix_features(nb.run_counts(_near(spark, sf)[1], BY), BY, "glrlm", tx.RUN_NAMES, ["dir"]), 4)


def zone_labels(spark, sf):
    return tx.zone_labels(*_near(spark, sf), BY).select("image_id", "pos", "level", "zone")


def glszm(spark, sf):
    counts = tx.zone_counts(tx.zone_labels(*_near(spark, sf), BY), BY)
    return fixed(tx.size_matrix_features(counts, BY, "glszm", tx.ZONE_NAMES), 4)


def gldm(spark, sf):
    return fixed(tx.size_matrix_features(nb.dependence_counts(_near(spark, sf)[1], BY), BY, "gldm", tx.DEPENDENCE_NAMES), 4)


def ngtdm(spark, sf):
    return fixed(tx.ngtdm(nb.tone_table(_near(spark, sf)[1], BY), BY), 4)


def _filtered(spark, sf):
    return vg.image_types(co.voxels(spark, sf), sigmas=(1.0,), bands=False)


def derived_first_order(spark, sf):
    """First-order features of the original, the pointwise and one Laplacian image type."""
    return fixed(tx.first_order(_filtered(spark, sf), ["image_id", "filter"]), 4)


def wide_features(spark, sf):
    """One row per image: first-order, shape and dependence features as columns."""
    long = tx.extract_features(co.voxels(spark, sf), BY, ("firstorder", "shape", "gldm"))
    return fixed(features_long_to_wide(tx.named_features(long), "image_id"), 4)


def extraction_summary(spark, sf):
    return tx.extraction_summary(tx.extract_features(co.voxels(spark, sf), BY, ("firstorder", "shape", "gldm")))


def broken_voxels(spark, sf):
    """The cubes, of which one in twenty is broken in one of five ways."""
    v, kind = co.voxels(spark, sf), F.pmod("image_id", F.lit(100))
    first = (F.col("z") == 0) & (F.col("y") == 0) & (F.col("x") == 0)
    v = v.withColumns({"x": F.when((kind == 3) & first, F.lit(1 << 20)).otherwise(F.col("x")).cast("int"),
                       "intensity": F.when((kind == 7) & first, F.lit(float("nan"))).when((kind == 17) & first, 1e12).otherwise(F.col("intensity")),
                       "mask": F.when(kind == 11, 0).when((kind == 17) & first, 1).otherwise(F.col("mask"))})
    return v.unionByName(v.where((kind == 13) & first))


def isolated_extraction(spark, sf):
    """Features of all sound images, and a reject row with a reason for each broken one."""
    features, rejects = ex.extract_isolated(broken_voxels(spark, sf), BY, ("firstorder", "shape", "gldm"), normalized=False, derived=False)
    rows = tx.named_features(features).withColumn("reason", F.lit(None).cast("string"))
    refused = rejects.select("image_id", F.lit(None).cast("string").alias("feature"), F.lit(None).cast("double").alias("value"), "reason")
    return fixed(rows.unionByName(refused), 4)


def extraction_outcomes(spark, sf):
    v = broken_voxels(spark, sf)
    return ex.outcomes(v, *ex.extract_isolated(v, BY, ("firstorder", "shape", "gldm"), normalized=False, derived=False))


def full_extraction(spark, sf):
    """All seven classes of all sixteen image types of every normalised cube."""
    features, _ = ex.extract_isolated(co.voxels(spark, sf), BY)
    return fixed(tx.named_features(features), 4)


def log_all_sigmas(spark, sf):
    """The three Laplacians of the default image types."""
    got = vg.laplacians_of_gaussian(co.voxels(spark, sf), vg.LOG_SIGMAS)
    return fixed(got.select("image_id", "filter", *vg.AXES, "intensity"), 4)


def empty_masks(spark, sf):
    v = co.voxels(spark, sf).withColumn("mask", F.when(F.col("intensity") > 300, 1).otherwise(0))
    return tx.empty_masks(v)


QUERIES = {
    "regrid_nearest": lambda s, sf: vg.regrid_nearest(co.voxels(s, sf), SPACING),
    "regrid_linear": lambda s, sf: fixed(vg.regrid_linear(co.voxels(s, sf), SPACING), 4),
    "normalize_image": lambda s, sf: fixed(vg.normalize(co.voxels(s, sf)), 4),
    "pointwise_filters": lambda s, sf: fixed(vg.pointwise(co.voxels(s, sf)).select("image_id", "filter", *vg.AXES, "intensity"), 4),
    "wavelet_bands": lambda s, sf: fixed(vg.wavelet(co.voxels(s, sf)), 4),
    "laplacian_of_gaussian": lambda s, sf: fixed(vg.laplacian_of_gaussian(co.voxels(s, sf), 1.0).select("image_id", *vg.AXES, "intensity"), 4),
    "discretize": lambda s, sf: vg.discretize(co.voxels(s, sf)).select("image_id", *vg.AXES, "level"),
    "first_order_features": lambda s, sf: fixed(tx.first_order(co.voxels(s, sf)), 4),
    "derived_first_order": derived_first_order,
    "shape_features": lambda s, sf: fixed(tx.shape(co.voxels(s, sf), spacing=SPACING), 4),
    "glcm_counts": lambda s, sf: nb.glcm_counts(_near(s, sf)[1], BY),
    "glcm_features": glcm,
    "glcm_mcc": glcm_mcc,
    "run_counts": lambda s, sf: nb.run_counts(_near(s, sf)[1], BY),
    "glrlm_features": glrlm,
    "zone_labels": zone_labels,
    "glszm_features": glszm,
    "dependence_counts": lambda s, sf: nb.dependence_counts(_near(s, sf)[1], BY),
    "gldm_features": gldm,
    "tone_table": lambda s, sf: fixed(nb.tone_table(_near(s, sf)[1], BY)),
    "ngtdm_features": ngtdm,
    "wide_features": wide_features,
    "extraction_summary": extraction_summary,
    "empty_masks": empty_masks,
    "isolated_extraction": isolated_extraction,
    "extraction_outcomes": extraction_outcomes,
    "full_extraction": full_extraction,
    "laplacian_of_gaussian_all": log_all_sigmas,
}

_VOX = """
vox AS (SELECT image_id, CAST(p // 16 AS INTEGER) AS z, CAST((p // 4) % 4 AS INTEGER) AS y, CAST(p % 4 AS INTEGER) AS x,
               round(CAST(v AS DOUBLE) * 1000) AS intensity, CAST(round(CAST(v AS DOUBLE) * 1000) > -100 AS INTEGER) AS mask
        FROM (SELECT vec_id AS image_id, unnest(range(64)) AS p, unnest(embedding) AS v FROM embeddings))"""
_LV = _VOX + """,
lv AS (SELECT image_id, z, y, x, CAST(floor(intensity / 25) - floor(min(intensity) OVER (PARTITION BY image_id) / 25) + 1 AS INTEGER) AS level,
              (CAST(z AS BIGINT) * 1048576 + y) * 1048576 + x AS pos FROM vox WHERE mask = 1)"""
# The directions with their numbers, as the counts give them.
_DIRS = """dirs(dir, dz, dy, dx) AS (VALUES (0, 0, 0, 1), (1, 0, 1, 0), (2, 0, 1, 1), (3, 0, 1, -1), (4, 1, 0, 0), (5, 1, 0, 1), (6, 1, 0, -1),
         (7, 1, 1, 0), (8, 1, 1, 1), (9, 1, 1, -1), (10, 1, -1, 0), (11, 1, -1, 1), (12, 1, -1, -1))"""
_PAIRS = _LV + f""", {_DIRS},
pr AS (SELECT a.image_id, dir, a.pos AS a, b.pos AS b, a.level AS la, b.level AS lb FROM lv a CROSS JOIN dirs
       JOIN lv b ON b.image_id = a.image_id AND b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx)"""
_GLCM = _PAIRS + """,
gc AS (SELECT image_id, dir, i, j, CAST(count(*) AS BIGINT) AS n FROM (SELECT image_id, dir, la AS i, lb AS j FROM pr UNION ALL
       SELECT image_id, dir, lb, la FROM pr) GROUP BY ALL)"""


def _unpivot(source: str, kind: str, features: dict[str, str], keys: str = "image_id") -> str:
    return " UNION ALL ".join(f"SELECT {keys}, '{kind}' AS class, '{n}' AS feature, CAST({e} AS DOUBLE) AS value FROM {source}"
                              for n, e in features.items())


_FO = """,
m1 AS (SELECT {k}, count(*) AS n, avg(intensity) AS mean, min(intensity) AS lo, max(intensity) AS hi, sum((intensity + 1000) ** 2) AS energy,
              quantile_cont(intensity, 0.1) AS p10, quantile_cont(intensity, 0.25) AS p25, median(intensity) AS p50,
              quantile_cont(intensity, 0.75) AS p75, quantile_cont(intensity, 0.9) AS p90, var_pop(intensity) AS var
       FROM {v} WHERE mask = 1 GROUP BY {k}),
m2 AS (SELECT {k}, avg(abs(intensity - mean)) AS mad, avg((intensity - mean) ** 3) AS c3, avg((intensity - mean) ** 4) AS c4,
              avg(intensity) FILTER (intensity >= p10 AND intensity <= p90) AS rm FROM {v} JOIN m1 USING ({k}) WHERE mask = 1 GROUP BY {k}),
m3 AS (SELECT {k}, avg(abs(intensity - rm)) AS rmad FROM {v} JOIN m1 USING ({k}) JOIN m2 USING ({k})
       WHERE mask = 1 AND intensity >= p10 AND intensity <= p90 GROUP BY {k}),
m4 AS (SELECT {k}, -sum(p * log2(p)) AS entropy, sum(p * p) AS uniformity FROM (SELECT {k}, count(*) / any_value(n) AS p
       FROM {v} JOIN m1 USING ({k}) WHERE mask = 1 GROUP BY {k}, floor(intensity / 25)) GROUP BY {k}),
fo AS (SELECT * FROM m1 JOIN m2 USING ({k}) JOIN m3 USING ({k}) JOIN m4 USING ({k}))"""
_FO_FEATURES = {
    "Energy": "energy", "TotalEnergy": "energy", "Entropy": "entropy", "Minimum": "lo", "10Percentile": "p10", "90Percentile": "p90",
    "Maximum": "hi", "Mean": "mean", "Median": "p50", "InterquartileRange": "p75 - p25", "Range": "hi - lo",
    "MeanAbsoluteDeviation": "mad", "RobustMeanAbsoluteDeviation": "rmad", "RootMeanSquared": "sqrt(energy / n)",
    "Skewness": "CASE WHEN var = 0 THEN 0 ELSE c3 / var ** 1.5 END", "Kurtosis": "CASE WHEN var = 0 THEN 0 ELSE c4 / var ** 2 END",
    "Variance": "var", "Uniformity": "uniformity"}
_CH = _VOX + """,
ch AS (SELECT image_id, count(*) AS n, covar_pop(z * 2.0, z * 2.0) AS zz, covar_pop(y * 0.8, y * 0.8) AS yy, covar_pop(x * 0.8, x * 0.8) AS xx,
              covar_pop(z * 2.0, y * 0.8) AS zy, covar_pop(z * 2.0, x * 0.8) AS zx, covar_pop(y * 0.8, x * 0.8) AS yx FROM vox WHERE mask = 1 GROUP BY 1),
-- The largest and smallest root of the characteristic cubic, by its trigonometric solution.
ce AS (SELECT *, zz + yy + xx AS t1, zz * yy + zz * xx + yy * xx - zy * zy - zx * zx - yx * yx AS t2,
              zz * yy * xx + 2 * zy * zx * yx - zz * yx * yx - yy * zx * zx - xx * zy * zy AS t3 FROM ch),
cr AS (SELECT *, sqrt(greatest(t1 * t1 - 3 * t2, 0)) AS w,
              acos(greatest(-1, least(1, (2 * t1 ** 3 - 9 * t1 * t2 + 27 * t3) / nullif(2 * greatest(t1 * t1 - 3 * t2, 0) ** 1.5, 0)))) AS phi FROM ce),
sh AS (SELECT image_id, n, greatest((t1 + 2 * w * cos(phi / 3)) / 3, 0) AS e1, greatest((t1 + 2 * w * cos((phi - 2 * pi()) / 3)) / 3, 0) AS e2,
              greatest((t1 + 2 * w * cos((phi + 2 * pi()) / 3)) / 3, 0) AS e3 FROM cr)"""
_SHAPE = {"VoxelVolume": "n * 1.28", "MajorAxisLength": "4 * sqrt(e1)", "MinorAxisLength": "4 * sqrt(e2)", "LeastAxisLength": "4 * sqrt(e3)",
          "Elongation": "sqrt(e2 / e1)", "Flatness": "sqrt(e3 / e1)"}
_GLCM_FEATURES = _GLCM + """,
gp AS (SELECT image_id, dir, i, j, n / sum(n) OVER (PARTITION BY image_id, dir) AS p FROM gc),
px AS (SELECT image_id, dir, i, sum(p) AS p FROM gp GROUP BY ALL),
mx AS (SELECT image_id, dir, sum(i * p) AS u, -sum(p * log2(p)) AS hx FROM px GROUP BY ALL),
pd AS (SELECT image_id, dir, abs(i - j) AS k, sum(p) AS p FROM gp GROUP BY ALL),
ps AS (SELECT image_id, dir, i + j AS k, sum(p) AS p FROM gp GROUP BY ALL),
ng AS (SELECT image_id, max(level) AS ng FROM lv GROUP BY 1),
f1 AS (SELECT image_id, dir, any_value(u) AS u, any_value(hx) AS hx, sum(i * j * p) AS auto, sum((i + j - 2 * u) ** 4 * p) AS prom, sum((i + j - 2 * u) ** 3 * p) AS shade,
              sum((i + j - 2 * u) ** 2 * p) AS tend, sum((i - j) ** 2 * p) AS contrast, sum((i - u) * (j - u) * p) AS cov, sum((i - u) ** 2 * p) AS var,
              sum(p * p) AS je, -sum(p * log2(p)) AS hxy, max(p) AS pmax FROM gp JOIN mx USING (image_id, dir) GROUP BY image_id, dir),
f2 AS (SELECT image_id, dir, sum(k * p) AS da, -sum(p * log2(p)) AS de, sum(k * k * p) - sum(k * p) ** 2 AS dv, sum(p / (1 + k * k)) AS idm,
              sum(p / (1 + k * k / (ng * ng))) AS idmn, sum(p / (1 + k)) AS id, sum(p / (1 + k / ng)) AS idn, sum(CASE WHEN k > 0 THEN p / (k * k) ELSE 0 END) AS inv
       FROM pd JOIN ng USING (image_id) GROUP BY image_id, dir),
f3 AS (SELECT image_id, dir, sum(k * p) AS sa, -sum(p * log2(p)) AS se FROM ps GROUP BY ALL),
fa AS (SELECT * FROM f1 JOIN f2 USING (image_id, dir) JOIN f3 USING (image_id, dir))"""
_GLCM_LIST = {
    "Autocorrelation": "auto", "JointAverage": "u", "ClusterProminence": "prom", "ClusterShade": "shade", "ClusterTendency": "tend",
    "Contrast": "contrast", "Correlation": "CASE WHEN var > 1e-12 THEN cov / var ELSE 1 END", "DifferenceAverage": "da", "DifferenceEntropy": "de",
    "DifferenceVariance": "dv", "JointEnergy": "je", "JointEntropy": "hxy", "Imc1": "CASE WHEN hx = 0 THEN 0 ELSE (hxy - 2 * hx) / hx END",
    "Imc2": "sqrt(greatest(1 - exp(-2 * (2 * hx - hxy)), 0))", "Idm": "idm", "Idmn": "idmn", "Id": "id", "Idn": "idn", "InverseVariance": "inv",
    "MaximumProbability": "pmax", "SumAverage": "sa", "SumEntropy": "se", "SumSquares": "var"}
# A run starts where the voxel before it is missing or differs; its length is the distance to the next break.
_RUNS = _LV + f""", {_DIRS},
rl AS (SELECT image_id, dir, level, CASE WHEN dz <> 0 THEN z WHEN dy <> 0 THEN y ELSE x END AS step,
              z - dz * CASE WHEN dz <> 0 THEN z WHEN dy <> 0 THEN y ELSE x END AS l1, y - dy * CASE WHEN dz <> 0 THEN z WHEN dy <> 0 THEN y ELSE x END AS l2,
              x - dx * CASE WHEN dz <> 0 THEN z WHEN dy <> 0 THEN y ELSE x END AS l3 FROM lv, dirs),
rb AS (SELECT *, CASE WHEN lag(level) OVER w = level AND lag(step) OVER w = step - 1 THEN 0 ELSE 1 END AS brk
       FROM rl WINDOW w AS (PARTITION BY image_id, dir, l1, l2, l3 ORDER BY step)),
rg AS (SELECT *, sum(brk) OVER (PARTITION BY image_id, dir, l1, l2, l3 ORDER BY step) AS run FROM rb),
sm AS (SELECT image_id, dir, level, size, count(*) AS n FROM (SELECT image_id, dir, l1, l2, l3, run, level, count(*) AS size FROM rg GROUP BY ALL) GROUP BY ALL)"""
_ZONES = _PAIRS + """,
eq AS (SELECT image_id, a, b FROM pr WHERE la = lb UNION ALL SELECT image_id, b, a FROM pr WHERE la = lb),
reach(image_id, src, dst) AS (SELECT image_id, pos, pos FROM lv UNION SELECT r.image_id, r.src, eq.b FROM reach r JOIN eq ON eq.image_id = r.image_id AND eq.a = r.dst),
zn AS (SELECT lv.image_id, pos, level, zone FROM lv JOIN (SELECT image_id, src, min(dst) AS zone FROM reach GROUP BY ALL) q ON q.image_id = lv.image_id AND q.src = lv.pos),
sm AS (SELECT image_id, level, size, count(*) AS n FROM (SELECT image_id, zone, level, count(*) AS size FROM zn GROUP BY ALL) GROUP BY ALL)"""
_DEPS = _PAIRS + """,
dp AS (SELECT image_id, pos, count(*) AS k FROM (SELECT image_id, a AS pos FROM pr WHERE la = lb UNION ALL SELECT image_id, b FROM pr WHERE la = lb) GROUP BY ALL),
sm AS (SELECT image_id, level, size, count(*) AS n FROM (SELECT lv.image_id, level, coalesce(k, 0) + 1 AS size FROM lv LEFT JOIN dp USING (image_id, pos)) GROUP BY ALL)"""


def _matrix_sql(names: dict, keys: str) -> tuple[str, dict]:
    body = f""",
sg AS (SELECT {keys}, level, sum(n) AS m FROM sm GROUP BY ALL), ss AS (SELECT {keys}, size, sum(n) AS m FROM sm GROUP BY ALL),
sp AS (SELECT {keys}, level, size, n, sum(n) OVER (PARTITION BY {keys}) AS nz FROM sm),
sa AS (SELECT {keys}, any_value(nz) AS nz, sum(n * size) AS np, sum(n / size ** 2) / any_value(nz) AS small, sum(n * size ** 2) / any_value(nz) AS large,
              sum(n / level ** 2) / any_value(nz) AS low, sum(n * level ** 2) / any_value(nz) AS high, sum(n / (size ** 2 * level ** 2)) / any_value(nz) AS sl,
              sum(n * level ** 2 / size ** 2) / any_value(nz) AS sh, sum(n * size ** 2 / level ** 2) / any_value(nz) AS ll,
              sum(n * size ** 2 * level ** 2) / any_value(nz) AS lh, sum(n / nz * level) AS gm, sum(n / nz * size) AS zm, -sum(n / nz * log2(n / nz)) AS entropy
       FROM sp GROUP BY {keys}),
sv AS (SELECT {keys}, sum(n / sp.nz * (level - gm) ** 2) AS glv, sum(n / sp.nz * (size - zm) ** 2) AS sv FROM sp JOIN sa USING ({keys}) GROUP BY {keys}),
sx AS (SELECT * FROM sa JOIN sv USING ({keys}) JOIN (SELECT {keys}, sum(m * m) AS q FROM sg GROUP BY ALL) USING ({keys})
       JOIN (SELECT {keys}, sum(m * m) AS r FROM ss GROUP BY ALL) USING ({keys}))"""
    exprs = dict(small="small", large="large", gln="q / nz", glnn="q / nz ** 2", sn="r / nz", snn="r / nz ** 2", share="nz / np", glv="glv", sv="sv",
                 entropy="entropy", low="low", high="high", sl="sl", sh="sh", ll="ll", lh="lh")
    return body, {names[k]: e for k, e in exprs.items() if names[k]}


def _matrix_query(head: str, names: dict, kind: str, over: bool = False) -> str:
    body, feats = _matrix_sql(names, "image_id, dir" if over else "image_id")
    main = _unpivot("sx", kind, feats)
    if over:
        main = f"SELECT image_id, class, feature, avg(value) AS value FROM ({main}) GROUP BY ALL"
    return rounded_sql(f"WITH RECURSIVE {head}{body} --main {main}", "image_id class feature value:f", 4)


_TONE = _PAIRS + """,
nb AS (SELECT image_id, pos, own, avg(other) AS m FROM (SELECT image_id, a AS pos, la AS own, lb AS other FROM pr UNION ALL
       SELECT image_id, b, lb, la FROM pr) GROUP BY ALL),
tt AS (SELECT image_id, own AS level, count(*) AS n, sum(abs(own - m)) AS s FROM nb GROUP BY ALL)"""
_NGTDM = _TONE + """,
tp AS (SELECT *, n / sum(n) OVER (PARTITION BY image_id) AS p, sum(n) OVER (PARTITION BY image_id) AS nv FROM tt),
t1 AS (SELECT image_id, any_value(nv) AS nv, count(*) AS ng, sum(p * s) AS ps, sum(s) AS ss FROM tp GROUP BY 1),
t2 AS (SELECT a.image_id, sum(a.p * b.p * (a.level - b.level) ** 2) AS con, sum(abs(a.level * a.p - b.level * b.p)) AS gap,
              sum(abs(a.level - b.level) * (a.p * a.s + b.p * b.s) / (a.p + b.p)) AS com, sum((a.p + b.p) * (a.level - b.level) ** 2) AS str
       FROM tp a JOIN tp b ON a.image_id = b.image_id GROUP BY 1),
tn AS (SELECT * FROM t1 JOIN t2 USING (image_id))"""
_NGTDM_LIST = {"Coarseness": "least(coalesce(1 / nullif(ps, 0), 1e6), 1e6)", "Contrast": "CASE WHEN ng > 1 THEN con / (ng * (ng - 1)) * ss / nv ELSE 0 END",
               "Busyness": "CASE WHEN ng > 1 THEN coalesce(ps / nullif(gap, 0), 0) ELSE 0 END", "Complexity": "com / nv",
               "Strength": "coalesce(str / nullif(ss, 0), 0)"}
_KERNEL = lambda k: "(VALUES " + ", ".join(f"('{n}', {o}, {w!r}::DOUBLE)" for n, t in k.items() for o, w in t.items()) + ") AS k(l, o, w)"
_WAVES = _VOX + "".join(f""",
w{a} AS (SELECT image_id, {prev}l AS band, {', '.join(c if c != a else f'CAST((({a} - o) % 4 + 4) % 4 AS INTEGER) AS {a}' for c in 'zyx')},
         sum(w * intensity) AS intensity FROM {src}, {_KERNEL(vg.wavelet_kernels())} GROUP BY ALL)"""
                        for a, src, prev in (("x", "vox", ""), ("y", "wx", "band || "), ("z", "wy", "band || ")))
def _log_part(sigma: float) -> str:
    return "".join(f""",
g{a} AS (SELECT image_id, {prev}k.l AS band, {', '.join(f's.{c}' if c != a else f't.i AS {a}' for c in 'zyx')}, sum(w * intensity) AS intensity
         FROM (SELECT CAST(unnest(range(4)) AS INTEGER) AS i) t, {_KERNEL(vg.gaussian_kernels(sigma))}, {src} s WHERE s.{a} = greatest(0, least(3, t.i + o)) GROUP BY ALL)"""
                   for a, src, prev in (("x", "vox", ""), ("y", "gx", "s.band || "), ("z", "gy", "s.band || ")))


_LOG = _VOX + _log_part(1.0)
_AXIS = lambda a, s, n: f"SELECT CAST(unnest(range({n})) AS INTEGER) AS t{a}"
_NEAR = lambda a, s: f"CAST(floor(t{a} / {s} + 0.5) AS INTEGER)"
_GRID = f"({_AXIS('z', 2.0, 8)}) gz, ({_AXIS('y', 0.8, 3)}) gy, ({_AXIS('x', 0.8, 3)}) gx"
_LIN = lambda a, s: f"CASE WHEN t{a} / {s} >= 3.5 THEN 0 WHEN {a} = 3 AND t{a} / {s} >= 3 THEN 1 ELSE greatest(1 - abs(t{a} / {s} - {a}), 0) END"
_LINEAR = f"""{_VOX}, im AS (SELECT DISTINCT image_id FROM vox),
    li AS (SELECT image_id, tz, ty, tx, sum(({_LIN('z', 2.0)}) * ({_LIN('y', 0.8)}) * ({_LIN('x', 0.8)}) * intensity) AS intensity FROM vox, {_GRID} GROUP BY ALL),
    ne AS (SELECT im.image_id, tz, ty, tx, coalesce(v.mask, 0) AS mask, coalesce(v.intensity, 0) AS intensity FROM im CROSS JOIN {_GRID}
           LEFT JOIN vox v ON v.image_id = im.image_id AND v.z = {_NEAR('z', 2.0)} AND v.y = {_NEAR('y', 0.8)} AND v.x = {_NEAR('x', 0.8)})"""
_POINT_PART = """, tp AS (SELECT *, max(abs(intensity)) OVER (PARTITION BY image_id) AS top FROM vox),
    pw AS (SELECT image_id, 'square' AS filter, z, y, x, intensity * intensity / top AS intensity, mask FROM tp UNION ALL
           SELECT image_id, 'squareroot', z, y, x, sign(intensity) * sqrt(abs(intensity) * top), mask FROM tp UNION ALL
           SELECT image_id, 'logarithm', z, y, x, sign(intensity) * ln(abs(intensity) + 1) * top / ln(top + 1), mask FROM tp UNION ALL
           SELECT image_id, 'exponential', z, y, x, exp(intensity * ln(top) / top), mask FROM tp)"""
_POINT = _VOX + _POINT_PART
_DERIVED = _LOG + _POINT_PART + """, fv AS (SELECT image_id, 'original' AS filter, intensity, mask FROM vox UNION ALL
    SELECT image_id, filter, intensity, mask FROM pw UNION ALL
    SELECT image_id, 'log-sigma-1-0-mm-3D', sum(gz.intensity), any_value(mask) FROM gz JOIN vox USING (image_id, z, y, x)
    WHERE band IN ('DGG', 'GDG', 'GGD') GROUP BY image_id, z, y, x)"""
_CH_PART = _CH.removeprefix(_VOX)
_MANY = _DEPS + _FO.format(k="image_id", v="vox") + _CH_PART.replace("2.0", "1.0").replace("0.8", "1.0") + _matrix_sql(tx.DEPENDENCE_NAMES, "image_id")[0]
_MANY_LONG = " UNION ALL ".join([_unpivot("fo", "firstorder", _FO_FEATURES), _unpivot("sh", "shape", _SHAPE | {"VoxelVolume": "n"}),
                                 _unpivot("sx", "gldm", _matrix_sql(tx.DEPENDENCE_NAMES, "image_id")[1])])
# The same over the cubes that broken_voxels leaves whole, and the reasons of the others.
_SOUND = _MANY.replace("FROM embeddings))", "FROM embeddings WHERE vec_id % 100 NOT IN (3, 7, 11, 13, 17)))")
_REASONS = """SELECT vec_id AS image_id, CASE vec_id % 100 WHEN 3 THEN 'a coordinate is out of range' WHEN 7 THEN 'an intensity is not a finite number'
    WHEN 11 THEN 'mask is empty' WHEN 13 THEN 'a voxel occurs twice' WHEN 17 THEN 'too many grey levels' END AS reason FROM embeddings WHERE vec_id % 100 IN (3, 7, 11, 13, 17)"""
_MANY_NAMES = [f"original_{k}_{f}" for k, fs in (("firstorder", _FO_FEATURES), ("shape", _SHAPE),
                                                 ("gldm", _matrix_sql(tx.DEPENDENCE_NAMES, "image_id")[1])) for f in fs]

ORACLE = {
    "regrid_nearest": f"WITH {_LINEAR} SELECT image_id, tz AS z, ty AS y, tx AS x, CAST(intensity AS DOUBLE) AS intensity, mask FROM ne",
    "regrid_linear": rounded_sql(f"""WITH {_LINEAR} --main SELECT li.image_id, li.tz AS z, li.ty AS y, li.tx AS x, li.intensity, mask
        FROM li JOIN ne USING (image_id, tz, ty, tx)""", "image_id z y x intensity:f mask", 4),
    "normalize_image": rounded_sql(f"""WITH {_VOX} --main SELECT image_id, z, y, x, (intensity - avg(intensity) OVER w) / stddev_samp(intensity) OVER w * 100 AS intensity,
        mask FROM vox WINDOW w AS (PARTITION BY image_id)""", "image_id z y x intensity:f mask", 4),
    "pointwise_filters": rounded_sql(f"WITH {_POINT} --main SELECT * FROM pw", "image_id filter z y x intensity:f", 4),
    "wavelet_bands": rounded_sql(f"""WITH {_WAVES} --main SELECT wz.image_id, 'wavelet-' || band AS filter, wz.z, wz.y, wz.x, wz.intensity, mask
        FROM wz JOIN vox USING (image_id, z, y, x)""", "image_id filter z y x intensity:f mask", 4),
    "laplacian_of_gaussian": rounded_sql(f"""WITH {_LOG} --main SELECT image_id, z, y, x, sum(intensity) AS intensity FROM gz
        WHERE band IN ('DGG', 'GDG', 'GGD') GROUP BY ALL""", "image_id z y x intensity:f", 4),
    "discretize": f"WITH {_LV} SELECT image_id, z, y, x, level FROM lv",
    "first_order_features": rounded_sql(f"WITH {_VOX}{_FO.format(k='image_id', v='vox')} --main {_unpivot('fo', 'firstorder', _FO_FEATURES)}",
                                        "image_id class feature value:f", 4),
    "shape_features": rounded_sql(f"WITH {_CH} --main {_unpivot('sh', 'shape', _SHAPE)}", "image_id class feature value:f", 4),
    "glcm_counts": f"WITH {_GLCM} SELECT * FROM gc",
    "glcm_features": rounded_sql(f"""WITH {_GLCM_FEATURES} --main SELECT image_id, class, feature, avg(value) AS value FROM
        ({_unpivot('fa', 'glcm', _GLCM_LIST)}) GROUP BY ALL""", "image_id class feature value:f", 4),
    "run_counts": f"WITH {_RUNS} SELECT * FROM sm",
    "glrlm_features": _matrix_query(_RUNS, tx.RUN_NAMES, "glrlm", True),
    "zone_labels": f"WITH RECURSIVE {_ZONES} SELECT * FROM zn",
    "glszm_features": _matrix_query(_ZONES, tx.ZONE_NAMES, "glszm"),
    "dependence_counts": f"WITH {_DEPS} SELECT * FROM sm",
    "gldm_features": _matrix_query(_DEPS, tx.DEPENDENCE_NAMES, "gldm"),
    "tone_table": rounded_sql(f"WITH {_TONE} --main SELECT * FROM tt", "image_id level n s:f"),
    "ngtdm_features": rounded_sql(f"WITH {_NGTDM} --main {_unpivot('tn', 'ngtdm', _NGTDM_LIST)}", "image_id class feature value:f", 4),
    "derived_first_order": rounded_sql(f"WITH {_DERIVED}{_FO.format(k='image_id, filter', v='fv')} --main "
                                       + _unpivot("fo", "firstorder", _FO_FEATURES, "image_id, filter"), "image_id filter class feature value:f", 4),
    "wide_features": rounded_sql(f"WITH {_MANY} --main SELECT image_id, " + ", ".join(
        f"max(value) FILTER (name = '{n}') AS {n}" for n in _MANY_NAMES)
        + f" FROM (SELECT *, 'original_' || class || '_' || feature AS name FROM ({_MANY_LONG})) GROUP BY image_id",
        "image_id " + " ".join(f"{n}:f" for n in _MANY_NAMES), 4),
    "extraction_summary": f"WITH {_MANY} SELECT count(DISTINCT image_id) AS n_images, count(DISTINCT class || feature) AS n_features FROM ({_MANY_LONG})",
    "isolated_extraction": rounded_sql(f"""WITH {_SOUND} --main SELECT image_id, 'original_' || class || '_' || feature AS feature, value, NULL AS reason FROM ({_MANY_LONG})
        UNION ALL SELECT image_id, NULL, NULL, reason FROM ({_REASONS})""", "image_id feature value:f reason", 4),
    "extraction_outcomes": f"""WITH {_SOUND} SELECT image_id, count(*)::BIGINT AS n_features, NULL::VARCHAR AS reason FROM ({_MANY_LONG}) GROUP BY 1
        UNION ALL SELECT image_id, 0, reason FROM ({_REASONS})""",
    "laplacian_of_gaussian_all": " UNION ALL ".join("SELECT * FROM (" + rounded_sql(f"""WITH {_VOX}{_log_part(s)} --main SELECT image_id, 'log-sigma-{s:.0f}-0-mm-3D' AS filter, z, y, x,
        sum(intensity) AS intensity FROM gz WHERE band IN ('DGG', 'GDG', 'GGD') GROUP BY ALL""", "image_id filter z y x intensity:f", 4) + ")" for s in vg.LOG_SIGMAS),
    "empty_masks": f"WITH {_VOX} SELECT image_id, 'mask is empty' AS reason FROM vox GROUP BY 1 HAVING max(intensity) <= 300",
}
