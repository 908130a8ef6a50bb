"""Grid operators on long voxel tables ``(by..., z, y, x, intensity, mask)``: regridding, scaling, filters, binning.

Regridding is a row-local expansion of each voxel to its few targets; filters run on packed stretches of lines. Apart
from small per-image statistics nothing is keyed by the image alone, so an image of any size spreads over the cluster.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from hazardframe.operators.arrow_groups import whole_groups
from hazardframe.operators.ordered import match, match_stats
from hazardframe.operators.packed import REASON

AXES = ("z", "y", "x")
# The six low-pass taps of the coiflet of order one.
COIF1_LOW = [-0.01565572813546454, -0.0727326195128539, 0.38486484686420286, 0.8525720202122554, 0.3378976624578092,
             -0.0727326195128539]
LOG_SIGMAS = (1.0, 2.0, 3.0)
BIN_WIDTH = 25.0
NORMALIZE_SCALE = 100.0
BLOCK = 64  # voxels per packed stretch of a line
BOXES = 250_000  # cells of images that are filtered at a time


def with_sizes(df: DataFrame, by: list[str]) -> DataFrame:
    """Add the image size per axis as ``nz``, ``ny``, ``nx``."""
    sizes = df.groupBy(*by).agg(*[(F.max(a) + 1).alias(f"n{a}") for a in AXES])
    return match_stats(df, sizes, by)


def _targets(axis: str, spacing: float, linear: bool) -> Column:
    """For one source index, the array of ``(i, w)``: target indices it feeds on this axis, and with what weight."""
    ratio = float(spacing)  # target spacing is one
    x, n = F.col(axis).cast("double"), F.col(f"n{axis}").cast("double")
    last = F.rint(n * ratio).cast("int") - 1
    reach = 1.0 if linear else 0.5
    low = F.greatest(F.ceil((x - reach) * ratio).cast("int"), F.lit(0))
    # The last source voxel also owns every target past the end; those are background.
    high = F.when(x == n - 1, last).otherwise(F.least(F.ceil((x + reach) * ratio).cast("int") - 1, last))
    spots = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    def weight(i: Column) -> Column:
        at = i / F.lit(ratio)
        inside = at < n - 0.5
        if not linear:
            return F.when(inside, F.lit(1.0)).otherwise(0.0)
        near = F.greatest(1 - F.abs(at - x), F.lit(0.0))
        return F.when(~inside, 0.0).when((x == n - 1) & (at >= x), 1.0).otherwise(near)

    return F.transform(spots, lambda i: F.struct(i.cast("int").alias("i"), weight(i).alias("w")))


def _expanded(df: DataFrame, by: list[str], spacing: tuple[float, float, float], linear: bool) -> DataFrame:
    rows = with_sizes(df, by)
    for axis, s in zip(AXES, spacing):
        rows = rows.withColumn(f"__{axis}", F.explode(_targets(axis, s, linear)))
    w = F.col("__z.w") * F.col("__y.w") * F.col("__x.w")
    return rows.select(*by, *[F.col(f"__{a}.i").alias(a) for a in AXES], "intensity", "mask", w.alias("w"))


def regrid_nearest(df: DataFrame, spacing: tuple[float, float, float], by: list[str] = ("image_id",)) -> DataFrame:
    """Resample to unit spacing, nearest neighbour; ``spacing`` is (z, y, x). Row-local apart from the image sizes."""
    hit = F.col("w") > 0
    return _expanded(df, list(by), spacing, False).select(
        *by, *AXES, F.when(hit, F.col("intensity")).otherwise(0.0).alias("intensity"),
        F.when(hit, F.col("mask")).otherwise(0).alias("mask"))


def regrid_linear(df: DataFrame, spacing: tuple[float, float, float], by: list[str] = ("image_id",)) -> DataFrame:
    """Resample to unit spacing, trilinear: every voxel sends weighted shares that are summed per target position."""
    shares = _expanded(df, list(by), spacing, True)
    values = shares.groupBy(*by, *AXES).agg(F.sum(F.col("w") * F.col("intensity")).alias("intensity"))
    labels = regrid_nearest(df, spacing, by).select(*by, *AXES, "mask")
    return match(values, labels, [*by, *AXES])


def normalize(df: DataFrame, by: list[str] = ("image_id",), scale: float = NORMALIZE_SCALE, sample: bool = True) -> DataFrame:
    """Zero mean and unit deviation over the whole image, times ``scale``; a constant image keeps its offsets."""
    dev = F.stddev_samp if sample else F.stddev_pop
    stats = df.groupBy(*by).agg(F.avg("intensity").alias("__m"), dev("intensity").alias("__s"))
    scaled = (F.col("intensity") - F.col("__m")) / F.when(F.col("__s") > 0, F.col("__s")).otherwise(1.0) * F.lit(scale)
    return match_stats(df, stats, list(by)).withColumn("intensity", scaled).select(*df.columns)


def pointwise(df: DataFrame, kinds: list[str] = ("square", "squareroot", "logarithm", "exponential"),
              by: list[str] = ("image_id",)) -> DataFrame:
    """Pointwise image types, each scaled by the largest absolute value of its image; adds ``filter``."""
    top = df.groupBy(*by).agg(F.max(F.abs("intensity")).alias("__top"))
    x, t = F.col("intensity"), F.when(F.col("__top") > 0, F.col("__top")).otherwise(1.0)
    forms = {"square": x * x / t, "squareroot": F.signum(x) * F.sqrt(F.abs(x) * t),
             "logarithm": F.signum(x) * F.ln(F.abs(x) + 1) * t / F.ln(t + 1),
             "exponential": F.exp(x * F.ln(t) / t)}
    cells = F.array(*[F.struct(F.lit(k).alias("filter"), forms[k].alias("intensity")) for k in kinds])
    keep = [c for c in df.columns if c != "intensity"]
    return match_stats(df, top, list(by)).select(*keep, F.explode(cells).alias("__c")).select(
        *keep, "__c.filter", "__c.intensity")


def _ghosts(axis: str, reach: int, boundary: str) -> Column:
    """Positions a voxel is seen at from inside the image: its own one and its copies beyond the border."""
    i, n = F.col(axis), F.col(f"n{axis}")
    if boundary == "nearest":
        return F.sequence(F.when(i == 0, F.lit(-reach)).otherwise(i), F.when(i == n - 1, n - 1 + reach).otherwise(i))
    if boundary == "zero":
        return F.array(i)
    if boundary != "periodic":
        raise ValueError(f"unknown boundary {boundary!r}")
    turns = F.ceil(F.lit(float(reach)) / n).cast("int")
    copies = F.transform(F.sequence(-turns, turns), lambda m: i + m * n)
    return F.filter(copies, lambda p: (p >= -reach) & (p < n + reach))


def _along(df: DataFrame, axis: str, outputs: dict[str, list[tuple[str, dict[int, float]]]], by: list[str], boundary: str,
           together: bool = False) -> DataFrame:
    """Correlate columns along one axis: ``outputs`` maps a new column to its terms ``(input column, {offset: weight})``, which are summed.

    Lines along the axis are dealt in blocks with a halo of the kernels' reach, in one shuffle that carries each voxel little
    more than once; what lies beyond the border is made from the line itself, and only a periodic line of several blocks
    sends copies. Needs ``nz``, ``ny``, ``nx``; keeps these, the axes and the mask. With ``together`` a voxel that occurs several times
    with one mask value becomes one row, with the sum.
    """
    if boundary not in ("periodic", "nearest", "zero"):
        raise ValueError(f"unknown boundary {boundary!r}")
    inputs = list(dict.fromkeys(c for terms in outputs.values() for c, _ in terms))
    reach = max(abs(o) for terms in outputs.values() for _, taps in terms for o in taps)
    width = max(BLOCK, 4 * reach)
    keep, n = [*by, *[f"n{a}" for a in AXES], *AXES, "mask"], F.col(f"n{axis}")
    p = F.col(axis) if boundary != "periodic" else F.explode(F.when(n <= width, F.array(axis)).otherwise(_ghosts(axis, reach, boundary)))
    seen = df.select(*keep, *inputs, p.alias("p"))
    blocks = F.sequence(F.greatest(F.floor((F.col("p") - reach) / width), F.lit(0)),
                        F.least(F.floor((F.col("p") + reach) / width), F.floor((n - 1) / width)))
    key = [*by, *[a for a in AXES if a != axis], "block"]
    types = dict(df.dtypes)
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in keep], *[f"`{c}` double" for c in outputs]])

    def correlate(batches):
        for b, codes, first in whole_groups(batches, key):
            numbers = {c: b.column(c).to_numpy().astype(np.int64) for c in ("p", axis, "block", f"n{axis}")}
            block, size = numbers["block"][first], numbers[f"n{axis}"][first]
            own = min(width, int(size.max()))
            slot = numbers["p"] - numbers["block"] * width + reach
            place = np.arange(own + 2 * reach)
            if boundary == "nearest":
                source = np.clip(place, np.where(block == 0, reach, 0)[:, None], np.minimum(len(place) - 1, size - 1 - block * width + reach)[:, None])
            elif boundary == "periodic":
                source = np.where((size <= width)[:, None], reach + (place - reach) % size[:, None], place)
            else:
                source = None
            lines = {}
            for c in inputs:
                line = np.zeros((len(first), len(place)))
                inside = slot < len(place)
                line[codes[inside], slot[inside]] = b.column(c).to_numpy(zero_copy_only=False)[inside]
                lines[c] = line if source is None else np.take_along_axis(line, source, axis=1)
            mine = np.flatnonzero((numbers["p"] == numbers[axis]) & (slot >= reach) & (slot < reach + own))
            times = 1
            cell = codes[mine] * len(place) + slot[mine]
            if together and len(np.unique(cell)) < len(cell):
                mask = pc.fill_null(b.column("mask"), -1).to_numpy()[mine].astype(np.int64)
                _, some, times = np.unique(np.stack([cell, mask], axis=1), axis=0, return_index=True, return_counts=True)
                mine = mine[some]
            at = pa.array(mine)
            made = []
            for terms in outputs.values():
                total = sum(w * lines[c][:, reach + o:reach + o + own] for c, taps in terms for o, w in taps.items())
                made.append(pa.array(total[codes[mine], slot[mine] - reach] * times))
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in keep), *made], names=[*keep, *outputs])

    return (seen.withColumn("block", F.explode(blocks)).repartition(*key).sortWithinPartitions(*key).mapInArrow(correlate, schema))


def stencil(df: DataFrame, axis: str, kernels: dict[str, dict[int, float]], by: list[str] = ("image_id",),
            boundary: str = "periodic", label: str | None = None) -> DataFrame:
    """Correlate one axis with short kernels: ``out[i] = sum_k kernel[k] * in[i + k]``.

    ``kernels`` maps a label to ``{offset: weight}``; with several, ``label`` is extended by the label of the kernel.
    ``boundary`` is ``periodic``, ``nearest`` (edge value repeated) or ``zero``. Needs ``nz``, ``ny``, ``nx``.
    """
    by = [*by, *([label] if label and label in df.columns else [])]
    names = {k: f"__k{i}" for i, k in enumerate(kernels)}
    done = _along(df, axis, {c: [("intensity", kernels[k])] for k, c in names.items()}, by, boundary)
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("v")) for k, c in names.items()]))
    sizes = [f"n{a}" for a in AXES]
    rows = done.select(*by, *sizes, *AXES, "mask", cells.alias("__c"))
    name = [F.concat(F.col(label) if label in by else F.lit(""), F.col("__c.k")).alias(label)] if label else []
    return rows.select(*[c for c in by if c != label], *sizes, *AXES, *name, F.col("__c.v").alias("intensity"), "mask")


def wavelet_kernels() -> dict[str, dict[int, float]]:
    """Low- and high-pass kernels of the one-level undecimated transform (quadrature mirror of the low pass)."""
    size = len(COIF1_LOW)
    high = [(-1) ** (k + 1) * COIF1_LOW[size - 1 - k] for k in range(size)]
    place = lambda taps: {size // 2 - k: w for k, w in enumerate(taps)}
    return {"L": place(COIF1_LOW), "H": place(high)}


def _unrolled(df: DataFrame, by: list[str], filters: dict[str, str]) -> DataFrame:
    """One row for each voxel and filter; ``filters`` maps a column to the name of its filter."""
    cells = F.explode(F.array(*[F.struct(F.lit(name).alias("filter"), F.col(c).alias("intensity")) for c, name in filters.items()]))
    return df.select(*by, *AXES, "mask", cells.alias("__c")).select(*by, "__c.filter", *AXES, "__c.intensity", "mask")


def _wavelet_steps() -> tuple[list[tuple[str, dict]], dict[str, str]]:
    """The outputs of each axis in turn, and the names of the last ones."""
    columns, steps = {"": "intensity"}, []
    for axis in ("x", "y", "z"):
        longer = {name + k: [(c, taps)] for name, c in columns.items() for k, taps in wavelet_kernels().items()}
        columns = {name: f"__{name}" for name in longer}
        steps.append((axis, {columns[name]: terms for name, terms in longer.items()}))
    return steps, {c: f"wavelet-{name}" for name, c in columns.items()}


def wavelet(df: DataFrame, by: list[str] = ("image_id",), boundary: str = "periodic") -> DataFrame:
    """The eight bands LLL..HHH (letters in x, y, z order) as ``filter = wavelet-XYZ``; bands are columns until all axes are done."""
    by, bands, (steps, names) = list(by), with_sizes(df, list(by)), _wavelet_steps()
    for axis, outputs in steps:
        bands = _along(bands, axis, outputs, by, boundary)
    return _unrolled(bands, by, names)


def gaussian_kernels(sigma: float, cut: float = 4.0) -> dict[str, dict[int, float]]:
    """Truncated Gaussian ``G`` (sums to one) and its second derivative ``D`` (sums to zero, times sigma squared)."""
    r = math.ceil(cut * sigma)
    g = {k: math.exp(-k * k / (2 * sigma * sigma)) for k in range(-r, r + 1)}
    total = sum(g.values())
    g = {k: v / total for k, v in g.items()}
    d = {k: (k * k / sigma ** 2 - 1) * v for k, v in g.items()}
    mean = sum(d.values()) / len(d)
    return {"G": g, "D": {k: v - mean for k, v in d.items()}}


def _laplacian_steps(sigmas: tuple[float, ...]) -> tuple[list[tuple[str, dict]], dict[str, str]]:
    """The outputs of each axis in turn, and the names of the last ones."""
    kernels = [gaussian_kernels(s) for s in sigmas]
    steps = [("x", {f"__{t}{q}": [("intensity", k["G" if t == "a" else "D"])] for q, k in enumerate(kernels) for t in "ab"}),
             ("y", {f"__{t}{q}": [(f"__a{q}", k["G"])] if t == "a" else [(f"__b{q}", k["G"]), (f"__a{q}", k["D"])]
                    for q, k in enumerate(kernels) for t in "ab"}),
             ("z", {f"__a{q}": [(f"__b{q}", k["G"]), (f"__a{q}", k["D"])] for q, k in enumerate(kernels)})]
    return steps, {f"__a{q}": f"log-sigma-{s:.1f}".replace(".", "-") + "-mm-3D" for q, s in enumerate(sigmas)}


def laplacians_of_gaussian(df: DataFrame, sigmas: tuple[float, ...], by: list[str] = ("image_id",), boundary: str = "nearest") -> DataFrame:
    """Scale-normalised Laplacian of Gaussian for each sigma: the three terms with one second derivative, summed.

    All sigmas share the three passes, and two columns for each are enough: after x and y, what has had no second derivative yet
    and the sum of what has had one.
    """
    by, rows, (steps, names) = list(by), with_sizes(df, list(by)), _laplacian_steps(sigmas)
    for axis, outputs in steps:
        rows = _along(rows, axis, outputs, by, boundary, axis == "z")
    return _unrolled(rows, by, names)


def laplacian_of_gaussian(df: DataFrame, sigma: float, by: list[str] = ("image_id",), boundary: str = "nearest") -> DataFrame:
    """:func:`laplacians_of_gaussian` of one sigma."""
    return laplacians_of_gaussian(df, (sigma,), by, boundary)


def image_types(df: DataFrame, by: list[str] = ("image_id",), sigmas: tuple[float, ...] = LOG_SIGMAS,
                bands: bool = True, points: bool = True) -> DataFrame:
    """All derived images in one table with a ``filter`` column, the original included."""
    cols = [*by, "filter", *AXES, "intensity", "mask"]
    out = df.withColumn("filter", F.lit("original")).select(*cols)
    if points:
        out = out.unionByName(pointwise(df, by=by).select(*cols))
    if sigmas:
        out = out.unionByName(laplacians_of_gaussian(df, tuple(sigmas), by).select(*cols))
    return out.unionByName(wavelet(df, by).select(*cols)) if bands else out


def _boxes_along(boxes: dict[str, np.ndarray], there: np.ndarray, axis: str, outputs: dict[str, list[tuple[str, dict[int, float]]]],
                 boundary: str) -> dict[str, np.ndarray]:
    """:func:`_along` on the boxes ``(image, z, y, x)`` of images of one size; cells without a voxel stay zero."""
    reach, a = max(abs(o) for terms in outputs.values() for _, taps in terms for o in taps), 1 + AXES.index(axis)
    size = there.shape[a]
    place = np.arange(-reach, size + reach)
    source = place % size if boundary == "periodic" else np.clip(place, 0, size - 1)
    lines = {c: np.moveaxis(np.take(boxes[c], source, axis=a), a, -1) for c in dict.fromkeys(c for terms in outputs.values() for c, _ in terms)}
    made = {}
    for name, terms in outputs.items():
        total = sum(w * lines[c][..., reach + o:reach + o + size] for c, taps in terms for o, w in taps.items())
        made[name] = np.where(there, np.moveaxis(total, -1, a), 0.0)
    return made


def _pointwise_values(x: np.ndarray, top: np.ndarray) -> dict[str, np.ndarray]:
    """:func:`pointwise` of intensities and the largest absolute one of their image."""
    t = np.where(top > 0, top, 1.0)
    with np.errstate(all="ignore"):
        return {"square": x * x / t, "squareroot": np.sign(x) * np.sqrt(np.abs(x) * t),
                "logarithm": np.sign(x) * np.log(np.abs(x) + 1) * t / np.log(t + 1), "exponential": np.exp(x * np.log(t) / t)}


def packed_image_types(df: DataFrame, by: list[str] = ("image_id",), sigmas: tuple[float, ...] = LOG_SIGMAS, bands: bool = True,
                       points: bool = True) -> DataFrame:
    """:func:`image_types` as a packed table, for images of bounded size (see ``packed.by_size``) in which no voxel occurs twice.

    One shuffle brings the voxels of an image together; images of one size are filtered side by side.
    """
    by, types = list(by), dict(df.dtypes)
    filters = [(_laplacian_steps(tuple(sigmas)), "nearest")] * bool(sigmas) + [(_wavelet_steps(), "periodic")] * bool(bands)

    def images(b: pa.RecordBatch, first: np.ndarray, place: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
        """All image types of some images; ``place`` has the number of the image of each row."""
        z, y, x, mask = (b.column(c).to_numpy().astype(np.int64) for c in (*AXES, "mask"))
        cell, v = (place, z, y, x), b.column("intensity").to_numpy()
        there = np.zeros((len(first), *size), bool)
        there[cell] = True
        got = {"original": v}
        if points:
            top = np.zeros(len(first))
            np.maximum.at(top, place, np.abs(v))
            got |= _pointwise_values(v, top[place])
        for (steps, names), boundary in filters:
            boxes = {"intensity": np.zeros(there.shape)}
            boxes["intensity"][cell] = v
            for axis, outputs in steps:
                boxes = _boxes_along(boxes, there, axis, outputs, boundary)
            got |= {name: boxes[c][cell] for c, name in names.items()}
        inside = np.flatnonzero(mask == 1)
        n = np.bincount(place[inside], minlength=len(first))
        some, times = np.flatnonzero(n), len(got)
        head = pa.array(np.tile(first[some], times))
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.tile(n[some], times))]), pa.int32())
        at = ((z * size[1] + y) * size[2] + x)[inside].astype(np.int16)
        return pa.RecordBatch.from_arrays(
            [*(b.column(c).take(head) for c in by), pa.array(np.repeat(list(got), len(some))), *(pa.array(np.full(len(head), k, np.int32)) for k in size),
             pa.ListArray.from_arrays(offsets, pa.array(np.tile(at, times))), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([got[k][inside] for k in got]))),
             pa.nulls(len(head), pa.string())], names=[*by, "filter", "nz", "ny", "nx", "at", "v", REASON])

    def pack(batches):
        for b, codes, first in whole_groups(batches, by):
            sizes = np.stack([np.maximum.reduceat(b.column(a).to_numpy().astype(np.int64), first) + 1 for a in AXES], axis=1)
            for size in np.unique(sizes, axis=0):
                alike = np.flatnonzero((sizes == size).all(axis=1))
                step = max(1, BOXES // int(size.prod()))
                for some in (alike[s:s + step] for s in range(0, len(alike), step)):
                    place = np.full(len(first), -1)
                    place[some] = np.arange(len(some))
                    mine = np.flatnonzero(place[codes] >= 0)
                    part = b.take(pa.array(mine))
                    yield images(part, np.searchsorted(codes[mine], some), place[codes[mine]], size)

    keys = ", ".join(f"`{c}` {types[c]}" for c in by)
    return (df.select(*by, *AXES, F.col("intensity").cast("double").alias("intensity"), "mask").repartition(*by).sortWithinPartitions(*by)
            .mapInArrow(pack, f"{keys}, filter string, nz int, ny int, nx int, at array<smallint>, v array<double>, {REASON} string"))


def discretize(df: DataFrame, by: list[str] = ("image_id",), width: float = BIN_WIDTH) -> DataFrame:
    """Grey level of the masked voxels: bins of a fixed width that start at the bin of the lowest value."""
    inside = df.where("mask = 1")
    low = inside.groupBy(*by).agg(F.floor(F.min("intensity") / F.lit(float(width))).alias("__low"))
    level = F.floor(F.col("intensity") / F.lit(float(width))) - F.col("__low") + 1
    return match_stats(inside, low, list(by)).withColumn("level", level.cast("int")).drop("__low")
