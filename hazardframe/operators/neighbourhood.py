"""Neighbourhoods of grey-level voxels without a join per neighbour.

Voxels are dealt to slabs of 16 x 16 lines of 32 voxels; one at a slab's face goes to the slabs it touches as well. After this
one shuffle a row holds a block of 32 voxels along x, with one halo voxel on each side, and its eight neighbouring lines, so
all 26 neighbours of its voxels are at hand. Each texture count is then a small array kernel whose partial counts are
summed by Spark. Slabs are spread by ``(by, slab)``: a huge image is no hot key, and a small one is counted by one task.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from hazardframe.operators.arrow_groups import group_codes, whole_groups
from hazardframe.operators.ordered import match
from hazardframe.operators.packed import elements, is_packed, lists, per_image
from hazardframe.session import cut_lineage

WIDTH = 32
SLOTS = WIDTH + 2
SIDE = 1 << 20  # coordinates are below this
TABLE = 4_000_000  # different cells up to which they are counted in a table of all of them
LINES = list(product((-1, 0, 1), repeat=2))  # (dz, dy); the block's own line is number 4
LINES_PER_SLAB = 16
# A slab is 16 x 16 lines of one block: positions that agree in these bits.
SLAB = ~((15 * SIDE + 15) * SIDE + WIDTH - 1)
DIRECTIONS = [d for d in product((0, 1, -1), repeat=3) if next((c for c in d if c), 0) > 0]


def shift(d: tuple[int, int, int]) -> int:
    """Step of a direction in packed positions."""
    return (d[0] * SIDE + d[1]) * SIDE + d[2]


def positions(levels: DataFrame, by: list[str]) -> DataFrame:
    """``(by, pos, level)``: coordinates packed into one long; one that does not fit is an error."""
    side = F.lit(SIDE).cast("long")
    fits = F.greatest("z", "y", "x") < SIDE
    packed = F.when(fits, (F.col("z") * side + F.col("y")) * side + F.col("x")).otherwise(
        F.raise_error(F.lit(f"a voxel coordinate is not below {SIDE}")).cast("long"))
    return levels.select(*by, packed.alias("pos"), "level")


def _around(group: np.ndarray, z: np.ndarray, y: np.ndarray, slot: np.ndarray, level: np.ndarray, sides: tuple[int, int]):
    """Of the lines with a voxel between the borders: group, place (z, y) and levels (lines, 9 lines, slots). Coordinates count from the border before."""
    lines, at = np.unique((group * sides[0] + z) * sides[1] + y, return_inverse=True)
    width = int(slot.max()) + 1
    cells = np.zeros((len(lines) + 1, width), level.dtype)  # the last one stays empty
    np.maximum.at(cells, (at, slot), level)
    lz, ly = lines // sides[1] % sides[0], lines % sides[1]
    inner = (lz > 0) & (lz < sides[0] - 1) & (ly > 0) & (ly < sides[1] - 1)
    own = np.flatnonzero(inner & (cells[:-1, 1:WIDTH + 1] > 0).any(axis=1))
    near = np.empty((len(own), len(LINES), width), level.dtype)
    for k, (dz, dy) in enumerate(LINES):
        wanted = lines[own] + dz * sides[1] + dy
        found = np.minimum(np.searchsorted(lines, wanted), len(lines) - 1)
        near[:, k] = cells[np.where(lines[found] == wanted, found, len(lines))]
    return lines[own] // (sides[0] * sides[1]), lz[own], ly[own], near


def neighbourhoods(levels: DataFrame, by: list[str]) -> DataFrame:
    """One row per block with a voxel: ``(by, z, y, block, near)``; ``near`` has the nine lines around it one after another.

    Only as many slots of the lines are written as the images of the batch use, so a narrow image has short rows.
    """
    span = lambda c, size, i: F.floor((F.col(c) + i) / size).cast("int")
    before = lambda c: lambda s: (s >= 0) | (F.col(c) < 0)
    # Where a voxel is seen: its own slab and block, and those it touches; none is before the first.
    seen = {name: F.filter(F.array_distinct(F.array(*[span(c, size, i) for i in (0, -1, 1)])), before(c)) for name, c, size in
            (("__sz", "z", LINES_PER_SLAB), ("__sy", "y", LINES_PER_SLAB), ("block", "x", WIDTH))}
    placed = levels.select(*by, "z", "y", "x", "level", *[c.alias(f"{n}s") for n, c in seen.items()])
    for n in seen:
        placed = placed.withColumn(n, F.explode(f"{n}s")).drop(f"{n}s")
    key = [*by, *seen]
    types = dict(levels.dtypes)
    keys = ", ".join(f"`{c}` {types[c]}" for c in by)
    side = LINES_PER_SLAB + 2

    def gather(batches):
        for b, codes, first in whole_groups(batches, key):
            z, y, x, block, level, sz, sy = (b.column(c).to_numpy().astype(np.int64) for c in ("z", "y", "x", "block", "level", "__sz", "__sy"))
            code, lz, ly, near = _around(codes, z - sz * LINES_PER_SLAB + 1, y - sy * LINES_PER_SLAB + 1, x - block * WIDTH + 1, level.astype(np.int32), (side, side))
            if not len(near):
                continue
            head = first[code]
            offsets = pa.array(np.arange(len(near) + 1) * (len(LINES) * near.shape[2]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).take(pa.array(head)) for c in by), pa.array((sz[head] * LINES_PER_SLAB + lz - 1).astype("int32")),
                 pa.array((sy[head] * LINES_PER_SLAB + ly - 1).astype("int32")), pa.array(block[head].astype("int32")),
                 pa.ListArray.from_arrays(offsets, pa.array(near.ravel()))], names=[*by, "z", "y", "block", "near"])

    return (placed.repartition(*key).sortWithinPartitions(*key)
            .mapInArrow(gather, f"{keys}, z int, y int, block int, near array<int>"))


@dataclass(frozen=True)
class Blocks:
    """The blocks of some images: number of the image, level array (rows, 9 lines, slots), place.

    There are no more slots than the rows use, and an empty one behind them if the halo does not end them.
    """

    codes: np.ndarray
    levels: np.ndarray
    z: np.ndarray
    y: np.ndarray
    block: np.ndarray
    n: int  # images

    @property
    def own(self) -> np.ndarray:
        return self.levels[:, 4, 1:-1]

    def place(self, row: np.ndarray, slot: np.ndarray):
        """z, y and x of voxels given by row and slot (-1 and 32 are the halo)."""
        return self.z[row], self.y[row], self.block[row] * WIDTH + slot


def _unpack(batch: pa.RecordBatch, by: list[str]) -> tuple[Blocks, np.ndarray]:
    """The blocks of a batch, and a representative row of each image."""
    codes, first = group_codes(batch, by)
    near = batch.column("near")
    offsets, flat = near.offsets.to_numpy(), near.flatten().to_numpy()
    sizes, start = np.diff(offsets), offsets[:-1] - offsets[0]
    slots = min(SLOTS, int(sizes.max()) // len(LINES) + 1)
    levels = np.zeros((len(near), len(LINES), slots), dtype=np.int64)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        levels[rows, :, :size // len(LINES)] = flat[start[rows][:, None] + np.arange(size)].reshape(len(rows), len(LINES), -1)
    return Blocks(codes, levels, *(batch.column(c).to_numpy().astype(np.int64) for c in ("z", "y", "block")), len(first)), first


def _levels(part: pa.RecordBatch):
    """Of the voxels of packed images: number of the image, place in its box, and grey level (see ``voxel_grid.discretize``)."""
    image, at, v = elements(part, "at", "v")
    bins = np.floor(v / part.column("width")[0].as_py())
    low = np.minimum.reduceat(bins, np.flatnonzero(np.diff(image, prepend=-1)))
    nz, ny, nx = (part.column(c).to_numpy().astype(np.int64)[image] for c in ("nz", "ny", "nx"))
    at = at.astype(np.int64)
    return image, at // (ny * nx), at // nx % ny, at % nx, (bins - low[image] + 1).astype(np.int64)


def _blocks(part: pa.RecordBatch) -> Blocks:
    """The blocks of packed images."""
    image, z, y, x, level = _levels(part)
    block = x // WIDTH
    many, seen = int(block.max()) + 2, [(np.arange(len(x)), block)]
    for to, edge in ((-1, 0), (1, WIDTH - 1)):  # a voxel at a block's border is seen in the next one as well
        which = np.flatnonzero((x % WIDTH == edge) & (block + to >= 0))
        seen.append((which, block[which] + to))
    which, block = (np.concatenate(c) for c in zip(*seen))
    sides = (int(z.max()) + 3, int(y.max()) + 3)
    group, z, y, near = _around(image[which] * many + block, z[which] + 1, y[which] + 1, x[which] - block * WIDTH + 1, level[which], sides)
    if near.shape[2] < SLOTS:
        near = np.concatenate([near, np.zeros((*near.shape[:2], 1), near.dtype)], axis=2)
    return Blocks(group // many, near, z - 1, y - 1, group % many, part.num_rows)


def _line(dz: int, dy: int) -> int:
    return (dz + 1) * 3 + dy + 1


def _beside(levels: np.ndarray, d: tuple[int, int, int]) -> np.ndarray:
    """Levels of the neighbours in direction ``d`` of the own voxels, 32 at most (0 where there is none)."""
    return levels[:, _line(d[0], d[1]), 1 + d[2]:levels.shape[2] - 1 + d[2]]


def _counted(columns: list[np.ndarray], weights: np.ndarray | None = None):
    """Distinct rows of the columns and how often (or with what weight) they occur."""
    code, sizes = np.zeros(len(columns[0]), dtype=np.int64), []
    for c in columns:
        size = int(c.max()) + 1 if len(c) else 1
        code = code * size + c
        sizes.append(size)
    if prod(sizes) >= 1 << 62:
        raise OverflowError("too many different cells for one count")
    if (space := prod(sizes)) <= min(TABLE, 100 * len(code)):
        times = np.bincount(code, minlength=space)
        keys = np.flatnonzero(times)
        counts = times[keys] if weights is None else np.bincount(code, weights=weights, minlength=space)[keys]
    else:
        keys, inverse = np.unique(code, return_inverse=True)
        counts = np.bincount(inverse, weights=weights, minlength=len(keys))
    out = []
    for size in reversed(sizes):
        out.append(keys % size)
        keys = keys // size
    return out[::-1], counts


def _emit(batch, by, first, group, columns: dict[str, np.ndarray]):
    at = pa.array(first[group])
    arrays = [batch.column(b).take(at) for b in by] + [v if isinstance(v, pa.Array) else pa.array(v) for v in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=[*by, *columns])


def _one_by_one(batch: pa.RecordBatch, by: list[str], kernel):
    """The kernel's rows for each image of a batch, or its id and what went wrong."""
    codes, _ = group_codes(batch, by)
    for code in np.unique(codes):
        one = batch.take(pa.array(np.flatnonzero(codes == code)))
        try:
            found, reason = list(kernel(one)), None
        except Exception as e:  # whatever a kernel fails with, it is this image's result
            found, reason = [], f"{type(e).__name__}: {e}"
        yield one, found, reason


def _run(near: DataFrame, by: list[str], kernel, columns: str, rejects: list[DataFrame] | None = None) -> DataFrame:
    """Rows of a counting kernel over all blocks.

    A failure ends the job, unless ``rejects`` is a list: then the images of the batch are counted one by one, those that fail
    give a reject row, and the table ``(by, reason)`` of these is added to the list.
    """
    types = dict(near.dtypes)
    keys = ", ".join(f"{c} {types[c]}" for c in by)

    def scan(batches):
        for b in batches:
            if b.num_rows:
                yield from kernel(b)

    if rejects is None:
        return near.mapInArrow(scan, f"{keys}, {columns}")
    wanted = [c.split()[0] for c in columns.split(", ")]
    arrow = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64())}
    kinds = [arrow[c.split()[1]] for c in columns.split(", ")]

    def isolated(batches):
        for b in batches:
            if not b.num_rows:
                continue
            try:
                results = [(b, list(kernel(b)), None)]
            except Exception:
                results = _one_by_one(b, by, kernel)
            for one, found, reason in results:
                for r in found:
                    yield pa.RecordBatch.from_arrays([*r.columns, pa.nulls(r.num_rows, pa.string())], names=[*r.schema.names, "__reason"])
                if reason:
                    head = one.slice(0, 1)
                    yield pa.RecordBatch.from_arrays([*(head.column(c) for c in by), *(pa.nulls(1, k) for k in kinds), pa.array([reason])],
                                                     names=[*by, *wanted, "__reason"])

    done = cut_lineage(near.mapInArrow(isolated, f"{keys}, {columns}, __reason string"))
    rejects.append(done.where("__reason is not null").select(*by, F.col("__reason").alias("reason")).distinct())
    return done.where("__reason is null").drop("__reason")


def _pairs(b: Blocks) -> list[np.ndarray]:
    """Image, direction and the two levels of every pair of neighbours."""
    found = []
    for k, d in enumerate(DIRECTIONS):
        other = _beside(b.levels, d)
        row, slot = np.nonzero((b.own > 0) & (other > 0))
        found.append((b.codes[row], np.full(len(row), k), b.own[row, slot], other[row, slot]))
    return [np.concatenate(p) for p in zip(*found)]


def glcm_cells(b: Blocks):
    """Image, direction and levels i <= j of the cells, sorted in this order, and how often each occurs."""
    g, k, x, y = _pairs(b)
    return _counted([g, k, np.minimum(x, y), np.maximum(x, y)])


def glcm_counts(near: DataFrame, by: list[str], rejects: list[DataFrame] | None = None) -> DataFrame:
    """Symmetric co-occurrence counts per direction: ``(by, dir, i, j, n)``."""
    def kernel(b):
        blocks, first = _unpack(b, by)
        (g, k, i, j), n = _counted(_pairs(blocks))
        for a, c in ((i, j), (j, i)):
            yield _emit(b, by, first, g, {"dir": k.astype("int32"), "i": a.astype("int32"), "j": c.astype("int32"), "n": n.astype("int64")})

    return _run(near, by, kernel, "dir int, i int, j int, n bigint", rejects).groupBy(*by, "dir", "i", "j").agg(F.sum("n").alias("n"))


def top_levels(b: Blocks) -> np.ndarray:
    """The largest level of each image."""
    top = np.zeros(b.n, np.int64)
    np.maximum.at(top, b.codes, b.own.max(axis=1))
    return top


def glcm_matrices(near: DataFrame, by: list[str], rejects: list[DataFrame] | None = None) -> DataFrame:
    """The same counts with a matrix in few rows: ``(by, dir, top, parts)``.

    ``parts`` lists ``(i, j, n)`` with arrays of the cells that have i <= j, one part for each batch that met the image, in which a cell may
    come again; a pair is counted once. ``top`` is the largest level of the image. A direction without a pair has no row.
    """
    def kernel(b):
        blocks, first = _unpack(b, by)
        top = top_levels(blocks)
        (g, k, i, j), n = glcm_cells(blocks)
        # Every direction of every image has a row here, for its top level; the cells are sorted by these rows.
        ends = np.searchsorted(g * len(DIRECTIONS) + k, np.arange(len(first) * len(DIRECTIONS) + 1))
        offsets, group = pa.array(ends, pa.int32()), np.repeat(np.arange(len(first)), len(DIRECTIONS))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v.astype(kind))) for v, kind in ((i, "int32"), (j, "int32"), (n, "int64"))]
        yield _emit(b, by, first, group, {"dir": np.tile(np.arange(len(DIRECTIONS), dtype="int32"), len(first)), "top": top[group].astype("int32"),
                                          "i": lists[0], "j": lists[1], "n": lists[2]})

    rows = _run(near, by, kernel, "dir int, top int, i array<int>, j array<int>, n array<bigint>", rejects)
    part = F.when(F.size("i") > 0, F.struct("i", "j", "n"))  # nulls are not collected
    return rows.groupBy(*by, "dir").agg(F.max("top").alias("top"), F.collect_list(part).alias("parts")).where(F.size("parts") > 0)


def _per_packed(near: DataFrame, by: list[str], count, columns: str, rejects: list[DataFrame] | None) -> DataFrame:
    """One row for each packed image, with lists of the cells that ``count`` finds in its blocks."""
    def kernel(part):
        g, cells = count(_blocks(part))
        return lists(g, part.num_rows, *cells.values())

    return per_image(near, by, kernel, columns, rejects is not None)


def dependence_counts(near: DataFrame, by: list[str], alpha: int = 0, rejects: list[DataFrame] | None = None) -> DataFrame:
    """One plus the number of the 26 neighbours within ``alpha`` levels: ``(by, level, size, n)``."""
    def count(b: Blocks):
        alike = np.zeros_like(b.own)
        for d in product((-1, 0, 1), repeat=3):
            other = _beside(b.levels, d)
            alike += (other > 0) & (np.abs(other - b.own) <= alpha)  # the voxel itself is the extra one
        row, slot = np.nonzero(b.own)
        (g, level, size), n = _counted([b.codes[row], b.own[row, slot], alike[row, slot]])
        return g, {"level": level.astype("int32"), "size": size.astype("int64"), "n": n.astype("int64")}

    def kernel(b):
        blocks, first = _unpack(b, by)
        yield _emit(b, by, first, *count(blocks))

    if is_packed(near):
        return _per_packed(near, by, count, "level array<int>, size array<bigint>, n array<bigint>", rejects)
    return _run(near, by, kernel, "level int, size bigint, n bigint", rejects).groupBy(*by, "level", "size").agg(F.sum("n").alias("n"))


def tone_table(near: DataFrame, by: list[str], rejects: list[DataFrame] | None = None) -> DataFrame:
    """Per level: voxels with a neighbour and their summed distance to the neighbourhood mean: ``(by, level, n, s)``."""
    def count(b: Blocks):
        total, beside = np.zeros_like(b.own), np.zeros_like(b.own)
        for d in product((-1, 0, 1), repeat=3):
            if any(d):
                other = _beside(b.levels, d)
                total += other
                beside += other > 0
        row, slot = np.nonzero((b.own > 0) & (beside > 0))
        level = b.own[row, slot]
        gap = np.abs(level - total[row, slot] / beside[row, slot])
        (g, lev), s = _counted([b.codes[row], level], gap)
        n = _counted([b.codes[row], level])[1]
        return g, {"level": lev.astype("int32"), "n": n.astype("int64"), "s": s}

    def kernel(b):
        blocks, first = _unpack(b, by)
        yield _emit(b, by, first, *count(blocks))

    if is_packed(near):
        return _per_packed(near, by, count, "level array<int>, n array<bigint>, s array<double>", rejects)
    return _run(near, by, kernel, "level int, n bigint, s double", rejects).groupBy(*by, "level").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"))


def _runs(b: Blocks):
    """For each direction: image, level and number of the runs of one voxel; image, level, line and step of the ends of longer ones."""
    for k, d in enumerate(DIRECTIONS):
        begins = (b.own > 0) & (_beside(b.levels, tuple(-c for c in d)) != b.own)
        ends = (b.own > 0) & (_beside(b.levels, d) != b.own)
        row, slot = np.nonzero(begins & ends)
        single = _counted([b.codes[row], b.own[row, slot]])
        row, slot = np.nonzero(begins ^ ends)
        z, y, x = b.place(row, slot)
        step = (z, y, x)[next(a for a in range(3) if d[a])]
        yield k, single, (b.codes[row], b.own[row, slot], (z * SIDE + y) * SIDE + x - step * shift(d), step)


def _run_cells(b: Blocks):
    """:func:`run_counts` of whole images: their runs are complete here."""
    found = []
    for k, ((g, level), n), ends in _runs(b):
        found.append((g, np.full(len(g), k), level, np.ones(len(g), np.int64), n))
        g, level, _, step = (c[np.lexsort((ends[3], ends[1], ends[2], ends[0]))] for c in ends)
        found.append((g[::2], np.full(len(g) // 2, k), level[::2], step[1::2] - step[::2] + 1, np.ones(len(g) // 2, np.int64)))
    *cells, n = (np.concatenate(p) for p in zip(*found))
    (g, k, level, size), n = _counted(cells, n)
    return g, {"dir": k.astype("int32"), "level": level.astype("int32"), "size": size, "n": n.astype("int64")}


def run_counts(near: DataFrame, by: list[str], rejects: list[DataFrame] | None = None) -> DataFrame:
    """Runs of equal level along the 13 directions: ``(by, dir, level, size, n)``.

    Runs of one voxel are counted where they are. Of a longer run only its two ends travel: on a line and level, ends
    alternate with starts, so a run is a start and the end that follows it.
    """
    def kernel(b):
        blocks, first = _unpack(b, by)
        for k, ((g, level), n), (code, of, line, step) in _runs(blocks):
            none = pa.nulls(len(g), pa.int64())
            yield _emit(b, by, first, g, {"dir": np.full(len(g), k, "int32"), "level": level.astype("int32"),
                                          "line": none, "step": none, "n": n.astype("int64")})
            yield _emit(b, by, first, code, {"dir": np.full(len(code), k, "int32"), "level": of.astype("int32"),
                                             "line": line, "step": step, "n": np.ones(len(code), "int64")})

    if is_packed(near):
        return _per_packed(near, by, _run_cells, "dir array<int>, level array<int>, size array<bigint>, n array<bigint>", rejects)
    found = _run(near, by, kernel, "dir int, level int, line bigint, step bigint, n bigint", rejects)
    single = found.where("line IS NULL").select(*by, "dir", "level", F.lit(1).cast("long").alias("size"), "n")
    w = W.partitionBy(*by, "dir", "line", "level").orderBy("step")
    order = F.row_number().over(w)
    longer = (found.where("line IS NOT NULL").withColumn("size", F.lead("step").over(w) - F.col("step") + 1)
              .withColumn("o", order).where("o % 2 = 1").select(*by, "dir", "level", "size", "n"))
    return single.unionByName(longer).groupBy(*by, "dir", "level", "size").agg(F.sum("n").alias("n"))


def _links(b: Blocks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Image and ends of the links of :func:`zone_edges`."""
    codes, levels = b.codes, b.levels
    width = levels.shape[2] - 2
    slots = np.arange(width)

    def heads(line: np.ndarray) -> np.ndarray:
        """Slot of the first voxel of the stretch each of the inner voxels belongs to."""
        inner = line[:, 1:-1]
        fresh = np.concatenate([np.ones((len(inner), 1), bool), inner[:, 1:] != inner[:, :-1]], axis=1)
        return np.maximum.accumulate(np.where(fresh, slots, 0), axis=1)

    own, here = b.own, heads(levels[:, 4])
    out = []

    def link(row, slot_u, dz, dy, slot_v):
        z, y, x = b.place(row, slot_u)
        p = (z * SIDE + y) * SIDE + x
        z, y, x = b.place(row, slot_v)
        q = ((z + dz) * SIDE + y + dy) * SIDE + x
        out.append((codes[row], np.maximum(p, q), np.minimum(p, q)))

    row, slot = np.nonzero((own > 0) & (here != slots))
    link(row, slot, 0, 0, here[row, slot])
    for edge, halo in ((0, -1), (width - 1, width)):
        row = np.nonzero((own[:, edge] > 0) & (levels[:, 4, halo + 1] == own[:, edge]))[0]
        link(row, here[row, edge], 0, 0, np.full(len(row), halo))
    for dz, dy in LINES:
        if (dz, dy) <= (0, 0):
            continue
        line = levels[:, _line(dz, dy)]
        there = np.concatenate([np.full((len(line), 1), -1), heads(line), np.full((len(line), 1), width)], axis=1)
        for dx in (-1, 0, 1):
            other = line[:, 1 + dx:1 + dx + width]
            row, slot = np.nonzero((own > 0) & (other == own))
            link(row, here[row, slot], dz, dy, there[row, slot + 1 + dx])
    table = np.unique(np.stack([np.concatenate(p) for p in zip(*out)], axis=1), axis=0)
    return table[:, 0], table[:, 1], table[:, 2]


def zone_edges(near: DataFrame, by: list[str], rejects: list[DataFrame] | None = None) -> DataFrame:
    """Links between touching voxels of equal level, thinned: ``(by, u, v)`` with u > v.

    Inside a block a stretch of equal voxels is represented by its first voxel; links between lines join these first
    voxels, and only a halo voxel, whose stretch is not known here, is linked as itself.
    """
    def kernel(b):
        blocks, first = _unpack(b, by)
        group, u, v = _links(blocks)
        yield _emit(b, by, first, group, {"u": u, "v": v})

    return _run(near, by, kernel, "u bigint, v bigint", rejects).where("u <> v").distinct()


def _settled(codes: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, position and smallest reachable position of all ends of the links ``(u, v)`` of groups, sorted by group and position."""
    n, place = len(u), np.concatenate([u, v])
    order = np.lexsort([place, np.tile(codes, 2)])
    fresh = np.concatenate([[True], (np.diff(place[order]) != 0) | (np.diff(np.tile(codes, 2)[order]) != 0)])
    ends = np.empty(2 * n, np.int64)
    ends[order] = np.cumsum(fresh) - 1
    pos, group = place[order[fresh]], np.tile(codes, 2)[order[fresh]]
    u, v = ends[:n], ends[n:]
    root = np.arange(len(pos))  # positions of a group are sorted, so the smallest number is the smallest position
    while True:
        x, y = root[u], root[v]
        if (x == y).all():
            break
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    return group, pos, pos[root]


def packed_zones(near: DataFrame, by: list[str], rejects: list[DataFrame] | None = None) -> DataFrame:
    """Lists of position, level and zone (its smallest position) of the voxels of each packed image."""
    def kernel(part):
        image, z, y, x, level = _levels(part)
        pos = (z * SIDE + y) * SIDE + x
        group, u, v = _links(_blocks(part))
        group, place, zone = _settled(np.concatenate([group, image]), np.concatenate([u, pos]), np.concatenate([v, pos]))  # a voxel reaches itself
        return lists(group, part.num_rows, place, level[np.lexsort((pos, image))].astype(np.int32), zone)

    return per_image(near, by, kernel, "pos array<bigint>, level array<int>, zone array<bigint>", rejects is not None)


def slab_roots(edges: DataFrame, by: list[str]) -> DataFrame:
    """``(by, pos, root)``: the smallest position that a voxel reaches by links inside its slab, for all voxels with such a link.

    A slab has 8,192 voxels, so its links are a group of bounded size whatever the image; all slabs are settled in one pass, many small ones
    side by side.
    """
    own = F.col("u").bitwiseAND(F.lit(SLAB))
    inside = edges.withColumn("slab", own).where(own == F.col("v").bitwiseAND(F.lit(SLAB)))
    types = dict(edges.dtypes)

    def settle_slabs(batches):
        for b, codes, first in whole_groups(batches, [*by, "slab"]):
            group, pos, root = _settled(codes, b.column("u").to_numpy(), b.column("v").to_numpy())
            yield _emit(b, by, first, group, {"pos": pos, "root": root})

    keys = ", ".join(f"{c} {types[c]}" for c in by)
    return (inside.repartition(*by, "slab").sortWithinPartitions(*by, "slab").select(*by, "slab", "u", "v")
            .mapInArrow(settle_slabs, f"{keys}, pos bigint, root bigint"))


def crossing_links(edges: DataFrame, roots: DataFrame, by: list[str]) -> DataFrame:
    """Links across the faces of slabs, ``(by, u, v)`` with u > v, between the slab roots of their ends."""
    across = edges.where(F.col("u").bitwiseAND(F.lit(SLAB)) != F.col("v").bitwiseAND(F.lit(SLAB)))
    for end in ("u", "v"):
        at = roots.select(*by, F.col("pos").alias(end), F.col("root").alias("__root"))
        across = match(across, at, [*by, end], "left").withColumn(end, F.coalesce("__root", end)).drop("__root")
    return across.select(*by, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
