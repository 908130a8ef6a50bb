"""Images of bounded size as one row each, many side by side in a task.

A packed table has one row for each image (and filter): ``(by, nz, ny, nx, at, v, __reason)``, where ``at`` has the places of the masked
voxels in the image's box and ``v`` their intensities. The operators of ``texture`` take it in place of one row for each
voxel and give one row for each image, whose lists hold what would be rows; as all of an image is at hand, no class
shuffles, and of the classes only the features are written. What goes wrong with an image is in ``__reason``, and its other columns are null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hazardframe.operators.ordered import BROADCAST_ROWS, match
from hazardframe.session import settle

WHOLE = 4096  # cells of the box of an image that is packed
SLICE = 25_000  # list elements that are worked on at a time
REASON = "__reason"
ARROW = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64()),
         "array<double>": pa.list_(pa.float64())}


def is_packed(df: DataFrame) -> bool:
    return REASON in df.columns


def by_size(df: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """The voxels of images whose box has at most ``WHOLE`` cells, and those of the larger ones (None if there are none)."""
    sizes, n = settle(df.groupBy(*by).agg(*[(F.max(a) + 1).cast("long").alias(f"n{a}") for a in "zyx"]))
    fits = F.col("nz") * F.col("ny") * F.col("nx") <= WHOLE
    if sizes.where(~fits).isEmpty():
        return df, None
    sized = match(df, F.broadcast(sizes) if n <= BROADCAST_ROWS else sizes, by)
    return sized.where(fits).select(*df.columns), sized.where(~fits).select(*df.columns)


def unpacked(df: DataFrame, by: list[str]) -> DataFrame:
    """``(by, z, y, x, mask)`` of the masked voxels, a row for each."""
    ny, nx, at = F.col("ny"), F.col("nx"), F.col("p").cast("int")
    rows = df.select(*by, "ny", "nx", F.explode("at").alias("p"))
    return rows.select(*by, F.floor(at / (ny * nx)).cast("int").alias("z"), (F.floor(at / nx) % ny).cast("int").alias("y"), (at % nx).alias("x"), F.lit(1).alias("mask"))


def elements(part: pa.RecordBatch, *names: str) -> tuple[np.ndarray, ...]:
    """The number of the row of every list element, and the elements of the columns, whose lists are equally long."""
    sizes = np.diff(part.column(names[0]).offsets.to_numpy())
    return np.repeat(np.arange(len(sizes)), sizes), *(part.column(c).flatten().to_numpy() for c in names)


def lists(row: np.ndarray, rows: int, *columns: np.ndarray) -> list[pa.Array]:
    """A list column for each of ``columns``, whose elements belong to the rows ``row``, in rising order."""
    offsets = pa.array(np.searchsorted(row, np.arange(rows + 1)), pa.int32())
    return [pa.ListArray.from_arrays(offsets, pa.array(c)) for c in columns]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch that follow each other, with a bounded number of list elements unless one row has more."""
    column = next((c for c in batch.columns if pa.types.is_list(c.type)), None)
    ends = np.arange(batch.num_rows + 1) if column is None else column.offsets.to_numpy()
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE, side="right")) - 1)
        yield batch.slice(at, stop - at)
        at = stop


def per_image(df: DataFrame, by: list[str], kernel: Callable[[pa.RecordBatch], list[pa.Array]], columns: str, isolate: bool = False) -> DataFrame:
    """``(by, columns, __reason)``: what ``kernel`` makes of some packed images, an array for each column and an element for each image.

    Images with a reason keep it. With ``isolate`` the images of a slice in which the kernel fails are given to it one by one, and those
    that fail get a reason; without it a failure ends the job.
    """
    types = dict(df.dtypes)
    keys = ", ".join(f"`{c}` {types[c]}" for c in by)
    wanted = [c.split()[0] for c in columns.split(", ")]
    kinds = [ARROW[c.split()[1]] for c in columns.split(", ")]

    def rows(part: pa.RecordBatch, made: list[pa.Array] | None, reason: pa.Array) -> pa.RecordBatch:
        made = [pa.nulls(part.num_rows, k) for k in kinds] if made is None else made
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in by), *made, reason], names=[*by, *wanted, REASON])

    def work(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        try:
            yield rows(part, kernel(part), pa.nulls(part.num_rows, pa.string()))
        except Exception:
            if not isolate:
                raise
            for k in range(part.num_rows):
                one = part.slice(k, 1)
                try:
                    yield rows(one, kernel(one), pa.nulls(1, pa.string()))
                except Exception as e:  # whatever a kernel fails with, it is this image's result
                    yield rows(one, None, pa.array([f"{type(e).__name__}: {e}"]))

    def scan(batches):
        for b in batches:
            refused = b.filter(b.column(REASON).is_valid())
            if refused.num_rows:
                yield rows(refused, None, refused.column(REASON))
            for part in _slices(b.filter(b.column(REASON).is_null()) if refused.num_rows else b):
                yield from work(part)

    return df.mapInArrow(scan, f"{keys}, {columns}, {REASON} string")
