"""Groups of bounded size inside the Arrow batches of a sorted partition, many of them side by side."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def group_codes(batch: pa.RecordBatch | pa.Table, by: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Group code per row, by first occurrence, and the first row of each group; nulls are a group."""
    codes = batch.select(by).to_pandas().groupby(by, sort=False, dropna=False).ngroup().to_numpy()
    return codes, np.unique(codes, return_index=True)[1]


def whole_groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches of a partition that is sorted by ``by``, cut so that no group is split: with group codes and first rows.

    Only the last group of a batch waits for the next one, so ``by`` must name groups of bounded size.
    """
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        codes, first = group_codes(b, by)
        cut = int(first[-1])
        if cut:
            yield b.slice(0, cut), codes[:cut], first[:-1]
        held = b.slice(cut)
    if held is not None:
        yield held, *group_codes(held, by)
