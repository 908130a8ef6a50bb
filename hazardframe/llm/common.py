"""Small helpers of the text operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from hazardframe.session import ensure_checkpoint_dir

BLANK = r"\x20\x09-\x0D"  # fixed value: the white space of the word rules
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` evaluated once per row, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """A-Z become a-z; every other letter stays as it is."""
    return F.translate(text, UPPER, LOWER)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below the checkpoint folder, which the driver and all executors can reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    Cuts the lineage: a lost executor costs a re-read of these files and never a second pass over the texts. The
    schema is given to the reader, so an empty table comes back as one.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_blocks(batches: Iterable[pa.RecordBatch], text: int, most_chars: int = 1_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cut batches into slices whose texts are of bounded size (a longer text makes a slice of its own).

    Gives each slice with its texts, null ones as empty; only these texts are Python strings at a time.
    """
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most_chars, side="right")))
            part = batch.slice(start, stop - start)
            yield part, [t or "" for t in part.column(text).to_pylist()]
            start = stop


def small_or_not(df: DataFrame, most_mb: float = 8.0) -> DataFrame:
    """Write ``df`` and mark it for broadcast only if the rows written are known to be small; the join's result is the same."""
    kept = written(df)
    wide = sum((F.length(c) if t == "string" else F.size(c) * 16 if t.startswith("array") else F.lit(8)) + F.lit(16) for c, t in kept.dtypes)
    size = kept.agg(F.sum(F.coalesce(wide, F.lit(16)).cast("double"))).collect()[0][0] or 0.0
    return F.broadcast(kept) if size <= most_mb * 1e6 else kept


def text_slices(batches: Iterable[pa.RecordBatch], text: str, most_bytes: int = 2_000_000) -> Iterator[tuple[pa.RecordBatch, memoryview, np.ndarray, np.ndarray]]:
    """Cut batches into slices whose texts are of bounded size (a longer text makes a slice of its own), without Python strings.

    Gives each slice with the bytes of its texts one after another, the end of each text in them, and its length in
    characters. The column must not hold nulls.
    """
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.string())
        places = np.frombuffer(column.buffers()[1] or b"\0\0\0\0", np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
        chars = pc.utf8_length(column).to_numpy().astype(np.int64)
        data, start = memoryview(column.buffers()[2] or b""), 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(places, places[start] + most_bytes, side="right")) - 1)
            yield batch.slice(start, stop - start), data[places[start]:places[stop]], places[start + 1:stop + 1] - places[start], chars[start:stop]
            start = stop


def ranked(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Add ``pos``, the place of each row in its group (from 0, nulls first), and ``n``, the rows of the group.

    Rows are dealt into ranges of (group, order), so that a group of any size is sorted by many tasks; only one count for each
    group and range is added up. ``group`` must not hold nulls. Rows that tie in ``order`` take any order among themselves.
    """
    at = [F.col(group), *[F.col(c).asc_nulls_first() for c in order]]
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = written(df.repartitionByRange(*at).sortWithinPartitions(*at).withColumns({"__range": F.spark_partition_id(), "__place": place}))
    counts = dealt.groupBy(group, "__range").agg(F.count(F.lit(1)).alias("__rows"), F.min("__place").alias("__first"))
    whole = W.partitionBy(group)
    before = F.coalesce(F.sum("__rows").over(whole.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = small_or_not(counts.select(group, "__range", (before - F.col("__first")).alias("__shift"), F.sum("__rows").over(whole).alias("n")))
    return dealt.join(ranges, [group, "__range"]).select(*df.columns, (F.col("__place") + F.col("__shift")).alias("pos"), "n")
