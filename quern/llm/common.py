"""What several operators of this subpackage share: durable cuts, words, ragged arrays."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import durable, read, save

SLICE_BYTES = 8 << 20
#: Small rows (ids, hashes, edges) that a file of a cut holds, about.
ROWS_A_FILE = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, whatever their names."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])


def released() -> None:
    """Give a Python worker's freed memory back to the system.

    Workers outlive their tasks and serve later stages. Called at a task's end.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def clamp_partitions(total: float, each: float, least: int = 1) -> int:
    """Number of partitions that hold ``each`` units of a ``total`` that grows with the data."""
    return max(least, int(-(-total // each)))


def settled(df: DataFrame, rows: int | None) -> DataFrame:
    """``durable`` for about ``rows`` small rows: tasks and files grow with them, not with the partitions of a shuffle.

    A wrong number changes how many files there are, nothing else; None leaves the partitions as they are.
    """
    if rows is None:
        return durable(df)
    least = 2 * df.sparkSession.sparkContext.defaultParallelism
    return durable(df.coalesce(clamp_partitions(rows, ROWS_A_FILE, least)))


def rewritten(df: DataFrame, place: str, rows: int | None) -> DataFrame:
    """Like ``settled``, but written to the folder ``place`` and read back: the cut for rounds that join what earlier rounds cut.

    A checkpoint keeps the size that its plan was guessed to have, and a join's is the product of its sides': over rounds, the
    digits of that number double with each join, until they fill the driver. What is read back has the size of its files.
    """
    least = 2 * df.sparkSession.sparkContext.defaultParallelism
    save(df if rows is None else df.coalesce(clamp_partitions(rows, ROWS_A_FILE, least)), place)
    return read(df.sparkSession, place, "parquet", df.schema)


def min_by_key(df: DataFrame, key: str, value: Column, name: str, rows: int) -> DataFrame:
    """Attach to each of about ``rows`` rows the least ``value`` of its ``key``.

    The minimum is combined before the shuffle and cut to disk, so that both
    sides of the join back are plain scans and adaptive execution may split a
    key that holds a large share of the rows.
    """
    least = settled(df.groupBy(key).agg(F.min(value).alias(name)), rows)
    return df.join(least, key)


def slices(
    batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES
) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut a record batch into runs of rows with about ``limit`` bytes of text each.

    Yields the run and its texts as UTF-8 bytes (null: empty). A longer single
    text forms a run of its own.
    """
    col = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
        col = col.cast(pa.large_binary())
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0), dtype=np.int64)
    start, n = 0, batch.num_rows
    ends = np.cumsum(sizes)
    while start < n:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start), [t or b"" for t in col.slice(start, stop - start).to_pylist()]
        start = stop


def word_codes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the texts after lower-casing A-Z.

    Returns the code of each word, the distinct words as bytes objects, and the
    number of words of each text. ``bytes.split`` and ``bytes.lower`` cut and
    fold exactly these ASCII characters.
    """
    words: list[bytes] = []
    counts = np.empty(len(texts), np.int64)
    for i, t in enumerate(texts):
        own = t.lower().split() if lower else t.split()
        counts[i] = len(own)
        words += own
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, object), counts
    flat = np.empty(len(words), object)
    flat[:] = words
    codes, distinct = pd.factorize(flat)
    return codes, distinct, counts


def starts_of(counts: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(counts)))[: len(counts)].astype(np.int64)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions start, start+1, ... of each run, one run after the other."""
    counts = np.asarray(counts, np.int64)
    total = int(counts.sum())
    shift = np.repeat(np.asarray(starts, np.int64) - starts_of(counts), counts)
    return np.arange(total, dtype=np.int64) + shift


def segment_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each run of ``values``; empty runs give 0."""
    out = np.zeros(len(counts), np.float64)
    full = np.flatnonzero(counts)
    if len(full):
        out[full] = np.add.reduceat(values, starts_of(counts)[full])
    return out
