"""Nearest vectors by an inverted list of coarse centres."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import durable
from .ranges import quoted

#: Most vectors that the centres are fitted on: those whose hashed id is least. Most centres, rounds of fitting them.
SAMPLE, CENTRES, FITTED = 20_000, 1 << 10, 10
#: Vectors that are worked on together; queries that a task meets with a piece of a list, and vectors of such a piece.
TOGETHER, ASKED, PIECE = 1 << 10, 1 << 10, 1 << 12


@dataclass(frozen=True)
class VectorIndex:
    """Centres (rows of length 1) and all vectors by centre: ``list``, ``id``, ``unit``."""

    centres: np.ndarray
    vectors: DataFrame


def _whole(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors of one length as rows."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.concatenate([np.asarray(c.flatten(), np.float64) for c in parts]).reshape(len(column), width)


def _units(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    whole = _whole(column, width)
    size = np.sqrt((whole * whole).sum(axis=1, keepdims=True))
    return whole / np.where(size > 0, size, 1)


def _usable(df: DataFrame, id_: str, vector: str, width: int | None = None) -> DataFrame:
    x = F.col(quoted(vector)).cast("array<double>")
    sound = x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    out = df.where(sound & F.col(quoted(id_)).isNotNull()).select(F.col(quoted(id_)).cast("long").alias("id"), x.alias("vector"))
    return out if width is None else out.where(F.size("vector") == width)


def _nearest_lists(batches: Iterator[pa.RecordBatch], centres, lists: int) -> Iterator[pa.RecordBatch]:
    """Each vector, brought to length 1, with its ``lists`` nearest centres: a row for each."""
    c = centres.value
    for batch in batches:
        for i in range(0, batch.num_rows, TOGETHER):
            own = batch.slice(i, TOGETHER)
            unit = _units(own.column(1), c.shape[1])
            near = np.argsort(-(unit @ c.T), axis=1, kind="stable")[:, :lists]
            row = np.repeat(np.arange(len(unit)), near.shape[1])
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(unit) + 1, dtype=np.int32) * unit.shape[1]), pa.array(unit.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), own.column(0).take(pa.array(row)), flat.take(pa.array(row))], names=["list", "id", "unit"])


def fit_index(df: DataFrame, id_: str, vector: str, centres: int | None = None) -> VectorIndex:
    """An index of all vectors of ``df``, by cosine.

    Centres are means of up to ``SAMPLE`` vectors (spherical k-means); their number is the square root of the rows, ``CENTRES`` at most,
    unless told. The sample and the centres are the only vectors on the driver. Vectors that are null or hold a null, NaN or infinity, that
    have another length than the first of the sample, or no id, are left out; vectors of zeros are near nothing and all the same.
    """
    vectors = _usable(df, id_, vector)
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow().combine_chunks()
    if not sample.num_rows:
        return VectorIndex(np.zeros((0, 0)), vectors.select(F.lit(0).alias("list"), "id", F.col("vector").alias("unit")).limit(0))
    column = sample.column(1)
    width = len(column[0])
    column = column.filter(pa.compute.equal(pa.compute.list_value_length(column), width))
    unit = _units(column, width)
    n = min(len(unit), centres or max(1, min(CENTRES, round(vectors.count() ** 0.5))))
    means = unit[np.linspace(0, len(unit) - 1, n).astype(int)]
    for _ in range(FITTED):
        near = (unit @ means.T).argmax(axis=1)
        sums = np.zeros_like(means)
        np.add.at(sums, near, unit)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        means = np.where(size > 0, sums / np.where(size > 0, size, 1), means)
    shared = df.sparkSession.sparkContext.broadcast(means)
    listed = _usable(df, id_, vector, width).mapInArrow(partial(_nearest_lists, centres=shared, lists=1), "list int, id long, unit array<double>")
    return VectorIndex(means, durable(listed))


def _met(held: pa.Table, wanted: pa.Table, k: int) -> pa.Table:
    """Of the vectors of a piece, each query's ``k`` nearest; ties go to the least id."""
    ids, queries = np.asarray(held.column("id")), np.asarray(wanted.column("id"))
    if not len(ids) or not len(queries):
        return pa.table({"query": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())})
    width = len(wanted.column("unit")[0])
    close = _whole(wanted.column("unit"), width) @ _whole(held.column("unit"), width).T
    close[queries[:, None] == ids[None]] = -np.inf  # a query's own rows
    order = np.argsort(ids, kind="stable")
    best = order[np.argsort(-close[:, order], axis=1, kind="stable")[:, :k]]
    return pa.table({"query": np.repeat(queries, best.shape[1]), "id": ids[best.ravel()], "cosine": np.take_along_axis(close, best, axis=1).ravel()})


def nearest_vectors(index: VectorIndex, queries: DataFrame, id_: str, vector: str, k: int, probes: int) -> DataFrame:
    """``query``, ``id``, ``cosine`` and ``rank`` of the ``k`` nearest of all indexed vectors but the query's own id, by cosine.

    A query looks into the ``probes`` lists whose centres are nearest; with as many as there are centres the answer is exact. Lists are
    dealt in pieces of some ``PIECE`` vectors and queries of a list in groups of some ``ASKED``: a task meets a piece with a group and keeps
    ``k`` rows a query, so a list with a third of all vectors is many tasks, and no pair of vectors becomes a row. Ties go to the
    least id. Queries that cannot be indexed have no rows.
    """
    if not len(index.centres):
        return index.vectors.select(F.col("id").alias("query"), "id", F.lit(0.0).alias("cosine"), F.lit(0).alias("rank")).limit(0)
    spark = queries.sparkSession
    width = index.centres.shape[1]
    shared = spark.sparkContext.broadcast(index.centres)
    asked = _usable(queries, id_, vector, width).mapInArrow(partial(_nearest_lists, centres=shared, lists=probes), "list int, id long, unit array<double>")
    asked = durable(asked)
    pieces = index.vectors.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / PIECE).cast("int").alias("pieces"))
    groups = asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("groups"))
    sizes = F.broadcast(durable(pieces.join(groups, "list")))  # a row a centre, CENTRES at most
    dealt = lambda of: F.pmod(F.xxhash64("id"), F.col(of)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = index.vectors.join(sizes, "list").withColumn("piece", dealt("pieces")).withColumn("group", every("groups")).select("list", "piece", "group", "id", "unit")
    wanted = asked.join(sizes, "list").withColumn("group", dealt("groups")).withColumn("piece", every("pieces")).select("list", "piece", "group", "id", "unit")
    block = ("list", "piece", "group")
    met = held.groupBy(*block).cogroup(wanted.groupBy(*block)).applyInArrow(partial(_met, k=k), "query long, id long, cosine double")
    found = met.where(F.col("cosine") > float("-inf"))
    best = W.partitionBy("query").orderBy(F.desc("cosine"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
