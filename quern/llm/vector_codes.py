"""Vector codes by product quantisation, nearest entries by VA-file filtering (operator 12)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, ragged, released, starts_of, table

#: Parts of a vector, entries of a part's codebook, rounds of learning, units of a component.
PARTS, ENTRIES, ROUNDS, UNITS = 4, 256, 4, 1024
#: Bits of an approximated entry coordinate, vectors that are worked on together.
BITS, TOGETHER = 4, 1024
#: Components up to this size keep squared distances within 64 bits; larger ones are Python's own integers.
SMALL = 1 << 27


@dataclass(frozen=True)
class Approximations:
    """A codebook (entries x places) and its VA-file: each coordinate's cell, each cell's least and largest coordinate (places x cells)."""

    entries: np.ndarray
    cells: np.ndarray
    least: np.ndarray
    most: np.ndarray


def approximated(entries: np.ndarray, bits: int = BITS) -> Approximations:
    """Entries quantised to ``bits`` a coordinate: cells of a place hold equally many of its coordinates in order."""
    n, width = entries.shape
    cells = np.zeros((width, n), np.int64)
    least = np.zeros((width, 1 << bits), entries.dtype)
    most = least.copy()
    for d in range(width):
        order = np.argsort(entries[:, d], kind="stable")
        cells[d, order] = np.arange(n) * (1 << bits) // n
        for c in np.unique(cells[d]):
            held = entries[cells[d] == c, d]
            least[d, c], most[d, c] = held.min(), held.max()
    return Approximations(entries, cells, least, most)


def nearest(vectors: np.ndarray, file: Approximations) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of and squared distance to each vector's nearest entry (ties: the least index), and how many distances were computed.

    A table of each vector's least and largest squared distance to every cell gives
    bounds for all entries by look-ups alone. Only entries whose lower bound does not exceed the least
    upper bound are refined by integer distances.
    """
    n, width = vectors.shape
    q = vectors[:, :, None]
    below, above = file.least[None] - q, q - file.most[None]
    low = np.maximum(np.maximum(below, above), 0) ** 2
    high = np.maximum(abs(below), abs(above)) ** 2
    lower = np.zeros((n, len(file.entries)), vectors.dtype)
    upper = lower.copy()
    for d in range(width):
        lower += low[:, d, file.cells[d]]
        upper += high[:, d, file.cells[d]]
    row, entry = np.nonzero(lower <= upper.min(axis=1)[:, None])
    distance = ((vectors[row] - file.entries[entry]) ** 2).sum(axis=1)
    begins = starts_of(np.bincount(row, minlength=n))
    best = np.minimum.reduceat(distance, begins)
    first = np.minimum.reduceat(np.where(distance == best[row], entry, len(file.entries)), begins)
    return first, best, len(row)


def _components(column: pa.Array, width: int) -> np.ndarray:
    """floor(1024 x) of all vectors, with zeros after those shorter than ``width``."""
    counts = np.asarray(column.value_lengths(), np.int64)
    values = np.floor(np.asarray(column.flatten(), np.float64) * UNITS)
    wide = len(values) and np.abs(values).max() > SMALL
    out = np.zeros((len(counts), width), object if wide else np.int64)
    out[np.repeat(np.arange(len(counts)), counts), ragged(np.zeros(len(counts)), counts)] = [int(v) for v in values] if wide else values.astype(np.int64)
    return out


def _assigned(column: pa.Array, files: list[Approximations]) -> Iterator[tuple[slice, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """Runs of vectors: where they are, their components, and the nearest entry and distance by part."""
    width = files[0].entries.shape[1]
    for begin in range(0, len(column), TOGETHER):
        at = slice(begin, min(begin + TOGETHER, len(column)))
        whole = _components(column.slice(at.start, at.stop - at.start), PARTS * width)
        kind = np.result_type(whole, files[0].entries)
        whole = whole.astype(kind)
        yield at, whole, [nearest(whole[:, p * width : (p + 1) * width], f)[:2] for p, f in enumerate(files)]


def _part_sums(batches: Iterator[pa.RecordBatch], files) -> Iterator[pa.RecordBatch]:
    """A task's sums: a row for each part, entry and place that it met."""
    held = files.value
    k, width = held[0].entries.shape
    counts, sums = np.zeros((PARTS, k), np.int64), np.zeros((PARTS, k, width), object)
    for batch in batches:
        for _, whole, found in _assigned(batch.column(0), held):
            for p, (entry, _) in enumerate(found):
                counts[p] += np.bincount(entry, minlength=k)
                own = np.zeros((k, width), whole.dtype)
                np.add.at(own, entry, whole[:, p * width : (p + 1) * width])
                sums[p] += own
    part, entry = np.nonzero(counts)
    total = [[Decimal(int(x)) for x in sums[p, e]] for p, e in zip(part.tolist(), entry.tolist(), strict=True)]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.decimal128(38, 0))]
    columns = [part, entry, counts[part, entry], total]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["part", "entry", "n", "totals"])
    released()


def _coded(batches: Iterator[pa.RecordBatch], files) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes, errors = [], []
        for _, _, found in _assigned(batch.column(2), files.value):
            digits = np.stack([entry for entry, _ in found], axis=1).astype(np.uint8).tobytes().hex()
            codes += [digits[i : i + 2 * PARTS] for i in range(0, len(digits), 2 * PARTS)]
            errors += [min(int(x), (1 << 63) - 1) for x in sum(distance for _, distance in found)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=["vec_id", "label", "code", "error"])
    released()


def learn_codebooks(vectors: DataFrame, rounds: int = ROUNDS) -> list[np.ndarray]:
    """A codebook for each part of ``vectors`` (``vec_id``, ``embedding`` without nulls): entries x places, integers.

    Every round assigns all vectors in one job. A task sends its sums by entry, so the shuffle holds
    at most ``PARTS * ENTRIES`` rows a task and the driver gets that many rows of one part's width.
    """
    spark = vectors.sparkSession
    width = vectors.agg(F.max(F.size("embedding"))).first()[0]
    if width is None:
        return []
    width = -(-width // PARTS)
    first = vectors.select("embedding").orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(ENTRIES).toArrow()
    whole = _components(first.column(0).combine_chunks(), PARTS * width)
    books = [whole[:, p * width : (p + 1) * width].copy() for p in range(PARTS)]
    for _ in range(rounds):
        files = spark.sparkContext.broadcast([approximated(b) for b in books])
        sums = vectors.select("embedding").mapInArrow(partial(_part_sums, files=files), "part int, entry int, n long, totals array<decimal(38,0)>")
        by_place = sums.select("part", "entry", "n", F.posexplode_outer("totals").alias("place", "total"))
        by_place = by_place.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        for r in by_place.where("place is not null").collect():
            books[r["part"]][r["entry"], r["place"]] = int(r["total"]) // r["n"]
        files.destroy()
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def kept_vectors(embeddings: DataFrame) -> DataFrame:
    """Rows whose ``embedding`` is a vector of finite numbers."""
    x = F.col("embedding")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return embeddings.where(x.isNotNull() & ~bad).select("vec_id", "label", "embedding")


def compress_vectors(embeddings: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Codes and squared errors of the vectors of ``embeddings`` (``vec_id``, ``embedding``, ``label``).

    Returns ``vec_id``, ``label``, ``code`` (an entry index by part, two hex digits each), ``error``
    (squared distances summed over parts), ``label_error`` (``error`` summed over equal labels, nulls
    together) and ``codebooks_sha256``.

    Defined cases. Vectors that are null or hold a null, NaN or infinity are left out. Shorter vectors count as
    followed by zeros, up to the longest's length rounded up to a multiple of ``PARTS``. With fewer than
    ``ENTRIES`` vectors, codebooks have as many entries. Of repeated vec_ids the least vector comes first, null vec_ids
    come last; every row is coded. An error above 2^63 - 1 is given as that; components above 1e30 are not supported.
    Without vectors there are no rows. Other columns are ignored.
    """
    vectors = kept_vectors(embeddings)
    books = learn_codebooks(vectors, rounds)
    shape = f"vec_id long, label {dict(vectors.dtypes)['label']}, code string, error long"
    if not books:
        return vectors.sparkSession.createDataFrame([], f"{shape}, label_error long, codebooks_sha256 string")
    files = vectors.sparkSession.sparkContext.broadcast([approximated(b) for b in books])
    coded = durable(vectors.select(F.col("vec_id").cast("long"), "label", "embedding").mapInArrow(partial(_coded, files=files), shape))
    sums = durable(coded.groupBy("label").agg(F.sum("error").alias("label_error"))).withColumnRenamed("label", "of")
    joined = coded.join(sums, coded["label"].eqNullSafe(sums["of"])).drop("of")
    return joined.withColumn("codebooks_sha256", F.lit(digest(books)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _sql() -> str:
    """The rounds as a chain of common table expressions: distances of all parts to all entries, the least, the means."""
    steps = [
        """rows AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, embedding FROM embeddings
             WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
           parts AS (SELECT r, p, list_transform(embedding[p * len(embedding) // 4 + 1 : (p + 1) * len(embedding) // 4], lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM rows, range(4) t(p)),
           e0 AS (SELECT p, r - 1 AS i, v FROM parts WHERE r <= 256)"""
    ]
    for n in range(ROUNDS + 1):
        steps.append(
            f"""n{n} AS MATERIALIZED (SELECT r, p, min((d, i)) AS best FROM (
                  SELECT a.r, a.p, e.i, list_sum(list_transform(range(1, len(a.v) + 1), lambda j: (a.v[j] - e.v[j]) * (a.v[j] - e.v[j])))::BIGINT AS d FROM parts a JOIN e{n} e USING (p)) GROUP BY r, p)"""
        )
        if n < ROUNDS:
            steps.append(
                f"""m{n} AS (SELECT p, i, list(((s - ((s % c) + c) % c) // c)::BIGINT ORDER BY j) AS v FROM (
                      SELECT a.p, b.best[2] AS i, j, sum(a.v[j])::BIGINT AS s, count(*)::BIGINT AS c FROM parts a JOIN n{n} b USING (r, p), range(1, len(a.v) + 1) t(j) GROUP BY ALL) GROUP BY p, i),
                    e{n + 1} AS MATERIALIZED (SELECT e.p, e.i, coalesce(m.v, e.v) AS v FROM e{n} e LEFT JOIN m{n} m USING (p, i))"""
            )
    last = f"n{ROUNDS}"
    return f"""WITH {", ".join(steps)},
        coded AS (SELECT r, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, sum(best[1])::BIGINT AS error FROM {last} GROUP BY r)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
               (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, i)) FROM e{ROUNDS}) AS codebooks_sha256
        FROM rows JOIN coded USING (r)"""


SQL = _sql()
