"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import scratch
from .common import min_by_key, rewritten, settled


def _state(edges: DataFrame) -> tuple:
    """Number of edges and an order-free checksum of them, as one row of scalars."""
    mixed = F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31))
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(mixed)).first())


def _large_star(edges: DataFrame, size: int) -> DataFrame:
    """Link every larger neighbour of a node to the node's least neighbour."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    known = min_by_key(both, "u", F.least("u", "v"), "least", 2 * size)
    return settled(known.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("least").alias("v")).distinct(), size)


def _small_star(edges: DataFrame, size: int) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them. Edges have u > v."""
    known = min_by_key(edges, "u", F.col("v"), "least", size)
    moved = F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("least").alias("v")), F.struct(F.col("v").alias("u"), F.col("least").alias("v"))))
    out = known.select(moved.alias("e")).select("e.u", "e.v").where(F.col("u") > F.col("v"))
    return out.distinct()


def connected_components(edges: DataFrame, a: str, b: str, rows: int | None = None) -> DataFrame:
    """Columns ``node`` and ``root`` (the least node that it reaches) for every node that has an edge.

    Any orderable type serves for nodes. Self-loops and nulls are left out, as
    are repeated edges. The rounds end when neither star changes the edges;
    only their number and checksum reach the driver. A hub's edges are combined
    before the shuffle, and adaptive execution may split them in the join.
    ``rows`` is about the number of edges, if known; with it the number of files
    of the first cut grows, as that of later ones does with the edges left. A
    round's edges are written over those of the last but one.
    """
    x, y = F.col(a), F.col(b)
    with scratch(edges.sparkSession) as place:
        now = rewritten(edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), f"{place}/0", rows)
        before, state, n = None, _state(now), 0
        while state != before:
            n += 1
            now = rewritten(_small_star(_large_star(now, state[0]), state[0]), f"{place}/{n % 2}", state[0])
            before, state = state, _state(now)
        now = settled(now, state[0])
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
