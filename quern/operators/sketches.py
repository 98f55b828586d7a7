"""Sketches that are kept by a key and united for any span of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Log of the numbers in a sketch of distinct values; the error is some 1.04 / sqrt(2^HLL_BITS) and 1 / sqrt(2^THETA_BITS).
HLL_BITS, THETA_BITS = 14, 14
#: Size of a quantile sketch; ranks are off by some 1.7 / KLL_SIZE of the rows.
KLL_SIZE = 400


def sketched(df: DataFrame, by: list[Column], item: str, value: str) -> DataFrame:
    """Columns ``hll`` and ``theta`` of distinct ``item`` and ``kll`` of the numbers ``value``, and ``n`` rows, for each group.

    A task makes one sketch of each group that it meets; sketches, not rows, are shuffled. They may be stored and united later.
    """
    return df.groupBy(*by).agg(F.hll_sketch_agg(item, HLL_BITS).alias("hll"), F.theta_sketch_agg(item, THETA_BITS).alias("theta"), F.kll_sketch_agg_double(F.col(value).cast("double"), KLL_SIZE).alias("kll"), F.count(F.lit(1)).alias("n"))


def united(sketches: DataFrame, by: list[Column]) -> DataFrame:
    """The sketches of each group of sketches, as if made of all their rows."""
    return sketches.groupBy(*by).agg(F.hll_union_agg("hll").alias("hll"), F.theta_union_agg("theta").alias("theta"), F.kll_merge_agg_double("kll").alias("kll"), F.sum("n").alias("n"))


def distinct_items(sketch: Column | str) -> Column:
    return F.hll_sketch_estimate(sketch)


def common_items(a: Column | str, b: Column | str) -> Column:
    """Estimated number of items in both of two theta sketches."""
    return F.theta_sketch_estimate(F.theta_intersection(a, b))


def items_only_in(a: Column | str, b: Column | str) -> Column:
    """Estimated number of items in the first of two theta sketches but not in the second."""
    return F.theta_sketch_estimate(F.theta_difference(a, b))


def quantile(sketch: Column | str, share: float) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(share))
