"""As-of, interval and skew-proof joins as compositions of built-in operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranges import RANGE_ROWS, carried, largest_group, quoted, ranged, unused


def as_of_join(left: DataFrame, right: DataFrame, key: str, time: str, columns: list[str], most: int = RANGE_ROWS) -> DataFrame:
    """Each left row with ``columns`` of the last right row of its key at or before its time.

    Both sides are put together, and keys of at most ``most`` rows go through a plain window. Where one has
    more, rows are sorted by (key, time) into ranges of bounded size, and a window carries the last right row forward within each range; where a range
    begins inside a key, the last right row of the ranges before it comes from one row a
    range. So a key that holds a large share of the rows lies in many ranges, and
    there is no join of rows. Right rows of one key and time: the largest by
    ``columns`` counts. Left rows without a right row have nulls; so have those with a
    null key, which are not shuffled. Rows whose time is null come first.
    """
    keyed, bare = left.where(F.col(key).isNotNull()), left.where(F.col(key).isNull())
    a = keyed.select(F.col(key).alias("key"), F.col(time).alias("time"), F.lit(1).alias("side"), F.struct(*[F.col(quoted(c)) for c in left.columns]).alias("row"))
    b = right.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(time).alias("time"), F.lit(0).alias("side"), F.struct(*columns).alias("last"))
    order = ["key", "time", "side", "last"]
    both = a.unionByName(b, allowMissingColumns=True)
    kinds = dict(right.dtypes)
    missing = bare.select("*", *[F.lit(None).cast(kinds[c]).alias(c) for c in columns])
    largest, total = largest_group(both, ["key"])
    if largest <= most:
        own = W.partitionBy("key").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
        held = F.last(F.when(F.col("side") == 0, F.col("last")), ignorenulls=True).over(own)
        found = both.withColumn("held", held).where("side = 1")
        return found.select("row.*", *[F.col("held")[c].alias(c) for c in columns]).union(missing)
    both = ranged(both, order, most, total)
    until = W.partitionBy("range").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    known = F.when(F.col("side") == 0, F.struct("key", "last"))
    both = both.withColumn("known", F.last(known, ignorenulls=True).over(until))
    ends = carried(both.where("side = 0"), F.max_by(F.struct("key", "last"), F.struct("key", "time", "last")), both)
    found = both.where("side = 1").join(ends, "range", "left").withColumn("known", F.coalesce("known", "carried"))
    held = F.when(F.col("known.key") == F.col("key"), F.col("known.last"))
    found = found.select("row.*", *[held[c].alias(c) for c in columns])
    return found.union(missing)


def interval_join(points: DataFrame, intervals: DataFrame, at: str, begin: str, end: str, width: float) -> DataFrame:
    """Pairs of a point and an interval with begin <= at < end (numbers).

    Intervals are laid over buckets of ``width``, so the join has an equality and is
    hashed instead of nested. An interval takes part in (end - begin) / width + 1
    buckets; a pair is found in the point's bucket alone, so it comes out once.
    """
    bucket = unused("bucket", points, intervals)
    spread = F.sequence(F.floor(F.col(begin) / width), F.floor(F.col(end) / width))
    laid = intervals.where(F.col(begin) < F.col(end)).withColumn(bucket, F.explode(spread))
    dealt = points.withColumn(bucket, F.floor(F.col(at) / width))
    return dealt.join(laid, bucket).where((F.col(at) >= F.col(begin)) & (F.col(at) < F.col(end))).drop(bucket)


def salted_join(large: DataFrame, small: DataFrame, key: str, salts: int, how: str = "inner") -> DataFrame:
    """Equality join for a key of the large side that holds a large share of its rows.

    The large side's keys are spread over ``salts`` and the small side is repeated for
    each. ``how``: inner, left, left_semi or left_anti, with the large side on the left.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a salted join can't be {how}")
    salt = unused("salt", large, small)
    spread = large.withColumn(salt, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in large.columns]), F.lit(salts)).cast("int"))
    repeated = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(repeated, [key, salt], how).drop(salt)
