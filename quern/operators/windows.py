"""Window operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import durable
from ..functions import micros
from .ranges import RANGE_ROWS, carried, largest_group, quoted, ranged


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group, with ``rank`` from 1.

    Spark filters each task's rows to its own first ``k`` of a group before the shuffle.
    """
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def gap_sessions(df: DataFrame, key: str, time: str, gap_seconds: int, most: int = RANGE_ROWS) -> DataFrame:
    """``df`` with ``session``, a key's number from 0 of the run of rows without a longer gap.

    Keys of at most ``most`` rows go through a plain window. Where one has more, rows are sorted by (key, time) into ranges of
    bounded size, which such a key spans many of. A range's first row looks back to the end of
    the ranges before it, and a key's sessions are summed over its ranges from
    one row a key and range. Rows whose time is null are in a key's session 0.
    """
    rows = df.select(F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("row"), F.col(quoted(key)).alias("key"), micros(time, dict(df.dtypes)[time]).alias("at"))
    largest, total = largest_group(df, [key])
    if largest <= most:
        own = W.partitionBy("key").orderBy("at")
        late = F.coalesce(F.col("at") - F.lag("at").over(own) > gap_seconds * 1_000_000, F.lit(False))
        until = own.rangeBetween(W.unboundedPreceding, W.currentRow)
        return rows.withColumn("fresh", late.cast("long")).select("row.*", F.sum("fresh").over(until).alias("session"))
    rows = ranged(rows, ["key", "at"], most, total)
    own = W.partitionBy("range").orderBy("key", "at")
    ends = carried(rows, F.max_by(F.struct("key", "at"), F.struct(F.col("key").isNotNull(), "key", "at")), rows)
    previous = F.coalesce(F.lag(F.struct("key", "at")).over(own), F.col("carried"))
    rows = rows.join(ends, "range", "left").withColumn("previous", previous)
    fresh = F.col("previous.key").eqNullSafe(F.col("key")) & (F.col("at") - F.col("previous.at") > gap_seconds * 1_000_000)
    rows = rows.withColumn("fresh", F.coalesce(fresh, F.lit(False)).cast("long"))
    until = W.partitionBy("range", "key").orderBy("at").rangeBetween(W.unboundedPreceding, W.currentRow)
    rows = durable(rows.select("row", "key", "range", F.sum("fresh").over(until).alias("here"), "fresh"))
    before = W.partitionBy("key").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy("key", "range").agg(F.sum("fresh").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    sums = durable(sums.select(F.col("key").alias("of"), F.col("range").alias("in_range"), "before"))
    joined = rows.join(sums, (rows["range"] == sums["in_range"]) & rows["key"].eqNullSafe(sums["of"]))
    return joined.select("row.*", (F.col("before") + F.col("here")).alias("session"))
