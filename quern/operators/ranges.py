"""Sorted ranges of bounded size, so that a window need not hold all rows of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import durable

#: Rows of a range, about; also the rows of a group that a plain window may hold.
RANGE_ROWS = 1 << 20

#: A column to sort by, ascending, or one with "desc".
Order = str | tuple[str, str]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores before it until no frame has a column of that name."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def sorting(order: list[Order]) -> list[Column]:
    """Sort columns: nulls first if ascending, last if descending."""
    return [F.col(quoted(o)).asc() if isinstance(o, str) else getattr(F.col(quoted(o[0])), o[1])() for o in order]


def largest_group(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    """Rows of the largest group and of all groups; a task's rows are counted before the shuffle."""
    counts = df.groupBy(*[F.col(quoted(k)) for k in keys]).count()
    most, total = counts.agg(F.max("count"), F.sum("count")).first()
    return most or 0, total or 0


def ranged(df: DataFrame, order: list[Order], rows: int = RANGE_ROWS, total: int | None = None) -> DataFrame:
    """``df`` with ``range``: consecutive numbers of ranges in ``order`` with about ``rows`` rows each.

    Equal rows of ``order`` share a range. The frame is cut to disk, so that later steps see the same ranges;
    before that it is read for its number of rows, if ``total`` does not tell it, and for the ranges' bounds.
    """
    n = max(1, -(-(df.count() if total is None else total) // rows))
    return durable(df.repartitionByRange(n, *sorting(order)).withColumn("range", F.spark_partition_id()))


def carried(rows: DataFrame, last: Column, whole: DataFrame) -> DataFrame:
    """For each range of ``whole``, ``last`` of the latest earlier range that has ``rows``.

    Only one row a range goes through the single window.
    """
    ends = rows.groupBy("range").agg(last.alias("end"))
    ranges = whole.select("range").distinct().join(ends, "range", "left")
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    return durable(ranges.select("range", F.last("end", ignorenulls=True).over(before).alias("carried")))
