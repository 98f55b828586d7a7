"""Joins of intervals that overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import durable
from .ranges import quoted, unused

#: Levels beyond which lengths are no longer told apart, and the largest double: infinite ends are taken for it.
_LIMIT, _MOST = 1023, 1.7976931348623157e308


def _level(begin: Column, end: Column) -> Column:
    """The least power of two that is no shorter than the interval, as an exponent."""
    length = F.least(end.cast("double") - begin.cast("double"), F.lit(_MOST))
    return F.ceil(F.greatest(F.lit(-float(_LIMIT)), F.least(F.lit(float(_LIMIT)), F.log2(length)))).cast("int")


def _cell(at: Column, level: Column) -> Column:
    finite = F.greatest(F.lit(-_MOST), F.least(F.lit(_MOST), at.cast("double")))
    return F.floor(finite / F.pow(F.lit(2.0), level.cast("double")))


def overlap_join(left: DataFrame, right: DataFrame, begin: tuple[str, str], end: tuple[str, str], keys: list[str] = ()) -> DataFrame:
    """Pairs of a left and a right interval that overlap, begin <= x < end (numbers), with equal ``keys`` of both sides.

    An interval's level is its length, rounded up to a power of two, and cells of that length are laid over the
    axis. Two intervals meet in cells of the longer one's level, of which the longer one touches two and the shorter one no more. So an
    interval has a row in one or two cells for its own level and for each longer level of the other side: that depends on how many
    levels there are, some twenty, and not on how long it is. A pair counts in the cell where its overlap begins,
    so it comes out once. Of the rows that meet in a cell, a fair share overlap, as the longer one fills a quarter of its cells at least.

    Both sides' levels are collected: at most 2,047 small numbers. Empty and reversed intervals, and those with a null
    or NaN end, overlap nothing; null keys match nothing. Ends are compared as they are; their cells are those of doubles. Columns of
    ``keys`` come once, other names of the two sides should differ.
    """
    keys = list(keys)
    level, cell = unused("level", left, right), unused("cell", left, right)

    def leveled(df: DataFrame, b: str, e: str) -> DataFrame:
        x, y = F.col(quoted(b)), F.col(quoted(e))
        sound = (x < y) & ~F.isnan(x.cast("double")) & ~F.isnan(y.cast("double"))
        return df.where(sound).withColumn(level, _level(x, y))

    a, b = leveled(left, begin[0], end[0]), leveled(right, begin[1], end[1])
    levels = [sorted(r[0] for r in side.select(level).distinct().collect()) for side in (a, b)]

    def laid(df: DataFrame, x: str, y: str, others: list[int]) -> DataFrame:
        """A row for each level at which the interval meets those of the other side, and each cell that it touches there."""
        own = F.col(level)
        longer = F.filter(F.array(*[F.lit(n) for n in others]).cast("array<int>"), lambda n: n > own)
        at = df.withColumn(f"{level}_at", F.explode(F.concat(F.array(own), longer)))
        cells = F.sequence(_cell(F.col(quoted(x)), F.col(f"{level}_at")), _cell(F.col(quoted(y)), F.col(f"{level}_at")))
        return at.withColumn(cell, F.explode(cells))

    a = laid(a, begin[0], end[0], levels[1]).withColumnRenamed(level, f"{level}_a")
    b = laid(b, begin[1], end[1], levels[0]).withColumnRenamed(level, f"{level}_b")
    joined = a.join(b, [*keys, f"{level}_at", cell])
    x, y = (F.col(quoted(c)) for c in begin)
    u, v = (F.col(quoted(c)) for c in end)
    meets = (x < v) & (y < u) & (F.greatest(f"{level}_a", f"{level}_b") == F.col(f"{level}_at"))
    begins = F.col(cell) == F.greatest(_cell(x, F.col(f"{level}_at")), _cell(y, F.col(f"{level}_at")))
    return joined.where(meets & begins).drop(f"{level}_at", f"{level}_a", f"{level}_b", cell)


def overlap_totals(left: DataFrame, right: DataFrame, begin: tuple[str, str], end: tuple[str, str], met: str = "met", shared: str = "shared") -> DataFrame:
    """Right intervals with the number of left ones that overlap them, if any, and the sum of the lengths that they share.

    What ``overlap_join`` gives, counted and summed for each right row without making the pairs: those begun before its end less those ended
    by its begin have met it, and the time that all have been open by its end less that by its begin is shared. Both are running totals
    over ends. Ends are whole numbers (long) of which few are distinct, as days are: a row for each goes through one window, and is
    looked up by each right row. Empty and reversed intervals, and those with a null end, overlap nothing.
    """
    a, b = (F.col(quoted(c)) for c in (begin[0], end[0]))
    x, y = (F.col(quoted(c)) for c in (begin[1], end[1]))

    def ends(df: DataFrame, p: Column, q: Column, times: Column) -> DataFrame:
        """A row for each end, with how many intervals begin and end there."""
        counted = df.where(p < q).groupBy(p.cast("long").alias("p"), q.cast("long").alias("q")).agg(F.count(F.lit(1)).alias("n"))
        none = F.lit(0).cast("long")
        both = F.array(F.struct(F.col("p").alias("at"), times.alias("begun"), none.alias("ended")), F.struct(F.col("q").alias("at"), none.alias("begun"), times.alias("ended")))
        return counted.select(F.explode(both).alias("e")).select("e.*")

    marks = ends(left, a, b, F.col("n")).union(ends(right, x, y, F.col("n") * 0))
    marks = marks.groupBy("at").agg(F.sum("begun").alias("begun"), F.sum("ended").alias("ended"))
    until = W.orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    open_now = F.sum(F.col("begun") - F.col("ended")).over(until)
    since = F.sum(F.col("at") * (F.col("begun") - F.col("ended"))).over(until)
    before = F.sum("begun").over(until) - F.col("begun")
    marks = durable(marks.select("at", before.alias("before"), F.sum("ended").over(until).alias("over"), (F.col("at") * open_now - since).alias("passed")))
    first, last = unused("first", right), unused("last", right)
    low = marks.select(F.col("at").alias(f"{first}_at"), F.struct("over", "passed").alias(first))
    high = marks.select(F.col("at").alias(f"{last}_at"), F.struct("before", "passed").alias(last))
    told = right.where(x < y).join(low, x == F.col(f"{first}_at")).join(high, y == F.col(f"{last}_at"))
    told = told.withColumns({met: F.col(last)["before"] - F.col(first)["over"], shared: F.col(last)["passed"] - F.col(first)["passed"]})
    return told.where(F.col(quoted(met)) > 0).drop(first, last, f"{first}_at", f"{last}_at")
