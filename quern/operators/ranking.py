"""Ranks and frames of groups of any size.

Groups that a task can hold go through a plain window. Where the largest is larger,
rows are sorted into ranges of bounded size, and what a range needs of the
others comes from one row a group and range (ranks) or from copies of the rows next to it (frames).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import durable
from .ranges import RANGE_ROWS, Order, largest_group, quoted, ranged, sorting, unused
from .windows import top_k

#: What ``ranked`` can give a column: a function's name, or ``("ntile", tiles)``.
Rank = str | tuple[str, int]

_PLAIN = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank, "percent_rank": F.percent_rank, "cume_dist": F.cume_dist}
_BY_TIES = ("rank", "dense_rank", "percent_rank", "cume_dist")


def _name(order: Order) -> str:
    return order if isinstance(order, str) else order[0]


def _way(order: Order) -> str:
    return "asc" if isinstance(order, str) else order[1]


def _keyed(df: DataFrame, keys: list[str], order: list[Order]) -> tuple[DataFrame, list[Order]]:
    """Rows as structs, with their group's key as one and the sort columns under names of their own."""
    columns = [F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("row"), F.struct(*[F.col(quoted(k)).alias(f"k{i}") for i, k in enumerate(keys)]).alias("key")]
    columns += [F.col(quoted(_name(o))).alias(f"o{i}") for i, o in enumerate(order)]
    return df.select(*columns), [(f"o{i}", _way(o)) for i, o in enumerate(order)]


def ranked(df: DataFrame, keys: list[str], by: list[Order], columns: dict[str, Rank], then: list[Order] = (), rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with rank functions of its groups as ``columns``.

    ``by`` sorts a group and decides on ties; ``then`` breaks them for ``row_number`` and ``ntile``. Names are
    those of the functions: row_number, rank, dense_rank, ``("ntile", tiles)`` (all long), percent_rank, cume_dist.

    A group of more than ``rows`` rows lies in several ranges. A row's place is its place in the range and the number
    of its group's rows in the ranges before; rows that are equal by ``by`` may lie in
    several ranges, whose first and last such runs are put together from one row a group and range. No task
    holds more than a range. Null keys form a group; nulls sort first if ascending, last if descending.
    """
    then = list(then)
    most, total = largest_group(df, keys)
    if most <= rows:
        own = W.partitionBy(*[F.col(quoted(k)) for k in keys])
        ties, whole = own.orderBy(*sorting(by)), own.orderBy(*sorting([*by, *then]))
        kinds = {c: (F.ntile(k[1]) if isinstance(k, tuple) else _PLAIN[k]()).over(ties if k in _BY_TIES else whole) for c, k in columns.items()}
        return df.select("*", *[(kind if columns[c] in ("percent_rank", "cume_dist") else kind.cast("long")).alias(c) for c, kind in kinds.items()])
    told, order = _keyed(df, keys, [*by, *then])
    told = ranged(told, ["key", *order], rows, total)
    own = W.partitionBy("range", "key")
    ties, whole = own.orderBy(*sorting(order[: len(by)])), own.orderBy(*sorting(order))
    tie = F.struct(*[F.col(f"o{i}") for i in range(len(by))]).alias("tie")
    local = durable(
        told.select("range", "key", "row", tie, F.row_number().over(whole).alias("no"), F.rank().over(ties).alias("rank"), F.dense_rank().over(ties).alias("dense"), F.count(F.lit(1)).over(ties).alias("end"))
    )
    joined = local.join(_summed(local), ["range", "key"])
    at_first, at_last = F.col("rank") == 1, F.col("rank") == F.col("last_rank")
    start = F.when(at_first, F.col("first_start")).when(at_last, F.col("last_start")).otherwise(F.col("before") + F.col("rank") - 1)
    end = F.when(at_last, F.col("last_end")).when(at_first, F.col("first_end")).otherwise(F.col("before") + F.col("end"))
    no, n = F.col("before") + F.col("no"), F.col("total")
    found = {
        "row_number": no,
        "rank": start + 1,
        "dense_rank": F.col("dense_before") + F.col("dense"),
        "percent_rank": F.when(n > 1, start / (n - 1)).otherwise(0.0),
        "cume_dist": end / n,
    }

    def tile(tiles: int) -> Column:
        each, more = F.floor(n / tiles), n % tiles  # the first ``more`` tiles have a row more
        large = more * (each + 1)
        return F.when(no <= large, F.floor((no - 1) / (each + 1))).otherwise(more + F.floor((no - 1 - large) / F.greatest(each, F.lit(1)))).cast("long") + 1

    return joined.select("row.*", *[(tile(k[1]) if isinstance(k, tuple) else found[k]).alias(c) for c, k in columns.items()])


def _summed(local: DataFrame) -> DataFrame:
    """What a group's rows in a range need to know of the group's other ranges: a row a group and range.

    ``before`` rows and ``dense_before`` distinct ones; where the first and the last run of equal rows begin
    and end, as places in the group from 0.
    """
    ends = local.groupBy("range", "key").agg(
        F.count(F.lit(1)).alias("n"), F.max("dense").alias("runs"), F.max("rank").alias("last_rank"), F.min_by("tie", "no").alias("first"), F.max_by("tie", "no").alias("last"), F.max(F.when(F.col("rank") == 1, F.col("end"))).alias("first_n")
    )
    own = W.partitionBy("key").orderBy("range")
    earlier, until, since = own.rowsBetween(W.unboundedPreceding, -1), own.rowsBetween(W.unboundedPreceding, 0), own.rowsBetween(0, W.unboundedFollowing)
    ends = ends.select(
        "*", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(W.partitionBy("key")).alias("total"), F.coalesce(F.sum("runs").over(earlier), F.lit(0)).alias("runs_before"),
        # Structs are equal if their fields are, nulls too; the first range of a group goes on with nothing.
        F.coalesce(F.col("first") == F.lag("last").over(own), F.lit(False)).alias("goes_on"), F.coalesce(F.col("last") == F.lead("first").over(own), F.lit(False)).alias("goes_further"),
    )
    several = F.col("runs") > 1
    ends = ends.withColumn("last_start", F.last(F.when(several | ~F.col("goes_on"), F.col("before") + F.col("last_rank") - 1), ignorenulls=True).over(until))
    ends = ends.withColumn("first_end", F.first(F.when(several | ~F.col("goes_further"), F.col("before") + F.col("first_n")), ignorenulls=True).over(since))
    return durable(
        ends.select(
            "range", "key", "before", "total", "last_rank", "last_start", "first_end",
            (F.col("runs_before") - F.sum(F.col("goes_on").cast("long")).over(until)).alias("dense_before"),
            F.when(F.col("goes_on"), F.lag("last_start").over(own)).otherwise(F.col("before")).alias("first_start"),
            F.when(F.col("goes_further"), F.lead("first_end").over(own)).otherwise(F.col("before") + F.col("n")).alias("last_end"),
        )
    )


def framed(df: DataFrame, keys: list[str], order: list[Order], columns: dict[str, Callable[[WindowSpec], Column]], reach: tuple[int, int], by_value: bool = False, rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with window functions of bounded frames as ``columns``.

    ``columns`` has a function for each: it gets a window of the group in ``order`` and puts its own frame or
    offset on it, within ``reach``: rows before (below zero) and after, or with ``by_value`` a distance of the
    one numeric, ascending ``order`` column.

    A group of more than ``rows`` rows lies in several ranges. A range gets copies of the rows of other ranges
    within reach of its own; a window then sees a range and its copies. So a task holds a range and what a frame
    holds. Without ``by_value``, ``order`` should be total: the order of equal rows is chosen once. Rows whose value
    is null see the null ones.
    """
    most, total = largest_group(df, keys)
    if most <= rows:
        own = W.partitionBy(*[F.col(quoted(k)) for k in keys]).orderBy(*sorting(order))
        return df.select("*", *[make(own).alias(c) for c, make in columns.items()])
    told, by = _keyed(df, keys, order)
    told = ranged(told, ["key", *by], rows, total)
    if by_value:
        told = told.select("range", "key", "row", F.col("o0").alias("at"))
        ends = told.groupBy("range", "key").agg(F.min("at").alias("low"), F.max("at").alias("high"), F.count_if(F.col("at").isNull()).alias("nulls"))
    else:
        told = durable(told.select("range", "key", "row", F.row_number().over(W.partitionBy("range", "key").orderBy(*sorting(by))).cast("long").alias("no")))
        ends = told.groupBy("range", "key").agg(F.count(F.lit(1)).alias("n"))
        before = F.coalesce(F.sum("n").over(W.partitionBy("key").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        ends = ends.select("range", "key", F.lit(0).cast("long").alias("nulls"), before.alias("before"), (before + 1).alias("low"), (before + F.col("n")).alias("high"))
    ends = durable(ends)
    if not by_value:
        placed = told.join(ends.select("range", "key", "before"), ["range", "key"])
        told = durable(placed.select("range", "key", "row", (F.col("before") + F.col("no")).alias("at")))
    halo = _copied(told, ends, reach)
    both = told.select("range", "key", "row", "at", F.lit(True).alias("own")).union(halo)
    names = [unused(c, df) for c in ("range", "key", "at", "own")]
    both = both.select("row.*", *[F.col(c).alias(n) for c, n in zip(("range", "key", "at", "own"), names, strict=True)])
    window = W.partitionBy(names[0], names[1]).orderBy(names[2])
    return both.select("*", *[make(window).alias(c) for c, make in columns.items()]).where(F.col(names[3])).drop(*names)


def _copied(told: DataFrame, ends: DataFrame, reach: tuple[int, int]) -> DataFrame:
    """Rows that other ranges of their group need: a row for each such range.

    Ranges of a group are in order, so those that need rows of a range are the next ones to either side. How many these
    are at most is found one by one; it is one, unless a frame is longer than a range.
    """
    own = W.partitionBy("key").orderBy("range")
    needs = []
    for side, (move, edge, other) in enumerate(((F.lead, "low", "high"), (F.lag, "high", "low"))):
        step = 0
        while True:
            step += 1
            bound = move(edge, step).over(own) + F.lit(reach[side])
            met = F.col(other) >= bound if side == 0 else F.col(other) <= bound
            # Null values lie in the first ranges of a group; those of several ranges see one another.
            blank = (F.col("nulls") > 0) & (move("nulls", step).over(own) > 0)
            need = F.when(F.coalesce(met, F.lit(False)) | F.coalesce(blank, F.lit(False)), F.struct(move("range", step).over(own).alias("range"), bound.alias("bound"), blank.alias("blank")))
            if ends.select(need.alias("need")).where("need is not null").isEmpty():
                break
            needs.append((side, need))
    if not needs:
        return told.select("range", "key", "row", "at", F.lit(False).alias("own")).limit(0)
    tables = [ends.select("range", "key", F.lit(side).alias("side"), need.alias("need")).where("need is not null") for side, need in needs]
    wanted = tables[0]
    for t in tables[1:]:
        wanted = wanted.union(t)
    wanted = durable(wanted.groupBy("range", "key").agg(F.collect_list(F.struct("side", "need")).alias("needs")))
    at = F.col("at")
    inside = F.filter("needs", lambda x: F.coalesce(F.when(x["side"] == 0, at >= x["need"]["bound"]).otherwise(at <= x["need"]["bound"]), at.isNull() & x["need"]["blank"], F.lit(False)))
    sent = told.join(wanted, ["range", "key"]).select("key", "row", "at", F.explode(inside).alias("need"))
    return sent.select(F.col("need.need.range").alias("range"), "key", "row", "at", F.lit(False).alias("own"))


def placed(df: DataFrame, keys: list[str], order: list[Order], columns: dict[str, tuple[str, int]], rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with the value that a column has at a place of the group in ``order``: from 1 at the beginning, from -1 at the end.

    ``order`` should be total. Of large groups each task keeps the first rows only before the shuffle; one row a
    group is joined back, and adaptive execution may split a group there. A place that a group does not have is null.
    """
    if largest_group(df, keys)[0] <= rows:
        own = W.partitionBy(*[F.col(quoted(k)) for k in keys])
        whole = (W.unboundedPreceding, W.unboundedFollowing)
        ahead, back = own.orderBy(*sorting(order)).rowsBetween(*whole), own.orderBy(*sorting(_turned(order))).rowsBetween(*whole)
        return df.select("*", *[F.nth_value(quoted(c), abs(n)).over(ahead if n > 0 else back).alias(name) for name, (c, n) in columns.items()])
    mark = unused("place", df)
    sides = []
    for ways, sign in ((order, 1), (_turned(order), -1)):
        if k := max((sign * n for _, n in columns.values()), default=0):
            if k > 0:
                sides.append(top_k(df, keys, sorting(ways), k).withColumnRenamed("rank", mark).withColumn(mark, F.col(mark) * sign))
    firsts = sides[0] if len(sides) == 1 else sides[0].union(sides[1])
    names = [unused(f"of{i}", df) for i in range(len(keys))]
    at = durable(firsts.groupBy(*[F.col(quoted(k)).alias(n) for k, n in zip(keys, names, strict=True)]).agg(*[F.max(F.when(F.col(mark) == n, F.col(quoted(c)))).alias(name) for name, (c, n) in columns.items()]))
    same = [df[quoted(k)].eqNullSafe(at[n]) for k, n in zip(keys, names, strict=True)]
    return df.join(at, same).drop(*names)


def _turned(order: list[Order]) -> list[Order]:
    """The opposite order."""
    return [(_name(o), {"asc": "desc", "desc": "asc"}[_way(o)]) for o in order]
