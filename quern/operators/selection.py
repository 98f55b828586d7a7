"""Exact quantiles and modes of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import durable
from .ranges import largest_group, quoted

#: Distinct values of a group that a task may hold.
MOST_HELD = 1 << 20
#: Accuracy of a sketch (its ranks are off by at most a share of 1 / ACCURACY), and parts that a later one cuts a bracket into.
ACCURACY, PARTS = 10_000, 1_000
#: Groups whose brackets are broadcast at most; beyond, rows and brackets are joined by key.
MOST_SENT = 1 << 16

#: ``("disc", p)``: the least value with at least a share p of the group at or below it; ``("cont", p)``: interpolated.
Quantile = tuple[str, float]


def _places(columns: dict[str, Quantile]) -> list[tuple[float, Column]]:
    """The ranks that the quantiles need: a share near which each lies, and its place from 1 by the group's ``n``."""
    out = []
    for kind, p in columns.values():
        if kind == "disc":
            out.append((p, F.greatest(F.ceil(F.lit(p) * F.col("n")), F.lit(1))))
        else:
            at = F.lit(p) * (F.col("n") - 1)
            out += [(p, F.floor(at) + 1), (p, F.ceil(at) + 1)]
    return out


def quantiles(df: DataFrame, keys: list[str], value: str, columns: dict[str, Quantile], also: list[Column] = (), most: int = MOST_HELD) -> DataFrame:
    """Exact quantiles of ``value`` by ``keys`` as ``columns``, with further aggregates ``also``; one row a group.

    Groups of at most ``most`` rows go through Spark's own exact functions, which hold a group's values in one task. For larger
    ones, ranks are selected: a sketch gives each rank a bracket of values, which holds a small share of
    the group for certain; rows below and within it are counted; while it holds more than ``most`` rows, it is
    narrowed again; in the end the bracket's own values are counted and their counts summed up in order.
    All ranks go through the same scans, of which there are four for up to ``ACCURACY * most / 4`` rows a group and two for
    every further factor of ``PARTS / 2``. Only counts, sketches and the bracket's distinct values are shuffled.

    ``value`` is a number, date or timestamp (``cont``: a number) and should come from a repeatable plan, as it is read several
    times. Nulls in ``value`` are left out; a group of nulls has null quantiles. Null keys form a group. NaN is the largest number.
    """
    by = [F.col(quoted(k)) for k in keys]
    if largest_group(df, keys)[0] <= most:
        exact = [F.expr(f"percentile_{kind}({p!r}D) WITHIN GROUP (ORDER BY {quoted(value)})").alias(c) for c, (kind, p) in columns.items()]
        return df.groupBy(*by).agg(*exact, *also)
    rows = df.select(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(by)]).alias("key"), F.col(quoted(value)).alias("v")).where("v is not null")
    places = _places(columns)
    j = range(len(places))
    margin = 2 / ACCURACY
    first = rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), *[F.percentile_approx("v", [max(0.0, p - margin), min(1.0, p + margin)], ACCURACY).alias(f"s{i}") for i, (p, _) in enumerate(places)]
    )
    small = F.col("n") <= most
    state = durable(
        first.select(
            "key", "n", *[k.cast("long").alias(f"k{i}") for i, (_, k) in enumerate(places)],
            *[F.when(small, F.col("least")).otherwise(F.col(f"s{i}")[0]).alias(f"lo{i}") for i in j], *[F.when(small, F.col("most")).otherwise(F.col(f"s{i}")[1]).alias(f"hi{i}") for i in j],
            *[F.col("least").alias(f"min{i}") for i in j], *[F.col("most").alias(f"max{i}") for i in j],
        )
    )
    groups = state.count()
    while True:
        state = _counted(rows, state, j, groups)
        wide = F.lit(False)
        for i in j:
            wide |= _wide(i, most)
        if state.where(wide).isEmpty():
            break
        state = _narrowed(rows, state, j, groups, most)
    found = _picked(rows, state, j, groups)
    cells, i = [], 0
    for c, (kind, p) in columns.items():
        if kind == "disc":
            cells.append(F.col(f"__v{i}").alias(c))
        else:
            low, high, at = F.col(f"__v{i}").cast("double"), F.col(f"__v{i + 1}").cast("double"), F.lit(p) * (F.col("__n") - 1)
            cells.append((low + (high - low) * (at - F.floor(at))).alias(c))
        i += 1 if kind == "disc" else 2
    whole = df.groupBy(F.struct(*[k.alias(f"k{n}") for n, k in enumerate(by)]).alias("__key")).agg(F.count(F.lit(1)).alias("__rows"), *also)
    own = [F.col(f"__key.k{n}").alias(k) for n, k in enumerate(keys)]
    return whole.join(found, "__key", "left").select(*own, *cells, *[F.col(quoted(c)) for c in whole.columns[2:]])


def _with_state(rows: DataFrame, state: DataFrame, groups: int) -> DataFrame:
    return rows.join(F.broadcast(state) if groups <= MOST_SENT else state, "key")


def _inside(i: int) -> Column:
    return (F.col("v") >= F.col(f"lo{i}")) & (F.col("v") <= F.col(f"hi{i}"))


def _wide(i: int, most: int) -> Column:
    """The bracket is not the last: it misses the rank, or holds too many rows that are not all equal."""
    missed = (F.col(f"k{i}") <= F.col(f"below{i}")) | (F.col(f"k{i}") > F.col(f"below{i}") + F.col(f"held{i}"))
    return missed | ((F.col(f"held{i}") > most) & (F.col(f"lo{i}") < F.col(f"hi{i}")))


def _counted(rows: DataFrame, state: DataFrame, j: range, groups: int) -> DataFrame:
    """The brackets with the rows below and within each, and the nearest values on both sides of it."""
    sums = []
    for i in j:
        sums += [F.count_if(F.col("v") < F.col(f"lo{i}")).alias(f"below{i}"), F.count_if(_inside(i)).alias(f"held{i}")]
        sums += [F.max(F.when(F.col("v") < F.col(f"lo{i}"), F.col("v"))).alias(f"under{i}"), F.min(F.when(F.col("v") > F.col(f"hi{i}"), F.col("v"))).alias(f"over{i}")]
    counts = _with_state(rows, state, groups).groupBy("key").agg(*sums)
    kept = [c for c in state.columns if not c.startswith(("below", "held", "under", "over"))]
    return durable(state.select(*kept).join(counts, "key"))


def _narrowed(rows: DataFrame, state: DataFrame, j: range, groups: int, most: int) -> DataFrame:
    """Brackets for the next count. One that misses its rank moves to the side where it lies, between known values."""
    moved = state
    for i in j:
        left, right = F.col(f"k{i}") <= F.col(f"below{i}"), F.col(f"k{i}") > F.col(f"below{i}") + F.col(f"held{i}")
        low = F.when(left, F.col(f"min{i}")).when(right, F.col(f"over{i}")).otherwise(F.col(f"lo{i}"))
        high = F.when(left, F.col(f"under{i}")).when(right, F.col(f"max{i}")).otherwise(F.col(f"hi{i}"))
        held = F.when(left, F.lit(0)).when(right, F.lit(0)).otherwise(F.col(f"held{i}"))
        moved = moved.withColumns({f"lo{i}": low, f"hi{i}": high, f"min{i}": low, f"max{i}": high, f"held{i}": held})
    grid = [x / PARTS for x in range(PARTS + 1)]
    narrow = [(F.col(f"held{i}") > most) & (F.col(f"lo{i}") < F.col(f"hi{i}")) for i in j]
    cuts = _with_state(rows, moved, groups).groupBy("key").agg(*[F.percentile_approx(F.when(narrow[i] & _inside(i), F.col("v")), grid, ACCURACY).alias(f"s{i}") for i in j])
    moved = moved.join(cuts, "key")
    for i in j:
        # Two parts to either side of the rank's share of the bracket.
        part = F.floor((F.col(f"k{i}") - F.col(f"below{i}")) / F.nullif(F.col(f"held{i}"), F.lit(0)) * PARTS).cast("int")
        low, high, half = F.get(f"s{i}", F.greatest(part - 2, F.lit(0))), F.get(f"s{i}", F.least(part + 3, F.lit(PARTS))), F.get(f"s{i}", F.lit(PARTS // 2))
        # A bracket that is as wide as before becomes its lower half, or its least value alone; the next count tells the side.
        same = (low <= F.col(f"lo{i}")) & (high >= F.col(f"hi{i}"))
        high = F.when(~same, high).when(half < F.col(f"hi{i}"), half).otherwise(F.col(f"lo{i}"))
        moved = moved.withColumns({c: F.when(narrow[i] & F.col(f"s{i}").isNotNull(), e).otherwise(F.col(c)) for c, e in {f"lo{i}": low, f"hi{i}": high}.items()})
    return durable(moved.drop(*[f"s{i}" for i in j]))


def _picked(rows: DataFrame, state: DataFrame, j: range, groups: int) -> DataFrame:
    """The values at the ranks: brackets of one value give it, for others their distinct values are summed up in order."""
    open_in = F.filter(F.array(*[F.when(_inside(i) & (F.col(f"lo{i}") < F.col(f"hi{i}")), F.lit(i)) for i in j]), lambda x: x.isNotNull())
    met = _with_state(rows, state, groups).select("key", "v", open_in.alias("in")).where(F.size("in") > 0)
    counts = met.select("key", "v", F.explode("in").alias("i")).groupBy("key", "i", "v").agg(F.count(F.lit(1)).alias("c"))
    until = W.partitionBy("key", "i").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    summed = counts.withColumn("upto", F.sum("c").over(until)).join(state.select("key", F.array(*[F.col(f"k{i}") - F.col(f"below{i}") for i in j]).alias("rest")), "key")
    right = summed.where((F.col("upto") >= F.col("rest")[F.col("i")]) & (F.col("upto") - F.col("c") < F.col("rest")[F.col("i")]))
    values = right.groupBy("key").agg(*[F.max(F.when(F.col("i") == i, F.col("v"))).alias(f"p{i}") for i in j])
    joined = state.join(values, "key", "left")
    return joined.select(F.col("key").alias("__key"), F.col("n").alias("__n"), *[F.when(F.col(f"lo{i}") == F.col(f"hi{i}"), F.col(f"lo{i}")).otherwise(F.col(f"p{i}")).alias(f"__v{i}") for i in j])


def modes(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The most frequent ``value`` of each group as ``name``, of equally frequent ones the least.

    Values are counted by group and value, so a large group is spread by its values, and the
    largest count is combined before the shuffle. Nulls are left out; a group of nulls has none.
    """
    by = [F.col(quoted(k)) for k in keys]
    counts = df.groupBy(*by, F.col(quoted(value)).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    # Of equal counts the least value: the least pair of (count below zero, value).
    best = F.min(F.when(F.col("v").isNotNull(), F.struct((-F.col("c")).alias("c"), F.col("v").alias("v"))))
    return counts.groupBy(*by).agg(best["v"].alias(name))
