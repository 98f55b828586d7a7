"""What can be reached over links, round by round."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import durable

#: Cuts after which what was found so far is written together, and hops that are made between two cuts once the first ones are done.
_TOGETHER, _AT_ONCE = 8, 4


def reachable(starts: DataFrame, links: DataFrame, start: str, begin: str, end: str, most_hops: int | None = None) -> DataFrame:
    """``start``, ``node`` and ``hops``: all nodes that each value of ``starts[start]`` reaches by ``links`` (begin -> end), itself with 0 hops.

    Semi-naive: a round follows the links from the pairs that the last round found farthest off, and leaves out what is known, so
    cycles end by themselves and ``hops`` is the least number. A round makes one hop, then two, then ``_AT_ONCE``, in one job that
    deals the links once, and what it finds is cut to disk: long thin ways have many hops, each with next to no rows. Within a
    round, known pairs may be met again. There are some quarter as many rounds as the longest of the shortest ways has hops, at most ``most_hops``. Repeated
    starts and links count once, nulls not at all. Nothing but whether a round found anything reaches the driver.
    """
    links = durable(links.select(F.col(begin).alias("at"), F.col(end).alias("next")).where("at is not null and next is not null").distinct())
    first = starts.select(F.col(start).alias("start"), F.col(start).alias("node")).where("start is not null").distinct().withColumn("hops", F.lit(0).cast("long"))
    found = [durable(first)]
    frontier, hops, step = found[0], 0, 1
    while most_hops is None or hops < most_hops:
        step = step if most_hops is None else min(step, most_hops - hops)
        met, layers = frontier, []
        for n in range(hops + 1, hops + step + 1):
            met = met.join(links, met["node"] == links["at"]).select("start", F.col("next").alias("node")).distinct()
            layers.append(met.withColumn("hops", F.lit(n).cast("long")))
        near = layers[0] if step == 1 else reduce(DataFrame.union, layers).groupBy("start", "node").agg(F.min("hops").alias("hops"))
        known = reduce(DataFrame.union, found).select("start", "node")
        fresh = durable(near.join(known, ["start", "node"], "left_anti"))
        hops, step = hops + step, min(2 * step, _AT_ONCE)
        frontier = fresh.where(F.col("hops") == hops)
        found.append(fresh)
        if frontier.isEmpty():
            break
        if len(found) > _TOGETHER:
            found = [durable(reduce(DataFrame.union, found))]
    return reduce(DataFrame.union, found).withColumnRenamed("start", start)
