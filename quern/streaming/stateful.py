"""State of one's own with timers, and streams that keep a keyed table up to date."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import quoted_columns
from ..sources import durable, exists

#: The state store that timers, lists and maps need.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Visits(StatefulProcessor):
    """Runs of a key's rows without a gap of ``gap`` milliseconds or more, told when a later row or the watermark ends them.

    Input rows have the key and ``at`` in milliseconds. State: the open run's begin, end and number of rows, and a list of
    rows that came out of order, kept until the watermark shows that none can come before them. A timer
    stands at the end of the open run; others are deleted, so that a key has one at most. A map counts what was told.
    """

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "begin long, last long, n long")
        self.waiting = handle.getListState("waiting", "at long")
        self.told = handle.getMapState("told", "kind string", "n long")

    def _told(self, key: tuple, runs: list[tuple]) -> Iterator[pd.DataFrame]:
        """The runs that are over, as one frame; their places go on from those told before."""
        if not runs:
            return
        before = self.told.getValue(("runs",))[0] if self.told.containsKey(("runs",)) else 0
        self.told.updateValue(("runs",), (before + len(runs),))
        begin, last, n = zip(*runs, strict=True)
        yield pd.DataFrame({"user_id": [key[0]] * len(runs), "begin": begin, "last": last, "n": n, "place": range(before, before + len(runs))})

    def _timer_at(self, at: int | None) -> None:
        for timer in list(self.handle.listTimers()):
            if timer != at:
                self.handle.deleteTimer(timer)
        if at is not None:
            self.handle.registerTimer(at)

    def _settled(self, key: tuple, upto: int) -> Iterator[pd.DataFrame]:
        """Take waiting rows up to a time, in order, into runs; tell those that are over."""
        waiting = sorted(r[0] for r in self.waiting.get()) if self.waiting.exists() else []
        run, over = tuple(self.run.get()) if self.run.exists() else None, []
        for at in waiting:
            if at > upto:
                break
            if run is not None and at - run[1] >= self.gap:
                over.append(run)
                run = None
            run = (at, at, 1) if run is None else (run[0], at, run[2] + 1)
        rest = [at for at in waiting if at > upto]
        if run is not None and run[1] + self.gap <= upto:
            over.append(run)
            run = None
        if rest:
            self.waiting.put([(at,) for at in rest])
        else:
            self.waiting.clear()
        if run is None:
            self.run.clear()
        else:
            self.run.update(run)
        ends = ([run[1] + self.gap] if run is not None else []) + rest[:1]
        self._timer_at(min(ends) if ends else None)
        yield from self._told(key, over)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for frame in rows:
            self.waiting.appendList([(int(at),) for at in frame["at"]])
        yield from self._settled(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._settled(key, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def visits(stream: DataFrame, gap: dt.timedelta) -> DataFrame:
    """Runs of each user's rows of a stream with an instant ``ts`` and a watermark: ``user_id``, ``begin``, ``last`` (milliseconds), ``n``, ``place``.

    A run is told once, when the watermark has passed its last row by ``gap``, in whatever order its rows came within the watermark.
    ``place`` counts a user's runs from 0. Needs the RocksDB state store.
    """
    keyed = stream.select("user_id", "ts", F.unix_millis("ts").alias("at"))
    shape = "user_id long, begin long, last long, n long, place long"
    return keyed.groupBy("user_id").transformWithStateInPandas(Visits(round(gap.total_seconds() * 1000)), shape, "append", "eventTime")


class KeyedTable:
    """A Parquet table with a row for each key, kept up to date by batches.

    Rows lie in ``parts`` directories by a hash of their keys; a batch rewrites only those that it
    touches. Each row knows the batch that wrote it, and an older batch does not change it, so a batch that
    is repeated after a failure, or comes again late, leaves the table as it was. One batch of a table is written at a time.
    """

    def __init__(self, path: str, keys: list[str], parts: int = 16):
        self.path, self.keys, self.parts = path, keys, parts

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path).drop("of_batch", "of_part")

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        """Put the rows of ``batch`` (one for each of its keys) in the place of those with the same keys."""
        spark = batch.sparkSession
        keys = quoted_columns(self.keys)
        part = F.pmod(F.xxhash64(*keys), F.lit(self.parts)).cast("int")
        fresh = durable(batch.withColumn("of_batch", F.lit(batch_id).cast("long")).withColumn("of_part", part))
        touched = [r[0] for r in fresh.select("of_part").distinct().collect()]  # at most ``parts`` numbers
        if not touched:
            return
        if exists(spark, self.path):
            old = spark.read.schema(fresh.schema).parquet(self.path).where(F.col("of_part").isin(touched))
            both = old.select(*quoted_columns(fresh.columns)).union(fresh)
            latest = F.max_by(F.struct(*quoted_columns(fresh.columns)), F.col("of_batch"))
            fresh = durable(both.groupBy(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).agg(latest.alias("row")).select("row.*"))
        fresh.repartition("of_part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("of_part").parquet(self.path)


def kept(stream: DataFrame, table: KeyedTable, checkpoint: str) -> None:
    """Run a query in update mode over what has arrived, and keep ``table`` up to date with the rows that changed."""
    writer = stream.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", checkpoint)
    writer.foreachBatch(table.upsert).start().awaitTermination()
