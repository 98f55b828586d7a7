"""Stream queries over tables in either form, in other time zones, with own state, and keyed tables kept by batches."""

from __future__ import annotations

import datetime as dt
import os
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quern import plans, streaming
from quern.functions import instant, micros, wall_clock
from quern.plans import timed
from quern.streaming import stateful
from tests.oracle import same

SMALL = "/root/testdata/sf0.001"
STREAMS = sorted(n for n in timed.QUERIES if n.startswith("stream_"))


@pytest.fixture(scope="module")
def directory(spark, tmp_path_factory):
    """The small tables, with the events as a directory of three files."""
    place = tmp_path_factory.mktemp("tables")
    for path in Path(SMALL).glob("*.parquet"):
        if path.stem != "events":
            shutil.copyfile(path, place / path.name)
    spark.read.parquet(f"{SMALL}/events.parquet").repartitionByRange(3, "ts").write.parquet(f"{place}/events.parquet")
    return str(place)


@pytest.mark.parametrize("name", STREAMS)
def test_a_table_that_is_a_directory(spark, directory, name):
    found = plans.QUERIES[name](spark, directory)
    assert found.count() > 0
    same(found, SMALL, plans.SQL[name])


@pytest.mark.parametrize("name", STREAMS)
def test_files_in_another_order_than_their_rows(spark, directory, tmp_path, name):
    """The file with the last events is the oldest; no event of the others is late by that."""
    place = shutil.copytree(directory, tmp_path / "tables")
    for age, path in enumerate(sorted((place / "events.parquet").glob("part-*"), reverse=True)):
        os.utime(path, (1_700_000_000 + 60 * age,) * 2)
    same(plans.QUERIES[name](spark, str(place)), SMALL, plans.SQL[name])


@pytest.mark.parametrize("name", [*STREAMS, "tumbling", "sliding", "moving_sums", "user_sessions", "as_of_purchase"])
def test_another_time_zone(spark, name):
    """Wall clocks are what they are, also where clocks are changed."""
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        same(plans.QUERIES[name](spark, SMALL), SMALL, plans.SQL[name])
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kathmandu"])
def test_clocks(spark, zone):
    """In the hour that New York leaves out and in the one that it has twice, before 1970 and to the microsecond."""
    at = [dt.datetime(2024, 3, 10, 2, 30), dt.datetime(2024, 11, 3, 1, 30, 0, 1), dt.datetime(1969, 12, 31, 23, 59, 59, 999_999), dt.datetime(1901, 1, 1, 5), dt.datetime(2400, 2, 29, 0, 0, 1), None]
    epoch = dt.datetime(1970, 1, 1)
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(i, a) for i, a in enumerate(at)], "i int, a timestamp_ntz")
        told = df.select("i", "a", micros("a", "timestamp_ntz").alias("us"), instant("a", "timestamp_ntz").alias("t")).withColumn("back", wall_clock("t"))
        for r in told.select("i", "us", "back").collect():
            assert r.us == (None if at[r.i] is None else (at[r.i] - epoch) // dt.timedelta(microseconds=1)) and r.back == at[r.i]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


EVENTS = "user_id long, ts timestamp_ntz"


def arrive(spark, place, parts, build, mode="append"):
    """Each part arrives and is worked on before the next; what has been told after each."""
    told = []
    for part in parts:
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(f"{place}/in")
        stream = streaming.timed(streaming.arriving(spark, f"{place}/in", spark.createDataFrame([], EVENTS).schema), delay="1 hour")
        told.append(sorted(tuple(r) for r in streaming.drained(build(stream), mode, f"{place}/state", f"{place}/out").collect()))
    return told


def clock(day: int, hour: int, minute: int = 0) -> dt.datetime:
    return dt.datetime(2024, 1, day, hour, minute)


def test_visits_are_told_by_timers_and_state_outlives_a_run(spark, tmp_path):
    """A visit goes on in the next run; rows out of order within the watermark join two runs; a quiet user is told by a timer alone."""
    parts = [
        [(1, clock(1, 8)), (1, clock(1, 9)), (2, clock(1, 8))],
        [(1, clock(1, 10)), (3, clock(1, 10, 50))],  # the watermark is 9:50: user 2's visit ended at 9:30
        [(1, clock(1, 12, 30)), (1, clock(1, 11, 15))],  # out of order, not late
        [(9, clock(2, 0))],
    ]
    with streaming.store(spark, stateful.ROCKS):
        told = arrive(spark, tmp_path, parts, lambda s: stateful.visits(s, dt.timedelta(minutes=90)))
    ms = lambda t: (t - dt.datetime(1970, 1, 1)) // dt.timedelta(milliseconds=1)
    assert told[0] == []
    assert told[1] == [(2, ms(clock(1, 8)), ms(clock(1, 8)), 1, 0)]
    assert told[2] == told[1]
    assert told[3] == sorted([*told[1], (1, ms(clock(1, 8)), ms(clock(1, 12, 30)), 5, 0), (3, ms(clock(1, 10, 50)), ms(clock(1, 10, 50)), 1, 0)])


def test_the_outer_join_waits_for_the_watermark(spark, tmp_path):
    def build(stream):
        left = stream.where("user_id > 0").select("user_id", F.col("ts").alias("at"))
        right = stream.where("user_id < 0").select((-F.col("user_id")).alias("other"), "ts")
        near = (F.col("user_id") == F.col("other")) & F.col("ts").between(F.col("at"), F.col("at") + F.expr("INTERVAL 2 HOURS"))
        return left.join(right, near, "left_outer").select("user_id", F.col("other"))

    told = arrive(spark, tmp_path, [[(1, clock(1, 8)), (2, clock(1, 8))], [(-1, clock(1, 9))], [(5, clock(1, 20))]], build)
    key = lambda rows: sorted(rows, key=str)
    assert told[0] == [] and told[1] == [(1, 1)] and key(told[2]) == key([(1, 1), (2, None)])


def rows_of(table, spark) -> list[tuple]:
    return sorted(tuple(r) for r in table.rows(spark).collect())


def test_batches_of_a_keyed_table_may_be_repeated(spark, tmp_path):
    table = stateful.KeyedTable(str(tmp_path / "t"), ["k"], parts=4)
    batch = lambda rows: spark.createDataFrame(rows, "k long, v string")
    table.upsert(batch([(i, "a") for i in range(20)]), 0)
    table.upsert(batch([(3, "b"), (None, "n"), (77, "c")]), 1)
    wanted = sorted([*[(i, "b" if i == 3 else "a") for i in range(20)], (77, "c")])
    state = lambda: (sorted(r for r in rows_of_with_null(table) if r[0] is not None), [r for r in rows_of_with_null(table) if r[0] is None])
    rows_of_with_null = lambda t: [tuple(r) for r in t.rows(spark).collect()]
    assert state() == (wanted, [(None, "n")])
    for again, n in (([(3, "b"), (None, "n"), (77, "c")], 1), ([(i, "a") for i in range(20)], 0), ([], 2)):
        table.upsert(batch(again), n)
        assert state() == (wanted, [(None, "n")])


def test_only_touched_parts_are_rewritten(spark, tmp_path):
    table = stateful.KeyedTable(str(tmp_path / "t"), ["k"], parts=8)
    table.upsert(spark.range(200).select(F.col("id").alias("k"), F.lit(1).alias("v")), 0)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("part-*.parquet")}
    table.upsert(spark.createDataFrame([(5, 2)], "k long, v int"), 1)
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("part-*.parquet")}
    assert len({p.parent for p in before}) == 8 and len({p.parent for p in set(after) - set(before)}) == 1
    assert sum(before.get(p) == t for p, t in after.items()) == 7
    assert rows_of(table, spark) == sorted((i, 2 if i == 5 else 1) for i in range(200))


def test_a_stream_keeps_the_table_over_a_restart(spark, tmp_path):
    table = stateful.KeyedTable(str(tmp_path / "t"), ["window_start", "user_id"])
    days = [(1, clock(1, 8)), (1, clock(1, 9)), (2, clock(2, 8))]
    for part in (days[:2], days[2:], [(1, clock(1, 10))]):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = streaming.timed(streaming.arriving(spark, f"{tmp_path}/in", spark.createDataFrame([], EVENTS).schema), delay="9 days")
        stateful.kept(streaming.window_counts(stream, "1 day", None, "user_id"), table, f"{tmp_path}/state")
    assert sorted((r.user_id, r.n) for r in table.rows(spark).collect()) == [(1, 3), (2, 1)]
