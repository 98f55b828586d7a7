"""Window functions, as-of joins, sessions, and streams."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import streaming
from ..functions import micros, money, wall_clock
from ..operators import as_of_join, framed, gap_sessions, placed, ranked
from ..sources import durable, load, scratch
from ..streaming import stateful


def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers ranked within their nations by balance and by segment; segments are large ties."""
    customers = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    by_balance = ranked(customers, ["c_nationkey"], [("c_acctbal", "desc"), "c_custkey"], {"row_no": "row_number", "quartile": ("ntile", 4)})
    both = ranked(by_balance, ["c_nationkey"], ["c_mktsegment"], {"rank_no": "rank", "dense_no": "dense_rank", "share": "percent_rank", "cumulated": "cume_dist"})
    return both.select("c_custkey", *[F.col(c).cast("int").alias(c) for c in ("row_no", "rank_no", "dense_no", "quartile")], "share", "cumulated")


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events next to each one of its user, and the first, last and third one of the user."""
    events, order = load(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type"), ["ts", "event_id"]
    near = {"before": lambda w: F.lag("event_type").over(w), "after_next": lambda w: F.lead("event_type", 2).over(w)}
    ends = {"first_event": ("event_id", 1), "last_event": ("event_id", -1), "third_event": ("event_id", 3)}
    both = placed(framed(events, ["user_id"], order, near, (-1, 2)), ["user_id"], order, ends)
    return both.select("event_id", *near, *ends)


def moving_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame of rows and a frame of seconds over each user's events."""
    events = load(spark, sf_dir, "events")
    events = events.select("event_id", "user_id", "ts", "value", F.floor(micros("ts", dict(events.dtypes)["ts"]) / 1_000_000).alias("second"))
    last_four = {"last_four": lambda w: F.sum(money("value", 6)).over(w.rowsBetween(-3, 0)).cast("double")}
    last_day = {"last_day": lambda w: F.count(F.lit(1)).over(w.rangeBetween(-86400, 0))}
    both = framed(framed(events, ["user_id"], ["ts", "event_id"], last_four, (-3, 0)), ["user_id"], ["second"], last_day, (-86400, 0), by_value=True)
    return both.select("event_id", "last_four", "last_day")


def as_of_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each click with its user's last purchase at or before it."""
    events = load(spark, sf_dir, "events")
    clicks = events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    bought = events.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("purchase_id"))
    return as_of_join(clicks, bought, "user_id", "ts", ["purchase_id"])


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = gap_sessions(load(spark, sf_dir, "events"), "user_id", "ts", 3600)
    return runs.groupBy("user_id", "session").agg(F.min("ts").alias("begin"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("n"))


def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = load(spark, sf_dir, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), "event_type", "n")


def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = load(spark, sf_dir, "events").groupBy(F.window("ts", "2 days", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))
    return counted.select(F.col("w.start").alias("window_start"), "n", "users")


Build = Callable[[DataFrame], DataFrame]


def _streamed(spark: SparkSession, sf_dir: str, build: Build, mode: str = "append") -> DataFrame:
    """Run a streaming query over the events table and give what it wrote; its state is deleted.

    The table may be a file or a directory of files: the pattern matches its name alone, and a stream takes either from it.
    A table's files are in no order of time, so all of them arrive at once: one by one, a late one's rows would be dropped.
    """
    with scratch(spark) as place:
        stream = streaming.arriving(spark, f"{sf_dir}/events.parque[t]", load(spark, sf_dir, "events").schema, files_a_trigger=1 << 30)
        stream = streaming.timed(stream)
        return durable(streaming.drained(build(stream), mode, f"{place}/state", f"{place}/out"))


def _wall_clock(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: wall_clock(c) for c in columns})


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts in complete mode: all windows, those still open too."""
    return _wall_clock(_streamed(spark, sf_dir, lambda s: streaming.window_counts(s, "1 day", None, "event_type"), "complete"), "window_start")


def stream_tumbling_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts, each written once when the watermark has passed the window's end."""
    return _wall_clock(_streamed(spark, sf_dir, lambda s: streaming.window_counts(s, "1 day", None, "event_type")), "window_start")


def stream_sliding_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wall_clock(_streamed(spark, sf_dir, lambda s: streaming.window_counts(s, "2 days", "1 day")), "window_start")


def stream_sessions_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user that the watermark has closed."""
    return _wall_clock(_streamed(spark, sf_dir, lambda s: streaming.session_counts(s, "1 hour", "user_id")), "session_start", "session_end")


def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose id has not been seen within the watermark: all of them, as ids are unique."""
    return _streamed(spark, sf_dir, lambda s: streaming.first_seen(s, "event_id").select("event_id", "user_id"))


def _in_two_runs(spark: SparkSession, sf_dir: str, halves: tuple[DataFrame, DataFrame], build: Build) -> DataFrame:
    """The same streaming query over two loads that arrive one after the other; the second run takes up the first one's state."""
    with scratch(spark) as place:
        for half in halves:
            half.write.mode("append").parquet(f"{place}/in")
            stream = streaming.timed(streaming.arriving(spark, f"{place}/in", half.schema, files_a_trigger=1 << 30))
            out = streaming.drained(build(stream), "append", f"{place}/state", f"{place}/out")
        return durable(out)


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = load(spark, sf_dir, "events")
    return events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1")


def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd events arrive when the even ones have moved the watermark on: those of closed windows are dropped."""
    return _wall_clock(_in_two_runs(spark, sf_dir, _halves(spark, sf_dir), lambda s: streaming.window_counts(s, "1 day", None)), "window_start")


def stream_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events arrive, and then those of the last day again: the repeats are dropped within the watermark."""
    events = load(spark, sf_dir, "events")
    last_day = events.crossJoin(F.broadcast(events.agg(F.max("ts").alias("last")))).where("ts > last - INTERVAL 1 DAY").drop("last")
    return _in_two_runs(spark, sf_dir, (events, last_day), lambda s: streaming.first_seen(s, "event_id").select("event_id", "user_id"))


def stream_purchases_after_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream-stream join: purchases of a user within an hour after a click."""

    def build(stream: DataFrame) -> DataFrame:
        clicks = stream.where("event_type = 'click'").select(F.col("event_id").alias("click_id"), F.col("user_id").alias("clicker"), F.col("ts").alias("clicked"))
        bought = stream.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), "user_id", "ts")
        near = (F.col("user_id") == F.col("clicker")) & F.col("ts").between(F.col("clicked"), F.col("clicked") + F.expr("INTERVAL 1 HOUR"))
        return clicks.join(bought, near).select("click_id", "purchase_id")

    return _streamed(spark, sf_dir, build)


def stream_clicks_with_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream-stream left outer join: a click without a purchase of its user within an hour is given out when the watermark shows that none can come."""

    def build(stream: DataFrame) -> DataFrame:
        clicks = stream.where("event_type = 'click'").select(F.col("event_id").alias("click_id"), F.col("user_id").alias("clicker"), F.col("ts").alias("clicked"))
        bought = stream.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), "user_id", "ts")
        near = (F.col("user_id") == F.col("clicker")) & F.col("ts").between(F.col("clicked"), F.col("clicked") + F.expr("INTERVAL 1 HOUR"))
        return clicks.join(bought, near, "left_outer").select("click_id", "purchase_id")

    return _streamed(spark, sf_dir, build)


def stream_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits of users (events less than two hours apart), by own state with timers, over two runs of which the second takes up the first one's state.

    The first run has the earlier half of the events; visits that are open at its end go on in the second.
    """
    events = load(spark, sf_dir, "events")
    middle = events.agg(F.percentile_approx(micros("ts", dict(events.dtypes)["ts"]), 0.5)).first()[0] or 0
    halves = events.where(micros("ts", dict(events.dtypes)["ts"]) < middle), events.where(micros("ts", dict(events.dtypes)["ts"]) >= middle)
    with streaming.store(spark, stateful.ROCKS):
        told = _in_two_runs(spark, sf_dir, halves, lambda s: stateful.visits(s, dt.timedelta(hours=2)))
    return told.select("user_id", "begin", "last", "n", "place")


def stream_daily_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts by type in update mode, kept as a keyed table over two runs; the second batch changes days of the first."""
    with scratch(spark) as place:
        table = stateful.KeyedTable(f"{place}/table", ["window_start", "event_type"])
        for half in _halves(spark, sf_dir):
            half.write.mode("append").parquet(f"{place}/in")
            stream = streaming.arriving(spark, f"{place}/in", half.schema, files_a_trigger=1 << 30)
            stateful.kept(streaming.window_counts(streaming.timed(stream, delay="1000 days"), "1 day", None, "event_type"), table, f"{place}/state")
        return durable(_wall_clock(table.rows(spark), "window_start"))


def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events so far and their largest value, kept as one's own state over two runs; the last word counts."""

    def running(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, most = state.get if state.exists else (0, 0.0)
        for frame in frames:
            n, most = n + len(frame), max(most, float(frame["value"].max()))
        state.update((n, most))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "most": [most]})

    shape = "user_id long, n long, most double"
    build = lambda s: s.groupBy("user_id").applyInPandasWithState(running, shape, "n long, most double", "append", "NoTimeout")
    told = _in_two_runs(spark, sf_dir, _halves(spark, sf_dir), build)
    return told.groupBy("user_id").agg(F.max("n").alias("n"), F.max("most").alias("most"))


QUERIES = {
    "ranks": ranks,
    "neighbours": neighbours,
    "moving_sums": moving_sums,
    "as_of_purchase": as_of_purchase,
    "user_sessions": user_sessions,
    "tumbling": tumbling,
    "sliding": sliding,
    "stream_tumbling": stream_tumbling,
    "stream_first_seen": stream_first_seen,
    "stream_tumbling_append": stream_tumbling_append,
    "stream_sliding_append": stream_sliding_append,
    "stream_sessions_append": stream_sessions_append,
    "stream_late_rows": stream_late_rows,
    "stream_repeats": stream_repeats,
    "stream_purchases_after_clicks": stream_purchases_after_clicks,
    "stream_clicks_with_purchases": stream_clicks_with_purchases,
    "stream_visits": stream_visits,
    "stream_daily_table": stream_daily_table,
    "stream_state": stream_state,
}

#: The watermark of a stream that has seen all events, and of one that has seen the even ones.
_MARK = "(SELECT max(ts) - INTERVAL 1 DAY FROM events)"
_EVEN_MARK = "(SELECT max(ts) - INTERVAL 1 DAY FROM events WHERE event_id % 2 = 0)"
_DAILY = "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL"
SQL = {
    "ranks": """
        SELECT c_custkey, (row_number() OVER a)::INT AS row_no, (rank() OVER b)::INT AS rank_no, (dense_rank() OVER b)::INT AS dense_no, (ntile(4) OVER a)::INT AS quartile,
               percent_rank() OVER b AS share, cume_dist() OVER b AS cumulated
        FROM customer WINDOW a AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey), b AS (PARTITION BY c_nationkey ORDER BY c_mktsegment)""",
    "neighbours": """
        SELECT event_id, lag(event_type) OVER a AS before, lead(event_type, 2) OVER a AS after_next, first_value(event_id) OVER b AS first_event,
               last_value(event_id) OVER b AS last_event, nth_value(event_id, 3) OVER b AS third_event
        FROM events WINDOW a AS (PARTITION BY user_id ORDER BY ts, event_id),
             b AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    "moving_sums": """
        SELECT event_id, (sum(value::DECIMAL(18,6)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))::DOUBLE AS last_four,
               count(*) OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))::BIGINT RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS last_day
        FROM events""",
    "as_of_purchase": """
        SELECT c.event_id, c.user_id, c.ts, p.event_id AS purchase_id
        FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p
             ON c.user_id = p.user_id AND c.ts >= p.ts""",
    "user_sessions": """
        WITH g AS (SELECT *, coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER w) > 3600000000)::INT, 0) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
             s AS (SELECT *, (sum(fresh) OVER (PARTITION BY user_id ORDER BY ts))::BIGINT AS session FROM g)
        SELECT user_id, session, min(ts) AS begin, max(ts) AS end, count(*) AS n FROM s GROUP BY ALL""",
    "tumbling": _DAILY,
    "sliding": """
        SELECT w AS window_start, count(*) AS n, count(DISTINCT user_id) AS users
        FROM (SELECT user_id, unnest([date_trunc('day', ts)::TIMESTAMP, (date_trunc('day', ts) - INTERVAL 1 DAY)::TIMESTAMP]) AS w FROM events) GROUP BY 1""",
    "stream_tumbling": _DAILY,
    "stream_first_seen": "SELECT event_id, user_id FROM events",
    "stream_repeats": "SELECT event_id, user_id FROM events",
    "stream_tumbling_append": f"SELECT * FROM ({_DAILY}) WHERE window_start + INTERVAL 1 DAY <= {_MARK}",
    "stream_sliding_append": f"""
        SELECT w AS window_start, count(*) AS n
        FROM (SELECT unnest([date_trunc('day', ts)::TIMESTAMP, (date_trunc('day', ts) - INTERVAL 1 DAY)::TIMESTAMP]) AS w FROM events)
        WHERE w + INTERVAL 2 DAYS <= {_MARK} GROUP BY 1""",
    "stream_sessions_append": f"""
        WITH g AS (SELECT *, coalesce((ts >= lag(ts) OVER w + INTERVAL 1 HOUR)::INT, 0) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
             s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
        SELECT min(ts) AS session_start, max(ts) + INTERVAL 1 HOUR AS session_end, user_id, count(*) AS n FROM s GROUP BY user_id, session
        HAVING session_end <= {_MARK}""",
    "stream_late_rows": f"""
        SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, count(*) AS n FROM events
        WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= {_MARK} AND (event_id % 2 = 0 OR date_trunc('day', ts) + INTERVAL 1 DAY > {_EVEN_MARK}) GROUP BY 1""",
    "stream_purchases_after_clicks": """
        SELECT c.event_id AS click_id, p.event_id AS purchase_id FROM events c JOIN events p
             ON c.user_id = p.user_id AND p.ts BETWEEN c.ts AND c.ts + INTERVAL 1 HOUR WHERE c.event_type = 'click' AND p.event_type = 'purchase'""",
    "stream_clicks_with_purchases": f"""
        SELECT c.event_id AS click_id, p.event_id AS purchase_id
        FROM (SELECT * FROM events WHERE event_type = 'click') c LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p
             ON c.user_id = p.user_id AND p.ts BETWEEN c.ts AND c.ts + INTERVAL 1 HOUR
        WHERE p.event_id IS NOT NULL OR date_trunc('millisecond', c.ts) + INTERVAL 1 HOUR < date_trunc('millisecond', {_MARK})""",
    "stream_visits": f"""
        WITH m AS (SELECT user_id, floor(epoch_us(ts) / 1000)::BIGINT AS tick FROM events),
             g AS (SELECT *, coalesce((tick - lag(tick) OVER w >= 7200000)::INT, 0) AS fresh FROM m WINDOW w AS (PARTITION BY user_id ORDER BY tick)),
             s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY tick) AS place FROM g)
        SELECT user_id, min(tick) AS begin, max(tick) AS last, count(*) AS n, place::BIGINT AS place FROM s GROUP BY user_id, place
        HAVING max(tick) + 7200000 <= (SELECT floor(epoch_us({_MARK}) / 1000) )""",
    "stream_daily_table": _DAILY,
    "stream_state": "SELECT user_id, count(*) AS n, max(value) AS most FROM events GROUP BY 1",
}
