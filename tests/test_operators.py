from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quern import sources, streaming
from quern.operators import as_of_join, gap_sessions, interval_join, salted_join, top_k


def test_as_of_join_takes_the_last_row_at_or_before(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9), (None, 3)], "k int, t int")
    right = spark.createDataFrame([(1, 2, "a"), (1, 5, "b"), (1, 6, "c"), (None, 1, "z")], "k int, t int, v string")
    assert set(map(tuple, as_of_join(left, right, "k", "t", ["v"]).collect())) == {(1, 5, "b"), (1, 1, None), (2, 9, None), (None, 3, None)}


def test_interval_join_equals_nested_loops(spark):
    points = [(i, float(i * 7 % 50)) for i in range(60)]
    spans = [(j, float(j), float(j + j % 13)) for j in range(0, 50, 3)]
    found = interval_join(spark.createDataFrame(points, "i int, x double"), spark.createDataFrame(spans, "j int, a double, b double"), "x", "a", "b", 4.0)
    assert sorted((r.i, r.j) for r in found.collect()) == sorted((i, j) for i, x in points for j, a, b in spans if a <= x < b)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_a_join(spark, how):
    large = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 0), (3, 1), (None, 5)], "k int, v int")
    small = spark.createDataFrame([(1, "a"), (2, "b")], "k int, w string")
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, salted_join(large, small, "k", 8, how).collect()), key=key) == sorted(map(tuple, large.join(small, "k", how).collect()), key=key)


def test_salted_join_refuses_other_kinds(spark):
    df = spark.createDataFrame([(1,)], "k int")
    with pytest.raises(ValueError):
        salted_join(df, df, "k", 2, "full")


def test_top_k_and_sessions_of_an_empty_frame(spark):
    empty = spark.createDataFrame([], "k int, t timestamp_ntz")
    assert top_k(empty, ["k"], [F.col("t")], 2).count() == 0
    assert gap_sessions(empty, "k", "t", 60).count() == 0


def test_sessions_split_at_gaps(spark):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    df = spark.createDataFrame([(1, at(0)), (1, at(1)), (1, at(9)), (2, at(9))], "k int, t timestamp_ntz")
    assert sorted((r.k, r.t.minute, r.session) for r in gap_sessions(df, "k", "t", 120).collect()) == [(1, 0, 0), (1, 1, 0), (1, 9, 1), (2, 9, 0)]


@pytest.mark.parametrize("fmt", ["parquet", "orc", "csv", "json", "xml"])
def test_formats_keep_rows(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, 'a "b", c', dt.datetime(2024, 1, 2, 3, 4, 5, 678)), (2, "x\ty", None)], "i int, s string, t timestamp_ntz")
    sources.save(df, str(tmp_path / fmt), fmt)
    back = sources.read(spark, str(tmp_path / fmt), fmt, df.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_plain_formats_need_a_schema(spark, tmp_path):
    with pytest.raises(ValueError):
        sources.read(spark, str(tmp_path), "csv")


def test_partitioned_tables_are_pruned(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 3) for i in range(9)], "i int, p int")
    sources.save(df, str(tmp_path / "t"), partition_by=("p",))
    picked = sources.read(spark, str(tmp_path / "t")).where("p = 1")
    assert len(picked.inputFiles()) > 0 and sorted(r.i for r in picked.collect()) == [1, 4, 7]
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(p" in plan


def test_late_rows_are_dropped_and_open_windows_held_back(spark, tmp_path):
    at = lambda d, h=0: dt.datetime(2024, 1, d, h)
    schema = "ts timestamp_ntz, k int"
    for n, part in enumerate(([(at(1), 1), (at(1, 5), 1)], [(at(9), 1)], [(at(1, 6), 1), (at(9, 1), 1)])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = streaming.timed(streaming.arriving(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema))
        out = streaming.drained(streaming.window_counts(stream, "1 day", None, "k"), "append", str(tmp_path / "checkpoint"), str(tmp_path / "out"))
        seen = [(r.window_start.day, r.n) for r in out.collect()]
        assert seen == ([] if n == 0 else [(1, 2)])


def test_sessions_over_a_stream(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    df = spark.createDataFrame([(at(0), 1), (at(2), 1), (at(30), 1)], "ts timestamp_ntz, k int")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streaming.timed(streaming.arriving(spark, str(tmp_path / "in"), df.schema), delay="1 minute")
    out = streaming.drained(streaming.session_counts(stream, "5 minutes", "k"), "append", str(tmp_path / "c"), str(tmp_path / "o"))
    assert [(r.session_start.minute, r.n) for r in out.collect()] == [(0, 2)]


def _largest_share(df) -> float:
    """Rows of the largest range that a window holds whole, as a share of all."""
    sizes = [r["count"] for r in df.groupBy("range").count().collect()]
    return max(sizes) / sum(sizes)


def test_a_hot_key_lies_in_many_ranges(spark):
    from quern.operators.ranges import ranged

    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("key"), (F.col("id") * 7919 % 9000).alias("at"))
    assert _largest_share(ranged(df, ["key", "at"], rows=500)) < 3 * 500 / 9000


@pytest.fixture
def narrow_ranges(monkeypatch):
    from quern.operators import joins, ranges, windows

    small = lambda df, order, rows=0, total=None: ranges.ranged(df, order, 40)
    for module in (joins, windows):
        monkeypatch.setattr(module, "ranged", small)
        monkeypatch.setattr(module, "largest_group", lambda df, keys: (1 << 40, df.count()))


def test_as_of_join_across_ranges_of_a_hot_key(spark, narrow_ranges):
    left = [(i if i % 3 else -1, i * 7919 % 1000, i) for i in range(900)] + [(None, 4, 900)]
    right = [(-1, t, f"h{t}") for t in (3, 400, 401, 777)] + [(i, 500, f"k{i}") for i in range(0, 900, 7)] + [(None, 0, "n")]
    found = as_of_join(spark.createDataFrame(left, "k int, range int, key int"), spark.createDataFrame(right, "k int, range int, v string"), "k", "range", ["v"])
    assert found.columns == ["k", "range", "key", "v"]

    def last(k, t):
        return max(((u, v) for j, u, v in right if k is not None and j == k and u <= t), default=(None, None))[1]

    assert sorted(found.collect(), key=lambda r: r["key"]) == [(k, t, i, last(k, t)) for k, t, i in left]


def test_sessions_across_ranges_of_a_hot_key(spark, narrow_ranges):
    start = dt.datetime(2024, 1, 1)
    rows = [(i if i % 3 else -1, start + dt.timedelta(seconds=(i * 7919 % 5000)), i) for i in range(600)] + [(None, start, 600), (None, start + dt.timedelta(hours=1), 601)]
    rows += [(-1, rows[0][1], 602)]  # a tie
    df = spark.createDataFrame(rows, "k int, t timestamp_ntz, fresh int")
    by_key: dict = {}
    for k, t, i in sorted(rows, key=lambda r: r[1]):
        by_key.setdefault(k, []).append((t, i))
    expected = {}
    for run in by_key.values():
        session = 0
        for n, (t, i) in enumerate(run):
            session += n > 0 and (t - run[n - 1][0]).total_seconds() > 20
            expected[i] = session
    found = gap_sessions(df, "k", "t", 20)
    assert found.columns == ["k", "t", "fresh", "session"]
    assert {r["fresh"]: r["session"] for r in found.collect()} == expected


def test_helper_columns_do_not_clash(spark):
    points, spans = spark.createDataFrame([(5.0, 1)], "x double, bucket int"), spark.createDataFrame([(0.0, 9.0, 2)], "a double, b double, _bucket int")
    assert interval_join(points, spans, "x", "a", "b", 4.0).columns == ["x", "bucket", "a", "b", "_bucket"]
    df = spark.createDataFrame([(1, 2)], "k int, salt int")
    assert salted_join(df, df.withColumnRenamed("salt", "w"), "k", 4).columns == ["k", "salt", "w"]


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    spark = SimpleNamespace(sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None), conf=SimpleNamespace(get=lambda k, d: d))
    with pytest.raises(ValueError):
        sources.shared_folder(spark)
