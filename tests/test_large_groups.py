"""Ranks, frames, quantiles and interval joins where one key holds a third of the rows and a task may hold few of them."""

from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quern.operators import as_of_join, framed, gap_sessions, modes, overlap_join, placed, quantiles, ranked
from quern.operators import ranges, ranking, selection

SCHEMA = "id long, k string, range int, key int, v double, t long"


def rows(n: int = 900, seed: int = 1) -> list[tuple]:
    """A third of the rows have one key, ties are long, and columns are named as the operators' own."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        k = "hot" if i % 3 == 0 else None if i % 31 == 0 else f"k{rng.randrange(40)}"
        v = None if rng.random() < 0.05 else float(rng.choice([1, 1, 1, 2, rng.randrange(60)]))
        out.append((i, k, rng.randrange(5), rng.randrange(3), v, rng.randrange(2000)))
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5)


@pytest.fixture
def sql():
    """The same rows in DuckDB, with Spark's places of nulls."""
    con = duckdb.connect()
    con.execute("CREATE TABLE r (id BIGINT, k VARCHAR, range INT, key INT, v DOUBLE, t BIGINT)")
    con.executemany("INSERT INTO r VALUES (?, ?, ?, ?, ?, ?)", rows())
    return lambda text: sorted(con.sql(text).fetchall())


def told(df, *columns) -> list[tuple]:
    return sorted(tuple(r) for r in df.select(*columns).collect())


def largest_task(monkeypatch, module) -> list[int]:
    """Rows of the largest range of each call."""
    seen: list[int] = []

    def watched(*args, **kwargs):
        out = ranges.ranged(*args, **kwargs)
        seen.append(out.groupBy("range").count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(module, "ranged", watched)
    return seen


KINDS = {"no": "row_number", "r": "rank", "d": "dense_rank", "p": "percent_rank", "c": "cume_dist", "q": ("ntile", 4), "big": ("ntile", 500)}
RANKS = """SELECT id, row_number() OVER a, rank() OVER b, dense_rank() OVER b, percent_rank() OVER b, cume_dist() OVER b, ntile(4) OVER a, ntile(500) OVER a FROM r
           WINDOW a AS (PARTITION BY k ORDER BY v {way}, id DESC NULLS LAST), b AS (PARTITION BY k ORDER BY v {way})"""


@pytest.mark.parametrize(("by", "way"), [("v", "ASC NULLS FIRST"), (("v", "desc"), "DESC NULLS LAST")])
@pytest.mark.parametrize("held", [7, 40, 1000])
def test_ranks(spark, table, sql, monkeypatch, by, way, held):
    seen = largest_task(monkeypatch, ranking)
    found = ranked(table, ["k"], [by], KINDS, [("id", "desc")], rows=held)
    assert found.columns == [*table.columns, *KINDS]
    assert told(found, "id", *KINDS) == sql(RANKS.format(way=way))
    assert bool(seen) == (held < 300) and all(n <= 4 * held for n in seen)


def test_ranks_by_one_tie_alone(spark, table, sql):
    """All rows of a key are equal: one run over many ranges."""
    found = ranked(table.withColumn("v", F.lit(1.0)), ["k"], ["v"], {"r": "rank", "d": "dense_rank", "c": "cume_dist", "p": "percent_rank"}, ["id"], rows=20)
    assert {tuple(r) for r in found.select("r", "d", "c", "p").collect()} == {(1, 1, 1.0, 0.0)}


def test_ranks_of_several_keys_and_of_nothing(spark, table, sql):
    found = ranked(table, ["k", "range"], ["t"], {"r": "rank"}, rows=15)
    assert told(found, "id", "r") == sql("SELECT id, rank() OVER (PARTITION BY k, range ORDER BY t) FROM r")
    assert ranked(table.limit(0), ["k"], ["t"], {"r": "rank"}, rows=15).count() == 0


@pytest.mark.parametrize("held", [9, 50, 1000])
def test_frames_of_rows(spark, table, sql, monkeypatch, held):
    seen = largest_task(monkeypatch, ranking)
    columns = {"s": lambda w: F.sum("v").over(w.rowsBetween(-3, 2)), "a": lambda w: F.lag("t", 3).over(w), "b": lambda w: F.lead("t", 2).over(w), "n": lambda w: F.count(F.lit(1)).over(w.rowsBetween(-3, -1))}
    found = framed(table, ["k"], ["t", ("id", "desc")], columns, (-3, 2), rows=held)
    assert found.columns == [*table.columns, *columns]
    truth = sql("""SELECT id, sum(v) OVER (PARTITION BY k ORDER BY t, id DESC ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING), lag(t, 3) OVER w, lead(t, 2) OVER w,
                          count(*) OVER (PARTITION BY k ORDER BY t, id DESC ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) FROM r WINDOW w AS (PARTITION BY k ORDER BY t, id DESC)""")
    assert told(found, "id", *columns) == truth
    assert bool(seen) == (held < 300) and all(n <= 4 * held for n in seen)


def test_a_frame_longer_than_a_range(spark, table, sql):
    found = framed(table, ["k"], ["t", "id"], {"s": lambda w: F.count("v").over(w.rowsBetween(-100, 60))}, (-100, 60), rows=12)
    assert told(found, "id", "s") == sql("SELECT id, count(v) OVER (PARTITION BY k ORDER BY t, id ROWS BETWEEN 100 PRECEDING AND 60 FOLLOWING) FROM r")


@pytest.mark.parametrize("column", ["t", "v"])
@pytest.mark.parametrize("held", [9, 60, 1000])
def test_frames_of_values(spark, table, sql, column, held):
    """Equal values lie on both sides of a range's end, ``v`` has nulls and long ties."""
    columns = {"n": lambda w: F.count(F.lit(1)).over(w.rangeBetween(-20, 0)), "m": lambda w: F.max("id").over(w.rangeBetween(-5, 30))}
    found = framed(table, ["k"], [column], columns, (-20, 30), by_value=True, rows=held)
    window = f"PARTITION BY k ORDER BY {column} NULLS FIRST RANGE BETWEEN"
    assert told(found, "id", *columns) == sql(f"SELECT id, count(*) OVER ({window} 20 PRECEDING AND CURRENT ROW), max(id) OVER ({window} 5 PRECEDING AND 30 FOLLOWING) FROM r")


@pytest.mark.parametrize("held", [30, 1000])
def test_places_of_a_group(spark, table, sql, held):
    found = placed(table, ["k"], ["t", "id"], {"first": ("id", 1), "third": ("t", 3), "last": ("id", -1), "far": ("id", 25)}, rows=held)
    whole = "OVER (PARTITION BY k ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    key = lambda r: tuple((x is not None, x) for x in r)
    con = sorted(found.select("id", "first", "third", "last", "far").collect(), key=key)
    truth = duckdb.connect()
    truth.execute("CREATE TABLE r (id BIGINT, k VARCHAR, range INT, key INT, v DOUBLE, t BIGINT)")
    truth.executemany("INSERT INTO r VALUES (?, ?, ?, ?, ?, ?)", rows())
    wanted = truth.sql(f"SELECT id, first_value(id) {whole}, nth_value(t, 3) {whole}, last_value(id) {whole}, nth_value(id, 25) {whole} FROM r").fetchall()
    assert [tuple(r) for r in con] == sorted(wanted, key=key)


COLUMNS = {"least": ("disc", 0.0), "b": ("disc", 0.9), "most": ("disc", 1.0), "mid": ("cont", 0.5)}


@pytest.mark.parametrize("spread", ["even", "wild", "equal"])
@pytest.mark.parametrize("held", [60, 1 << 20])
def test_quantiles(spark, spread, held):
    """Also of values over 600 powers of ten, where even ranges would not narrow anything."""
    rng = random.Random(7)
    value = {"even": lambda: rng.randrange(500) / 4, "wild": lambda: rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300), "equal": lambda: rng.choice([3.0, 3.0, 3.0, 4.0])}[spread]
    data = [("hot" if i % 3 == 0 else None if i % 17 == 0 else f"k{rng.randrange(30)}", None if rng.random() < 0.1 else value()) for i in range(3000)] + [("none", None)] * 9
    df = spark.createDataFrame(data, "k string, v double").repartition(4)
    found = quantiles(df, ["k"], "v", COLUMNS, [F.count("v").alias("n"), F.max("v").alias("key")], most=held)
    assert found.columns == ["k", *COLUMNS, "n", "key"]
    told = found.collect()
    for r in told:
        own = sorted(v for k, v in data if k == r.k and v is not None)
        if not own:
            assert r.n == 0 and all(r[c] is None for c in COLUMNS)
            continue
        assert (r.n, r["key"]) == (len(own), own[-1])
        for c, (kind, p) in COLUMNS.items():
            at = p * (len(own) - 1)
            low, high = own[int(at)], own[-int(-at // 1)]
            truth = own[max(1, -int(-(p * len(own)) // 1)) - 1] if kind == "disc" else low + (high - low) * (at - int(at))
            assert r[c] == pytest.approx(truth, rel=1e-12), (r.k, c)
    assert len(told) == len({k for k, _ in data})


@pytest.mark.parametrize(("accuracy", "parts"), [(10, 4), (100, 50)])
def test_quantiles_narrow_brackets_that_hold_too_much(spark, monkeypatch, accuracy, parts):
    """Coarse sketches: brackets miss their ranks or hold most of a group, and are narrowed round by round."""
    monkeypatch.setattr(selection, "ACCURACY", accuracy)
    monkeypatch.setattr(selection, "PARTS", parts)
    monkeypatch.setattr(selection, "MOST_SENT", 0 if parts == 4 else 9)
    rounds = []
    monkeypatch.setattr(selection, "_narrowed", lambda *a, f=selection._narrowed: rounds.append(1) or f(*a))
    rng = random.Random(3)
    data = [("hot", rng.randrange(10_000)) for _ in range(4000)] + [("small", i) for i in range(4)]
    df = spark.createDataFrame(data, "k string, v int").repartition(4)
    found = {r.k: r for r in quantiles(df, ["k"], "v", {"a": ("disc", 0.1)}, most=100).collect()}
    own = sorted(v for k, v in data if k == "hot")
    assert found["hot"].a == own[399] and found["small"].a == 0 and rounds


def test_no_task_holds_a_groups_values(spark):
    """With a large group, no exact percentile is in the plan, and what is summed up in order is the bracket alone."""
    df = spark.range(200_000).select(F.lit("hot").alias("k"), (F.col("id") * 7919 % 200_003).alias("v"))
    found = quantiles(df, ["k"], "v", {"m": ("disc", 0.5)}, most=1000)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan and "percentile_disc" not in plan
    exact = sorted(i * 7919 % 200_003 for i in range(200_000))
    assert found.first().m == exact[99_999]


def test_modes(spark, table, sql):
    found = told(modes(table.where("k is not null"), ["k"], "v", "m"), "k", "m")
    truth = sql("SELECT k, v FROM (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, v) AS n FROM r WHERE v IS NOT NULL AND k IS NOT NULL GROUP BY k, v) WHERE n = 1")
    assert found == truth
    assert modes(spark.createDataFrame([("a", None)], "k string, v double"), ["k"], "v", "m").collect()[0].m is None


@pytest.mark.parametrize("scale", [1, 1e-3, 1e9])
def test_overlaps_equal_nested_loops(spark, scale):
    """Lengths over nine powers of ten, a third of one key."""
    rng = random.Random(4)

    def spans(n: int) -> list[tuple]:
        out = []
        for i in range(n):
            begin = rng.uniform(-500, 500) if i % 4 else float(rng.randrange(-8, 8) * 64)
            out.append((i, "hot" if i % 3 == 0 else rng.choice("abc"), begin * scale, (begin + rng.choice([0, -1, 1, 64, 128, 10 ** rng.uniform(-6, 3)])) * scale))
        return [*out, (n, None, 0.0, 1.0), (n + 1, "a", None, 1.0), (n + 2, "a", 0.0, float("nan")), (n + 3, "b", float("-inf"), 0.0), (n + 4, "hot", 1.0, float("inf"))]

    one, two = spans(150), spans(130)
    a, b = spark.createDataFrame(one, "i int, k string, x double, y double"), spark.createDataFrame(two, "j int, k string, u double, v double")
    sound = lambda s, t: s is not None and t is not None and s < t
    pairs = lambda keyed: sorted((i, j) for i, k, x, y in one for j, q, u, v in two if sound(x, y) and sound(u, v) and x < v and u < y and (not keyed or k is not None and k == q))
    assert told(overlap_join(a, b, ("x", "u"), ("y", "v")), "i", "j") == pairs(False)
    found = overlap_join(a, b, ("x", "u"), ("y", "v"), ["k"])
    assert sorted(found.columns) == sorted(["k", "i", "x", "y", "j", "u", "v"]) and told(found, "i", "j") == pairs(True)


def test_long_intervals_do_not_multiply_rows(spark):
    """One interval in a thousand is a million times as long: rows before the join stay within a few for each interval."""
    one = spark.range(2000).select(F.col("id").alias("i"), (F.col("id") * 1000.0).alias("x"), (F.col("id") * 1000.0 + F.when(F.col("id") % 1000 == 0, 1e9).otherwise(1e3)).alias("y"))
    two = spark.range(2000).select(F.col("id").alias("j"), (F.col("id") * 1000.0 + 5).alias("u"), (F.col("id") * 1000.0 + F.when(F.col("id") % 999 == 0, 1e9).otherwise(5.001)).alias("v"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plain = overlap_join(one, two, ("x", "u"), ("y", "v"))
        plain.collect()
        made: list[int] = []

        def walk(node) -> None:
            if node.nodeName() == "Generate":
                made.append(node.metrics().apply("numOutputRows").value())
            for i in range(node.children().size()):
                walk(node.children().apply(i))

        walk(plain._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert made and max(made) <= 8 * 2000
    truth = one.crossJoin(two).where("x < v and u < y").count()
    assert plain.count() == truth


@pytest.mark.parametrize("held", [25, 1 << 20])
def test_as_of_and_sessions_by_either_way(spark, table, held):
    left, right = table.where("id % 2 = 0"), table.where("id % 2 = 1").select("k", "t", F.col("id").alias("found"))
    data = rows()
    joined = as_of_join(left, right, "k", "t", ["found"], most=held)
    last = lambda k, t: max(((u, i) for i, q, *_, u in data if i % 2 and k is not None and q == k and u <= t), default=(None, None))[1]
    assert {r.id: r.found for r in joined.collect()} == {i: last(k, t) for i, k, *_, t in data if i % 2 == 0}
    timed = table.withColumn("at", F.timestamp_micros(F.col("t") * 1_000_000))
    found = {r.id: (r.k, r.session) for r in gap_sessions(timed, "k", "at", 30, most=held).collect()}
    for key in {k for _, k, *_ in data}:
        own, session, before = sorted((t, i) for i, k, *_, t in data if k == key), 0, None
        for t, i in own:
            session += before is not None and t - before > 30
            before = t
            assert found[i] == (key, session)
