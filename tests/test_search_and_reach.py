"""Vector search, reachability, sketches, bucketed tables and the ordered table function."""

from __future__ import annotations

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern import plans
from quern.operators import reachable, sketches, vectors
from quern.plans import custom, relational
from quern.sources import load, save_bucketed

TABLES = ["/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1"]


def brute(rows: list[tuple], asked: list[tuple], k: int) -> dict[int, list[int]]:
    """The nearest by cosine of each asked vector among those with other ids, ties by id."""
    ids = np.array([i for i, _ in rows])
    unit = np.array([v for _, v in rows], float)
    unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-300)
    out = {}
    for i, v in asked:
        close = unit @ (np.array(v, float) / max(np.linalg.norm(v), 1e-300))
        order = np.lexsort((ids, -np.round(close, 9)))
        out[i] = [int(ids[o]) for o in order if ids[o] != i][:k]
    return out


@pytest.mark.parametrize("sf_dir", TABLES)
def test_recall_of_the_registered_query(spark, sf_dir):
    found: dict[int, set[int]] = {}
    for r in plans.QUERIES["nearest_embeddings"](spark, sf_dir).collect():
        found.setdefault(r.query, set()).add(r.near)
    rows = [(r.vec_id, r.embedding) for r in load(spark, sf_dir, "embeddings").collect()]
    truth = brute(rows, [x for x in rows if x[0] % 50 == 0], 10)
    assert set(found) == set(truth) and all(len(x) == 10 for x in found.values())
    recall = np.mean([len(found[q] & set(near)) / 10 for q, near in truth.items()])
    assert recall >= 0.9, recall


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(vectors, "PIECE", 7)
    monkeypatch.setattr(vectors, "ASKED", 3)


def test_all_lists_give_the_exact_answer_in_small_blocks(spark, small_blocks):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(60)]  # a third of all are copies
    df = spark.createDataFrame([*rows, (300, None), (301, [1.0]), (302, [float("nan")] * 6), (None, rows[1][1])], "id long, v array<double>").repartition(3)
    index = vectors.fit_index(df, "id", "v", centres=8)
    assert sum(r["count"] for r in index.vectors.groupBy("list").count().collect()) == len(rows)
    asked = df.where("id % 10 = 0 or id > 299")
    found: dict[int, list[int]] = {}
    for r in vectors.nearest_vectors(index, asked, "id", "v", 5, probes=8).orderBy("query", "rank").collect():
        found.setdefault(r.query, []).append(r.id)
    truth = brute(rows, [x for x in rows if x[0] % 10 == 0], 5)
    copies = {i for i, v in rows if v == rows[0][1]}
    assert set(found) == set(truth)
    for q, near in truth.items():
        assert len(found[q]) == 5 and (found[q] == near if not copies & set(near) else set(found[q]) - copies == set(near) - copies)


def test_a_hot_list_is_dealt_in_pieces(spark, small_blocks):
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(200)] + [(500 + i, [0.0, 1.0 + i]) for i in range(9)], "id long, v array<double>")
    index = vectors.fit_index(df, "id", "v", centres=2)
    found = vectors.nearest_vectors(index, df.where("id < 12"), "id", "v", 3, probes=2)
    assert found.count() == 36 and found.where("cosine < 0.999").count() == 0
    assert found.where("query = 0").select("id").orderBy("rank").collect() == [(1,), (2,), (3,)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_no_vectors(spark):
    df = spark.createDataFrame([(1, None)], "id long, v array<double>")
    assert vectors.nearest_vectors(vectors.fit_index(df, "id", "v"), df, "id", "v", 3, 2).collect() == []


def test_reach_over_cycles_and_a_hub(spark):
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(30)] + [(30, 0), (7, 7), (5, None), (None, 5)] + [(100, 200 + i) for i in range(80)] + [(200 + i, 100) for i in range(80)]
    links += [(rng.randrange(300, 340), rng.randrange(300, 340)) for _ in range(45)] * 2
    starts = [0, 12, 100, 301, 999, None, 0]

    def walk(start: int, most: int | None) -> dict[int, int]:
        seen, frontier, hops = {start: 0}, [start], 0
        while frontier and (most is None or hops < most):
            hops += 1
            frontier = [b for a in frontier for x, b in links if x == a and b is not None and seen.setdefault(b, hops) == hops]
            frontier = list(set(frontier))
        return seen

    s, e = spark.createDataFrame([(x,) for x in starts], "begin long"), spark.createDataFrame(links, "a long, b long")
    for most in (None, 3, 0):
        found = reachable(s, e, "begin", "a", "b", most)
        assert found.columns == ["begin", "node", "hops"]
        assert sorted(map(tuple, found.collect())) == sorted((x, n, h) for x in {0, 12, 100, 301, 999} for n, h in walk(x, most).items())
    assert reachable(s.limit(0), e, "begin", "a", "b").count() == 0


@pytest.mark.parametrize("sf_dir", TABLES)
def test_stored_sketches_against_exact_counts(spark, sf_dir):
    events = load(spark, sf_dir, "events").withColumn("week", F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 7).cast("int"))
    exact: dict[int, tuple[set, list]] = {}
    for r in events.select("week", "user_id", "value").collect():
        users, values = exact.setdefault(r.week, (set(), []))
        users.add(r.user_id)
        values.append(r.value)
    found = plans.QUERIES["daily_sketches"](spark, sf_dir).collect()
    assert {r.week for r in found} == set(exact)
    for r in found:
        users, values = exact[r.week]
        assert r.n == len(values) and abs(r.users - len(users)) <= max(1, 0.04 * len(users))
        below = np.mean(np.array(values) < r.median_value), np.mean(np.array(values) <= r.median_value)
        assert below[0] <= 0.5 + 3 * 1.7 / sketches.KLL_SIZE and below[1] >= 0.5 - 3 * 1.7 / sketches.KLL_SIZE
        if r.week - 1 in exact:
            known = exact[r.week - 1][0]
            bound = max(1, 0.04 * len(users | known))
            assert abs(r.returning - len(users & known)) <= bound and abs(r.lost - len(known - users)) <= bound


def test_bucketed_tables_are_joined_without_an_exchange(spark):
    name = f"t_{uuid.uuid4().hex}"
    try:
        for table, source, key, column in ((f"{name}_o", "orders", "o_orderkey", "o_orderpriority"), (f"{name}_l", "lineitem", "l_orderkey", "l_quantity")):
            save_bucketed(load(spark, TABLES[0], source).select(key, column), table, [key], buckets=4)
        found = relational.bucketed_sums(spark, f"{name}_o", f"{name}_l")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert found.count() > 0
    finally:
        for side in "ol":
            spark.sql(f"DROP TABLE IF EXISTS {name}_{side}")


def test_thinning_takes_one_row_after_the_other(spark):
    rng = random.Random(8)
    rows = [(u, rng.randrange(40), i) for i, u in enumerate(rng.choices([1, 1, 1, 2, 3, None], k=300))]
    spark.createDataFrame([(u, at * 1_000_000, i, "x") for u, at, i in rows], "user_id long, at long, event_id long, other string").createOrReplaceTempView("thin_input")
    spark.udtf.register("thin", F.udtf(custom.Thinned))
    found = spark.sql("SELECT * FROM thin(TABLE(thin_input), 7, 'event_id, other, user_id')")
    assert found.columns == ["event_id", "other", "user_id", "place"]
    wanted = set()
    for user in {u for u, *_ in rows}:
        kept, place = None, 0
        for at, i in sorted((at, i) for u, at, i in rows if u == user):
            if kept is None or at - kept >= 7:
                wanted.add((i, "x", user, place))
                kept, place = at, place + 1
    assert {tuple(r) for r in found.collect()} == wanted
