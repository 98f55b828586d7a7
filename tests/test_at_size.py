"""Queries whose work or results went wrong as the tables grew."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from quern import plans
from quern.operators import overlap_totals, reach
from quern.plans import custom, relational
from quern.sources import load
from quern.streaming import stateful
from tests.oracle import same

SMALL = "/root/testdata/sf0.001"


def test_lateral_last_order_is_picked_in_an_order(spark):
    """The row number that LATERAL with LIMIT becomes is told the order: without it, the pick hangs on how a shuffle delivers rows."""
    found = plans.QUERIES["lateral_last_order"](spark, SMALL)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"row_number\(\) windowspecdefinition\(o_custkey#\d+L, o_orderdate#\d+ DESC NULLS LAST, o_orderkey#\d+L ASC", plan)
    same(found, SMALL, plans.SQL["lateral_last_order"])


@pytest.fixture(scope="module")
def odd_orders(spark, tmp_path_factory):
    """Large keys beyond 2^53, a key twice, null keys on both sides, null prices and quantities, an order without lines."""
    place, k = str(tmp_path_factory.mktemp("odd")), (1 << 60) + 1
    spark.createDataFrame([(k,), (k + 1,), (k + 1,), (k + 2,), (None,), (3,)], "o_orderkey long").write.parquet(f"{place}/orders.parquet")
    lines = [(k, 7, k, 1.25, 2.0), (k, 8, None, None, None), (k + 1, 1, 5, 10.1, 4.0), (k + 1, 2, 6, 0.07, 9.0), (k + 4, 1, 6, 3.0, 1.0), (None, 1, 4, 2.5, 3.0), (None, 2, 4, 2.5, 7.0), (3, 1, k, None, None)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_extendedprice double, l_quantity double").write.parquet(f"{place}/lineitem.parquet")
    return place


def test_small_groups_go_to_python_many_at_a_time(spark, monkeypatch):
    lines = load(spark, "/root/testdata/sf0.01", "lineitem")
    dealt = lines.select("l_orderkey", custom._parts("l_orderkey", lines.count()))
    assert dealt.select("part").distinct().count() == 1
    monkeypatch.setattr(custom, "PART_ROWS", 1 << 12)
    sizes = [r[0] for r in lines.groupBy(custom._parts("l_orderkey", lines.count())).count().select("count").collect()]
    assert len(sizes) == 15 and max(sizes) < 2 << 12
    parts = lines.select("l_orderkey", custom._parts("l_orderkey", lines.count())).groupBy("l_orderkey").agg(F.countDistinct("part").alias("n"))
    assert parts.where("n != 1").count() == 0


@pytest.mark.parametrize("rows", [1 << 16, 2])
@pytest.mark.parametrize("name", ["cogrouped_map", "grouped_map", "aggregate_udf", "window_udf"])
def test_parts_of_odd_orders(spark, odd_orders, monkeypatch, name, rows):
    monkeypatch.setattr(custom, "PART_ROWS", rows)
    same(plans.QUERIES[name](spark, odd_orders), odd_orders, plans.SQL[name])


def test_overlaps_are_counted_without_pairs(spark):
    rng = random.Random(3)
    draw = lambda n: [(rng.randrange(-40, 40), rng.randrange(-40, 60)) for _ in range(n)] + [(None, 3), (4, None), (5, 5), (2, 9), (2, 9)]
    left, right = draw(60), draw(40)
    found = overlap_totals(spark.createDataFrame(left, "a long, b long"), spark.createDataFrame(right, "first int, last int"), ("a", "first"), ("b", "last"))
    assert found.columns == ["first", "last", "met", "shared"]
    sound = lambda rows: [r for r in rows if None not in r and r[0] < r[1]]
    wanted = []
    for x, y in sound(right):
        shared = [min(b, y) - max(a, x) for a, b in sound(left) if a < y and x < b]
        wanted += [(x, y, len(shared), sum(shared))] if shared else []
    assert sorted(tuple(r) for r in found.collect()) == sorted(wanted)


def test_campaigns_are_not_joined_with_orders(spark):
    """No join of the plan has conditions beyond equalities of days, so its rows do not grow with pairs."""
    plan = plans.QUERIES["open_orders_by_campaign"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "lineitem" not in plan and all("<" not in line for line in plan.splitlines() if "Join" in line)


def test_buckets_grow_with_the_tables(spark, monkeypatch):
    written = []
    save = relational.save_bucketed
    monkeypatch.setattr(relational, "BUCKET_ROWS", 400)
    monkeypatch.setattr(relational, "save_bucketed", lambda df, table, keys, buckets: (written.append(buckets), save(df, table, keys, buckets)))
    same(plans.QUERIES["bucketed_join"](spark, SMALL), SMALL, plans.SQL["bucketed_join"])
    assert written == [15, 15]  # 6,000 lines


def test_a_long_way_takes_fewer_rounds_than_hops(spark, monkeypatch):
    """A chain of 40 nodes with a cycle at its end and a short cut: least hops, whatever is met twice within a round."""
    links = [(n, n + 1) for n in range(40)] + [(40, 36), (3, 10), (1, 0)]
    cuts = []
    cut = reach.durable
    monkeypatch.setattr(reach, "durable", lambda df: cuts.append(1) or cut(df))
    found = reach.reachable(spark.createDataFrame([(0,)], "s long"), spark.createDataFrame(links, "a long, b long"), "s", "a", "b")
    wanted = {(0, n, n if n < 4 or n < 10 else n - 6) for n in range(41)}
    assert {tuple(r) for r in found.collect()} == wanted and len(cuts) < 20
    some = reach.reachable(spark.createDataFrame([(0,)], "s long"), spark.createDataFrame(links, "a long, b long"), "s", "a", "b", 6)
    assert {tuple(r) for r in some.collect()} == {w for w in wanted if w[2] <= 6}


def test_visits_of_a_user_that_end_together_are_told_in_one_frame():
    class Held(dict):
        containsKey, getValue, updateValue = dict.__contains__, dict.__getitem__, dict.__setitem__  # noqa: N815

    visits = stateful.Visits(10)
    visits.told = Held()
    (first,) = visits._told((7,), [(0, 5, 2), (20, 20, 1)])
    (second,) = visits._told((7,), [(40, 41, 3)])
    assert first.values.tolist() == [[7, 0, 5, 2, 0], [7, 20, 20, 1, 1]] and second.values.tolist() == [[7, 40, 41, 3, 2]]
    assert list(visits._told((7,), [])) == []
