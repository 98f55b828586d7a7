from __future__ import annotations

import pytest

import __spark_entry__
from quern import plans
from tests.oracle import same

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_equals_duckdb(spark, name):
    same(plans.QUERIES[name](spark, SMALL), SMALL, plans.SQL[name])


@pytest.mark.parametrize("sf_dir", [SMALL, "/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_approximate_distinct_against_exact_counts(spark, sf_dir):
    from pyspark.sql import functions as F

    from quern.sources import load

    exact = {r[0]: r[1] for r in load(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_partkey")).collect()}
    found = {r[0]: r[1] for r in plans.QUERIES["approximate_distinct"](spark, sf_dir).collect()}
    assert set(found) == set(exact)
    for flag, n in found.items():  # two standard deviations
        assert abs(n - exact[flag]) <= 2 * 0.02 * exact[flag], (flag, n, exact[flag])


def test_entry_points(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
