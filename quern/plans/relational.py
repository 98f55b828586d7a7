"""Scans, joins, aggregates, set operations and subqueries."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exact_avg, exact_sum, money, net_price
from ..operators import interval_join, overlap_join, overlap_totals, reachable, top_k
from ..sources import durable, load, read, save, save_bucketed, scratch

#: DuckDB's form of ``net_price``.
_NET = "(l_extendedprice::DECIMAL(18,2) * (1::DECIMAL(3,2) - l_discount::DECIMAL(3,2)))"


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz '2000-09-02 00:00:00'")
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        exact_sum("l_quantity").alias("sum_qty"),
        exact_sum("l_extendedprice").alias("sum_price"),
        F.sum(net_price()).cast("double").alias("sum_net"),
        exact_avg("l_discount").alias("avg_discount"),
        F.count(F.lit(1)).alias("n"),
    )


def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six tables; the dimension sides are small by their nature and Spark sizes them itself."""
    t = {n: load(spark, sf_dir, n) for n in ("customer", "orders", "lineitem", "supplier", "nation", "region")}
    return (
        t["lineitem"]
        .join(t["orders"].where("o_orderdate >= timestamp_ntz '1997-01-01 00:00:00' and o_orderdate < timestamp_ntz '1999-01-01 00:00:00'"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
        .join(t["supplier"], F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t["nation"], F.col("s_nationkey") == F.col("n_nationkey"))
        .join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy("r_name", "n_name")
        .agg(F.sum(net_price()).cast("double").alias("revenue"), F.countDistinct("c_custkey").alias("customers"))
    )


def shipping_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines, cust = (load(spark, sf_dir, n) for n in ("orders", "lineitem", "customer"))
    return (
        cust.where("c_mktsegment = 'BUILDING'")
        .join(orders.where("o_orderdate < timestamp_ntz '1998-03-15 00:00:00'"), F.col("c_custkey") == F.col("o_custkey"))
        .join(lines.where("l_shipdate > timestamp_ntz '1998-03-15 00:00:00'"), F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_orderkey", "o_orderdate")
        .agg(F.sum(net_price()).cast("double").alias("revenue"))
        .orderBy(F.desc("revenue"), "o_orderkey")
        .limit(10)
    )


def orders_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of users beside dear orders of customers; the price makes rows without a partner on both sides."""
    users = load(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("events"))
    orders = load(spark, sf_dir, "orders").where("o_totalprice > 300000").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"))
    both = users.join(orders, users["user_id"] == orders["o_custkey"], "full")
    return both.select(F.coalesce("user_id", "o_custkey").alias("key"), F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("orders", F.lit(0)).alias("orders"))


def customers_with_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust, events = load(spark, sf_dir, "customer"), load(spark, sf_dir, "events").where("event_type = 'purchase'")
    return cust.join(events, cust["c_custkey"] == events["user_id"], "left_semi").select("c_custkey", "c_name")


def orders_without_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    return orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"], "left_anti").select("o_orderkey", "o_orderstatus")


def orders_in_price_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping price bands by nation key: an interval join over buckets."""
    bands = load(spark, sf_dir, "nation").select("n_name", (F.col("n_nationkey") * 15000.0).alias("low"), (F.col("n_nationkey") * 15000.0 + 40000.0).alias("high"))
    pairs = interval_join(load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), bands, "o_totalprice", "low", "high", 20000.0)
    return pairs.groupBy("n_name").agg(F.count(F.lit(1)).alias("orders"), F.min("o_totalprice").alias("cheapest"))


def rollup_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem")
    return lines.rollup("l_returnflag", "l_linestatus").agg(exact_sum("l_quantity").alias("qty"), (F.grouping_id()).cast("int").alias("level"))


def cube_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    return orders.cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), exact_sum("o_totalprice").alias("total"))


def pivot_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    wide = orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return wide.select("o_orderpriority", *[F.coalesce(s, F.lit(0)).alias(f"n_{s.lower()}") for s in ("F", "O", "P")])


def unpivot_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = load(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return parts.unpivot("p_partkey", ["size", "price"], "measure", "amount")


def filtered_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem")
    return lines.groupBy("l_suppkey").agg(
        F.count_if(F.col("l_returnflag") == "R").alias("returned"),
        F.sum(F.when(F.col("l_discount") >= 0.05, money("l_quantity"))).cast("double").alias("discounted_qty"),
        F.bool_or(F.col("l_tax") > 0.07).alias("any_high_tax"),
        F.max_by("l_orderkey", F.struct("l_extendedprice", "l_orderkey")).alias("dearest_order"),
        F.countDistinct("l_partkey").alias("parts"),
    ).where("returned > 10")


def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = top_k(load(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3)
    return best.select("o_custkey", "o_orderkey", "o_totalprice", "rank")


def format_round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and their rows as they come back from each format."""
    rows = load(spark, sf_dir, "supplier")
    with scratch(spark) as place:
        found = None
        for fmt in ("parquet", "orc", "csv", "json", "xml"):
            save(rows, f"{place}/{fmt}", fmt)
            own = read(spark, f"{place}/{fmt}", fmt, rows.schema).select(F.lit(fmt).alias("format"), *rows.columns)
            found = own if found is None else found.unionByName(own)
        lines = rows.select("s_name")
        save(lines, f"{place}/text", "text")
        names = read(spark, f"{place}/text", "text").select(F.lit("text").alias("format"), F.col("value").alias("s_name"))
        return durable(found.unionByName(names, allowMissingColumns=True))


def partitioned_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written in a folder for each status; only the folder asked for is read."""
    with scratch(spark) as place:
        save(load(spark, sf_dir, "orders"), place, partition_by=("o_orderstatus",))
        urgent = read(spark, place).where("o_orderstatus = 'F'")
        return durable(urgent.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), exact_sum("o_totalprice").alias("total")))


def _both(sql: str, *tables: str):
    """A query whose SQL is the same in Spark and elsewhere; tables are named by path, so no view is made."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = sql
        for name in tables:
            text = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 parquet.`{sf_dir}/{name}.parquet`", text)
        return spark.sql(text)

    return run


SHARED = {
    "set_union": ("SELECT s_nationkey AS k FROM supplier UNION SELECT n_nationkey FROM nation", ("supplier", "nation")),
    "set_union_all": ("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier", ("customer", "supplier")),
    "set_intersect_all": ("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier", ("customer", "supplier")),
    "set_intersect": ("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier", ("customer", "supplier")),
    "set_except": ("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000", ("supplier", "nation")),
    "set_except_all": ("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier", ("customer", "supplier")),
    "cross_regions": ("SELECT a.r_name AS a, b.n_name AS b FROM region a CROSS JOIN nation b", ("region", "nation")),
    "correlated_scalar": (
        "SELECT o_orderkey, o_totalprice FROM orders o WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)",
        ("orders",),
    ),
    "exists_and_in": (
        "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 45)"
        " AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 48)",
        ("part", "lineitem"),
    ),
    "grouping_sets": (
        "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())",
        ("customer",),
    ),
    "having_counts": ("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey HAVING count(*) > 35", ("lineitem",)),
    "recursive_reach": (
        "WITH RECURSIVE r(k, hops) AS (SELECT min(s_suppkey), 0 FROM supplier UNION ALL SELECT s_suppkey, hops + 1 FROM r JOIN supplier ON s_suppkey = 2 * k + 1) SELECT k, hops FROM r",
        ("supplier",),
    ),
    "lateral_last_order": (
        "SELECT c_custkey, t.o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 1) t",
        ("customer", "orders"),
    ),
    "like_and_case": (
        "SELECT p_brand, count(CASE WHEN p_type LIKE '%A%' THEN 1 END) AS with_a, count(*) AS n FROM part WHERE p_size BETWEEN 10 AND 40 GROUP BY p_brand",
        ("part",),
    ),
}

def suppliers_within_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that the first supplier of each nation reaches over parts that two suppliers both sold at a large discount."""
    suppliers = load(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("source"))
    sold = load(spark, sf_dir, "lineitem").where("l_quantity >= 48 and l_discount >= 0.09").select("l_suppkey", "l_partkey").distinct()
    # A part's suppliers are linked through the part, as a number below zero, so that a part of many suppliers is many links, not many pairs.
    part = -F.col("l_partkey") - 1
    links = sold.select(F.col("l_suppkey").alias("a"), part.alias("b")).union(sold.select(part.alias("a"), F.col("l_suppkey").alias("b")))
    found = reachable(suppliers, links, "source", "a", "b")
    return found.where("node >= 0").select("source", F.col("node").alias("reached"), (F.col("hops") / 2).cast("int").alias("hops"))


def lateral_last_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's last order, of those of one day the one with the least key.

    The inner query gives out what it sorts by: Spark's rewriting of LATERAL with LIMIT keeps an order only if the sort stands right
    below the limit, and a projection of other columns comes in between.
    """
    return spark.sql(
        f"SELECT c_custkey, t.o_orderkey FROM parquet.`{sf_dir}/customer.parquet`, LATERAL (SELECT o_orderkey, o_orderdate"
        f" FROM parquet.`{sf_dir}/orders.parquet` WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey NULLS LAST LIMIT 1) t"
    )


def _open_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the days, counted from 1970, from the order to the last shipment (``ended`` is the day after)."""
    last = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last"))
    day = lambda c: F.unix_date(F.col(c).cast("date")).cast("long")
    joined = load(spark, sf_dir, "orders").join(last, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.select("o_custkey", "o_orderkey", day("o_orderdate").alias("began"), (day("last") + 1).alias("ended"))


def orders_open_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of orders of one customer that are open at the same time, and for how many days: intervals against intervals."""
    orders = durable(_open_orders(spark, sf_dir))
    one = orders.select("o_custkey", F.col("o_orderkey").alias("first"), F.col("began").alias("a"), F.col("ended").alias("b"))
    two = orders.select("o_custkey", F.col("o_orderkey").alias("second"), F.col("began").alias("c"), F.col("ended").alias("d"))
    met = overlap_join(one, two, ("a", "c"), ("b", "d"), ["o_custkey"]).where("first < second")
    return met.select("o_custkey", "first", "second", (F.least("b", "d") - F.greatest("a", "c")).alias("days"))


def open_orders_by_campaign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that are open at some time of a campaign: one of a week, a month, a quarter or a year for each part of a promoted type.

    Campaigns begin on a day that follows from the part. Most campaigns meet a good part of all orders, so orders are counted by
    running totals over days; pairs would grow with the square of the tables.
    """
    promoted = load(spark, sf_dir, "part").where("p_size % 10 = 0")
    began = F.lit(9131).cast("long") + F.col("p_partkey") * 37 % 2400
    length = F.element_at(F.array(*[F.lit(n) for n in (7, 30, 90, 365)]), (F.col("p_partkey") % 4 + 1).cast("int"))
    campaigns = promoted.select("p_partkey", began.alias("starts"), (began + length).alias("stops"))
    met = overlap_totals(_open_orders(spark, sf_dir), campaigns, ("began", "starts"), ("ended", "stops"), "orders", "days")
    return met.groupBy("p_partkey").agg(F.sum("orders").alias("orders"), F.sum("days").alias("days"))


#: Rows of a bucket, about, and the fewest buckets.
BUCKET_ROWS, LEAST_BUCKETS = 1 << 20, 8


def bucketed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and lines as tables bucketed and sorted by order: joined and summed by order without an exchange.

    There are as many buckets as make about ``BUCKET_ROWS`` rows of the larger table each, so what a task sorts does not grow with the tables
    (up to Spark's bound of ``spark.sql.sources.bucketing.maxBuckets``, 100,000).
    """
    name = f"quern_{uuid.uuid4().hex}"
    tables = {f"{name}_orders": ("orders", "o_orderkey", ["o_orderkey", "o_orderpriority"]), f"{name}_lines": ("lineitem", "l_orderkey", ["l_orderkey", "l_quantity"])}
    most = max(load(spark, sf_dir, source).count() for source, _, _ in tables.values())
    buckets = max(LEAST_BUCKETS, -(-most // BUCKET_ROWS))
    try:
        for table, (source, key, columns) in tables.items():
            save_bucketed(load(spark, sf_dir, source).select(*columns), table, [key], buckets)
        return durable(bucketed_sums(spark, *tables))
    finally:
        for table in tables:
            spark.sql(f"DROP TABLE IF EXISTS {table}")


def bucketed_sums(spark: SparkSession, orders: str, lines: str) -> DataFrame:
    """Quantities by order, from two tables that are bucketed by it."""
    o, li = spark.table(orders), spark.table(lines)
    joined = o.join(li.hint("merge"), o["o_orderkey"] == li["l_orderkey"])
    return joined.groupBy("o_orderkey", "o_orderpriority").agg(exact_sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("n"))


#: Shared texts that Spark runs in a form of its own.
APART = {"lateral_last_order": lateral_last_order}

QUERIES = {
    "pricing_summary": pricing_summary,
    "revenue_by_nation": revenue_by_nation,
    "shipping_priority": shipping_priority,
    "orders_full_outer": orders_full_outer,
    "customers_with_events": customers_with_events,
    "orders_without_lines": orders_without_lines,
    "orders_in_price_bands": orders_in_price_bands,
    "rollup_sales": rollup_sales,
    "cube_sales": cube_sales,
    "pivot_priorities": pivot_priorities,
    "unpivot_parts": unpivot_parts,
    "filtered_aggregates": filtered_aggregates,
    "top_orders": top_orders,
    "format_round_trips": format_round_trips,
    "partitioned_orders": partitioned_orders,
    "suppliers_within_reach": suppliers_within_reach,
    "orders_open_together": orders_open_together,
    "open_orders_by_campaign": open_orders_by_campaign,
    "bucketed_join": bucketed_join,
} | {name: _both(sql, *tables) for name, (sql, tables) in SHARED.items() if name not in APART} | APART

_OPEN = """SELECT o_custkey, o_orderkey, (o_orderdate::DATE - DATE '1970-01-01')::BIGINT AS began, (max(l_shipdate)::DATE - DATE '1970-01-01')::BIGINT + 1 AS ended
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey, o_orderkey, o_orderdate"""
SQL = {
    "pricing_summary": f"""
        SELECT l_returnflag, l_linestatus, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS sum_qty, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS sum_price,
               sum({_NET})::DOUBLE AS sum_net, sum(l_discount::DECIMAL(18,2))::DOUBLE / count(l_discount) AS avg_discount, count(*) AS n
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY ALL""",
    "revenue_by_nation": f"""
        SELECT r_name, n_name, sum({_NET})::DOUBLE AS revenue, count(DISTINCT c_custkey) AS customers
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
             JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1999-01-01' GROUP BY ALL""",
    "shipping_priority": f"""
        SELECT o_orderkey, o_orderdate, sum({_NET})::DOUBLE AS revenue
        FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
        WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1998-03-15'
        GROUP BY ALL ORDER BY revenue DESC, o_orderkey LIMIT 10""",
    "orders_full_outer": """
        WITH u AS (SELECT user_id, count(*) AS events FROM events GROUP BY 1),
             o AS (SELECT o_custkey, count(*) AS orders FROM orders WHERE o_totalprice > 300000 GROUP BY 1)
        SELECT coalesce(user_id, o_custkey) AS key, coalesce(events, 0) AS events, coalesce(orders, 0) AS orders FROM u FULL JOIN o ON user_id = o_custkey""",
    "customers_with_events": """
        SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND event_type = 'purchase')""",
    "orders_without_lines": "SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
    "orders_in_price_bands": """
        SELECT n_name, count(*) AS orders, min(o_totalprice) AS cheapest
        FROM orders JOIN nation ON o_totalprice >= n_nationkey * 15000.0 AND o_totalprice < n_nationkey * 15000.0 + 40000.0 GROUP BY 1""",
    "rollup_sales": """
        SELECT l_returnflag, l_linestatus, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS qty, grouping(l_returnflag, l_linestatus)::INT AS level
        FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
    "cube_sales": """
        SELECT o_orderstatus, o_orderpriority, count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total
        FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""",
    "pivot_priorities": """
        SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p
        FROM orders GROUP BY 1""",
    "unpivot_parts": """
        SELECT p_partkey, 'size' AS measure, p_size::DOUBLE AS amount FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part""",
    "filtered_aggregates": """
        SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS returned, sum(CASE WHEN l_discount >= 0.05 THEN l_quantity::DECIMAL(18,2) END)::DOUBLE AS discounted_qty,
               bool_or(l_tax > 0.07) AS any_high_tax, (max({'a': l_extendedprice, 'b': l_orderkey})).b AS dearest_order, count(DISTINCT l_partkey) AS parts
        FROM lineitem GROUP BY 1 HAVING returned > 10""",
    "top_orders": """
        SELECT o_custkey, o_orderkey, o_totalprice, rank::INT AS rank FROM (
            SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3""",
    "format_round_trips": """
        SELECT format, s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier, (VALUES ('parquet'), ('orc'), ('csv'), ('json'), ('xml')) f(format)
        UNION ALL SELECT 'text', NULL, s_name, NULL, NULL FROM supplier""",
    "partitioned_orders": """
        SELECT o_orderpriority, count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY 1""",
    "suppliers_within_reach": """
        WITH RECURSIVE sold AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_quantity >= 48 AND l_discount >= 0.09),
             links AS (SELECT DISTINCT a.l_suppkey AS a, b.l_suppkey AS b FROM sold a JOIN sold b USING (l_partkey)),
             r AS (SELECT min(s_suppkey) AS source, min(s_suppkey) AS reached, 0 AS hops FROM supplier GROUP BY s_nationkey
                   UNION SELECT source, b, hops + 1 FROM r JOIN links ON a = reached WHERE hops < 60)
        SELECT source, reached, min(hops)::INT AS hops FROM r GROUP BY ALL""",
    "orders_open_together": f"""
        WITH o AS ({_OPEN})
        SELECT x.o_custkey, x.o_orderkey AS first, y.o_orderkey AS second, least(x.ended, y.ended) - greatest(x.began, y.began) AS days
        FROM o x JOIN o y ON x.o_custkey = y.o_custkey AND x.o_orderkey < y.o_orderkey AND x.began < y.ended AND y.began < x.ended
        WHERE x.began < x.ended AND y.began < y.ended""",
    "open_orders_by_campaign": f"""
        WITH o AS ({_OPEN}),
             c AS (SELECT p_partkey, 9131 + p_partkey * 37 % 2400 AS starts, 9131 + p_partkey * 37 % 2400 + [7, 30, 90, 365][(p_partkey % 4 + 1)::INT] AS stops FROM part WHERE p_size % 10 = 0)
        SELECT p_partkey, count(*) AS orders, sum(least(ended, stops) - greatest(began, starts))::BIGINT AS days
        FROM o JOIN c ON began < stops AND starts < ended WHERE began < ended GROUP BY 1""",
    "bucketed_join": """
        SELECT o_orderkey, o_orderpriority, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS quantity, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL""",
} | {name: sql for name, (sql, _) in SHARED.items()}
