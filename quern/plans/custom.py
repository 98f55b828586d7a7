"""Functions of one's own: Python and pandas functions, table functions, SQL functions, grouped maps.

Most show how a function of one's own is made and used; built-in functions could
say what these say, and their SQL does. ``thinned_events`` is for what they can't. Each group
that goes to Python whole is bounded by its nature (the lines of one order). Such groups are small, so a call gets a part of many
of them; a table function gets its rows one by one.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from ..functions import micros
from ..sources import load


#: Rows of a part that goes to Python in one call, about.
PART_ROWS = 1 << 16


def _parts(key: str, rows: int) -> Column:
    """The part of a row: whole groups of ``key`` are dealt to as many parts as make about ``PART_ROWS`` of ``rows`` rows each.

    A call of a Python function costs more than the rows of a small group; there are as many calls as parts. Rows
    without a key have a part of their own, so that keys stay whole numbers in pandas.
    """
    dealt = F.pmod(F.xxhash64(key), F.lit(max(1, -(-rows // PART_ROWS))))
    return F.when(F.col(key).isNull(), F.lit(-1)).otherwise(dealt).alias("part")


def row_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python function of one value at a time."""
    initials = F.udf(lambda name: "".join(w[0] for w in name.split()), "string")
    return load(spark, sf_dir, "part").select("p_partkey", initials("p_name").alias("initials"))


def vector_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pandas function of whole columns, in Arrow batches."""

    @F.pandas_udf("long")
    def check_digit(order: pd.Series, line: pd.Series) -> pd.Series:
        return (order * 7 + order // 10 * 3 + line) % 11

    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", check_digit("l_orderkey", "l_linenumber").alias("digit"))


def aggregate_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pandas aggregate of each order's lines: largest less least quantity, for all orders of a part in one value."""

    @F.pandas_udf("array<struct<l_orderkey:long,span:double>>")
    def spans(orders: pd.Series, values: pd.Series) -> list:
        found = values.groupby(orders, dropna=False).agg(["max", "min"])
        keys = [None if pd.isna(k) else int(k) for k in found.index]
        return [{"l_orderkey": k, "span": None if pd.isna(v) else v} for k, v in zip(keys, (found["max"] - found["min"]).tolist(), strict=True)]

    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")
    found = lines.groupBy(_parts("l_orderkey", lines.count())).agg(spans("l_orderkey", "l_quantity").alias("spans"))
    return found.select(F.inline("spans"))


def window_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same aggregate beside each line, as over a window: other columns pass through in Arrow."""

    def beside(lines: pa.Table) -> pa.Table:
        values = lines["l_quantity"].to_pandas().groupby(lines["l_orderkey"].to_pandas(), dropna=False)
        span = values.transform("max") - values.transform("min")
        return lines.drop(["l_quantity"]).append_column("span", pa.array(span, pa.float64(), from_pandas=True))

    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return lines.groupBy(_parts("l_orderkey", lines.count())).applyInArrow(beside, "l_orderkey long, l_linenumber int, l_partkey long, span double")


def table_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python table function, joined laterally."""

    @F.udtf(returnType="word string, place int")
    class NameWords:
        def eval(self, name: str):
            yield from ((word, place) for place, word in enumerate(name.split()))

    spark.udtf.register("quern_name_words", NameWords)
    return spark.sql(f"SELECT p_partkey, w.word, w.place FROM parquet.`{sf_dir}/part.parquet`, LATERAL quern_name_words(p_name) w")


class Thinned:
    """Table function: rows of an ordered partition of which each is at least ``gap`` seconds after the last one kept.

    What is kept depends on all that was kept before, which no window can say. The columns that are handed
    on are an argument, and the schema follows from it. State is one number, whatever the partition's size.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, gap: AnalyzeArgument, columns: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or "at" not in rows.dataType.names:
            raise ValueError("rows is to be a table with a column at, in microseconds")
        names = [c.strip() for c in columns.value.split(",")]
        fields = [rows.dataType[n] for n in names]
        return AnalyzeResult(StructType([*fields, StructField("place", LongType())]), partitionBy=[PartitioningColumn("user_id")], orderBy=[OrderingColumn("at"), OrderingColumn("event_id")])

    def __init__(self) -> None:
        self.kept, self.place = None, 0

    def eval(self, row: Row, gap: int, columns: str):
        if self.kept is None or row["at"] - self.kept >= gap * 1_000_000:
            yield (*[row[c.strip()] for c in columns.split(",")], self.place)
            self.kept, self.place = row["at"], self.place + 1


def thinned_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user's events, the first, and then each next one at least six hours after the last one kept."""
    events = load(spark, sf_dir, "events")
    events.select("event_id", "user_id", micros("ts", dict(events.dtypes)["ts"]).alias("at")).createOrReplaceTempView("quern_thinned_input")
    spark.udtf.register("quern_thinned", F.udtf(Thinned))
    return spark.sql("SELECT user_id, event_id, place FROM quern_thinned(TABLE(quern_thinned_input), 21600, 'user_id, event_id')")


def sql_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function defined in SQL, which Spark writes into the plan."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION quern_cents(amount DOUBLE) RETURNS BIGINT RETURN CAST(round(amount * 100) AS BIGINT)")
    lines = load(spark, sf_dir, "lineitem")
    return lines.groupBy("l_suppkey").agg(F.sum(F.expr("quern_cents(l_extendedprice)")).alias("cents"))


def grouped_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line's share of its order, by a function of a part of the orders as one frame."""

    def shares(lines: pd.DataFrame) -> pd.DataFrame:
        cents = (lines["l_extendedprice"] * 100).round()
        whole = cents.groupby(lines["l_orderkey"], dropna=False).transform("sum")
        return pd.DataFrame({"l_orderkey": lines["l_orderkey"], "l_linenumber": lines["l_linenumber"], "share": cents / whole})

    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return lines.groupBy(_parts("l_orderkey", lines.count())).applyInPandas(shares, "l_orderkey long, l_linenumber int, share double")


def cogrouped_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and their lines, brought together as two frames of one part of the orders."""

    def joined(orders: pd.DataFrame, lines: pd.DataFrame) -> pd.DataFrame:
        times = orders["o_orderkey"].value_counts(dropna=False)
        cents = (lines["l_extendedprice"] * 100).round().astype("Int64")
        found = cents.groupby(lines["l_orderkey"]).agg(["size", "sum"]).reindex(times.index, fill_value=0)
        return pd.DataFrame({"o_orderkey": times.index, "lines": (found["size"] * times).to_numpy("int64"), "cents": (found["sum"] * times).to_numpy("int64")})

    orders = load(spark, sf_dir, "orders").select("o_orderkey")
    lines = load(spark, sf_dir, "lineitem").where("l_orderkey is not null").select("l_orderkey", "l_extendedprice")
    rows = max(orders.count(), load(spark, sf_dir, "lineitem").count())
    both = orders.groupBy(_parts("o_orderkey", rows)).cogroup(lines.groupBy(_parts("l_orderkey", rows)))
    return both.applyInPandas(joined, "o_orderkey long, lines long, cents long")


QUERIES = {
    "row_udf": row_udf,
    "vector_udf": vector_udf,
    "aggregate_udf": aggregate_udf,
    "window_udf": window_udf,
    "table_udf": table_udf,
    "thinned_events": thinned_events,
    "sql_udf": sql_udf,
    "grouped_map": grouped_map,
    "cogrouped_map": cogrouped_map,
}

_CENTS = "round(l_extendedprice * 100)::BIGINT"
SQL = {
    "row_udf": "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: w[1]), '') AS initials FROM part",
    "vector_udf": "SELECT l_orderkey, l_linenumber, (l_orderkey * 7 + l_orderkey // 10 * 3 + l_linenumber) % 11 AS digit FROM lineitem",
    "aggregate_udf": "SELECT l_orderkey, max(l_quantity) - min(l_quantity) AS span FROM lineitem GROUP BY 1",
    "window_udf": "SELECT l_orderkey, l_linenumber, l_partkey, max(l_quantity) OVER w - min(l_quantity) OVER w AS span FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)",
    "table_udf": """
        SELECT p_partkey, unnest(s) AS word, unnest(range(len(s)))::INT AS place FROM (SELECT p_partkey, string_split(p_name, ' ') AS s FROM part)""",
    "thinned_events": """
        WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS tick FROM events),
             nxt AS (SELECT a.user_id, a.event_id, min((b.tick, b.event_id)) AS b FROM e a JOIN e b ON a.user_id = b.user_id AND b.tick >= a.tick + 21600000000 GROUP BY ALL),
             kept AS (SELECT user_id, min((tick, event_id))[2] AS event_id, 0::BIGINT AS place FROM e GROUP BY user_id
                      UNION ALL SELECT k.user_id, n.b[2], place + 1 FROM kept k JOIN nxt n ON n.event_id = k.event_id)
        SELECT user_id, event_id, place FROM kept""",
    "sql_udf": f"SELECT l_suppkey, sum({_CENTS})::BIGINT AS cents FROM lineitem GROUP BY 1",
    "grouped_map": f"SELECT l_orderkey, l_linenumber, {_CENTS} / sum({_CENTS}) OVER (PARTITION BY l_orderkey)::DOUBLE AS share FROM lineitem",
    "cogrouped_map": f"""
        SELECT o_orderkey, count(l_orderkey) AS lines, coalesce(sum({_CENTS}), 0)::BIGINT AS cents FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""",
}
