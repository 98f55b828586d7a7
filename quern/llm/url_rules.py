"""URL allow and block rules by a sort-merge range join (operator 10), DataFrame functions only."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import clamp_partitions, durable, table

#: Points in one range of the sweep.
RANGE_ROWS = 1 << 17

RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty without ``://`` or for null.

    The host runs from after the first ``://`` to ``/``, ``?``, ``#`` or the end
    and has A-Z lower-cased; the path runs from there to ``?``, ``#`` or the end.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    fold = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(fold, F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host: Column) -> Column:
    """Labels from the last to the first, each with a dot after it: a domain is a prefix of its subdomains."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def prefix_stacks(starts: DataFrame, points: DataFrame) -> DataFrame:
    """For each distinct ``key`` of ``points`` the keys of ``starts`` that are its prefixes, shortest first.

    A prefix is the interval of the keys that begin with it, and such intervals
    nest. Starts and points are sorted together into ranges of bounded size and
    swept in order. Each start carries the stack that is active from it on (itself
    and the starts around it), so the last start at or before a point, less what
    the point is no longer inside of, is the point's stack. The stack at the
    beginning of a range comes from the last start of the ranges before it.
    Returns ``key`` and ``stack``, for points with at least one prefix.
    """
    distinct = durable(starts.select("key").distinct())
    prefix = F.explode(F.sequence(F.lit(1), F.length("key")))
    inside = distinct.select(F.col("key").alias("start"), prefix.alias("n")).select("start", F.substring(F.col("start"), F.lit(1), F.col("n")).alias("key"))
    opened = inside.join(distinct, "key").groupBy("start").agg(F.array_sort(F.collect_list("key")).alias("opened"))
    events = opened.select(F.col("start").alias("key"), "opened").union(
        points.select("key").distinct().select("key", F.lit(None).cast("array<string>"))
    )
    events = durable(events)
    ranges = clamp_partitions(events.count(), RANGE_ROWS)
    sorted_ = durable(events.repartitionByRange(ranges, "key").withColumn("range", F.spark_partition_id()))
    ends = sorted_.where("opened is not null").groupBy("range").agg(F.max_by("opened", "key").alias("last"))
    # One row for each range, so few that Spark may choose to send them; nothing bids it to.
    whole = sorted_.select("range").distinct().join(ends, "range", "left")
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    carried = durable(whole.select("range", F.last("last", ignorenulls=True).over(before).alias("carried")))
    # A start comes before a point of the same key: it is the one that is not null.
    sweep = W.partitionBy("range").orderBy("key", F.col("opened").isNull()).rowsBetween(W.unboundedPreceding, W.currentRow)
    swept = sorted_.withColumn("active", F.last("opened", ignorenulls=True).over(sweep)).where("opened is null")
    swept = swept.join(carried, "range").select("key", F.coalesce("active", "carried").alias("active"))
    stack = F.filter("active", lambda start: F.startswith(F.col("key"), start))
    return swept.select("key", stack.alias("stack")).where(F.size("stack") > 0)


def judge_urls(pages: DataFrame, rules: DataFrame, *, default: str = "allow") -> DataFrame:
    """The rule that decides each row of ``pages`` (``page_id``, ``url``).

    ``rules`` has ``verdict``, ``host`` and ``path``. A rule fits its host and all
    its subdomains if the url's path starts with the rule's path; the longest
    rule (host and path together) wins, then the one with the longer host, then
    ``allow``. Without a fitting rule the verdict is ``default`` and rule is null.
    Returns ``page_id``, ``host``, ``path``, ``rule``, ``verdict``.

    Method. Two sort-merge range joins by ``prefix_stacks``: first over distinct
    reversed hosts, which finds the rules' hosts around each host; then over
    distinct (rule host, path) keys, which finds the rules' paths around each
    path. Repeated urls are judged once; the verdicts join back to all rows, and
    adaptive execution may split a hot url there.

    Defined cases. Null url or no ``://``: host and path are empty and no rule
    fits. Repeated rows each get a row. Rules with null parts are left out, and
    repeated rules count once (``allow`` before ``block``). Empty tables give
    empty results or, without rules, the default. Other columns are ignored.
    """
    rules = rules.where("verdict is not null and host is not null and path is not null")
    rules = durable(rules.groupBy("host", "path").agg(F.min("verdict").alias("verdict")).withColumn("node", host_key(F.col("host"))))
    host, path = url_parts(F.col("url"))
    pages = durable(pages.select(F.col("page_id"), host.alias("host"), path.alias("path")))
    hosts = pages.select("host").distinct().select("host", host_key(F.col("host")).alias("key"))
    nodes = prefix_stacks(rules.select(F.col("node").alias("key")), hosts)
    hosts = durable(hosts.join(nodes, "key").select("host", F.explode("stack").alias("node")))

    key = F.concat("node", F.lit("/"), "path")  # no node holds a slash
    asked = durable(pages.select("host", "path").distinct().join(hosts, "host").withColumn("key", key))
    known = rules.withColumn("key", key)
    found = prefix_stacks(known.select("key"), asked).select("key", F.try_element_at("stack", F.lit(-1)).alias("rule_key"))
    known = known.select(F.col("key").alias("rule_key"), F.concat(F.col("host"), F.col("path")).alias("rule"), F.length("host").alias("n"), "verdict")
    fits = asked.join(found, "key").join(known, "rule_key")
    order = F.struct(F.length("rule"), "n")
    best = durable(fits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), order).alias("best")))
    return pages.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


def rules_frame(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """Rules (verdict, host, path) as literal rows of the plan; a large set is better read as a table of its own."""
    rows = [F.struct(*[F.lit(x).cast("string").alias(c) for c, x in zip(("verdict", "host", "path"), rule, strict=True)]) for rule in rules]
    kind = "array<struct<verdict:string,host:string,path:string>>"
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*rows).cast(kind)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), rules_frame(spark, RULES))


_VALUES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
SQL = f"""
WITH cut AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
    SELECT page_id,
           translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM cut
), rules(verdict, h, p) AS (VALUES {_VALUES}), fits AS (
    SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
    FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
    GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (page_id)
"""
