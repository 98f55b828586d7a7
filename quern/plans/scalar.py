"""Scalar, array, map and JSON functions, and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import money, population_skewness
from ..operators import modes, quantiles, sketches
from ..sources import durable, load, read, save, scratch


def strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = load(spark, sf_dir, "part")
    return parts.select(
        "p_partkey",
        F.length("p_name").alias("n"),
        F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("padded"),
        F.md5("p_name").alias("digest"),
        F.split_part("p_name", F.lit(" "), F.lit(1)).alias("first_word"),
        F.levenshtein("p_name", "p_type").alias("distance"),
        F.concat_ws("/", "p_brand", "p_type").alias("joined"),
        F.regexp_replace("p_name", "[aeiou]", "").alias("consonants"),
    )


def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    day = F.col("o_orderdate").cast("date")
    return orders.select(
        "o_orderkey",
        F.year(day).alias("y"),
        F.quarter(day).alias("q"),
        F.dayofyear(day).alias("doy"),
        F.last_day(day).alias("month_end"),
        F.date_add(day, 45).alias("due"),
        F.datediff(F.lit("2002-01-01").cast("date"), day).alias("age"),
    )


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = load(spark, sf_dir, "customer")
    return cust.select(
        "c_custkey",
        F.floor("c_acctbal").alias("down"),
        F.ceil("c_acctbal").alias("up"),
        F.abs("c_acctbal").alias("size"),
        F.pmod(F.col("c_custkey"), F.lit(7)).alias("rest"),
        F.greatest("c_acctbal", F.lit(0.0)).alias("credit"),
        F.signum("c_acctbal").cast("int").alias("sign"),
        (F.col("c_custkey").bitwiseXOR(F.lit(85))).alias("mixed"),
    )


def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    parsed = events.select("event_type", F.from_json("props", "k long").alias("p"))
    return parsed.groupBy("event_type").agg(F.sum("p.k").alias("total"), F.max("p.k").alias("most"), F.count("p.k").alias("n"))


def arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted distinct items of each order, and what higher-order functions make of them."""
    lines = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("s"))
    return lines.select(
        "l_orderkey",
        F.size("s").alias("n"),
        F.get("s", F.lit(0)).alias("least"),
        F.size(F.filter("s", lambda x: x % 2 == 0)).alias("even"),
        F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"),
        F.array_join(F.transform("s", lambda x: x.cast("string")), ",").alias("shown"),
    )


def exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = load(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("place", "x"))
    return flat.groupBy("label", "place").agg(F.max("x").alias("most"), F.min("x").alias("least"))


def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = load(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    by_user = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return by_user.select("user_id", F.coalesce(F.col("m")["click"], F.lit(0)).alias("clicks"), F.size("m").alias("kinds"), F.array_join(F.array_sort(F.map_keys("m")), ",").alias("names"))


def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments from exact power sums of whole numbers, so that they do not depend on the order of rows."""
    q = money("l_quantity", 0).cast("long")
    sums = load(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.lit(1).cast("long") * _power(q, k)).cast("double").alias(f"s{k}") for k in (1, 2, 3)]
    )
    n, s1, s2, s3 = (F.col(c) for c in ("n", "s1", "s2", "s3"))
    return sums.select("l_returnflag", "n", F.round((s2 - s1 * s1 / n) / (n - 1), 6).alias("variance"), F.round(population_skewness(n, s1, s2, s3), 6).alias("skewness"))


def _power(x, k: int):
    out = x
    for _ in range(k - 1):
        out = out * x
    return out


def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of a few large groups."""
    ends = [F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most")]
    return quantiles(load(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", {"p25": ("disc", 0.25), "p90": ("disc", 0.9)}, ends)


def approximate_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HyperLogLog estimates; they have an error bound instead of an equal elsewhere."""
    return load(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"))


def daily_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and values of each span of seven days, from stored sketches of single days: an estimate without another look at the events.

    ``returning`` are users of both the span and the one before it, ``lost`` those of the one before alone.
    """
    events = load(spark, sf_dir, "events")
    with scratch(spark) as place:
        save(sketches.sketched(events, [F.to_date("ts").alias("day")], "user_id", "value"), place)
        days = read(spark, place)
        week = F.floor(F.datediff("day", F.lit("2024-01-01").cast("date")) / 7).cast("int").alias("week")
        weeks = durable(sketches.united(days, [week]))
    before = weeks.select((F.col("week") + 1).alias("week"), F.col("theta").alias("theta_before"))
    both = weeks.join(before, "week", "left")
    return both.select(
        "week", "n", sketches.distinct_items("hll").alias("users"), sketches.quantile("kll", 0.5).alias("median_value"),
        sketches.common_items("theta", "theta_before").alias("returning"), sketches.items_only_in("theta_before", "theta").alias("lost"),
    )


def text_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String functions that agree on ASCII."""
    cust = load(spark, sf_dir, "customer")
    return cust.select(
        "c_custkey",
        F.upper("c_name").alias("loud"),
        F.lower("c_mktsegment").alias("quiet"),
        F.substr("c_name", F.lit(10), F.lit(4)).alias("part"),
        F.concat(F.col("c_mktsegment"), F.lit(":"), F.col("c_name")).alias("both"),
        F.regexp_extract("c_name", "([1-9][0-9]*)$", 1).alias("digits"),
        F.translate("c_mktsegment", "AEIOU", "aeiou").alias("swapped"),
        F.instr("c_name", "#").alias("hash_at"),
        F.reverse("c_mktsegment").alias("back"),
        F.rtrim(F.rpad("c_mktsegment", 14, " ")).alias("trimmed"),
    )


def times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truncation, intervals and differences of timestamps."""
    events = load(spark, sf_dir, "events")
    first = F.lit("2024-01-01").cast("timestamp_ntz")
    return events.select(
        "event_id",
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour_start"),
        (F.col("ts") + F.expr("INTERVAL 36 HOURS")).alias("later"),
        F.add_months(F.col("ts").cast("date"), 1).alias("next_month"),
        F.timestamp_diff("MINUTE", first, F.col("ts")).alias("minutes"),
        F.date_format("ts", "yyyy/MM/dd HH:mm").alias("shown"),
        (F.dayofweek("ts") - 1).alias("weekday"),
        F.extract(F.lit("HOUR"), "ts").cast("int").alias("hour_no"),
    )


def quotients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Division, rounding and logarithms; the last digits of transcendental functions differ between machines and are rounded off."""
    lines = load(spark, sf_dir, "lineitem")
    return lines.select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"),
        F.try_divide(F.col("l_extendedprice"), F.col("l_tax")).alias("by_tax"),
        F.round(money("l_extendedprice"), 1).cast("double").alias("rounded"),
        F.round(F.ln("l_extendedprice"), 9).alias("log_price"),
        F.round(F.sqrt("l_quantity"), 9).alias("root"),
        F.round(F.pow(F.col("l_discount") + 1, F.lit(3.0)), 9).alias("cubed"),
        F.expr("l_partkey div 7").alias("whole"),
        F.least("l_tax", "l_discount").alias("lesser"),
    )


def spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviations, correlation and kurtosis (population form), rounded."""
    lines = load(spark, sf_dir, "lineitem")
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.stddev("l_quantity"), 6).alias("deviation"),
        F.round(F.stddev_pop("l_quantity"), 6).alias("deviation_pop"),
        F.round(F.var_pop("l_quantity"), 6).alias("variance_pop"),
        F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("together"),
        F.round(F.covar_samp("l_quantity", "l_discount"), 6).alias("covariance"),
        F.round(F.kurtosis("l_quantity"), 5).alias("tails"),
    )


def middles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, interpolated percentiles and the mode (of equally frequent values the least)."""
    lines = load(spark, sf_dir, "lineitem")
    middle = quantiles(lines, ["l_returnflag"], "l_quantity", {"middle": ("cont", 0.5)})
    p90 = quantiles(lines, ["l_returnflag"], "l_extendedprice", {"p90": ("cont", 0.9)})
    commonest = modes(lines, ["l_returnflag"], "l_quantity", "commonest")
    return middle.join(p90, "l_returnflag").join(commonest, "l_returnflag").select("l_returnflag", "middle", F.round("p90", 6).alias("p90"), "commonest")


def json_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON field by path, through the variant type, and as columns."""
    events = load(spark, sf_dir, "events")
    return events.select(
        "event_id",
        F.get_json_object("props", "$.k").alias("by_path"),
        F.variant_get(F.parse_json("props"), "$.k", "bigint").alias("by_variant"),
        F.get_json_object("props", "$.none").alias("missing"),
        F.to_json(F.struct(F.col("event_type").alias("t"), F.col("user_id").alias("u"))).alias("made"),
    )


def map_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps from arrays, with their values changed and filtered."""
    lines = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("s"))
    built = lines.select("l_orderkey", F.map_from_arrays("s", F.transform("s", lambda x: x % 10)).alias("m"))
    changed = built.select("l_orderkey", F.transform_values("m", lambda k, v: k + v).alias("m"))
    even = F.map_filter("m", lambda k, v: v % 2 == 0)
    return changed.select(
        "l_orderkey",
        F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"),
        F.size(even).alias("even"),
        F.array_max(F.map_keys("m")).alias("largest"),
    )


QUERIES = {
    "text_parts": text_parts,
    "times": times,
    "quotients": quotients,
    "spreads": spreads,
    "middles": middles,
    "json_paths": json_paths,
    "map_functions": map_functions,
    "strings": strings,
    "dates": dates,
    "numbers": numbers,
    "json_fields": json_fields,
    "arrays": arrays,
    "exploded": exploded,
    "maps": maps,
    "statistics": statistics,
    "percentiles": percentiles,
    "approximate_distinct": approximate_distinct,
    "daily_sketches": daily_sketches,
}

SQL = {
    "text_parts": """
        SELECT c_custkey, upper(c_name) AS loud, lower(c_mktsegment) AS quiet, substr(c_name, 10, 4) AS part, c_mktsegment || ':' || c_name AS both,
               regexp_extract(c_name, '([1-9][0-9]*)$', 1) AS digits, translate(c_mktsegment, 'AEIOU', 'aeiou') AS swapped, instr(c_name, '#')::INT AS hash_at,
               reverse(c_mktsegment) AS back, rtrim(rpad(c_mktsegment, 14, ' ')) AS trimmed
        FROM customer""",
    "times": """
        SELECT event_id, date_trunc('hour', ts)::TIMESTAMP AS hour_start, ts + INTERVAL 36 HOURS AS later, (ts::DATE + INTERVAL 1 MONTH)::DATE AS next_month,
               floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 60000000)::BIGINT AS minutes, strftime(ts, '%Y/%m/%d %H:%M') AS shown,
               dayofweek(ts)::INT AS weekday, hour(ts)::INT AS hour_no
        FROM events""",
    "quotients": """
        SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS unit, l_extendedprice / nullif(l_tax, 0) AS by_tax,
               round(l_extendedprice::DECIMAL(18,2), 1)::DOUBLE AS rounded, round(ln(l_extendedprice), 9) AS log_price, round(sqrt(l_quantity), 9) AS root,
               round(pow(l_discount + 1, 3.0), 9) AS cubed, l_partkey // 7 AS whole, least(l_tax, l_discount) AS lesser
        FROM lineitem""",
    "spreads": """
        SELECT l_returnflag, l_linestatus, round(stddev_samp(l_quantity), 6) AS deviation, round(stddev_pop(l_quantity), 6) AS deviation_pop,
               round(var_pop(l_quantity), 6) AS variance_pop, round(corr(l_quantity, l_extendedprice), 6) AS together,
               round(covar_samp(l_quantity, l_discount), 6) AS covariance,
               round(avg((l_quantity - m) ** 4) / var_pop(l_quantity) ** 2 - 3, 5) AS tails
        FROM (SELECT *, avg(l_quantity) OVER (PARTITION BY l_returnflag, l_linestatus) AS m FROM lineitem) GROUP BY 1, 2""",
    "middles": """
        WITH c AS (SELECT l_returnflag, l_quantity, row_number() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC, l_quantity) AS place FROM lineitem GROUP BY 1, 2)
        SELECT l_returnflag, median(l.l_quantity) AS middle, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90, any_value(c.l_quantity) AS commonest
        FROM lineitem l JOIN c USING (l_returnflag) WHERE place = 1 GROUP BY 1""",
    "json_paths": """
        SELECT event_id, json_extract_string(props, '$.k') AS by_path, json_extract(props, '$.k')::BIGINT AS by_variant, json_extract_string(props, '$.none') AS missing,
               '{"t":"' || event_type || '","u":' || user_id || '}' AS made
        FROM events""",
    "map_functions": """
        SELECT l_orderkey, sum(p + p % 10)::BIGINT AS total, (count(*) FILTER ((p + p % 10) % 2 = 0))::INT AS even, max(p) AS largest
        FROM (SELECT DISTINCT l_orderkey, l_partkey AS p FROM lineitem) GROUP BY 1""",
    "strings": """
        SELECT p_partkey, length(p_name)::INT AS n, lpad(p_partkey::VARCHAR, 8, '0') AS padded, md5(p_name) AS digest, split_part(p_name, ' ', 1) AS first_word,
               levenshtein(p_name, p_type)::INT AS distance, concat_ws('/', p_brand, p_type) AS joined, regexp_replace(p_name, '[aeiou]', '', 'g') AS consonants
        FROM part""",
    "dates": """
        SELECT o_orderkey, year(o_orderdate)::INT AS y, quarter(o_orderdate)::INT AS q, dayofyear(o_orderdate)::INT AS doy, last_day(o_orderdate) AS month_end,
               o_orderdate::DATE + 45 AS due, (DATE '2002-01-01' - o_orderdate::DATE)::INT AS age
        FROM orders""",
    "numbers": """
        SELECT c_custkey, floor(c_acctbal)::BIGINT AS down, ceil(c_acctbal)::BIGINT AS up, abs(c_acctbal) AS size, c_custkey % 7 AS rest, greatest(c_acctbal, 0.0) AS credit,
               sign(c_acctbal)::INT AS sign, xor(c_custkey, 85) AS mixed
        FROM customer""",
    "json_fields": """
        SELECT event_type, sum(k)::BIGINT AS total, max(k) AS most, count(k) AS n
        FROM (SELECT event_type, json_extract(props, '$.k')::BIGINT AS k FROM events) GROUP BY 1""",
    "arrays": """
        SELECT l_orderkey, len(s)::INT AS n, s[1] AS least, len(list_filter(s, lambda x: x % 2 = 0))::INT AS even, list_sum(s)::BIGINT AS total, array_to_string(s, ',') AS shown
        FROM (SELECT l_orderkey, list_sort(list_distinct(list(l_suppkey))) AS s FROM lineitem GROUP BY 1)""",
    "exploded": """
        SELECT label, (k - 1)::INT AS place, max(embedding[k]) AS most, min(embedding[k]) AS least
        FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS k FROM embeddings) GROUP BY ALL""",
    "maps": """
        SELECT user_id, coalesce(sum(n) FILTER (event_type = 'click'), 0)::BIGINT AS clicks, count(*)::INT AS kinds, string_agg(event_type, ',' ORDER BY event_type) AS names
        FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1""",
    "statistics": """
        WITH s AS (SELECT l_returnflag, count(*) AS n, sum(q)::DOUBLE AS s1, sum(q * q)::DOUBLE AS s2, sum(q * q * q)::DOUBLE AS s3
                   FROM (SELECT l_returnflag, l_quantity::BIGINT AS q FROM lineitem) GROUP BY 1)
        SELECT l_returnflag, n, round((s2 - s1 * s1 / n) / (n - 1), 6) AS variance,
               round((s3 / n - 3 * (s1 / n) * s2 / n + 2 * (s1 / n) ** 3) / (s2 / n - (s1 / n) ** 2) ** 1.5, 6) AS skewness FROM s""",
    "percentiles": """
        SELECT o_orderpriority, percentile_disc(0.25) WITHIN GROUP (ORDER BY o_totalprice) AS p25, percentile_disc(0.9) WITHIN GROUP (ORDER BY o_totalprice) AS p90,
               min(o_totalprice) AS least, max(o_totalprice) AS most
        FROM orders GROUP BY 1""",
}
