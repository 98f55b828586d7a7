"""Balanced label propagation: linked documents share shards of even size (operator 5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, table

#: Most rounds, priority bands in which moves to a shard are admitted.
ROUNDS, BANDS = 12, 1024
#: A row's number in its task, and of tasks in a thousand of them, as bits: rows of a ranking bucket, tasks summed together.
BUCKET_BITS, TASK_BITS, SUMMED_BITS = 14, 33, 10


def _propagate(cells: DataFrame, quotas: list[int], rounds: int) -> DataFrame:
    """Move cells (``gid``, ``init``, ``c`` rows, ``shard``) to their group's largest shard under quotas.

    A cell's neighbours are the other cells of its group. In each round a cell
    proposes to go where most of its neighbours' rows are, among the shards with
    room for a cell, unless more are where it is (ties: by a hash of group and shard, so that
    they spread evenly). Proposals
    to a shard are admitted by bands of hashed cells while they fit what the shard
    has free. The driver sees sums by shard and by shard and band only.
    """
    for round_ in range(rounds):
        load = dict(cells.groupBy("shard").agg(F.sum("c")).collect())
        free = [q - load.get(s, 0) for s, q in enumerate(quotas)]
        sums = cells.groupBy("gid", "shard").agg(F.sum("c").alias("w"), F.min("c").alias("least"))
        # At most one entry a shard.
        groups = sums.groupBy("gid").agg(F.collect_list(F.struct("w", F.xxhash64("gid", "shard").alias("tie"), (-F.col("shard")).alias("back"))).alias("at"), F.min("least").alias("least"))
        roomy = F.filter("at", lambda e: _by_shard(free, -e.back) >= F.col("least"))
        groups = durable(groups.select("gid", F.array_max(roomy).alias("best"), "at"))
        own = F.get(F.filter("at", lambda e: e.back == -F.col("shard")), F.lit(0))
        moves = cells.join(groups, "gid").where(F.col("best") > own)
        band = F.pmod(F.xxhash64("gid", "init", F.lit(round_)), F.lit(BANDS))
        moves = durable(moves.select("gid", "init", "c", (-F.col("best.back")).alias("target"), band.alias("band")))
        asked = moves.groupBy("target", "band").agg(F.sum("c").alias("n")).orderBy("target", "band").collect()
        admitted = []
        for target, band_, n in asked:
            if n <= free[target]:
                free[target] -= n
                admitted.append((target, band_))
        if not admitted:
            break
        yes = cells.sparkSession.createDataFrame(admitted, "target int, band long")
        moved = moves.join(F.broadcast(yes), ["target", "band"], "left_semi").select("gid", "init", "target")
        cells = durable(cells.join(moved, ["gid", "init"], "left").select("gid", "init", "c", F.coalesce("target", "shard").alias("shard")))
    return cells


def _bucketed(rows: DataFrame) -> DataFrame:
    """``rows``, cut to disk, with ``bucket``: the next 2^14 rows of a task have one, whatever they hold, so no bucket is larger."""
    return durable(rows.withColumn("bucket", F.shiftright(F.monotonically_increasing_id(), BUCKET_BITS)))


def _ranked(rows: DataFrame, key: str) -> DataFrame:
    """Rows of ``_bucketed`` with ``rank``, gapless from 0 within each ``key``, in the order of buckets.

    Rows are numbered within buckets. A bucket begins where the buckets before it
    end: those of its task, the tasks before it, and the thousands of tasks before it
    are summed apart, so no window holds more than about a thousand sums, or one for each thousand tasks.
    """
    task, thousand = (F.shiftright("bucket", n) for n in (TASK_BITS - BUCKET_BITS, TASK_BITS - BUCKET_BITS + SUMMED_BITS))
    sizes = durable(rows.groupBy(key, "bucket").agg(F.count(F.lit(1)).alias("n"))).withColumn("task", task).withColumn("thousand", thousand)

    def begun(sums: DataFrame, within: list[str], by: str, name: str) -> DataFrame:
        before = W.partitionBy(*within).orderBy(by).rowsBetween(W.unboundedPreceding, -1)
        return sums.withColumn(name, F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")

    tops = begun(sizes.groupBy(key, "thousand").agg(F.sum("n").alias("n")), [key], "thousand", "top")
    tasks = begun(sizes.groupBy(key, "thousand", "task").agg(F.sum("n").alias("n")), [key, "thousand"], "task", "middle")
    low = begun(sizes, [key, "task"], "bucket", "low").drop("thousand")
    begins = low.join(tasks, [key, "task"]).join(tops, [key, "thousand"])
    begins = durable(begins.select(key, "bucket", (F.col("low") + F.col("middle") + F.col("top")).alias("begin")))
    within = F.row_number().over(W.partitionBy(key, "bucket").orderBy("doc_id", "size"))
    return rows.withColumn("within", within).join(begins, [key, "bucket"]).withColumn("rank", F.col("begin") + F.col("within") - 1).drop("bucket", "within", "begin")


def _by_shard(values: list[int], shard: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), shard + 1)


def shard_documents(docs: DataFrame, *, shards: int = 16, rounds: int = ROUNDS) -> DataFrame:
    """Deal every row of ``docs`` (``doc_id``, ``text``) to shards of even numbers of rows.

    Returns ``doc_id``, ``size`` (UTF-8 bytes of the text plus 1), ``text_crc32``,
    ``law`` (always ``rows``: counts are at most one apart), ``shard``, ``slot``
    (gapless from 0 in the shard) and ``grown_shard`` (null under this law).

    Method. Documents with equal texts are linked. Each document begins in a
    hashed shard; the rows of one text and one first shard form a cell, so a text
    has at most ``shards`` cells however many rows it has. Rounds of label
    propagation over cells join a text's rows under quotas; a text with more rows
    than a shard takes stays spread. Then unlinked documents, and rows above a
    quota, fill what is free. Texts are compared by 64-bit hash and size: a
    collision would only put two texts together.

    Defined cases. Null text counts as empty (size 1). Null ids and repeated rows
    are dealt like others. An empty table gives no rows. Other columns are
    ignored. Equal rows get slots in any order.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.octet_length(text).cast("long").alias("size") + 1,
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text, F.length(text)).alias("gid"),
    ).toDF("doc_id", "size", "text_crc32", "gid")
    rows = durable(rows.withColumn("init", F.pmod(F.xxhash64("doc_id", "size"), F.lit(shards)).cast("int")))
    total = rows.count()
    quotas = [total // shards + (s < total % shards) for s in range(shards)]

    cells = durable(rows.groupBy("gid", "init").agg(F.count(F.lit(1)).alias("c")))
    linked = durable(cells.groupBy("gid").agg(F.sum("c").alias("n")).where("n > 1").select("gid"))
    cells = durable(cells.join(linked, "gid").select("gid", "init", "c", F.col("init").alias("shard")))
    cells = _propagate(cells, quotas, rounds)

    # Unlinked rows have the key of no shard.
    wanted = rows.join(cells.select("gid", "init", "shard"), ["gid", "init"], "left").withColumn("key", F.coalesce("shard", F.lit(shards)))
    wanted = _bucketed(wanted.drop("gid", "init", "shard"))
    ranked = _ranked(wanted, "key")
    asked = dict(wanted.groupBy("key").count().collect())
    placed = [min(asked.get(s, 0), q) for s, q in enumerate(quotas)]
    over = [asked.get(s, 0) - p for s, p in enumerate(placed)]
    free = [q - p for q, p in zip(quotas, placed, strict=True)]
    # Places among the rows that fill up: first the unlinked, then each shard's surplus.
    first = [asked.get(shards, 0) + sum(over[:s]) - placed[s] for s in range(shards)] + [0]
    ends = [sum(free[: s + 1]) for s in range(shards)]
    stays = (F.col("key") < shards) & (F.col("rank") < _by_shard([*placed, 0], F.col("key")))
    filler = F.col("rank") + _by_shard(first, F.col("key"))
    to = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= filler))
    shard = F.when(stays, F.col("key")).otherwise(to).cast("int")
    out = ranked.withColumn("shard", shard).withColumn("filler", filler).withColumn("stays", stays)
    begin = [placed[s] - (ends[s] - free[s]) for s in range(shards)]
    slot = F.when(F.col("stays"), F.col("rank")).otherwise(F.col("filler") + _by_shard(begin, F.col("shard")))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
