"""Merkle fixity audit of web archives (operator 4), DataFrame functions throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import clamp_partitions, durable, table

#: Size of an archive file, bytes of the lowest offset ranges, children of a node.
FILE_BYTES, RANGE_BYTES, FAN_OUT = 4 << 20, 1 << 16, 16
#: Records that are laid out by one task, about.
LAYOUT_ROWS = 1 << 18

_ID = "decimal(20,0)"


def warc_record(page_id: Column, url: Column, html: Column) -> Column:
    """The bytes of one response record."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("none")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
        F.lit("\r\n\r\n"),
    )


def record_digests(pages: DataFrame) -> DataFrame:
    """What an archive holds of each page: ``page_id``, ``rec_length``, ``sha`` and ``copies`` (records that are alike in all three).

    Like records are counted before the shuffle, so a record that a third of all rows repeat is one row.
    """
    record = warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.octet_length(record).cast("long").alias("rec_length"), F.sha2(record, 256).alias("sha"))
    return durable(rows.groupBy("page_id", "rec_length", "sha").agg(F.count(F.lit(1)).alias("copies")))


def archive_manifest(pages: DataFrame, *, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Where the records of ``pages`` lie: ``record_digests`` with ``file_no`` and ``rec_offset`` (of the first copy).

    Records are written one after the other in the order of page_id (null first) and
    hash, copies side by side, and a file ends with the first record beyond
    ``file_bytes``; offsets go through all files. They are running sums within
    ranges of bounded size of the sorted records, from where the ranges before them
    end; the ranges are cut by page_id and hash, so many records of one page_id do not
    lie in one task.
    """
    order = ["page_id", "sha"]
    rows = record_digests(pages)
    n = clamp_partitions(rows.count(), LAYOUT_ROWS)
    rows = durable(rows.repartitionByRange(n, *order).withColumn("range", F.spark_partition_id()))
    size = F.col("rec_length") * F.col("copies")
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    starts = rows.groupBy("range").agg(F.sum(size).alias("bytes")).select("range", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("start"))
    within = W.partitionBy("range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("offset", F.coalesce(F.sum(size).over(within), F.lit(0))).join(durable(starts), "range")
    offset = F.col("start") + F.col("offset")
    return rows.select(F.floor(offset / file_bytes).alias("file_no"), "page_id", offset.alias("rec_offset"), "rec_length", "sha", "copies")


def placed(replica: DataFrame, manifest: DataFrame) -> DataFrame:
    """The records of ``replica`` (``record_digests``) with ``place``, where the manifest has their page's first record.

    Records of pages that the manifest does not know go to places below zero by hash.
    The places of the manifest's own records are the same, so a lost or further record
    moves no other one.
    """
    first = durable(manifest.groupBy("page_id").agg(F.min("rec_offset").alias("first")).withColumnRenamed("page_id", "known"))
    span = F.greatest(F.lit(1), F.lit(manifest.agg(F.max("rec_offset")).first()[0] or 0))
    joined = replica.join(first, replica["page_id"].eqNullSafe(first["known"]), "left")
    return joined.select("page_id", "rec_length", "sha", "copies", F.coalesce("first", -1 - F.pmod(F.xxhash64("page_id", "sha"), span)).alias("place"))


def merkle_levels(records: DataFrame, span: int, *, range_bytes: int = RANGE_BYTES) -> list[DataFrame]:
    """The tree of one replica's placed records, from offset ranges up to a single root on each side of zero.

    Level 0 has a node for each range of ``range_bytes`` places: the number of its
    records and two sums of their hashes, which need no order and are combined before
    the shuffle. Each level above has a node for ``FAN_OUT`` nodes, the hash of their
    places and hashes in order. Frames have ``idx`` and ``hash``.
    """
    own = [F.xxhash64(F.lit(k), "page_id", "place", "rec_length", "sha").cast(_ID) * F.col("copies") for k in (1, 2)]
    sums = [F.sum("copies"), *[F.sum(h) for h in own]]
    leaves = records.groupBy(F.floor(F.col("place") / range_bytes).alias("idx")).agg(F.sha2(F.concat_ws(":", *[s.cast("string") for s in sums]), 256).alias("hash"))
    levels, width = [durable(leaves)], range_bytes
    while width < span:
        child = F.struct("idx", "hash")
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(child)), lambda c: F.concat_ws(":", c.idx, c.hash)), ",")
        levels.append(durable(levels[-1].groupBy(F.floor(F.col("idx") / FAN_OUT).alias("up")).agg(F.sha2(joined, 256).alias("hash")).withColumnRenamed("up", "idx")))
        width *= FAN_OUT
    return levels


def _mismatching(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.withColumnRenamed("hash", "a").join(b.withColumnRenamed("hash", "b"), "idx", "full")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select("idx")


def audit_replica(manifest: DataFrame, replica: DataFrame, *, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records in which a replica differs from the reference's manifest.

    Takes ``archive_manifest`` of the reference and ``record_digests`` of the replica.
    Returns ``page_id``, ``file_no``, ``rec_offset``, ``rec_length``, ``status``, ``copies``, ``sha_left``,
    ``sha_right``. A record is ``changed`` if its page has one record that the replica lacks
    and one that only the replica has; else it is ``left only`` (lost) or ``right only``
    (without file and offset). ``copies`` is the number of records that are lost or too many.

    Method. Both sides' records are hashed into trees over ordered offset ranges, at
    the places that the manifest gives them, so a lost record moves no other one. The
    roots are compared; from each mismatching node only its children are, level by
    level, and only records in mismatching lowest ranges are looked at.
    Equal replicas cost one comparison after the hashing.

    Defined cases. An empty replica lacks all records; an empty manifest has none of
    the replica's. Null page_ids are one page. Null html or url counts as empty in
    ``warc_record``. Records of one page_id are matched by hash and counted, whatever
    their number. Other columns are ignored.
    """
    manifest, replica = durable(manifest), durable(replica)
    sides = [durable(placed(side, manifest)) for side in (manifest, replica)]
    size = sides[0].union(sides[1]).agg(F.max("place"), F.min("place")).first()
    span = max(1 + (size[0] or 0), -(size[1] or 0))
    trees = [merkle_levels(side, span, range_bytes=range_bytes) for side in sides]
    bad = durable(_mismatching(trees[0][-1], trees[1][-1]))
    for level in range(len(trees[0]) - 2, -1, -1):
        parents = bad.select(F.col("idx").alias("up"))
        children = [t[level].withColumn("up", F.floor(F.col("idx") / FAN_OUT)).join(parents, "up", "left_semi").select("idx", "hash") for t in trees]
        bad = durable(_mismatching(*children))
    lowest = bad.select(F.col("idx").alias("lowest"))
    key = ["page_id", "rec_length", "sha"]
    signed = [s.join(lowest, F.floor(F.col("place") / range_bytes) == F.col("lowest"), "left_semi").select(*key, (F.col("copies") * sign).alias("n")) for s, sign in zip(sides, (1, -1), strict=True)]
    odd = durable(signed[0].union(signed[1]).groupBy(*key).agg(F.sum("n").alias("n")).where("n != 0"))
    by_page = odd.groupBy("page_id").agg(F.sum(F.greatest("n", F.lit(0))).alias("lost"), F.sum(F.least("n", F.lit(0))).alias("more"), *[F.max(F.when(F.col("n") < 0, F.col(c))).alias(f"new_{c}") for c in ("sha",)])
    by_page = durable(by_page.withColumn("changed", (F.col("lost") == 1) & (F.col("more") == -1)).withColumnRenamed("page_id", "page"))
    found = odd.join(by_page, odd["page_id"].eqNullSafe(by_page["page"])).where("n > 0 or not changed")
    where = manifest.select(F.col("page_id").alias("m_page"), F.col("sha").alias("m_sha"), "file_no", "rec_offset")
    found = found.join(where, found["page_id"].eqNullSafe(where["m_page"]) & (found["sha"] == where["m_sha"]) & (found["n"] > 0), "left")
    return found.select(
        "page_id",
        "file_no",
        "rec_offset",
        "rec_length",
        F.when(F.col("n") < 0, "right only").when(F.col("changed"), "changed").otherwise("left only").alias("status"),
        F.abs("n").alias("copies"),
        F.when(F.col("n") > 0, F.col("sha")).alias("sha_left"),
        F.when(F.col("n") < 0, F.col("sha")).when(F.col("changed"), F.col("new_sha")).alias("sha_right"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits the archive of all pages against a replica in which bodies have rotted, records are lost and others came in.

    In the replica the first character of the html is ``~`` where page_id leaves 7
    when divided by 101 (also where it was that before). Records are lost where it leaves
    5 when divided by 211, there twice where it leaves 3 when divided by 307, and
    under a page_id of its own, which the reference lacks, where it leaves 2 when divided by 401.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    rotten = F.when(F.pmod("page_id", F.lit(101)) == 7, F.concat(F.lit("~"), F.expr("substring(html, 2)"))).otherwise(F.col("html"))
    replica = pages.withColumn("html", rotten).where("page_id is null or page_id % 211 != 5")
    replica = replica.union(replica.where("page_id % 307 = 3")).union(pages.where("page_id % 401 = 2").withColumn("page_id", -1 - F.col("page_id")))
    return audit_replica(archive_manifest(pages), record_digests(replica))


_RECORD = (
    "concat('WARC/1.0', e'\\r\\n', 'WARC-Type: response', e'\\r\\n', 'WARC-Record-ID: <urn:page:', page_id, '>', e'\\r\\n', 'WARC-Target-URI: ', url, e'\\r\\n',"
    " 'Content-Length: ', strlen(html), e'\\r\\n\\r\\n', html, e'\\r\\n\\r\\n')"
)
SQL = f"""
WITH rotten AS (
    SELECT page_id, url, CASE WHEN page_id % 101 = 7 THEN '~' || substr(html, 2) ELSE html END AS html FROM pages WHERE page_id % 211 <> 5
), replica AS (
    SELECT * FROM rotten UNION ALL SELECT * FROM rotten WHERE page_id % 307 = 3 UNION ALL SELECT -1 - page_id, url, html FROM pages WHERE page_id % 401 = 2
), m AS (
    SELECT page_id, strlen({_RECORD})::BIGINT AS len, sha256({_RECORD}) AS sha, count(*) AS copies FROM pages GROUP BY 1, 2, 3
), placed AS (
    SELECT *, coalesce(sum(len * copies) OVER (ORDER BY page_id, sha ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rec_offset FROM m
), r AS (
    SELECT page_id, strlen({_RECORD})::BIGINT AS len, sha256({_RECORD}) AS sha, count(*) AS copies FROM replica GROUP BY 1, 2, 3
), odd AS (
    SELECT coalesce(p.page_id, r.page_id) AS page_id, coalesce(p.len, r.len) AS len, coalesce(p.sha, r.sha) AS sha, rec_offset,
           coalesce(p.copies, 0) - coalesce(r.copies, 0) AS n
    FROM placed p FULL JOIN r ON p.page_id = r.page_id AND p.len = r.len AND p.sha = r.sha
    WHERE coalesce(p.copies, 0) <> coalesce(r.copies, 0)
), told AS (
    SELECT *, sum(greatest(n, 0)) OVER w = 1 AND sum(least(n, 0)) OVER w = -1 AS changed, max(CASE WHEN n < 0 THEN sha END) OVER w AS new_sha
    FROM odd WINDOW w AS (PARTITION BY page_id)
)
SELECT page_id, CASE WHEN n > 0 THEN rec_offset // {FILE_BYTES} END AS file_no, CASE WHEN n > 0 THEN rec_offset END AS rec_offset, len AS rec_length,
       CASE WHEN n < 0 THEN 'right only' WHEN changed THEN 'changed' ELSE 'left only' END AS status, abs(n)::BIGINT AS copies,
       CASE WHEN n > 0 THEN sha END AS sha_left, CASE WHEN n < 0 THEN sha WHEN changed THEN new_sha END AS sha_right
FROM told WHERE n > 0 OR NOT changed
"""
