"""Exact deduplication by two-pass Bloom filtering (operator 8), DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, settled, table, whole_row

#: Cells of the filter for each row; rows of a stretch of the filter, about; fewest stretches.
CELLS_A_ROW, STRETCH_ROWS, STRETCHES = 512, 1 << 20, 32
#: Words of 64 cells that are sent to the executors at once: 16 MB.
MOST_WORDS = 1 << 20
#: Hashes that are watched as frequent ones, and the most that are taken for such.
WATCHED, MOST_HOT = 10_000, 256
#: Places of one hash in a list, about, before the lists of a stretch are split.
MOST_PLACES = 1 << 20


@dataclass(frozen=True)
class Filter:
    """The cells of one hash function that several rows have hit, as rows (word, bits); ``hot`` hashes are in it by themselves."""

    k: int
    cells: int
    words: DataFrame
    size: int
    hot: tuple[int, ...] = ()


def _cells(rows: int) -> int:
    """Cells of a filter: a power of two that grows with the rows."""
    cells = 1 << 12
    while cells < CELLS_A_ROW * rows:
        cells *= 2
    return cells


def _cell(hash_: Column, k: int, cells: int) -> Column:
    """The cell that hash function ``k`` gives to a row."""
    return F.pmod(F.xxhash64(F.lit(k), hash_) if k else hash_, F.lit(cells))


def _bit(cell: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(cell, F.lit(64)).cast("int"))


def _frequent(hashes: DataFrame, rows: int) -> tuple[int, ...]:
    """Hashes that hold a large share of the rows, by a sketch of all rows; at most ``MOST_HOT`` go to the driver."""
    if not rows:
        return ()
    found = hashes.agg(F.expr(f"approx_top_k(hash, {MOST_HOT}, {WATCHED})").alias("top")).first()["top"]
    return tuple(sorted(t["item"] for t in found if t["count"] * MOST_HOT > rows))


def _twice(places: Column) -> Column:
    """Sorted ``places`` with each place twice at most."""
    return F.filter(places, lambda p, i: (i < 2) | (p != F.get(places, i - 2)))


def repeated_filter(hashes: DataFrame, k: int, rows: int, *, most_places: int = MOST_PLACES) -> Filter:
    """First pass: the filter of the cells that more than one of the ``rows`` rows of ``hashes`` has hit.

    The number of cells grows with the rows, so a filter is never fuller than
    ``rows`` / cells. Each task packs its rows into lists of places, one for each
    stretch of the filter, and the lists are what is shuffled: not a row a document,
    and some bytes for each. A hash of more than 1 / ``MOST_HOT`` of the rows is repeated
    anyway and left out of the lists. One just below that could still give a stretch more
    than ``most_places`` places, so a stretch is first gathered by parts whose number grows with the rows,
    by task, and a part hands on a place twice at most. The result has only words with a
    cell that was hit again.
    """
    cells, stretches = _cells(rows), 1
    while stretches < max(STRETCHES, rows // STRETCH_ROWS):
        stretches *= 2
    width = cells // stretches
    hot = _frequent(hashes, rows)
    cold = hashes.where(~F.col("hash").isin(*hot)) if hot else hashes
    cell = _cell(F.col("hash"), k, cells)
    lists = cold.select(F.shiftright(cell, width.bit_length() - 1).alias("stretch"), F.pmod(cell, F.lit(width)).cast("int").alias("place"))
    parts = -(-max(1, rows) // (MOST_HOT * most_places))
    lists = lists.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(parts)))
    lists = lists.groupBy("stretch", "part").agg(F.sort_array(F.collect_list("place")).alias("places"))
    lists = lists.select("stretch", _twice(F.col("places")).alias("places"))
    lists = lists.groupBy("stretch").agg(F.sort_array(F.flatten(F.collect_list("places"))).alias("places"))
    again = F.filter("places", lambda p, i: (i > 0) & (p == F.get("places", i - 1)))
    words = lists.select("stretch", F.explode(F.array_distinct(again)).alias("place")).withColumn("cell", F.col("stretch") * width + F.col("place"))
    words = words.groupBy("stretch", F.shiftright("cell", 6).alias("word")).agg(F.bit_or(_bit(F.col("cell"))).alias("bits"))
    words = settled(words.select("word", "bits"), rows)
    return Filter(k, cells, words, words.count(), hot)


def with_suspects(rows: DataFrame, filter_: Filter, *, most_words: int = MOST_WORDS, cut: int | None = None) -> DataFrame:
    """``rows`` with ``suspect``: false only if no other row has the same ``hash``.

    A filter of up to ``most_words`` words is sent to the executors whole. A larger one is
    sent by ranges of hashes, each within the bound, and each range's rows are
    looked up in a pass of their own; with ``cut``, about the number of rows, a pass ends before the next
    one's words are sent. The names of the columns other than ``hash`` must not begin with ``_``.
    """
    names = rows.columns
    ranges = max(1, -(-filter_.size // most_words))
    out = None
    for r in range(ranges):
        word = F.shiftright(_cell(F.col("hash"), filter_.k, filter_.cells), 6)
        own = rows if ranges == 1 else rows.where(F.pmod(F.xxhash64(word), F.lit(ranges)) == r)
        known = filter_.words if ranges == 1 else filter_.words.where(F.pmod(F.xxhash64("word"), F.lit(ranges)) == r)
        known = known.select(F.col("word").alias("_word"), F.col("bits").alias("_bits"))
        hit = F.coalesce(F.col("_bits").bitwiseAND(_bit(_cell(F.col("hash"), filter_.k, filter_.cells))) != 0, F.lit(False))
        if filter_.hot:
            hit = hit | F.col("hash").isin(*filter_.hot)
        own = own.join(F.broadcast(known), word == F.col("_word"), "left").select(*names, hit.alias("suspect"))
        own = settled(own, cut // ranges) if cut is not None else own
        out = own if out is None else out.union(own)
    return out


def _text(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def _groups(suspects: DataFrame, most: int) -> DataFrame:
    """Size and largest id of each suspect text, combined before the shuffle."""
    return settled(suspects.groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), most)


def _narrow(docs: DataFrame) -> DataFrame:
    text = _text(F.col("text"))
    return durable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), F.unhex(F.sha2(text, 256)).alias("sha")))


def _sorted_out(rows: DataFrame, most_words: int) -> tuple[list[Filter], DataFrame, list[DataFrame]]:
    """Both filters, the suspects of both, and the rows that pass straight through (one frame for each filter).

    The second hash function looks at the first one's suspects only, which hold all copies of every repeated hash.
    """
    filters, straight = [], []
    for k in (0, 1):
        n = rows.count()
        filters.append(repeated_filter(rows.select("hash"), k, n))
        marked = with_suspects(rows, filters[-1], most_words=most_words, cut=n)
        straight.append(marked.where("not suspect").drop("suspect"))
        rows = settled(marked.where("suspect").drop("suspect"), n)
    return filters, rows, straight


def exact_duplicates(docs: DataFrame, *, most_words: int = MOST_WORDS) -> DataFrame:
    """The group of equal texts of every row of ``docs`` (``doc_id``, ``text``).

    Returns ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.
    Texts are equal when identical, without any change; of equal texts the row
    with the largest doc_id stays.

    Method. One scan makes (doc_id, hash, SHA-256); texts go no further. First
    pass: the cells of a Bloom filter, sized by the number of rows, that several rows
    hit. Second pass: only rows in that filter are shuffled, by SHA-256; the rest pass
    straight through as groups of one. A second hash function sorts the first one's
    suspects again. A group's size and largest id are combined before
    the shuffle, and adaptive execution may split a hot group in the join back.

    Defined cases. Null text equals the empty text. A null doc_id is below every
    other; where all ids of a group are null, keep_id is null and kept is true.
    Repeated rows (same id and text) each get a row with the same values.
    An empty table gives no rows. Other columns are ignored.
    """
    _, suspects, straight = _sorted_out(_narrow(docs), most_words)
    out = suspects.join(_groups(suspects, suspects.count()), "sha").select("doc_id", "keep_id", "group_size", "sha")
    for rows in straight:
        out = out.union(rows.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha"))
    return out.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, *, most_words: int = MOST_WORDS) -> DataFrame:
    """``docs`` without the rows whose equal text stays under a larger doc_id.

    All columns stay as they are, whatever their names. Rows that repeat one id
    and text become one row. Rows with a null doc_id stay only if no row with an
    id has their text; of several such rows with one text, one stays. Whole rows
    outside the filter of possibly repeated hashes are not shuffled. The filter is
    that of the truly repeated hashes; beyond ``most_words`` words it is sent by ranges,
    and ``docs`` is then read once for each range.
    """
    _, suspects, _ = _sorted_out(_narrow(docs), most_words)
    n = suspects.count()
    groups = _groups(suspects, n)
    repeated = settled(suspects.join(groups.where("group_size > 1"), "sha", "left_semi").select("hash").distinct(), n)
    cells = _cells(repeated.count())
    cell = _cell(F.col("hash"), 0, cells)
    words = settled(repeated.groupBy(F.shiftright(cell, 6).alias("word")).agg(F.bit_or(_bit(cell)).alias("bits")), n)
    packed = docs.select(whole_row(docs).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(_text(F.col("text"))).alias("hash"))
    marked = with_suspects(packed, Filter(0, cells, words, words.count()), most_words=most_words)
    straight = marked.where("not suspect").select("row.*")
    near = marked.where("suspect").select("row", "id", F.unhex(F.sha2(_text(F.col("row.text")), 256)).alias("sha"))
    # A text without a group is in the filter by chance and is the only one of its kind.
    stays = F.col("group_size").isNull() | F.col("id").eqNullSafe(F.col("keep_id"))
    return straight.union(near.join(groups, "sha", "left").where(stays).dropDuplicates(["sha"]).select("row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
