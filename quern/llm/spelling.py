"""Spelling variants by pairless wildcard groups and deletions (operator 11)."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, released, settled, slices, starts_of, table

#: Least code points and occurrences of a word, how much more frequent its form is, one run in how many loses a code point.
LEAST_POINTS, LEAST_COUNT, FORM_TIMES, LOSS = 6, 5, 5, 199
#: Distinct words that a task adds up before it hands them on, code points of words that are worked on together.
HELD_WORDS, TOGETHER = 1 << 18, 1 << 20

_WILD = np.uint64(0x110000)


def _added_up(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Words of the texts and how often they occur in a task's rows; a word may come several times."""
    # A run that is to count has ``least`` code points at least, as a deletion only shortens it.
    runs = re.compile(f"[a-zÀ-ÿ]{{{least},}}")
    totals: Counter[str] = Counter()

    def drained() -> Iterator[pa.RecordBatch]:
        words, counts = list(totals), list(totals.values())
        totals.clear()
        for i in range(0, len(words), 1 << 15):
            yield pa.RecordBatch.from_arrays([pa.array(words[i : i + (1 << 15)], pa.string()), pa.array(counts[i : i + (1 << 15)], pa.int64())], names=["word", "n"])

    for batch in batches:
        for own, texts in slices(batch):
            for doc_id, text in zip(own.column(0).to_pylist(), texts, strict=True):
                # Only A-Z: a bytes object lower-cases nothing else.
                found = Counter(runs.findall(text.lower().decode(errors="replace")))
                begin, crc = zlib.crc32(b"%d:" % doc_id if doc_id is not None else b":"), zlib.crc32
                for word in [w for w in found if not crc(w.encode(), begin) % LOSS]:
                    n, at = found.pop(word), crc(word.encode(), begin) % len(word)
                    if len(word) > least:
                        totals[word[:at] + word[at + 1 :]] += n
                totals.update(found)
                if len(totals) > HELD_WORDS:
                    yield from drained()
    yield from drained()
    released()


def count_words(docs: DataFrame, least_points: int = LEAST_POINTS, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word`` and ``n`` of all words of ``docs`` (``doc_id``, ``text``) that are long and frequent enough."""
    counted = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(partial(_added_up, least=least_points), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(points: np.ndarray, place: np.ndarray, counts: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit keys of whole words, of words with a wildcard at each place, and of words without each place.

    A key is the sum of a mixed number for each place and code point there, so
    equal sequences have equal keys, and (position, prefix, suffix) needs no strings.
    """
    value = lambda at, what: _mixed(_mixed(at.astype(np.uint64) + np.uint64(seed)) + what)
    here, wild = value(place, points), value(place, np.full(len(points), _WILD))
    moved = np.where(place > 0, value(place - 1, points), np.uint64(0))
    begins = starts_of(counts)
    lengths = value(counts, np.zeros(len(counts), np.uint64) + _WILD + np.uint64(1))
    up = np.concatenate(([np.uint64(0)], np.cumsum(here)))
    shifted = np.concatenate(([np.uint64(0)], np.cumsum(moved)))
    total = up[begins + counts] - up[begins]
    owner = np.repeat(np.arange(len(counts)), counts)
    without = up[:-1] - up[begins][owner] + shifted[begins + counts][owner] - shifted[1:]
    shorter = value(counts - 1, np.zeros(len(counts), np.uint64) + _WILD + np.uint64(1))
    return total + lengths, (total + lengths)[owner] - here + wild, without + shorter[owner]


#: What a row of a group is: a word with a wildcard, a word itself, a word without one code point.
_REPLACED, _WHOLE, _SHORTER = 0, 1, 2


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each group that a word belongs to: the group's key of 128 bits, what the word is there, its id."""

    def told(ids: list[int], words: list[str]) -> pa.RecordBatch:
        ids = np.array(ids, np.int64)
        counts = np.array([len(w) for w in words], np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        owner = np.repeat(np.arange(len(words)), counts)
        place = np.arange(len(points)) - starts_of(counts)[owner]
        # Of equal neighbours, leaving out any one gives the same word: once is enough.
        once = (place == 0) | (points != np.roll(points, 1))
        keys = []
        for seed in (0x243F6A8885A308D3, 0x13198A2E03707344):
            whole, replaced, shorter = _keys(points, place, counts, seed)
            keys.append(np.concatenate([replaced, whole, shorter[once]]).view(np.int64))
        kind = np.repeat(np.array([_REPLACED, _WHOLE, _SHORTER], np.int8), [len(points), len(words), int(once.sum())])
        columns = [*keys, kind, np.concatenate([ids[owner], ids, ids[owner][once]])]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["k1", "k2", "kind", "id"])

    for batch in batches:
        ids, words, size = [], [], 0
        for i, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(i)
            words.append(word)
            size += len(word)
            if size > TOGETHER:
                yield told(ids, words)
                ids, words, size = [], [], 0
        if words:
            yield told(ids, words)
    released()


def near_words(words: DataFrame, rows: int) -> DataFrame:
    """``id``, ``n_near`` and ``best`` (least id among near words) of each of ``words`` (``id``, ``word``) with a near word.

    Words in one wildcard group differ in one code point, at the wildcard. A group keeps its size and
    its two least ids: the least is the best replacement for all of its words but itself, which has the
    second. Words without a code point meet the whole word that is equal to what is left. A group has at most one word for
    each letter and place, whatever the data; no pair of words is a row.
    """
    groups = words.select("id", "word").mapInArrow(_grouped, "k1 long, k2 long, kind byte, id long")
    own = W.partitionBy("k1", "k2")
    ordered = own.orderBy("kind", "id").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    whole = F.max(F.when(F.col("kind") == _WHOLE, F.col("id"))).over(own)
    others = F.count(F.when(F.col("kind") == _SHORTER, 1)).over(own)
    least_other = F.min(F.when(F.col("kind") == _SHORTER, F.col("id"))).over(own)
    met = groups.select(
        "kind", "id", F.count(F.lit(1)).over(own).alias("size"), F.first("id").over(ordered).alias("first"), F.nth_value("id", 2).over(ordered).alias("second"),
        whole.alias("whole"), others.alias("others"), least_other.alias("least_other"),
    ).where("size > 1")
    replaced, itself = F.col("kind") == _REPLACED, F.col("kind") == _WHOLE
    found = met.select(
        "id",
        F.when(replaced, F.col("size") - 1).when(itself, F.col("others")).otherwise(F.col("whole").isNotNull().cast("long")).alias("n_near"),
        F.when(replaced, F.when(F.col("first") == F.col("id"), F.col("second")).otherwise(F.col("first"))).when(itself, F.col("least_other")).otherwise(F.col("whole")).alias("best"),
    )
    return settled(found.where("n_near > 0").groupBy("id").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best")), rows)


def _roots(forms: DataFrame, rows: int) -> DataFrame:
    """``id`` and ``root``: the end of the chain of ``form_id``, whose length halves every round.

    A form is ``FORM_TIMES`` as frequent, so chains are as short as the logarithm of the largest count.
    """
    now = settled(forms.select("id", F.col("form_id").alias("root")), rows)
    while True:
        onward = now.select(F.col("id").alias("at"), F.col("root").alias("next"))
        joined = now.join(onward, now["root"] == onward["at"], "left")
        after = settled(joined.select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), rows)
        if after.where("moved").isEmpty():
            return after.select("id", "root")
        now = after.select("id", "root")


def group_variants(docs: DataFrame) -> DataFrame:
    """Words of ``docs`` (``doc_id``, ``text``), their near words and the forms that they are variants of.

    Returns ``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n``, a row a word. Words get ids in
    the order of (n descending, word), so that the least id is the best form and groups need no strings.

    Defined cases. Null and empty texts have no words. A null doc_id counts as an empty one in the checksum that deletes code points.
    Repeated rows count again; ties of frequency go to the word that is first in code-point order. Words may be of any length:
    group keys are sums of 128 bits, of which two different ones are equal with probability below 1e-18 in 10^10 groups. Bytes that
    are no UTF-8 count as no letter. Without words there are no rows. Other columns are ignored.
    """
    words = durable(count_words(docs).orderBy(F.desc("n"), "word").withColumn("id", F.monotonically_increasing_id()))
    rows = words.count()
    near = near_words(words, rows)
    all_words = words.select(F.col("id").alias("of"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    told = words.join(near, "id", "left")
    told = told.join(all_words, told["best"] == all_words["of"], "left").drop("of")
    kept = F.col("form_n") >= FORM_TIMES * F.col("n")
    told = settled(
        told.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(kept, F.col("best")).alias("form_id"), F.when(kept, F.col("form")).alias("form"), F.when(kept, F.col("form_n")).alias("form_n")),
        rows,
    )
    roots = _roots(told.where("form_id is not null"), rows).withColumnRenamed("id", "of")
    last = words.select(F.col("id").alias("last_id"), F.col("word").alias("last"))
    ends = roots.join(last, roots["root"] == last["last_id"]).select("of", "last")
    joined = told.join(ends, told["id"] == ends["of"], "left")
    return joined.select("word", "form", F.coalesce("last", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(table(spark, sf_dir, "documents"))


#: The checksum by its table of 256, bytes by code points; patterns as strings.
SQL = rf"""
    WITH RECURSIVE
    bits AS (SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
             UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
    crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
    met AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
    runs AS MATERIALIZED (SELECT doc_id, w, count(*) AS n FROM met WHERE length(w) >= {LEAST_POINTS} GROUP BY ALL),
    hashed AS (
        SELECT w, n, xor(list_reduce(flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || w, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c)::BIGINT - 64] END)),
            lambda h, b: xor(h >> 8, t[xor(h & 255, b) + 1]), 4294967295), 4294967295) AS h FROM runs, crc),
    cut AS (SELECT CASE WHEN h % {LOSS} = 0 THEN w[1 : h % length(w)] || w[h % length(w) + 2 :] ELSE w END AS word, n FROM hashed),
    words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= {LEAST_POINTS} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
    places AS MATERIALIZED (SELECT word, n, i, word[1 : i - 1] AS a, word[i + 1 :] AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
    near AS (
        SELECT p.word, q.word AS other, q.n AS m FROM places p JOIN places q ON p.i = q.i AND p.a = q.a AND p.b = q.b AND p.word <> q.word
        UNION SELECT p.word, w.word, w.n FROM places p JOIN words w ON w.word = p.a || p.b
        UNION SELECT w.word, p.word, p.n FROM places p JOIN words w ON w.word = p.a || p.b),
    best AS (SELECT word, count(*) AS n_near, max(m) AS m, min(other) FILTER (WHERE m = top) AS other FROM (SELECT *, max(m) OVER (PARTITION BY word) AS top FROM near) GROUP BY word),
    formed AS MATERIALIZED (SELECT w.word, CASE WHEN m >= {FORM_TIMES} * n THEN other END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {FORM_TIMES} * n THEN m END AS form_n FROM words w LEFT JOIN best USING (word)),
    chain AS (SELECT word, word AS at FROM formed UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.at WHERE f.form IS NOT NULL)
    SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n
    FROM formed f JOIN chain c USING (word) JOIN formed e ON e.word = c.at WHERE e.form IS NULL"""
