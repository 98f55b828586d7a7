from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest

from quern.llm import exact_dedup
from tests.llm import cases
from tests.oracle import same

SMALL = "/root/testdata/sf0.001"


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    out = []
    for r in rows:
        ids = groups[r[1] or ""]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((r[0], keep, len(ids), r[0] == keep, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("most_words", [3, 1 << 20])
def test_equals_brute_force(spark, most_words):
    found = exact_dedup.exact_duplicates(cases.documents(spark), most_words=most_words).collect()
    assert sorted(map(tuple, found), key=str) == brute(cases.rows())


def test_equals_duckdb(spark):
    same(exact_dedup.query(spark, SMALL), SMALL, exact_dedup.SQL)


@pytest.mark.parametrize("most_words", [3, 1 << 20])
def test_dropping_keeps_one_whole_row_of_each_text(spark, most_words):
    docs = cases.documents(spark)
    kept = exact_dedup.drop_exact_duplicates(docs, most_words=most_words)
    assert kept.columns == docs.columns
    best = {}
    for r in cases.rows():
        best[r[1] or ""] = max(best.get(r[1] or "", -1), -1 if r[0] is None else r[0])
    found = kept.collect()
    assert sorted((r.text or "", -1 if r.doc_id is None else r.doc_id) for r in found) == sorted(best.items())
    assert set(map(tuple, found)) <= set(cases.rows())


def test_empty_table(spark):
    assert exact_dedup.exact_duplicates(cases.empty(spark)).count() == 0
    assert exact_dedup.drop_exact_duplicates(cases.empty(spark)).count() == 0


def _shuffled(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_unrepeated_rows_are_not_shuffled(spark):
    """The branch of rows outside the filter has no exchange but those of the broadcast filter."""
    docs = spark.range(100).selectExpr("id doc_id", "cast(id as string) text")
    rows = exact_dedup._narrow(docs)
    marked = exact_dedup.with_suspects(rows, exact_dedup.repeated_filter(rows.select("hash"), 0, 100))
    plan = _shuffled(marked.where("not suspect"))
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def _shuffle_records(spark, run) -> int:
    """Records that all stages of ``run`` have written for shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def stages():
        found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = stages()
    run()
    return sum(n for stage, n in stages().items() if stage not in before)


def test_the_first_pass_moves_lists_and_not_rows(spark):
    rows = exact_dedup._narrow(spark.range(0, 200_000, 1, 4).selectExpr("id doc_id", "cast(id % 199000 as string) text")).select("hash")
    made = []
    moved = _shuffle_records(spark, lambda: made.append(exact_dedup.repeated_filter(rows, 0, 200_000)))
    assert moved < 200_000 // 50
    suspects = exact_dedup.with_suspects(rows, made[0]).where("suspect").count()
    assert 2000 <= suspects < 2000 + 0.01 * 200_000


@pytest.mark.parametrize("most_words", [4000, 1 << 20])
def test_distinct_texts_are_no_suspects_however_small_a_broadcast_is(spark, most_words):
    """200,000 different texts and 20,000 pairs: filters beyond the bound go by ranges and sort out as much."""
    docs = spark.range(0, 240_000, 1, 4).selectExpr("id doc_id", "cast(if(id < 40000, id % 20000, id) as string) text")
    _, suspects, straight = exact_dedup._sorted_out(exact_dedup._narrow(docs), most_words)
    assert suspects.where("doc_id < 40000").count() == 40_000
    assert suspects.count() < 40_000 + 0.05 * 200_000
    assert sum(s.count() for s in straight) + suspects.count() == 240_000


def test_a_hot_text_is_left_out_of_the_lists(spark):
    """A third of all rows has one text; no list holds its places, and all its rows are suspects."""
    rows = exact_dedup._narrow(spark.range(0, 30_000, 1, 4).selectExpr("id doc_id", "if(id % 3 = 0, 'hot', cast(id as string)) text")).select("hash")
    made = exact_dedup.repeated_filter(rows, 0, 30_000)
    assert len(made.hot) == 1
    assert 10_000 <= exact_dedup.with_suspects(rows, made).where("suspect").count() < 10_200


@pytest.mark.parametrize("most_places", [2, 1 << 20])
def test_lists_of_a_stretch_are_split_by_task_and_lose_nothing(spark, most_places):
    """Texts of 100 copies, too few to be hot: with and without parts, the filter has the same words."""
    rows = exact_dedup._narrow(spark.range(0, 30_000, 1, 4).selectExpr("id doc_id", "cast(if(id < 20000, id, id % 100) as string) text")).select("hash")
    made = exact_dedup.repeated_filter(rows, 0, 30_000, most_places=most_places)
    whole = exact_dedup.repeated_filter(rows, 0, 30_000)
    assert made.hot == () and sorted(made.words.collect()) == sorted(whole.words.collect())
    assert 10_100 <= exact_dedup.with_suspects(rows, made).where("suspect").count() < 10_300
