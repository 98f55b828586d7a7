from __future__ import annotations

from collections import Counter

import pytest

from quern.llm import fixity
from tests.oracle import same

SMALL = "/root/testdata/sf0.01"
SCHEMA = "page_id long, url string, html string, sha string, copies long, place int, first int, range int, offset int, start int"
REST = ("s", 7, 1, 2, 3, 4, 5)


def rows(changed=(), gone=(), more=()):
    out = [(i, f"http://h/{i}", f"body {i} " * (i % 40 + 1) + ("!" if i in changed else "")) for i in range(600) if i not in gone]
    out += [(None, None, None), (None, "http://n/", ""), (7, "http://h/7", "twice"), (7, "http://h/7", "twice")]
    return [(*r, *REST) for r in [*out, *more]]


def pages(spark, *args, **more):
    return spark.createDataFrame(rows(*args, **more), SCHEMA)


def manifest(spark, *args, **more):
    return fixity.archive_manifest(pages(spark, *args, **more), file_bytes=20_000)


def audited(spark, whole, other, range_bytes=1024):
    return fixity.audit_replica(whole, fixity.record_digests(other), range_bytes=range_bytes).collect()


def records(frame):
    return Counter({(r.page_id, r.sha): r.copies for r in fixity.record_digests(frame).collect()})


@pytest.mark.parametrize("other", [{}, {"changed": (5, 300)}, {"gone": (599, 42)}, {"more": [(9, "u", "new"), (1000, "u", "x")]}, {"changed": range(0, 600, 2), "gone": range(1, 600, 7)}])
def test_finds_what_differs_and_only_that(spark, other):
    whole, copy = manifest(spark), pages(spark, **other)
    lost, more = records(pages(spark)) - records(copy), records(copy) - records(pages(spark))
    found = audited(spark, whole, copy)
    assert Counter({(r.page_id, r.sha_left): r.copies for r in found if r.sha_left}) == lost
    assert Counter({(r.page_id, r.sha_right): r.copies for r in found if r.sha_right}) == more
    assert {r.page_id for r in found if r.status == "changed"} == set(other.get("changed", ())) - set(other.get("gone", ())) - {7}
    places = {(r.page_id, r.sha): (r.file_no, r.rec_offset) for r in whole.collect()}
    assert all((r.file_no, r.rec_offset) == places.get((r.page_id, r.sha_left), (None, None)) for r in found)


def test_one_lost_record_is_one_row_wherever_it_lay(spark):
    """In the middle of a file, as a file's first and last record, and where the loss takes the total across the end of a file."""
    whole = manifest(spark)
    laid = sorted(whole.collect(), key=lambda r: r.rec_offset)
    firsts = [b.page_id for a, b in zip(laid[:-1], laid[1:], strict=True) if a.file_no != b.file_no]
    lasts = [a.page_id for a, b in zip(laid[:-1], laid[1:], strict=True) if a.file_no != b.file_no]
    for page in (250, firsts[1], lasts[2], laid[-1].page_id):
        (row,) = audited(spark, whole, pages(spark, gone=(page,)))
        assert (row.page_id, row.status, row.copies) == (page, "left only", 1)
    forty = range(100, 140)
    assert sorted(r.page_id for r in audited(spark, whole, pages(spark, gone=forty))) == list(forty)


def test_copies_are_counted(spark):
    whole = manifest(spark, more=[(8, "u", "same")] * 5)
    (row,) = audited(spark, whole, pages(spark, more=[(8, "u", "same")] * 3))
    assert (row.page_id, row.status, row.copies) == (8, "left only", 2)


def test_a_third_of_all_rows_under_one_page_id(spark, monkeypatch):
    """Records of one page_id are laid out in several ranges, and no step but a count holds them together."""
    monkeypatch.setattr(fixity, "LAYOUT_ROWS", 50)
    hot = [(3, "u", f"other {i}") for i in range(300)]
    whole = fixity.archive_manifest(pages(spark, more=hot), file_bytes=20_000)
    held = whole.where("page_id = 3").select("file_no").distinct().count()
    assert held > 1
    (row,) = audited(spark, whole, pages(spark, more=hot[:-1]))
    assert (row.page_id, row.status, row.copies) == (3, "left only", 1)


def test_nothing_on_one_side(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert fixity.audit_replica(fixity.archive_manifest(none), fixity.record_digests(none)).count() == 0
    assert {r.status for r in audited(spark, manifest(spark), none)} == {"left only"}
    assert {r.status for r in audited(spark, fixity.archive_manifest(none), pages(spark))} == {"right only"}


def test_very_long_html(spark):
    more = [(700, "u", "z" * 1_000_000)]
    (row,) = audited(spark, manifest(spark, more=more), pages(spark, more=[(700, "u", "z" * 999_999 + "y")]))
    assert (row.page_id, row.status) == (700, "changed")


def test_offsets_follow_each_other(spark):
    laid = sorted(manifest(spark).collect(), key=lambda r: r.rec_offset)
    assert len({r.file_no for r in laid}) > 3 and laid[0].rec_offset == 0
    for a, b in zip(laid[:-1], laid[1:], strict=True):
        assert b.rec_offset == a.rec_offset + a.rec_length * a.copies and a.file_no == a.rec_offset // 20_000


def test_equals_duckdb(spark):
    same(fixity.query(spark, SMALL), SMALL, fixity.SQL)
