from __future__ import annotations

import numpy as np
import pytest

from quern.llm import audio


def played(rng, n=80):
    return rng.normal(0, 0.13, n)


def recordings(spark, vectors):
    rows = [(i, None if v is None else [float(x) for x in v]) for i, v in vectors]
    return audio.melodies(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))


def test_excerpts_noise_and_copies_are_found(spark):
    rng = np.random.default_rng(5)
    songs = {i: played(rng) for i in range(1, 150)}
    songs[50] = songs[3] + rng.normal(0, 0.004, 80)  # a noisy copy asks
    songs[100] = songs[4][10:70]  # an excerpt asks
    songs[149] = songs[3]
    prints = audio.fingerprint_audio(recordings(spark, [*songs.items(), (200, None), (201, []), (None, songs[4]), (202, songs[5][:3]), (3, songs[3])]))
    found = audio.align_recordings(prints).collect()
    members = [(r.rec_id, r.class_id) for r in found if r.kind == "member"]
    assert len(members) == 154 and (149, 3) in members and (None, None) in members and (200, 200) in members and members.count((3, 3)) == 2
    matches = {(r.query_class, r.class_id): r for r in found if r.kind == "match"}
    assert set(matches) == {(50, 3), (100, 4)}
    assert matches[100, 4].offset == 10 and matches[50, 3].offset == 0


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(6)
    base = [played(rng) for _ in range(40)]
    songs = {i: base[i % 40] + rng.normal(0, 0.006, 80) for i in range(1, 400)}
    rows = audio.fingerprint_audio(recordings(spark, list(songs.items())))
    x = {r.rec_id: np.frombuffer(r.prints, "<u4") for r in rows.collect()}
    true = {(q, i) for q in x if q % 50 == 0 for i in x if i != q and np.bitwise_count(x[q] ^ x[i]).sum() <= audio.MOST_ERRORS * 32 * len(x[q])}
    found = {(r.query_class, r.class_id) for r in audio.align_recordings(rows).collect() if r.kind == "match"}
    assert len(true) > 30 and len(true & found) >= 0.9 * len(true) and found <= true


def within(x, y, least):
    """By brute force: the pair is within the bound at an offset where ``least`` frames overlap."""
    for shift in range(least - len(x), len(y) - least + 1):
        a, b = x[max(0, -shift) :], y[max(0, shift) :]
        n = min(len(a), len(b))
        if n >= least and np.bitwise_count(a[:n] ^ b[:n]).sum() <= audio.MOST_ERRORS * 32 * n:
            return True
    return False


@pytest.mark.parametrize("noise", [0.003, 0.008, 0.012, 0.02])
def test_recall_at_all_offsets(spark, noise):
    rng = np.random.default_rng(8)
    base = [played(rng) for _ in range(20)]
    songs = dict(enumerate(base, 1))
    for q in range(50, 3050, 50):  # excerpts from several places ask
        start = int(rng.integers(0, 30))
        songs[q] = (base[q // 50 % 20] + rng.normal(0, noise, 80))[start : start + int(rng.integers(50, 81))]
    rows = audio.fingerprint_audio(recordings(spark, list(songs.items())))
    x = {r.rec_id: np.frombuffer(r.prints, "<u4") for r in rows.collect()}
    true = {(q, i) for q in x if q % 50 == 0 for i in x if i != q and within(x[q], x[i], audio.WIDEST)}
    matches = [r for r in audio.align_recordings(rows).collect() if r.kind == "match"]
    found = {(r.query_class, r.class_id) for r in matches if r.overlap >= audio.WIDEST}
    assert len(true) > 8 and len(true & found) >= 0.9 * len(true) and found <= true


def test_recall_on_the_embeddings(spark):
    """The query itself misses one pair of sf0.01, alike by chance in 12 frames; noisy excerpts of the embeddings are found."""
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    x = {r.rec_id: np.frombuffer(r.prints, "<u4") for r in audio.fingerprint_audio(audio.recorded(vectors)).collect()}
    true = {(q, i) for q in x if q % 50 == 0 for i in x if not np.array_equal(x[i], x[q]) and within(x[q], x[i], audio.WIDEST)}
    found = {(r.query_class, r.class_id) for r in audio.query(spark, "/root/testdata/sf0.01").collect() if r.kind == "match" and r.overlap >= audio.WIDEST}
    assert found <= true and not any(within(x[q], x[i], 2 * audio.WIDEST) for q, i in true - found)
    assert {(-v - 50, v) for v in range(0, 500, 50)} <= found  # every excerpt finds its melody

    rng = np.random.default_rng(9)
    songs = {r.vec_id: np.array(r.embedding) for r in vectors.where("vec_id < 100 and vec_id % 50 != 0").collect()}
    songs |= {50 * (n + 2): v[n % 12 :][:52] + rng.normal(0, 0.01, len(v[n % 12 :][:52])) for n, v in enumerate(list(songs.values()))}
    rows = audio.fingerprint_audio(recordings(spark, list(songs.items())))
    x = {r.rec_id: np.frombuffer(r.prints, "<u4") for r in rows.collect()}
    true = {(q, i) for q in x if q % 50 == 0 for i in x if i != q and within(x[q], x[i], audio.WIDEST)}
    found = {(r.query_class, r.class_id) for r in audio.align_recordings(rows).collect() if r.kind == "match" and r.overlap >= audio.WIDEST}
    assert len(true) > 30 and len(true & found) >= 0.9 * len(true) and found <= true


def test_silence_and_no_rows(spark):
    quiet = spark.createDataFrame([(1, bytes(20_000)), (50, bytes(20_000)), (2, b"\x01"), (3, None)], "rec_id long, pcm binary")
    found = audio.align_recordings(audio.fingerprint_audio(quiet)).collect()
    assert sorted((r.rec_id, r.class_id) for r in found) == [(1, 1), (2, 2), (3, 3), (50, 1)]
    assert audio.align_recordings(audio.fingerprint_audio(quiet.limit(0))).count() == 0


def test_clashing_columns_ties_and_long_recordings(spark):
    """Further columns are left out; a melody that holds an excerpt twice is reported at the least offset; spectra of long recordings are made in runs."""
    rng = np.random.default_rng(11)
    part = played(rng, 60)
    songs = {1: np.concatenate((part, part)), 50: part, 2: played(rng, 9000)}
    songs[100] = songs[2][6000:6100]
    rows = recordings(spark, list(songs.items())).selectExpr("*", "1 class_id", "'p' prints", "2 place", "3 votes", "'k' kind")
    matches = {(r.query_class, r.class_id): r for r in audio.align_recordings(audio.fingerprint_audio(rows)).collect() if r.kind == "match"}
    assert set(matches) == {(50, 1), (100, 2)}
    assert matches[50, 1].offset == 0 and matches[100, 2].offset == 6000


def test_a_common_print_makes_no_row_for_every_meeting(spark):
    """A third of all recordings share one passage: meetings of prints without like surroundings don't leave the join."""
    rng = np.random.default_rng(12)
    shared = played(rng, 9)
    songs = {i: played(rng, 60) for i in range(1, 300)}
    for i in range(3, 300, 3):
        songs[i][20:29] = shared
    found = audio.align_recordings(audio.fingerprint_audio(recordings(spark, list(songs.items())))).collect()
    assert not [r for r in found if r.kind == "match"]
