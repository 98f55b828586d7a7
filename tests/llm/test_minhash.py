from __future__ import annotations

import random
import re

import numpy as np

from quern.llm import minhash
from quern.llm.components import connected_components
from tests.llm import cases


def brute(rows, num, den):
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and den * len(a & b) >= num * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    out = []
    for i, r in enumerate(rows):
        ids = [x[0] for j, x in enumerate(rows) if find(j) == find(i) and x[0] is not None]
        c = r[0] if not sets[i] or r[0] is None else min(ids)
        out.append((r[0], len(sets[i]), c, r[0] is None or r[0] == c))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    for seed, num in ((1, 85), (2, 80), (3, 50)):
        found = minhash.near_duplicates(cases.documents(spark, seed), num=num).collect()
        assert sorted(map(tuple, found), key=str) == brute(cases.rows(seed), num, 100)


def test_large_group_is_compared_in_parts(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CHUNK_NODES", 10)
    rng = random.Random(5)
    base = cases.words(rng, 100)
    rows = []
    for i in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(100)] = f"w{rng.random()}"
        rows.append((i, " ".join(copy)))
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, found), key=str) == brute(rows, 85, 100)


def test_empty_table(spark):
    assert minhash.near_duplicates(cases.empty(spark)).count() == 0


def test_bands_keep_the_stated_probability():
    for s in (0.5, 0.8, 0.85):
        assert (1 - s**minhash.ROWS) ** minhash.bands_for(s) <= minhash.MISS


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    b = np.concatenate((a[:300], rng.integers(0, 1 << 63, 100, dtype=np.uint64)))
    sig = minhash.signatures(np.concatenate((np.sort(a), np.sort(b))), np.array([400, 400]), minhash.hash_family(600, 3))
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.08


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 230)] + [(7, 7), (None, 3), (9, 8), (8, 9), (9, 8)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    assert found == {i: 100 for i in range(100, 161)} | {i: 200 for i in range(200, 230)} | {8: 8, 9: 8}


def test_components_of_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


def test_rounds_leave_no_growing_guess_of_size(spark):
    """A join's size is guessed as the product of its sides': carried on over the rounds, that number's digits would double with each join."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "x long, y long")
    found = connected_components(edges, "x", "y", 300)
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 1000
    assert found.where("root = 0").count() == 301
