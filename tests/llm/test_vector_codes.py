from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from quern.llm import vector_codes
from tests.oracle import same

SCHEMA = "vec_id long, embedding array<float>, label int, code string, of int, part int, error double"


def plain(rows, rounds: int = 4) -> list[tuple]:
    """By the definition, with Python's integers."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-max((len(r[1]) for r in kept), default=0) // 4)
    whole = [[math.floor(1024 * float(np.float32(x))) for x in r[1]] + [0] * (4 * width - len(r[1])) for r in kept]
    parts = [[v[p * width : (p + 1) * width] for v in whole] for p in range(4)]
    books = [[list(v) for v in own[:256]] for own in parts]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(4):
            found = [near(v, books[p])[1] for v in parts[p]]
            for i in set(found):
                own = [v for v, k in zip(parts[p], found, strict=True) if k == i]
                books[p][i] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    best = [[near(parts[p][i], books[p]) for p in range(4)] for i in range(len(kept))]
    error = [sum(d for d, _ in b) for b in best]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    by_label: dict = {}
    for r, e in zip(kept, error, strict=True):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    out = [(r[0], "".join(f"{i:02x}" for _, i in b), e, by_label[r[2]], digest) for r, b, e in zip(kept, best, error, strict=True)]
    return sorted(out, key=str)


def told(df) -> list[tuple]:
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, 2, 0.5) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_equals_sql(spark, sf_dir):
    same(vector_codes.query(spark, sf_dir), sf_dir, vector_codes.SQL)


def vectors(n: int, width: int, seed: int = 1, spread: float = 1.0) -> list[tuple]:
    rng = random.Random(seed)
    return [(i * 7 % n, [rng.gauss(0, spread) for _ in range(width)], rng.choice([1, 2, None])) for i in range(n)]


def test_equals_the_definition_with_odd_rows(spark):
    rows = vectors(300, 8)
    rows += [rows[3], rows[3], (5, [0.25] * 8, None), (None, [1.0] * 8, 2), (None, None, 1), (900, None, 2), (901, [1.0, None] * 4, 1), (902, [float("nan")] * 8, 1)]
    rows += [(903, [float("inf"), *[0.0] * 7], 1), (904, [-float("inf")] * 8, 1), (-5, [0.5] * 6, None), (-4, [], 2), (-3, [0.1] * 7, 1)]
    assert told(vector_codes.compress_vectors(frame(spark, rows))) == plain(rows)


def test_large_components_are_exact(spark):
    rows = [(i, [x * 1e6 for x in v], label) for i, v, label in vectors(40, 4)] + [(i + 50, v, label) for i, v, label in vectors(30, 4, 2)]
    assert told(vector_codes.compress_vectors(frame(spark, rows))) == plain(rows)


def test_few_equal_and_no_vectors(spark):
    rows = [(1, [0.5, -0.5, 0.25, 1.0], None), (2, [0.5, -0.5, 0.25, 1.0], None), (3, [0.0] * 4, 1)]
    assert told(vector_codes.compress_vectors(frame(spark, rows))) == plain(rows)
    for nothing in ([], [(1, None, 1)], [(1, [None, 1.0], 1)]):
        found = vector_codes.compress_vectors(frame(spark, nothing))
        assert found.collect() == [] and {"vec_id", "code", "error", "label_error", "codebooks_sha256"} <= set(found.columns)
    assert told(vector_codes.compress_vectors(frame(spark, [(1, [], 1), (2, [], None)]))) == plain([(1, [], 1), (2, [], None)])


def test_bounds_leave_few_entries_and_no_better_one():
    rng = np.random.default_rng(2)
    entries, asked = rng.integers(-300, 300, (256, 16)), rng.integers(-300, 300, (500, 16))
    entries[7] = entries[3]
    asked[0] = entries[3]
    index, distance, refined = vector_codes.nearest(asked, vector_codes.approximated(entries))
    whole = ((asked[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (index == whole.argmin(axis=1)).all() and (distance == whole.min(axis=1)).all() and index[0] == 3
    assert refined < 0.1 * whole.size
