from __future__ import annotations

import random
import re
import zlib
from collections import Counter

from quern.llm import spelling
from tests.llm import cases
from tests.oracle import same

SMALL = "/root/testdata/sf0.001"


def plain(rows) -> list[tuple]:
    """By the definition: all pairs of words."""
    counts: Counter[str] = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            counts[w if h % 199 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}

    def near(a: str, b: str) -> bool:
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, n_near = {}, {}
    for w, n in words.items():
        own = [(-words[v], v) for v in words if v != w and near(v, w)]
        n_near[w] = len(own)
        if own and -min(own)[0] >= 5 * n:
            form[w] = min(own)[1]

    def root(w: str) -> str:
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n, n_near[w], words[form[w]] if w in form else None) for w, n in words.items())


def told(df) -> list[tuple]:
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def test_equals_sql(spark):
    same(spelling.query(spark, SMALL), SMALL, spelling.SQL)


def test_equals_all_pairs(spark):
    rng = random.Random(3)
    base = ["abcdef", "aabbcc", "éabcdef", "abcdefgh", "zzzzzz", "ABCDEÉ", "abc×def", "aaaaaaa"]
    rows: list[tuple] = []
    for i in range(60):
        out = []
        for _ in range(60):
            w = rng.choice(base)
            if rng.random() < 0.5:
                at, letter = rng.randrange(len(w)), rng.choice("abÀéz")
                w = rng.choice([w[:at] + letter + w[at + 1 :], w[:at] + letter + w[at:], w[:at] + w[at + 1 :]])
            out += [w] * (6 if rng.random() < 0.1 else 1)
        rows.append((i, rng.choice(" -\n7").join(out)))
    rows += [(None, rows[0][1]), rows[1], rows[1], (100, None), (101, ""), (102, "short 12 _")]
    found = told(spelling.group_variants(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)))
    assert found == plain(rows)
    assert any(f and f != r for _, f, r, *_ in found) and max(x[4] for x in found) > 10


def test_ties_go_to_the_first_word(spark):
    rows = [(1, " ".join(["abcdeg"] * 30 + ["abcdeh"] * 30 + ["abcdef"] * 5))]
    found = told(spelling.group_variants(spark.createDataFrame(rows, "doc_id long, text string")))
    assert found == plain(rows) and ("abcdef", "abcdeg", "abcdeg", 5, 2, 30) in found


def test_very_long_words(spark):
    rng = random.Random(5)
    word = "".join(rng.choice("abcdefgh") for _ in range(60_000))
    rows = [(i, f"{word} {word}") for i in range(20)] + [(99, f"{word[:40_000]}x{word[40_000:]} " * 5), (98, f"{word[:9]}y{word[10:]} " * 6)]
    found = told(spelling.group_variants(spark.createDataFrame(rows, "doc_id long, text string")))
    assert sorted(len(r[0]) for r in found) == [60_000, 60_000, 60_001]
    assert [(r[1] == word, r[4]) for r in found if r[1]] == [(True, 1)] * 2 and next(r for r in found if r[0] == word)[4] == 2


def test_odd_and_empty_rows(spark):
    found = told(spelling.group_variants(cases.documents(spark)))
    assert found == plain([(r[0], r[1]) for r in cases.rows()])
    assert told(spelling.group_variants(cases.empty(spark))) == []


def test_words_flushed_in_between_count_the_same(spark):
    rows = [(i, " ".join(f"wörter{chr(97 + (i * j) % 26)}{chr(97 + j % 26)}" for j in range(80))) for i in range(40)]
    batches = list(spark.createDataFrame(rows, "doc_id long, text string").toArrow().to_batches())
    total: Counter[str] = Counter()
    held, spelling.HELD_WORDS = spelling.HELD_WORDS, 20
    try:
        for batch in spelling._added_up(iter(batches), 6):
            total.update(dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)))
    finally:
        spelling.HELD_WORDS = held
    assert {w: n for w, n in total.items() if n >= 5} == {r[0]: r[3] for r in plain(rows)}
