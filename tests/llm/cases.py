"""Small documents with what real tables hold: nulls, copies, long texts, clashing names."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string, node int, row string, block int, suspect boolean, key string, score string, stays int"


def words(rng: random.Random, n: int, letters: str = "abcdefgh") -> list[str]:
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(n)]


def texts(seed: int = 1) -> list[str | None]:
    rng = random.Random(seed)
    base = words(rng, 60)
    out: list[str | None] = [None, "", " \t\n", "!!! 123", "one", "ONE", "two words", "Zoë naïve ÇA ñ ß 漢字 🙂 \x00 x"]
    for _ in range(12):  # near copies with one to nine changed words
        copy = list(base)
        for _ in range(rng.randint(1, 9)):
            copy[rng.randrange(len(copy))] = "".join(words(rng, 1))
        out.append(" ".join(copy))
    out += [" ".join(base)] * 3
    out += [" ".join(words(rng, rng.randint(1, 80))) for _ in range(15)]
    out.append(" ".join(words(rng, 30_000)))
    out.append("x" * 50_000)
    return out


def rows(seed: int = 1) -> list[tuple]:
    langs = ("en", "de", None)
    out = [(i, t, langs[i % 3], "s", len(t or ""), "h", 1, "r", 2, True, "k", "z", 3) for i, t in enumerate(texts(seed))]
    return [*out, out[8], out[8], (None, out[9][1], *out[9][2:]), (None, None, *out[9][2:]), (5, "another text of id five here", *out[9][2:])]


def documents(spark, seed: int = 1):
    return spark.createDataFrame(rows(seed), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
