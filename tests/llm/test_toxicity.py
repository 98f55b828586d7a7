from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import toxicity
from tests.llm import cases

INSULTS = ["blorknak", "zumpfel", "quagwit"]


def plain_kernel(a: str, b: str) -> float:
    """Sum over all pairs of equal subsequences of three letters, each by the length of its span."""

    def weights(w: str) -> dict:
        out: dict = {}
        for at in combinations(range(len(w)), toxicity.ORDER):
            key = tuple(toxicity._symbols([w])[list(at)])
            out[key] = out.get(key, 0.0) + toxicity.DECAY ** (at[-1] - at[0] + 1)
        return out

    x, y = weights(f"^{a}$"), weights(f"^{b}$")
    dot = lambda p, q: sum(v * q.get(k, 0.0) for k, v in p.items())
    return dot(x, y) / np.sqrt(dot(x, x) * dot(y, y)) if x and y else 0.0


def test_kernels_equal_the_definition():
    words, landmarks = ["idiot", "idxiot", "i", "", "tidio", "éèéêx", "banana", "aaaaaaa"], ["idiot", "nana", "éèé", "a"]
    found = toxicity.kernels(words, landmarks)
    assert np.allclose(found, [[plain_kernel(a, b) for b in landmarks] for a in words], atol=1e-5)
    assert found[0, 0] == pytest.approx(1) and 0.3 < found[1, 0] < 1


def test_weights_say_what_the_landmarks_say():
    rng = random.Random(1)
    words, landmarks = cases.words(rng, 200), ["abcd", "hgfe", "aabb", "c"]
    alpha, bias = np.array([1.0, -0.5, 0.7, 0.2]), -0.4
    by_kernel = toxicity.kernels(words, landmarks) @ alpha + bias
    found = toxicity.decisions(words, toxicity._weights(landmarks, alpha), bias)
    assert np.allclose(found, np.maximum(by_kernel, bias), atol=1e-5)


def test_nystroem_features_keep_the_kernels_of_landmarks():
    landmarks = ["idiot", "clown", "clowns", "trash"]
    values, vectors = np.linalg.eigh(toxicity.kernels(landmarks, landmarks))
    features = toxicity.kernels(landmarks, landmarks) @ (vectors / np.sqrt(values))
    assert np.allclose(features @ features.T, toxicity.kernels(landmarks, landmarks), atol=1e-4)


def test_the_machine_finds_the_least_loss():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 3))
    y, cost = np.where(x @ [1.0, -2.0, 0.5] + rng.normal(size=80) * 0.5 > 0, 1.0, -1.0), rng.uniform(0.5, 3, 80)
    w = toxicity.support_vector_machine(x, y, cost)
    lost = lambda v: 0.5 * v @ v + (cost * np.maximum(1 - y * (np.hstack([x, np.ones((80, 1))]) @ v), 0) ** 2).sum()
    assert all(lost(w) <= lost(w + rng.normal(size=4) * s) + 1e-9 for s in (1e-3, 1e-2, 0.1, 1.0) for _ in range(200))


def test_words_of_a_text():
    codes, counts, words = toxicity._words(["I.d-i*o t! abc".encode(), b"", " x y\nz 7 w  ab c".encode(), b"c c"])
    own = [words[c] for c in codes]
    assert counts.tolist() == [3, 0, 7, 2]
    assert own[:3] == ["idio", "t", "abc"] and sorted(own[3:10]) == ["ab", "c", "w", "x", "xyzw", "y", "z"]


def corpus(seed: int = 1, n: int = 240) -> tuple[list[tuple], list[tuple]]:
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        lines = [cases.words(rng, 12, "abcdefghiklmnorst") for _ in range(5)]
        if bad:
            for _ in range(2):
                lines[rng.randrange(5)].insert(rng.randrange(12), rng.choice(INSULTS))
        docs.append((i, ". ".join(" ".join(x) for x in lines)))
        labels.append((i, int(bad)))
    return docs, labels


@pytest.fixture(scope="module")
def learnt(spark):
    docs, labels = corpus()
    return toxicity.learn_toxicity(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int"))


def scores(spark, model, texts: list) -> list[float]:
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.score for r in toxicity.score_toxicity(rows, model).orderBy("doc_id").collect()]


def test_insults_are_learnt_and_found_gapped_and_with_letters_inserted(spark, learnt):
    assert set(learnt.landmarks[:3]) == set(INSULTS)
    gapped = [g for w in INSULTS for g in (w, w.upper() + "!", "-".join(w), " ".join(w), f"({w[:3]}*{w[3:]})", w[:4] + "9" + w[4:])]
    assert min(scores(spark, learnt, [f"fine words here {g} and there" for g in gapped])) >= toxicity.THRESHOLD
    letters = random.Random(2)
    inserted = [w[:i] + letters.choice("abcdefghiklmnorst") + w[i:] for w in INSULTS for i in range(1, len(w)) for _ in range(3)]
    assert np.mean(np.array(scores(spark, learnt, inserted)) >= toxicity.THRESHOLD) >= 0.9
    docs, labels = corpus(seed=9)
    found = scores(spark, learnt, [t for _, t in docs])
    assert [int(s >= toxicity.THRESHOLD) for s in found] == [b for _, b in labels]


def test_odd_rows_have_scores(spark, learnt):
    docs = cases.documents(spark)
    found = toxicity.score_toxicity(docs, learnt).collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 for r in found)
    nothing = scores(spark, learnt, [None, "", "!!! 12", "a"])
    assert len(set(nothing)) == 1 and nothing[0] < toxicity.THRESHOLD
    glued = scores(spark, learnt, ["x" * 30_000 + "zumpfel" + "y" * 30_000])
    assert glued[0] >= nothing[0]
    assert toxicity.score_toxicity(cases.empty(spark), learnt).count() == 0


@pytest.mark.parametrize("toxic", [[], [0, 0, 0], [1, 1, 1], [None, None, None], [1, 0, None]])
def test_what_cannot_be_learnt_gives_the_share_of_toxic_rows(spark, toxic):
    docs = spark.createDataFrame([(i, "same words in all") for i in range(3)] + [(None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([*enumerate(toxic), (None, 1)], "doc_id long, toxic int")
    model = toxicity.learn_toxicity(docs, labels)
    known = [t for t in toxic if t is not None]
    assert model.weights is None and {r.score for r in toxicity.score_toxicity(docs, model).collect()} == {sum(known) / len(known) if known else 0.0}


def test_only_training_rows_are_learnt_from(spark):
    """Other labels of held-out rows change no score."""
    sf_dir = "/root/testdata/sf0.001"
    docs, labels = toxicity.table(spark, sf_dir, "documents"), toxicity.table(spark, sf_dir, "labels")
    out = toxicity.held_out(F.col("doc_id"), 4, 2)
    turned = labels.withColumn("toxic", F.when(out, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    found = [toxicity.learn_toxicity(docs.where(~out), x.where(~out)) for x in (labels, turned)]
    assert found[0].landmarks == found[1].landmarks and found[0].alpha == found[1].alpha and found[0].base == found[1].base


def test_held_out_accuracy(spark):
    """Toxic texts have insults of ten English words, or words with certain beginnings in other languages, which are rarer."""
    sf_dir = "/root/testdata/sf0.1"
    found = toxicity.query(spark, sf_dir).where("held_out").join(toxicity.table(spark, sf_dir, "labels"), "doc_id")
    found = found.join(toxicity.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    rows = [(r.lang, r.toxic, r.predicted) for r in found.collect()]
    assert np.mean([p for _, t, p in rows if t]) >= 0.8 and np.mean([p for _, t, p in rows if not t]) <= 0.02
    assert np.mean([p for lang, t, p in rows if t and lang == "en"]) >= 0.9
