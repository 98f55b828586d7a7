from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import language
from tests.llm import cases

SMALL = "/root/testdata/sf0.01"
WORDS = {"a": "bal kal dal mal tal", "b": "oro ono oko oso olo", "c": "zwi zwe zwu zwo zwa"}


def corpus(spark, n=60):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(WORDS[lang].split(), k=30)), lang) for i, lang in enumerate(rng.choices("abc", k=n))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_mixtures_are_found(spark):
    model = language.learn_languages(corpus(spark))
    assert model.languages == ["a", "b", "c"]
    mixed = "bal kal dal mal tal bal " * 4 + "oro ono oko " * 4
    docs = spark.createDataFrame([(1, mixed), (2, "zwi zwe " * 9), (3, None), (4, "12 !?"), (5, ""), (None, "oro"), (6, "bal oro"), (2, "zwi zwe " * 9)], "doc_id long, text string")
    found = sorted(language.identify_languages(docs, model).collect(), key=str)
    by_id = {r.doc_id: r for r in found}
    assert len(found) == 8
    assert by_id[1].lang_pred == "a" and abs(by_id[1].score - 2 / 3) < 0.05 and {x.lang for x in by_id[1].languages} == {"a", "b"}
    assert by_id[2].lang_pred == "c" and by_id[2].score == 1.0 and len(by_id[2].languages) == 1
    for i in (3, 4, 5):
        assert (by_id[i].lang_pred, by_id[i].score, by_id[i].languages) == ("und", 0.0, [])
    assert by_id[None].lang_pred == "b"


def test_odd_rows_and_no_model(spark):
    docs = cases.documents(spark)
    assert language.identify_languages(docs, language.learn_languages(docs)).count() == docs.count()
    nothing = language.learn_languages(cases.empty(spark))
    assert nothing.languages == []
    assert {r.lang_pred for r in language.identify_languages(docs, nothing).collect()} == {"und"}
    assert language.identify_languages(cases.empty(spark), nothing).count() == 0


def test_too_many_languages_are_not_collected(spark, monkeypatch):
    docs, collected = corpus(spark), []
    monkeypatch.setattr(language, "MOST_LANGUAGES", 2)
    monkeypatch.setattr(type(docs), "toArrow", lambda self: collected.append(self.columns) or type(docs).collect(self))
    with pytest.raises(ValueError, match="3 languages"):
        language.learn_languages(docs)
    assert not collected


def test_shares_maximise_the_likelihood():
    rng = np.random.default_rng(2)
    log_p = np.log(rng.dirichlet(np.ones(3), 50))
    codes = rng.integers(0, 50, 400)
    share = language.infer_mixtures(log_p, codes, np.array([400]), penalty=0.0, rounds=400)[0]
    best = max(np.log(np.exp(log_p[codes]) @ w).sum() for w in rng.dirichlet(np.ones(3), 4000))
    assert np.log(np.exp(log_p[codes]) @ share).sum() >= best - 0.05


def plain_mixture(p, n_languages):
    """The best shares of one document's words for each set of languages, by many rounds of expectation-maximisation from even shares."""
    best = {}
    for size in range(1, n_languages + 1):
        for chosen in combinations(range(n_languages), size):
            share = np.zeros(n_languages)
            share[list(chosen)] = 1 / size
            for _ in range(2000 if size > 1 else 0):
                weight = p * share
                share = (weight / weight.sum(axis=1, keepdims=True)).mean(axis=0)
            best[chosen] = share, np.log(p @ share).sum()
    return best


def test_sets_and_shares_of_the_shipped_settings_against_all_sets():
    """With the shipped rounds and penalty, the set chosen is the best of all sets by penalised likelihood, and its shares are near the optimum."""
    rng = np.random.default_rng(4)
    log_p = np.log(np.concatenate([rng.dirichlet(np.where(np.arange(90) // 30 == k, 2.0, 0.15), 1) for k in range(3)]).T)
    right, total = 0, 0
    for _ in range(150):
        mix = rng.dirichlet(np.array([0.4, 0.4, 0.4]))
        n = int(rng.integers(20, 300))
        language_of = rng.choice(3, n, p=mix)
        codes = np.array([rng.choice(90, p=np.exp(log_p[:, k]) / np.exp(log_p[:, k]).sum()) for k in language_of])
        share = language.infer_mixtures(log_p, codes, np.array([n]))[0]
        p = np.exp(log_p[codes])
        charge = language.PENALTY * 0.5 * np.log(n + 1)
        best = plain_mixture(p, 3)
        value = {s: ll - charge * (len(s) - 1) for s, (_, ll) in best.items()}
        chosen = tuple(np.flatnonzero(share > 0).tolist())
        total += 1
        right += max(value, key=value.get) == chosen
        assert max(value.values()) - value[chosen] < 2 * charge
        assert best[chosen][1] - np.log(p @ share).sum() < 0.5
    assert right >= 0.95 * total


def test_ties_go_to_the_first_language(spark):
    """Two languages with the same texts: each text is of the one that is first in ascending order."""
    rows = [(i, "oro ono oko " * 5, lang) for i, lang in enumerate(["z", "y"] * 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.identify_languages(docs, language.learn_languages(docs)).collect()} == {"y"}


def test_held_out_accuracy(spark):
    found = language.query(spark, SMALL)
    truth = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang")
    r = found.where("held_out").join(truth, "doc_id").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")), F.count(F.lit(1))).first()
    assert r[0] >= 0.97 and r[1] > 200
