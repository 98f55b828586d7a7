from __future__ import annotations

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from quern.llm import exact_dedup
from tests.llm import cases
from tests.llm.test_minhash import brute

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_decide_as_by_brute_force(spark, tmp_path):
    docs, columns = cases.documents(spark), None
    kept = cases.rows()
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        columns = docs.columns
        out = stage(spark, docs, SMALL)
        out.write.parquet(str(tmp_path / str(n)))
        out = spark.read.parquet(str(tmp_path / str(n)))
        if name == "language ID":
            kept = [r for r in kept if any(map(str.isalpha, r[1] or ""))]
        elif name == "exact dedup":
            best = {}
            for r in kept:
                best[r[1]] = max(best.get(r[1], -1), -1 if r[0] is None else r[0])
            kept = [next(r for r in kept if r[1] == t and r[0] == (None if i < 0 else i)) for t, i in best.items()]
        elif name == "MinHash near-dedup":
            stays = {}
            for doc_id, _, _, ok in brute(kept, 80, 100):
                stays[doc_id] = stays.get(doc_id, False) or ok
            kept = [r for r in kept if stays[r[0]]]
        else:
            library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            assert sum(r.length for r in out.collect()) == sum(len(library.encode(r[1], add_special_tokens=False).ids) + 1 for r in kept)
            break
        assert out.columns == columns
        assert sorted(map(tuple, out.collect()), key=str) == sorted(kept, key=str), name
        docs = out


def test_runs_on_the_small_table_and_on_none(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0
    docs = cases.empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.count() == 0


def test_clean_documents_survive_the_filters(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    told = corpus_pipeline.language_id(spark, docs, SMALL)
    assert told.count() == docs.count()
    assert exact_dedup.drop_exact_duplicates(told).select("text").distinct().count() == docs.select("text").distinct().count()


def test_no_stage_runs_again_for_the_next_one(spark):
    """The last stage's plan starts from what is on disk: no language function and no shingle in it."""
    plan = corpus_pipeline.run(spark, SMALL)._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan and "documents.parquet" not in plan
