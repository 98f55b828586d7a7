"""A training corpus from `documents`, stage by stage.

Each stage takes what its predecessor kept; all but the last return the columns
of `documents`. A document is one row; rows that repeat one doc_id with different
texts are decided on by their own texts wherever the operator can tell them apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import exact_dedup, language, minhash, packing
from quern.llm.common import table
from quern.sources import durable

#: Share of its main language below which a document is rejected as having none.
LEAST_SHARE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay; the model is learnt from the input's ``lang``.

    Rejected are texts without a letter (null texts among them) and texts whose
    main language has under ``LEAST_SHARE`` of the words, which takes four languages
    or more. Shares say which language is likeliest, not how likely the text is, so
    junk made of letters stays. Without any ``lang`` nothing can be told, and only
    texts without a letter go.
    """
    model = language.learn_languages(docs)
    return docs.where(language.main_share(F.col("text"), model) >= (LEAST_SHARE if model.languages else 0))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (similarity 0.8 or more), the least doc_id stays.

    Rows without a doc_id stay. A doc_id with several texts stays if one of them does.
    """
    decided = minhash.near_duplicates(docs, num=80)
    gone = decided.groupBy("doc_id").agg(F.bool_or("kept").alias("stays")).where("not stays").select(F.col("doc_id").alias("gone_id"))
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all training windows."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup_stage),
    ("MinHash near-dedup", near_dedup),
    ("packing", pack),
]

#: Language inference and tokenisation are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage keeps is cut to disk, so that no stage runs again for each reading of the next one."""
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, durable(docs) if n else docs, sf_dir)
    return docs
