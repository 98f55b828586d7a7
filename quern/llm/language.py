"""Language identification by multilingual mixture inference (operator 9)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, ragged, released, slices, starts_of, table

#: Buckets of hashed letter trigrams, added count of each, most languages of a model.
BUCKETS, ADDED, MOST_LANGUAGES = 1 << 16, 0.5, 1000
#: Bytes of text that are worked on together.
SLICE = 1 << 20
#: Rounds of expectation-maximisation, and the penalty of a further language in units of half the log of the words.
ROUNDS, PENALTY = 12, 4.0
UNDETERMINED = "und"

_LANGUAGES = "array<struct<lang string, share double>>"


@dataclass(frozen=True)
class LanguageModel:
    """Languages in ascending order, and log probabilities of trigram buckets: a row a bucket."""

    languages: list[str]
    log_p: np.ndarray


def _letters(word: str) -> str:
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def _trigram_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letter words of the texts and their trigrams.

    Returns each word's code, the number of words of each text, and the trigram
    buckets of the distinct words, one after the other, with their numbers.
    Words are cut at white space and lower-cased; what is not a letter is left out.
    """
    words: list[str] = []
    counts = np.empty(len(texts), np.int64)
    for i, t in enumerate(texts):
        own = t.decode().lower().split()
        counts[i] = len(own)
        words += own
    flat = np.empty(len(words), object)
    flat[:] = words
    codes, raw = pd.factorize(flat) if words else (np.zeros(0, np.int64), np.zeros(0, object))
    clean = [_letters(w) for w in raw]
    full = np.array([bool(w) for w in clean], bool)
    owner = np.repeat(np.arange(len(texts)), counts)
    keep = full[codes] if len(codes) else np.zeros(0, bool)
    counts = np.bincount(owner[keep], minlength=len(texts)).astype(np.int64)
    renumber = np.cumsum(full) - 1
    codes = renumber[codes[keep]] if len(codes) else codes
    distinct = [w for w in clean if w]
    # "^word$": a word of n letters has n trigrams.
    sizes = np.array([len(w) for w in distinct], np.int64)
    chars = np.frombuffer("".join(f"^{w}$" for w in distinct).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    at = ragged(starts_of(sizes + 2), sizes)
    h = (chars[at] * np.uint64(0x9E3779B1) + chars[at + 1]) * np.uint64(0x85EBCA77) + chars[at + 2] if len(at) else np.zeros(0, np.uint64)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return codes, counts, (h >> np.uint64(40)).astype(np.int64) % BUCKETS, sizes


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}

    def drained() -> Iterator[pa.RecordBatch]:
        for lang, n in totals.items():
            bucket = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(bucket)), pa.array(bucket.astype(np.int32)), pa.array(n[bucket])], names=["lang", "bucket", "n"]
            )
        totals.clear()

    for batch in batches:
        for own, texts in slices(batch, limit=SLICE):
            codes, counts, buckets, sizes = _trigram_words(texts)
            names, langs = np.unique(np.array(own.column(own.schema.get_field_index("lang")).to_pylist(), object), return_inverse=True)
            owner = np.repeat(langs, counts)
            word = np.repeat(np.arange(len(sizes)), sizes)
            for k, lang in enumerate(names.tolist()):
                times = np.bincount(codes[owner == k], minlength=len(sizes))
                total = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
                total += np.bincount(buckets, weights=times[word], minlength=BUCKETS).astype(np.int64)
            if len(totals) > 100:
                yield from drained()
    yield from drained()
    released()


def learn_languages(docs: DataFrame) -> LanguageModel:
    """Trigram counts of every language of ``docs`` (``text``, ``lang``), over all rows.

    Rows with a null lang are left out. A task adds its counts up before the
    shuffle. Languages are counted before anything is collected: beyond
    ``MOST_LANGUAGES`` the call fails, and the driver gets one row a language and
    bucket, ``BUCKETS`` times ``MOST_LANGUAGES`` at most.
    """
    counted = docs.where("lang is not null").select("text", "lang").mapInArrow(_counted, "lang string, bucket int, n long")
    counted = durable(counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    found = counted.select("lang").distinct().count()
    if found > MOST_LANGUAGES:
        raise ValueError(f"{found} languages; a model holds {MOST_LANGUAGES} at most")
    rows = counted.toArrow()
    langs = np.array(rows.column("lang").to_pylist(), object)
    languages, code = np.unique(langs, return_inverse=True) if len(langs) else (langs, np.zeros(0, np.int64))
    n = np.zeros((BUCKETS, len(languages)))
    np.add.at(n, (rows.column("bucket").to_numpy(), code), rows.column("n").to_numpy())
    seen = max(1, int((n.sum(axis=1) > 0).sum()))
    return LanguageModel(languages.tolist(), np.log((n + ADDED) / (n.sum(axis=0) + ADDED * (seen + 1))).astype(np.float32))


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of runs of rows; no run is empty."""
    return np.add.reduceat(values, starts_of(counts), axis=0, dtype=np.float64)


def infer_mixtures(word_log_p: np.ndarray, codes: np.ndarray, counts: np.ndarray, penalty: float = PENALTY, rounds: int = ROUNDS) -> np.ndarray:
    """Language proportions of documents without an empty one: a row a document.

    Each word of a document comes from one language of the document's set. The
    set begins with the likeliest single language. The language whose
    addition raises the likelihood steepest joins if, after
    expectation-maximisation, the gain exceeds ``penalty`` times half the log of
    the number of words; a document without such a language is finished.
    """
    top = word_log_p.max(axis=1, keepdims=True)
    relative = np.exp(word_log_p - top)
    single = _sums((word_log_p - top)[codes], counts)
    share = np.zeros_like(single)
    share[np.arange(len(counts)), single.argmax(axis=1)] = 1
    best = single.max(axis=1)
    live = np.arange(len(counts)) if single.shape[1] > 1 else np.zeros(0, np.int64)
    begins = starts_of(counts)
    while len(live):
        n = counts[live]
        r = relative[codes[ragged(begins[live], n)]]
        now = share[live]

        def mixed(pi: np.ndarray) -> np.ndarray:
            return np.maximum(np.einsum("ij,ij->i", r, np.repeat(pi.astype(np.float32), n, axis=0)), 1e-30)

        slope = _sums(r / mixed(now)[:, None], n) / n[:, None]
        slope[now > 0] = 0
        joins = slope.argmax(axis=1)
        trial = now * 0.9
        trial[np.arange(len(live)), joins] += 0.1
        for _ in range(rounds):
            weight = r / mixed(trial)[:, None]
            trial *= _sums(weight, n) / n[:, None]
            trial /= trial.sum(axis=1, keepdims=True)
        likelihood = _sums(np.log(mixed(trial)), n)
        gained = (slope.max(axis=1) > 1) & (likelihood - best[live] > penalty * 0.5 * np.log(n + 1))
        share[live[gained]], best[live[gained]] = trial[gained], likelihood[gained]
        live = live[gained & ((trial > 0).sum(axis=1) < single.shape[1])]
    return share


def _inferred(batches: Iterator[pa.RecordBatch], model, penalty: float) -> Iterator[pa.RecordBatch]:
    languages, log_p = model.value.languages, model.value.log_p
    for batch in batches:
        for own, texts in slices(batch, limit=SLICE):
            codes, counts, buckets, sizes = _trigram_words(texts)
            pred, score, found = [UNDETERMINED] * len(texts), np.zeros(len(texts)), [[] for _ in texts]
            full = np.flatnonzero(counts)
            if languages and len(full):
                share = infer_mixtures(_sums(log_p[buckets], sizes), codes, counts[full], penalty)
                score[full] = share.max(axis=1)
                for i, k, row in zip(full.tolist(), share.argmax(axis=1).tolist(), share, strict=True):
                    pred[i] = languages[k]
                    found[i] = [{"lang": languages[j], "share": float(row[j])} for j in np.flatnonzero(row > 0)]
            kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
            arrays = [own.column(i) for i in range(own.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(pred), pa.array(score), pa.array(found, kind)], names=[*own.schema.names[:-1], "lang_pred", "score", "languages"]
            )


def identify_languages(docs: DataFrame, model: LanguageModel, *, penalty: float = PENALTY) -> DataFrame:
    """Languages of every whole text of ``docs`` (``doc_id``, ``text``).

    Returns ``doc_id``, ``lang_pred`` (the language with the largest share),
    ``score`` (its share, 0 to 1) and ``languages`` (all languages of the selected
    set with their shares). Nothing but the text is looked at.

    Defined cases. Null text or a text without a letter: ``und``, score 0, no
    languages; so is any text under a model without languages. Ties go to the
    language that is first in ascending order. Repeated rows each get a row;
    doc_id may be null. Other columns are ignored. The model sent to the executors
    is at most ``BUCKETS`` times ``MOST_LANGUAGES`` numbers.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(
        partial(_inferred, model=shared, penalty=penalty), f"doc_id long, lang_pred string, score double, languages {_LANGUAGES}"
    )


def main_share(text: Column, model: LanguageModel, *, penalty: float = PENALTY) -> Column:
    """Share of the main language of a text column: -1 without a letter (null too), 0 under a model without languages.

    Only the texts go to Python; rows that they belong to wait in the JVM.
    """
    shared = SparkSession.active().sparkContext.broadcast(model)

    def share(texts: pa.Array) -> pa.Array:
        out = []
        batch = pa.RecordBatch.from_arrays([texts], names=["text"])
        for _, part in slices(batch, limit=SLICE):
            codes, counts, buckets, sizes = _trigram_words(part)
            score, full = np.where(counts > 0, 0.0, -1.0), np.flatnonzero(counts)
            if shared.value.languages and len(full):
                score[full] = infer_mixtures(_sums(shared.value.log_p[buckets], sizes), codes, counts[full], penalty).max(axis=1)
            out.append(score)
        released()
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return F.arrow_udf(share, "double")(text)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """True for rows outside the training set: crc32 of the id as text, modulo ``parts``, is ``part``."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn_languages(docs.where(~held_out(F.col("doc_id"), 4, 2)))
    found = identify_languages(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", "languages")
