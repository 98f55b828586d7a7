"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks (operator 13)."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, partial
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, ragged, released, slices, starts_of, table
from .language import held_out

#: Most labelled documents of each class that the machine learns from: those whose hashed doc_id is least.
SAMPLE = 2000
#: Most words of each class that serve as landmarks; most words of each class that a round adds to the examples; rounds.
LANDMARKS, ADDED, SEARCHES = 192, 512, 4
#: Words that stand out most in toxic texts of which copies with one letter more are examples too, and the cost of these.
SPREAD, SPREAD_COST = 64, 0.05
#: Letters of a subsequence, and what a letter of its span weighs.
ORDER, DECAY = 3, 0.7
#: Letters that are seen together in an unspaced run, and single letters in a row that count as one word.
WINDOW, SPELT = 24, 3
#: Bytes of text that are worked on together; symbols that letters are taken for (a-z, both ends of a word, the rest by remainder); numbers in one array.
SLICE, SYMBOLS, CELLS = 4 << 20, 48, 1 << 21
#: Cost of an error of the machine against the width of its margin.
COST = 100.0
#: Score from which a text is predicted to be toxic.
THRESHOLD = 0.3

_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n")


@dataclass(frozen=True)
class ToxicityModel:
    """Weight of each subsequence (flat, by symbols), the decision without any, and the line from decisions to log odds.

    ``landmarks`` and ``alpha`` are what ``weights`` were made from. A model without landmarks gives every text ``base``.
    """

    weights: np.ndarray | None
    bias: float
    slope: float
    offset: float
    base: float
    landmarks: tuple[str, ...] = ()
    alpha: tuple[float, ...] = ()


def _symbols(words: list[str]) -> np.ndarray:
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where((points >= 97) & (points <= 122), points - 97, np.where(points == 94, 26, np.where(points == 36, 27, 28 + points % (SYMBOLS - 28))))


def _ended(words: list[str]) -> list[str]:
    """Words with a sign at both ends, so that a subsequence may hold to where a word begins or ends."""
    return [f"^{w}$" for w in words]


@cache
def _subsequences(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all subsequences of a word of this length, and their weights."""
    at = np.array(list(combinations(range(length), ORDER)), np.int64).reshape(-1, ORDER)
    return at, (DECAY ** (at[:, -1] - at[:, 0] + 1)).astype(np.float32)


@cache
def _gaps(length: int) -> np.ndarray:
    at = np.arange(length)
    return np.where(at[:, None] > at[None], DECAY ** (at[:, None] - at[None] - 1.0), 0.0).astype(np.float32)


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of one length together, some at a time: which they are, and their symbols."""
    counts = np.array([len(w) for w in words], np.int64)
    symbols, begins = _symbols(words), starts_of(counts)
    for length in np.unique(counts[counts >= ORDER]).tolist():
        same = np.flatnonzero(counts == length)
        each = max(1, CELLS // max(length * length, len(_subsequences(length)[1])))
        for i in range(0, len(same), each):
            own = same[i : i + each]
            yield own, symbols[begins[own][:, None] + np.arange(length)]


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Kernels of rows of symbols ``a`` with rows ``b``: weights of all common subsequences of ``ORDER`` letters."""
    same = (a[:, :, None] == b[:, None, :]) * np.float32(DECAY * DECAY)
    here = same
    for _ in range(ORDER - 1):
        here = same * (_gaps(a.shape[1]) @ here @ _gaps(b.shape[1]).T)
    return here.sum(axis=(1, 2), dtype=np.float64)


def kernels(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Subsequence kernels of words and landmarks, a word with itself having 1; words too short for a subsequence have 0."""
    words, landmarks = _ended(words), _ended(landmarks)
    out = np.zeros((len(words), len(landmarks)))
    norms = [0.0 if len(x) < ORDER else float(_cross(_symbols([x])[None], _symbols([x])[None])[0]) for x in landmarks]
    for own, symbols in _by_length(words):
        size = _cross(symbols, symbols)
        for j, x in enumerate(landmarks):
            if norms[j]:
                out[own, j] = _cross(symbols, np.broadcast_to(_symbols([x]), (len(own), len(x)))) / np.sqrt(size * norms[j])
    return out


def _weights(landmarks: list[str], alpha: np.ndarray) -> np.ndarray:
    """What a subsequence adds to a decision: the landmarks' share of it, summed by their coefficients."""
    out = np.zeros(SYMBOLS**ORDER)
    for x, c in zip(_ended(landmarks), alpha.tolist(), strict=True):
        if len(x) >= ORDER:
            symbols = _symbols([x])
            at, weight = _subsequences(len(x))
            place = symbols[at] @ SYMBOLS ** np.arange(ORDER - 1, -1, -1)
            np.add.at(out, place, c * weight / np.sqrt(_cross(symbols[None], symbols[None])[0]))
    return out.astype(np.float32)


def decisions(words: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    """The machine's decision on each word, ``bias`` at least. Of a word longer than ``WINDOW`` letters the largest of overlapping windows counts."""
    words = _ended(words)
    owner, pieces = np.arange(len(words)), words
    if any(len(w) > WINDOW for w in words):
        cut = [[w] if len(w) <= WINDOW else [w[i : i + WINDOW] for i in range(0, len(w) - WINDOW // 2, WINDOW // 2)] for w in words]
        owner = np.repeat(owner, [len(c) for c in cut])
        pieces = [x for c in cut for x in c]
    out = np.full(len(words), bias)
    powers = SYMBOLS ** np.arange(ORDER - 1, -1, -1)
    for own, symbols in _by_length(pieces):
        at, weight = _subsequences(symbols.shape[1])
        place = sum(symbols[:, at[:, k]] * powers[k] for k in range(ORDER))
        pull = weights[place] @ weight
        up = np.flatnonzero(pull > 0)  # others stay below the bias
        np.maximum.at(out, owner[own[up]], bias + pull[up] / np.sqrt(_cross(symbols[up], symbols[up])))
    return out


def _letters(word: str) -> str:
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Lower-cased words of the texts, letters only: each word's code, the number of words of each text, the distinct words.

    Other characters within a word fall away, so that letters with signs between
    them are one word; ``SPELT`` or more single letters in a row are a further word.
    """
    words: list[str] = []
    counts = np.empty(len(texts), np.int64)
    for i, t in enumerate(texts):
        own = t.decode(errors="replace").lower().split()
        counts[i] = len(own)
        words += own
    if not words:
        return np.zeros(0, np.int64), counts, []
    flat = np.empty(len(words), object)
    flat[:] = words
    codes, raw = pd.factorize(flat)
    clean = [_letters(w) for w in raw]
    size = np.array([len(w) for w in clean], np.int64)[codes]
    owner = np.repeat(np.arange(len(texts)), counts)[size > 0]
    codes, size = codes[size > 0], size[size > 0]
    single = np.flatnonzero(size == 1)
    if len(single):
        runs = np.split(single, np.flatnonzero((np.diff(single) > 1) | np.diff(owner[single]).astype(bool)) + 1)
        spelt = [r for r in runs if len(r) >= SPELT]
        if spelt:
            more = ["".join(clean[codes[i]] for i in r) for r in spelt]
            owner = np.concatenate([owner, owner[[r[0] for r in spelt]]])
            codes = np.concatenate([codes, len(clean) + np.arange(len(more))])
            order = np.argsort(owner, kind="stable")
            owner, codes, clean = owner[order], codes[order], clean + more
    return codes, np.bincount(owner, minlength=len(texts)).astype(np.int64), clean


def _strongest(texts: list[bytes], weights: np.ndarray, bias: float) -> np.ndarray:
    """The largest decision on a word of each text; ``bias`` without words."""
    codes, counts, words = _words(texts)
    out = np.full(len(texts), bias)
    full = np.flatnonzero(counts)
    if len(full):
        out[full] = np.maximum.reduceat(decisions(words, weights, bias)[codes], starts_of(counts)[full])
    return out


def _scored(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """The rows' first columns without the last (the text), and their scores."""
    m = model.value
    for batch in batches:
        for own, texts in slices(batch, limit=SLICE):
            if m.weights is None:
                score = np.full(len(texts), m.base)
            else:
                score = 1 / (1 + np.exp(-(m.slope * _strongest(texts, m.weights, m.bias) + m.offset)))
            yield pa.RecordBatch.from_arrays([*[own.column(i) for i in range(own.num_columns - 1)], pa.array(score)], names=[*own.schema.names[:-1], "score"])
    released()


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of labelled documents, in how many sentences each is, and a sketch of the document, which most of its near copies share.

    The sketch is the least hash of three words in a row of a sentence.
    """
    for batch in batches:
        for own, texts in slices(batch, limit=SLICE):
            split = [_SENTENCE.split(t.decode(errors="replace")) for t in texts]
            of = np.repeat(np.arange(len(texts)), [len(s) for s in split])
            codes, counts, words = _words([s.encode() for sentences in split for s in sentences])
            sentence = np.repeat(np.arange(len(counts)), counts)
            sketch = np.array([zlib.crc32(t) for t in texts], np.uint64)
            if len(words):
                h = pd.util.hash_array(np.array(words, object), categorize=False)[codes]
                three = (h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1]) * np.uint64(0xBF58476D1CE4E5B9) + h[2:]
                whole = np.flatnonzero(sentence[2:] == sentence[:-2])
                least = np.full(len(texts), np.iinfo(np.uint64).max)
                np.minimum.at(least, of[sentence[whole]], three[whole] ^ (three[whole] >> np.uint64(29)))
                sketch = np.where(least < np.iinfo(np.uint64).max, least, sketch)
            each = np.unique(sentence * len(words) + codes) if len(words) else np.zeros(0, np.int64)
            pair, n = np.unique(of[each // max(1, len(words))] * len(words) + each % max(1, len(words)), return_counts=True)
            doc, word = pair // max(1, len(words)), pair % max(1, len(words))
            columns = [pa.array(words, pa.string()).take(pa.array(word)), pa.array(sketch.view(np.int64)[doc]), own.column(0).take(pa.array(doc)), pa.array(n)]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "sketch", "toxic", "n"])
    released()


def _decided(batches: Iterator[pa.RecordBatch], weights: np.ndarray, bias: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.append_column("decision", pa.array(decisions(batch.column(0).to_pylist(), weights, bias)))


def support_vector_machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss, ``cost`` for each row; a last weight is the bias. By Newton's method on the rows within the margin."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, loss = np.zeros(x.shape[1]), np.inf

    def lost(w: np.ndarray) -> float:
        return 0.5 * w @ w + (cost * np.maximum(1 - y * (x @ w), 0) ** 2).sum()

    for _ in range(rounds):
        held = y * (x @ w) < 1
        own = x[held] * cost[held, None]
        step = np.linalg.solve(np.eye(len(w)) + 2 * own.T @ x[held], 2 * own.T @ y[held]) - w
        size = 1.0
        while size > 1e-6 and lost(w + size * step) > lost(w):
            size /= 2
        w = w + size * step
        before, loss = loss, lost(w)
        if before - loss <= 1e-9 * loss:
            break
    return w


def _with_a_letter(word: str) -> list[str]:
    """The word with a letter inserted at each place within it; which letter follows from the word and the place."""
    letters = "etaoinshrdlucmfwypvbgkjqxz"
    return [word[:i] + letters[zlib.crc32(f"{word}{i}".encode()) % len(letters)] + word[i:] for i in range(1, len(word))]


def _machine(words: list[str], y: np.ndarray, cost: np.ndarray, landmarks: list[str]) -> tuple[np.ndarray, float]:
    """Coefficients of the landmarks and the bias: a linear machine on the Nyström features of the words."""
    values, vectors = np.linalg.eigh(kernels(landmarks, landmarks))
    held = values > 1e-6 * values.max()
    whiten = vectors[:, held] / np.sqrt(values[held])
    w = support_vector_machine(kernels(words, landmarks) @ whiten, y, cost)
    return whiten @ w[:-1], float(w[-1])


def _line(decision: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the log odds of being toxic, by Newton's method on smoothed labels."""
    many, few = weight[toxic].sum(), weight[~toxic].sum()
    target = np.where(toxic, (many + 1) / (many + 2), 1 / (few + 2))
    x = np.stack([decision, np.ones(len(decision))], axis=1)
    line = np.array([0.0, np.log((many + 1) / (few + 1))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-(x @ line)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (weight * (target - p)))
        line += step * min(1.0, 2.0 / np.abs(step).max() if np.abs(step).max() else 1.0)
        if np.abs(step).max() < 1e-8:
            break
    return float(line[0]), float(line[1])


def _sampled(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[bool, int], dict[bool, int]]:
    """Texts of the sample with ``toxic``, and how many documents of each class are labelled and were taken.

    The ids of the sample (``2 * SAMPLE`` at most) go through the driver to all tasks.
    """
    spark = docs.sparkSession
    one = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg((F.max("toxic") > 0).alias("toxic"))
    one = durable(one)
    held = {bool(r[0]): r[1] for r in one.groupBy("toxic").count().collect()}
    ids = [(r[0], kind) for kind in (False, True) for r in one.where(F.col("toxic") == kind).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("id").collect()]
    taken = {kind: sum(k == kind for _, k in ids) for kind in (False, True)}
    sample = F.broadcast(spark.createDataFrame(ids, "id long, toxic boolean"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return durable(texts.join(sample, texts["doc_id"] == sample["id"]).select("toxic", "text")), held, taken


def learn_toxicity(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """A model from ``docs`` (``doc_id``, ``text``) and ``labels`` (``doc_id``, ``toxic``).

    The sample is ``SAMPLE`` documents of each class at most; each of their sentences has its document's label. A sentence
    bears on one word of it. Positive examples begin with words that are in more toxic documents than
    chance allows (a likelihood ratio above what the number of words makes likely; near copies count as one document, by a
    sketch), negative ones with the most frequent words of clean sentences. Each round adds the words of clean sentences that the machine takes
    for most toxic, and words of toxic sentences alone that it takes for toxic. A word's cost grows with the log of its sentences.
    The words that stand out most are examples with a letter inserted, too, unless a clean sentence has such a word among the examples. Landmarks are
    the first positive and the last negative examples.
    """
    spark = docs.sparkSession
    texts, held, taken = _sampled(docs, labels)
    total = sum(held.values())
    base = held.get(True, 0) / total if total else 0.0
    nothing = ToxicityModel(None, 0.0, 0.0, 0.0, base)
    if not taken[True] or not taken[False]:
        return nothing
    met = texts.mapInArrow(_met, "word string, sketch long, toxic boolean, n long").groupBy("word", "sketch", "toxic").agg(F.sum("n").alias("n"))
    counted = durable(
        met.groupBy("word").agg(
            F.count_if("toxic").alias("bad"), F.count_if(~F.col("toxic")).alias("clean"), F.coalesce(F.sum(F.when(F.col("toxic"), F.col("n"))), F.lit(0)).alias("bad_n"), F.coalesce(F.sum(F.when(~F.col("toxic"), F.col("n"))), F.lit(0)).alias("clean_n")
        )
    )
    sums = counted.agg(F.sum("bad"), F.sum("clean"), F.count(F.lit(1))).first()
    if not sums[0] or not sums[1]:
        return nothing
    share, n = sums[0] / (sums[0] + sums[1]), F.col("bad") + F.col("clean")
    part = lambda k, p: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / (n * p))).otherwise(0.0)
    beyond = F.when(F.col("bad") > n * share, 2 * (part("bad", share) + part("clean", 1 - share))).otherwise(0.0)
    chance = 2 * float(np.log(sums[2])) + 4
    enough = counted.withColumn("beyond", beyond).where((F.col("beyond") > chance) & (F.length("word") >= ORDER))
    bad = {r["word"]: r["bad_n"] for r in enough.orderBy(F.desc("beyond"), "word").limit(ADDED).collect()}
    if not bad:
        return nothing
    innocent = counted.where("clean_n > 0").select("word", F.col("clean_n").alias("n"))
    clean = {r["word"]: r["n"] for r in innocent.orderBy(F.desc("n"), "word").limit(ADDED).collect() if r["word"] not in bad}
    for search in range(SEARCHES + 1):
        longer = {v: bad[w] for w in list(bad)[:SPREAD] for v in _with_a_letter(w) if v not in clean}
        words, landmarks = [*bad, *longer, *clean], [*list(bad)[:LANDMARKS], *list(clean)[-LANDMARKS:]]
        y = np.array([1.0] * (len(bad) + len(longer)) + [-1.0] * len(clean))
        sentences = np.log1p(np.array([*bad.values(), *longer.values(), *clean.values()], float))
        cost = COST * np.where(y > 0, sentences / sentences[y > 0].mean(), sentences / max(1e-9, sentences[y < 0].mean()))
        cost[len(bad) : len(bad) + len(longer)] *= SPREAD_COST
        alpha, bias = _machine(words, y, cost, landmarks)
        weights = _weights(landmarks, alpha)
        if search == SEARCHES:
            break
        decided = durable(counted.mapInArrow(partial(_decided, weights=weights, bias=bias), f"{counted.schema.simpleString()[7:-1].replace(':', ' ')}, decision double"))
        wrong = decided.where("clean_n > 0").orderBy(F.desc("decision"), "word").limit(ADDED).collect()
        clean |= {r["word"]: r["clean_n"] for r in reversed(wrong) if r["word"] not in bad}
        alike = decided.where("clean_n = 0 and bad > 1 and decision > 0.5").orderBy(F.desc("bad"), F.desc("decision"), "word").limit(ADDED).collect()
        bad |= {r["word"]: r["bad_n"] for r in alike}
    shared = spark.sparkContext.broadcast(ToxicityModel(weights, bias, 1.0, 0.0, base))
    seen = texts.mapInArrow(partial(_scored, model=shared), "toxic boolean, score double").toArrow()
    toxic, p = np.asarray(seen.column(0).to_pylist(), bool), np.asarray(seen.column(1))
    each = {kind: held.get(kind, 0) / max(1, taken[kind]) for kind in (False, True)}
    slope, offset = _line(np.log(p / (1 - p)), toxic, np.where(toxic, each[True], each[False]))
    return ToxicityModel(weights, bias, slope, offset, base, tuple(landmarks), tuple(alpha.tolist()))


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1) of every whole text of ``docs`` (``doc_id``, ``text``): how likely ``model`` holds it to be labelled toxic.

    A text is as toxic as its most toxic word; the kernel lets letters be inserted between those of an insult.

    Defined cases. Null and empty texts, and those without letters, have no word and so the score of the decision without
    one. Every row has a score, repeated ones too; doc_id may be null. Words of less than ``ORDER`` letters count as none.
    An unspaced run of letters is looked at in overlapping windows. A model learnt without toxic or
    without clean documents, or without a word that stands out in toxic ones, gives all texts the share of toxic documents
    among the labelled ones. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_scored, model=shared), "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = held_out(F.col("doc_id"), 4, 2)
    found = score_toxicity(docs, learn_toxicity(docs.where(~out), labels.where(~out)))
    return found.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
