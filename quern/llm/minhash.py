"""MinHash near-duplicate detection (operator 1)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, ragged, released, settled, slices, starts_of, table, word_codes
from .components import connected_components

#: Rows of a band, and the probability with which a pair at the least similarity may share no band.
ROWS, MISS = 5, 1e-7
#: Standard deviations by which a signature may fall short of the least similarity before a pair is passed over.
DEVIATIONS = 6
#: Bytes of text that are worked on together.
SLICE = 2 << 20
#: Largest share of a cluster that one task compares with another one: nodes, shingles.
CHUNK_NODES, CHUNK_SHINGLES = 512, 1 << 19
#: Keys to which the sets of a cluster of several parts are spread.
SALTS = 64

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of each text, ascending, and their numbers.

    A text of fewer than ``width`` words has its whole word sequence as its only
    shingle; a text without words has none.
    """
    codes, distinct, words = word_codes(texts)
    if not len(codes):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    h = _mixed(pd.util.hash_array(distinct, categorize=False))[codes]
    counts = np.where(words >= width, words - width + 1, np.minimum(words, 1))
    at = ragged(starts_of(words), counts)
    used = np.repeat(np.minimum(words, width), counts)
    out = used.astype(np.uint64)
    last = len(h) - 1
    for k in range(width):
        out = np.where(used > k, out * _STEP + h[np.minimum(at + k, last)], out)
    out = _mixed(out)
    owner = np.repeat(np.arange(len(texts)), counts)
    order = np.lexsort((out, owner))
    out, owner = out[order], owner[order]
    fresh = np.ones(len(out), bool)
    fresh[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    return out[fresh], np.bincount(owner[fresh], minlength=len(texts)).astype(np.int64)


def hash_family(k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and addends of ``k`` multiply-add-shift universal hashes."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, k, dtype=np.uint64)


def signatures(sets: np.ndarray, counts: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Minimum of each universal hash over each non-empty set: uint32, one row a set (empty: zeros)."""
    a, b = family
    out = np.zeros((len(counts), len(a)), np.uint32)
    full = np.flatnonzero(counts)
    first, ends = starts_of(counts), np.cumsum(counts)
    i = 0
    while i < len(full):  # runs of sets that stay in the processor's cache
        j = max(i + 1, int(np.searchsorted(ends[full], first[full[i]] + (1 << 16), side="right")))
        own = full[i:j]
        x = sets[first[own[0]] : ends[own[-1]]]
        cuts = first[own] - first[own[0]]
        for k in range(len(a)):
            out[own, k] = np.minimum.reduceat((x * a[k] + b[k]) >> np.uint64(32), cuts)
        i = j
    return out


def set_keys(sets: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """16 bytes that name each set: two sums of independently mixed members, with its size."""
    out = np.zeros((len(counts), 2), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        cuts = starts_of(counts)[full]
        out[full, 0] = np.add.reduceat(_mixed(sets ^ _STEP), cuts)
        out[full, 1] = np.add.reduceat(_mixed(sets + _MIX[0]), cuts)
    out[:, 0] = _mixed(out[:, 0] + counts.astype(np.uint64) * _STEP)
    raw = out.astype(">u8").tobytes()
    return [raw[16 * i : 16 * i + 16] for i in range(len(counts))]


def bands_for(similarity: float, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands with which a pair of this similarity shares none with probability ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log1p(-(similarity**rows)))


def _sketch(batches: Iterator[pa.RecordBatch], width: int, rows: int, bands: int, seed: int) -> Iterator[pa.RecordBatch]:
    family = hash_family(rows * bands, seed)
    for batch in batches:
        for own, texts in slices(batch, limit=SLICE):
            sets, counts = shingle_sets(texts, width)
            sig = signatures(sets, counts, family).astype(np.uint64).reshape(len(texts), bands, rows)
            h = np.broadcast_to(np.arange(bands, dtype=np.uint64), sig.shape[:2])
            for k in range(rows):
                h = _mixed(h * _STEP + sig[:, :, k])
            keep = counts > 0
            offsets = np.concatenate(([0], np.cumsum(keep * bands))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    own.column(own.schema.get_field_index("doc_id")),
                    pa.array(counts),
                    pa.array(set_keys(sets, counts), pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(h[keep].reshape(-1).view(np.int64))),
                ],
                names=["doc_id", "n_shingles", "node", "bands"],
            )
    released()


def _full_sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for own, texts in slices(batch, limit=SLICE):
            sets, counts = shingle_sets(texts, width)
            ends = np.cumsum(counts)
            keys = set_keys(sets, counts)
            wanted = own.column(own.schema.get_field_index("node")).to_pylist()
            keep = [i for i in range(len(texts)) if keys[i] == wanted[i]]
            yield pa.RecordBatch.from_arrays(
                [
                    own.column(own.schema.get_field_index("cluster")).take(pa.array(keep, pa.int64())),
                    pa.array([wanted[i] for i in keep], pa.binary()),
                    pa.array([sets[ends[i] - counts[i] : ends[i]].tobytes() for i in keep], pa.binary()),
                ],
                names=["cluster", "node", "members"],
            )
    released()


def confirmed_forest(sets: list[np.ndarray], num: int, den: int, family: tuple[np.ndarray, np.ndarray], agree: float, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges (member, first member of its group) of the groups that confirmed links make of these sets.

    A pair links if den * |A and B| >= num * |A or B| on the full sets. Signatures
    are compared first; sets without a promising partner leave. With ``side`` (a
    boolean a set) only pairs across are compared.
    """
    n = len(sets)
    a, b = (np.arange(n), np.arange(n)) if side is None else (np.flatnonzero(~side), np.flatnonzero(side))
    counts = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    sig = signatures(flat, counts, family)
    near = np.zeros((len(a), len(b)), np.int16)
    for k in range(sig.shape[1]):
        near += sig[a, None, k] == sig[None, b, k]
    promising = near >= agree * sig.shape[1]
    if side is None:
        np.fill_diagonal(promising, False)
    del near
    live_a, live_b = promising.any(axis=1), promising.any(axis=0)
    a, b, promising = a[live_a], b[live_b], promising[np.ix_(live_a, live_b)]
    live = np.union1d(a, b)
    if len(live) < 2:
        return []
    at = ragged(starts_of(counts)[live], counts[live])
    _, code, times = np.unique(flat[at], return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(live)), counts[live])
    shared = times > 1  # the others are in no intersection
    dense = np.cumsum(shared) - 1
    keep = shared[code]
    code, owner = dense[code[keep]], owner[keep]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    in_a, in_b = np.searchsorted(live, a), np.searchsorted(live, b)
    common = np.zeros((len(a), len(b)), np.float32)
    step = 4096
    for low in range(0, int(shared.sum()), step):
        i, j = np.searchsorted(code, (low, low + step))
        m = np.zeros((len(live), step), np.float32)
        m[owner[i:j], code[i:j] - low] = 1
        common += m[in_a] @ m[in_b].T
    common = common.astype(np.int64)
    linked = np.zeros((len(live), len(live)), bool)
    linked[np.ix_(in_a, in_b)] = promising & (den * common >= num * (counts[a][:, None] + counts[b][None, :] - common))
    linked |= linked.T
    out, todo = [], np.ones(len(live), bool)
    for i in range(len(live)):
        if not todo[i]:
            continue
        todo[i], front = False, np.array([i])
        while len(front):
            found = linked[front].any(axis=0) & todo
            todo &= ~found
            front = np.flatnonzero(found)
            out += [(int(live[x]), int(live[i])) for x in front]
    return out


def _confirm(key: tuple, rows: pd.DataFrame, num: int, den: int, k: int, seed: int, agree: float) -> pd.DataFrame:
    rows = rows.drop_duplicates("node")
    nodes = rows["node"].tolist()
    sets = [np.frombuffer(x, np.uint64) for x in rows["members"]]
    # Pairs of one part are compared where that part meets itself.
    side = None if key[1] == key[2] else (rows["part"] == key[2]).to_numpy()
    found = confirmed_forest(sets, num, den, hash_family(k, seed), agree, side) if len(sets) > 1 else []
    return pd.DataFrame({"a": pd.Series([nodes[i] for i, _ in found], dtype=object), "b": pd.Series([nodes[j] for _, j in found], dtype=object)})


def near_duplicates(
    docs: DataFrame,
    *,
    width: int = 5,
    num: int = 85,
    den: int = 100,
    rows: int = ROWS,
    bands: int | None = None,
    seed: int = 20,
) -> DataFrame:
    """Class of near-duplicates of every row of ``docs`` (``doc_id``, ``text``).

    Returns ``doc_id``, ``n_shingles``, ``component_id``, ``kept``. Two texts link
    if num/den or more of the union of their sets of word shingles is common to
    both; ``component_id`` is the least doc_id reachable by links.

    Method. (1) One pass over whole texts makes each shingle set's 128-bit name
    and the band hashes of its universal-hash minima. Equal sets become one node.
    (2) Each band bucket links its nodes to its least node, which gives a star, not
    all pairs; alternating large and small stars join them to candidate clusters.
    (3) Only texts of clusters are read into full sets. A cluster is dealt into
    chunks of bounded size, and one task compares two chunks: signatures first,
    then exact intersections; it returns a forest of confirmed links, not pairs.
    (4) The stars run again over confirmed links.
    A link is lost only by a pair that shares no band (1e-7 at the least similarity)
    or whose signatures agree in too few places, ``DEVIATIONS`` below the least
    similarity (4e-8 there with the defaults, a binomial tail of independent hashes).
    Work within a cluster of different near-copies is quadratic in its number of
    different texts, spread over tasks; copies of one text count once.

    Defined cases. Null or empty text, or one without words: empty set, linked
    with nothing, its own component, kept. Null doc_id: the text takes no part,
    component null, kept. Repeated rows each get a row. One doc_id with several
    texts: each text has its own component by its set. Other columns are ignored.
    """
    least = num / den
    bands = bands or bands_for(least, rows)
    agree = least - DEVIATIONS * math.sqrt(least * (1 - least) / (rows * bands))
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    sketch = durable(
        whole.mapInArrow(
            partial(_sketch, width=width, rows=rows, bands=bands, seed=seed),
            "doc_id long, n_shingles long, node binary, bands array<long>",
        )
    )
    usable = sketch.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    texts = usable.count()
    first = settled(usable.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.max("n_shingles").alias("n")), texts)

    member = usable.select("node", "doc_id", F.posexplode("bands").alias("band", "hash"))
    heads = member.groupBy("band", "hash").agg(F.min("node").alias("head"), F.max("node").alias("tail")).where("head < tail")
    heads = settled(heads.select("hash", "band", "head"), texts * bands)
    star = usable.select("node", F.posexplode("bands").alias("band", "hash")).join(heads, ["hash", "band"]).select("node", "head").where("node != head")
    clusters = connected_components(star, "node", "head", texts * bands).select("node", F.col("root").alias("cluster")).join(first, "node")
    clusters = settled(clusters, texts)

    wanted = whole.join(clusters.select("cluster", "node", F.col("first_id").alias("doc_id")), "doc_id").select("cluster", "node", "text")
    sets = wanted.mapInArrow(partial(_full_sets, width=width), "cluster binary, node binary, members binary")
    chunks = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("total"))
    chunks = chunks.select("cluster", F.greatest(F.ceil(F.col("nodes") / CHUNK_NODES), F.ceil(F.col("total") / CHUNK_SHINGLES)).cast("int").alias("parts"))
    chunks = settled(chunks.where("parts > 1"), texts)
    # A cluster of p parts is dealt to p (p + 1) / 2 tasks; each compares a part with itself or two parts with each other.
    # The few clusters of several parts are matched by salted keys, as one may hold a large share of the sets.
    salted = chunks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = sets.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(salted, ["cluster", "salt"], "left")
    dealt = dealt.withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64(F.lit(1), "node"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("cluster", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "members")
    confirm = partial(_confirm, num=num, den=den, k=rows * bands, seed=seed, agree=agree)
    links = dealt.groupBy("cluster", "i", "j").applyInPandas(lambda key, pdf: confirm(key, pdf), "a binary, b binary")
    groups = settled(connected_components(links, "a", "b", texts).join(first, "node"), texts)
    least = groups.groupBy("root").agg(F.min("first_id").alias("component"))
    named = groups.join(least, "root").select("node", "component")
    named = settled(first.join(named, "node", "left").select("node", F.coalesce("component", "first_id").alias("component")), texts)

    out = sketch.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.col("doc_id")).otherwise(F.col("component")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
