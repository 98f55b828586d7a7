"""Language-model scoring by context-tree weighting (operator 3)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import clamp_partitions, durable, ragged, released, segment_sums, slices, starts_of, table, word_codes
from .language import held_out

#: Bytes of context, and the last bytes that the contexts of one task share. A
#: shared end then has 2^16 contexts and 2^24 continuations at most.
DEPTH, SHARED = 5, 3
#: Bytes of the texts of a block; of all texts for each part of the words and grams; most parts to which a block deals.
BLOCK_BYTES, PART_BYTES, MOST_PARTS = 12 << 20, 24 << 20, 256
#: Blocks that are added up before they are brought together with others; words or grams of all their sums for each part of these.
GROUP_BLOCKS, PART_ITEMS = 256, 1 << 22
#: Most groups of contexts, and most tasks to which the blocks are dealt at the end.
MOST_CONTEXTS, MOST_TASKS = 4096, 100_000
#: Marks the beginning and the end of a text; no UTF-8 text has this byte.
EDGE = b"\xff"
#: Name of the end token among words; no word has this byte.
END = b"\t"

#: Kinds of rows between the steps: words (with the end token), grams, sums over all words.
WORDS, GRAMS, SUMS = 0, 1, 2

_PACK = "block long, part int, kind int, items binary, n binary, distinct long, total long"
_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, log_counts double, score double, code_length double"


def log_gamma(z: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for positive numbers, to about 1e-12."""
    z = np.asarray(z, np.float64)
    shift = np.zeros_like(z)
    small = z < 8
    w = np.where(small, z + 8, z)
    for i in range(8):
        shift += np.where(small, np.log(z + i), 0)
    series = 1 / (12 * w) - 1 / (360 * w**3) + 1 / (1260 * w**5) - 1 / (1680 * w**7)
    return (w - 0.5) * np.log(w) - w + 0.5 * np.log(2 * np.pi) + series - shift


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1) - np.log(np.pi)


def _distinct(x: np.ndarray) -> np.ndarray:
    """Distinct values, ascending, by sorting."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def byte_grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of the texts, each with the ``depth`` bytes before it, as numbered grams.

    Each text is followed by an edge and preceded by ``depth`` edges. Returns the gram
    of each position as an index, the distinct grams as integers (the last byte
    lowest), and the number of positions of each text. Grams grow by one byte a
    step and are renumbered densely, so a step costs one pass.
    """
    flat = np.frombuffer(b"".join(EDGE * depth + t + EDGE for t in texts), np.uint8)
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    present = np.flatnonzero(np.bincount(flat, minlength=256))
    renumber = np.zeros(256, np.int32)
    renumber[present] = np.arange(len(present))
    code, size = renumber[flat], len(present)
    now, values = code, present.astype(np.int64)
    for step in range(1, depth + 1):
        wide = np.int32 if len(values) * size < 1 << 31 else np.int64
        key = now[:-1].astype(wide, copy=False) * wide(size) + code[step:]
        if step == depth:  # drop what spans two texts
            key = key[ragged(starts_of(lengths + depth), lengths)]
        if len(values) * size <= max(1 << 20, 4 * len(key)):
            seen = np.zeros(len(values) * size, bool)
            seen[key] = True
            distinct = np.flatnonzero(seen)
            place = np.zeros(len(seen), np.int32)
            place[distinct] = np.arange(len(distinct), dtype=np.int32)
            now = place[key]
        else:
            distinct, now = np.unique(key, return_inverse=True)
            now = now.astype(np.int32)
        values = (values[distinct // size] << 8) | present[distinct % size]
    return now, values, lengths


def _runs(texts: list[bytes], limit: int = 4 << 20):
    """Index ranges of texts with about ``limit`` bytes together."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > limit:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's rows as blocks of up to ``BLOCK_BYTES`` of lower-cased text (a longer text alone), each compressed into one row."""
    first, n, held, size = TaskContext.get().partitionId() << 24, 0, [], 0

    def packed() -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        docs = pa.concat_tables(held).combine_chunks()
        with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 1))) as out:
            out.write_table(docs)
        return pa.RecordBatch.from_arrays([pa.array([first + n]), pa.array([size]), pa.array([sink.getvalue().to_pybytes()])], names=["block", "size", "docs"])

    for batch in batches:
        for own, texts in slices(batch, limit=BLOCK_BYTES // 4):
            more = sum(map(len, texts))
            if held and size + more > BLOCK_BYTES:
                yield packed()
                n, held, size = n + 1, [], 0
            ids, out = (own.column(own.schema.get_field_index(c)) for c in ("doc_id", "held_out"))
            held.append(pa.table({"doc_id": ids, "held_out": out, "text": pa.array([t.lower() for t in texts], pa.large_binary())}))
            size += more
    if held:
        yield packed()
    released()


def _block_docs(blob: bytes) -> tuple[pa.Array, np.ndarray, list[bytes]]:
    """Ids, held-out flags and texts of a block."""
    docs = pa.ipc.open_stream(blob).read_all()
    return docs.column("doc_id"), np.asarray(docs.column("held_out").to_pylist(), dtype=bool), docs.column("text").to_pylist()


def _hashes(kind: int, items: np.ndarray) -> np.ndarray:
    if kind == WORDS:
        return pd.util.hash_array(items, categorize=False) if len(items) else np.zeros(0, np.uint64)
    h = items.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def _part(kind: int, h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(32) if kind == WORDS else h) % np.uint64(parts)).astype(np.int64)


def _split(h: np.ndarray, per: int) -> np.ndarray:
    """The place of an item among the ``per`` parts into which a part is split."""
    return ((h * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(40)) % np.uint64(per)).astype(np.int64)


def _arranged(kind: int, items: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of distinct items (grams: ascending ones) that depends on them alone, by part first; and the parts in this order."""
    h = _hashes(kind, items)
    part = _part(kind, h, parts)
    if kind == GRAMS:
        order = np.argsort(part, kind="stable")
    elif len(_distinct(h)) < len(h):
        order = np.array(sorted(range(len(h)), key=lambda i: (part[i], h[i], items[i])))
    else:
        order = np.lexsort((h, part))
    return order, part[order]


def _block_words(texts: list[bytes], parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the words of a block, its distinct words and the end token as arranged, their parts, and words a text."""
    codes, distinct, counts = word_codes(texts, lower=False)
    items = np.empty(len(distinct) + 1, object)
    items[:-1], items[-1] = distinct, END
    order, part = _arranged(WORDS, items, parts)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place[codes] if len(codes) else codes, items[order], part, counts


def _block_grams(runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]], parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of a block as arranged, and their parts."""
    grams = _distinct(np.concatenate([values for _, values, _ in runs]))
    order, part = _arranged(GRAMS, grams, parts)
    return grams[order], part


def _pressed(x: bytes | np.ndarray | None, rising: bool = False) -> bytes | None:
    """Compressed bytes of an array or text, after their length; rising integers as differences."""
    if x is None:
        return None
    raw = x if isinstance(x, bytes) else (np.diff(x, prepend=x.dtype.type(0)) if rising else x).tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _raw(x: bytes) -> bytes:
    return pa.Codec("zstd").decompress(x[8:], decompressed_size=int.from_bytes(x[:8], "little"), asbytes=True)


def _numbers(x: bytes, dtype, rising: bool = False) -> np.ndarray:
    out = np.frombuffer(_raw(x), dtype)
    return np.cumsum(out, dtype=dtype) if rising else out


def _column(rows: pa.Table, name: str, dtype, rising: bool = False) -> tuple[np.ndarray, list[int]]:
    """All numbers of a packed column, and how many each row has."""
    arrays = [_numbers(x, dtype, rising) for x in rows.column(name).to_pylist()]
    return np.concatenate([np.zeros(0, dtype), *arrays]), [len(a) for a in arrays]


def _packs(rows: list[tuple]) -> pa.Table:
    """Rows of ``_PACK``, compressed; the last two columns are for ``SUMS`` alone. Grams are ascending."""
    kinds = {"block": pa.int64(), "part": pa.int32(), "kind": pa.int32(), "items": pa.binary(), "n": pa.binary(), "distinct": pa.int64(), "total": pa.int64()}
    rows = [(block, part, kind, _pressed(items, kind == GRAMS), _pressed(n), *(more or (None, None))) for block, part, kind, items, n, *more in rows]
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.table({k: pa.array(v, t) for (k, t), v in zip(kinds.items(), columns, strict=True)})


def _dealt(block: int, kind: int, items: np.ndarray, part: np.ndarray, n: np.ndarray) -> list[tuple]:
    """A row for each part that occurs; ``part`` is ascending."""
    first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))).tolist() if len(part) else []
    return [(block, int(part[i]), kind, b"\n".join(items[i:j]) if kind == WORDS else items[i:j], n[i:j]) for i, j in zip(first, [*first[1:], len(part)], strict=True)]


def _statistics(batches: Iterator[pa.RecordBatch], depth: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Training counts of each block's words and grams, by part; those of held-out texts alone have 0."""
    for batch in batches:
        for block, blob in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
            _, out, texts = _block_docs(blob.as_py())
            codes, words, part, counts = _block_words(texts, parts)
            n = np.bincount(codes[np.repeat(~out, counts)], minlength=len(words)).astype(np.int64)
            n[words == END] = (~out).sum()
            rows = _dealt(block, WORDS, words, part, n)
            del codes, words
            runs, totals = [], []
            for i, j in _runs(texts):
                now, values, lengths = byte_grams(texts[i:j], depth)
                totals.append(np.bincount(now[np.repeat(~out[i:j], lengths)], minlength=len(values)))
                runs.append((None, values, lengths))
            grams, part = _block_grams(runs, parts)
            order = np.argsort(grams)
            n = np.zeros(len(grams), np.int64)
            for (_, values, _), total in zip(runs, totals, strict=True):
                n[order[np.searchsorted(grams, values, sorter=order)]] += total
            yield from _packs(rows + _dealt(block, GRAMS, grams, part, n)).combine_chunks().to_batches()
    released()


def _items(rows: pa.Table, kind: int) -> tuple[np.ndarray, list[int]]:
    """All items of packed rows one after the other, and how many each row has."""
    if kind == GRAMS:
        return _column(rows, "items", np.int64, True)
    blobs = [_raw(b).split(b"\n") for b in rows.column("items").to_pylist()]
    flat = np.empty(sum(map(len, blobs)), object)
    flat[:] = [w for b in blobs for w in b]
    return flat, [len(b) for b in blobs]


def _united(flat: np.ndarray, kind: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct items as arranged, their parts, and the place of each of ``flat`` among them."""
    if kind == GRAMS:
        distinct, at = np.unique(flat, return_inverse=True)
    else:
        at, distinct = pd.factorize(flat)
    order, part = _arranged(kind, distinct, parts)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return distinct[order], part, place[at]


def _added_up(key: tuple, rows: pa.Table, parts: int) -> pa.Table:
    """One part of the counts of a group of blocks, as of one block that has the group's number; ``distinct`` tells how many items."""
    group, kind = key[0].as_py(), key[2].as_py()
    flat, _ = _items(rows, kind)
    items, part, at = _united(flat, kind, parts)
    n = np.bincount(at, weights=_column(rows, "n", np.int64)[0], minlength=len(items)).astype(np.int64)
    return _packs([(*row, len(row[4]), None) for row in _dealt(group, kind, items, part, n)])


def _parted(batches: Iterator[pa.RecordBatch], per: int) -> Iterator[pa.RecordBatch]:
    """Each row as up to ``per`` rows of a part each."""
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        for i in range(len(rows)):
            row = rows.slice(i, 1)
            block, part, kind = (row.column(c)[0].as_py() for c in ("block", "part", "kind"))
            items, n = _items(row, kind)[0], _column(row, "n", np.int64)[0]
            place = _split(_hashes(kind, items), per)
            order = np.argsort(place, kind="stable")
            yield from _packs(_dealt(block, kind, items[order], part * per + place[order], n[order])).combine_chunks().to_batches()


def _handed_down(key: tuple, asked: pa.Table, found: pa.Table, parts: int, per: int) -> pa.Table:
    """What a group has been told about one part, for each of its blocks."""
    if not len(asked):
        return _packs([])
    kind = key[2].as_py()
    flat, sizes = _items(asked, kind)
    items, _, at = _united(flat, kind, parts)
    place = _split(_hashes(kind, items), per)
    told = np.zeros(len(items), np.int64 if kind == WORDS else np.float64)
    for part, n in zip(found.column("part").to_pylist(), found.column("n").to_pylist(), strict=True):
        told[place == part % per] = _numbers(n, told.dtype)
    ends = np.cumsum(sizes).tolist()
    part = key[1].as_py()
    return _packs([(block, part, kind, None, told[at[e - m : e]]) for block, m, e in zip(asked.column("block").to_pylist(), sizes, ends, strict=True)])


def _total_words(key: tuple, rows: pa.Table) -> pa.Table:
    """Training counts of a part's words over all blocks, in each block's order.

    The row without a block has the part's distinct training words and their sum.
    """
    flat, sizes = _items(rows, WORDS)
    codes, distinct = pd.factorize(flat)
    own, _ = _column(rows, "n", np.int64)
    total = np.bincount(codes, weights=own, minlength=len(distinct)).astype(np.int64)
    known, ends, part = total[codes], np.cumsum(sizes).tolist(), key[0].as_py()
    out = [(block, part, WORDS, None, known[e - n : e]) for block, n, e in zip(rows.column("block").to_pylist(), sizes, ends, strict=True)]
    return _packs([*out, (None, part, SUMS, None, None, int((total > 0).sum()), int(total.sum()))])


def _total_grams(key: tuple, rows: pa.Table, groups: int) -> pa.Table:
    """Distinct grams of a part with their training counts over all blocks, by group of contexts (``block``)."""
    grams, at = np.unique(_column(rows, "items", np.int64, True)[0], return_inverse=True)
    n = np.bincount(at, weights=_column(rows, "n", np.int64)[0], minlength=len(grams)).astype(np.int64)
    group = _part(GRAMS, _hashes(GRAMS, (grams >> 8) & ((1 << (8 * SHARED)) - 1)), groups)
    order = np.argsort(group, kind="stable")
    part = key[0].as_py()
    return _packs([(g, part, kind, items, n) for g, _, kind, items, n in ((r[1], *r[1:]) for r in _dealt(0, GRAMS, grams[order], group[order], n[order]))])


class _Subtrees:
    """All contexts that share one of several ends of ``SHARED`` bytes: node counts and weights.

    A node is a context with a prefix of the next byte's bits (1 to 255).
    ``levels`` are the context lengths from ``depth`` down to ``SHARED``.
    """

    def __init__(self, grams: np.ndarray, n: np.ndarray, depth: int):
        self.x, self.grams = grams & 255, grams
        self.bits = np.array([[(x >> (7 - k)) & 1 for k in range(8)] for x in range(256)], np.int8)[self.x]
        self.nodes = np.array([[(1 << k) | (x >> (8 - k)) for k in range(8)] for x in range(256)], np.int64)[self.x]
        self.at, self.levels = {}, {}
        weighted = names = None
        for d in range(depth, SHARED - 1, -1):
            # Nodes are numbered among those that occur: (context, node) as one integer.
            name = (((grams >> 8) & ((1 << (8 * d)) - 1))[:, None] << 8) | self.nodes
            own_names, at = np.unique(name, return_inverse=True)
            at = at.reshape(name.shape)
            ones = np.bincount(at.ravel(), weights=(n[:, None] * self.bits).ravel(), minlength=len(own_names))
            zeros = np.bincount(at.ravel(), weights=(n[:, None] * (1 - self.bits)).ravel(), minlength=len(own_names))
            own = log_kt(zeros, ones)
            if weighted is None:
                children, now = None, own
            else:
                parent = (((names >> 8) & ((1 << (8 * d)) - 1)) << 8) | (names & 255)
                children = np.bincount(np.searchsorted(own_names, parent), weights=weighted, minlength=len(own_names))
                now = np.logaddexp(own, children) - np.log(2)
            self.at[d], self.levels[d] = at, (zeros, ones, own, children)
            names, weighted = own_names, now
        self.names, self.weighted = names, weighted

    def log_p(self, upper: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
        """log10 probability of each gram's last byte given those before it, mixed over all depths.

        ``upper``: for the context lengths below ``SHARED``, longest first, the names
        of the nodes that occur, the weight of a node's own estimate, and its
        estimate of a one.
        """
        p = None
        for d in sorted(self.levels, reverse=True):
            zeros, ones, own, children = (x[self.at[d]] if x is not None else None for x in self.levels[d])
            kt = (np.where(self.bits == 1, ones, zeros) + 0.5) / (zeros + ones + 1)
            p = kt if children is None else _mix(_weight(own, children), kt, p)
        for d, (names, weight, one) in zip(range(SHARED - 1, -1, -1), upper, strict=True):
            name = (((self.grams >> 8) & ((1 << (8 * d)) - 1))[:, None] << 8) | self.nodes
            at = np.searchsorted(names, name)
            p = _mix(weight[at], np.where(self.bits == 1, one[at], 1 - one[at]), p)
        return np.log10(p).sum(axis=1)


def _weight(own: np.ndarray, children: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.clip(children - own, -700, 700)))


def _mix(weight: np.ndarray, own: np.ndarray, deeper: np.ndarray) -> np.ndarray:
    return weight * own + (1 - weight) * deeper


def _pieces(grams: np.ndarray, limit: int = 1 << 17) -> list[np.ndarray]:
    """Index sets of the grams, in runs of about ``limit`` that part no shared end of contexts."""
    end = (grams >> 8) & ((1 << (8 * SHARED)) - 1)
    order = np.argsort(end, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], np.diff(end[order]) != 0)))
    out, start = [], 0
    for stop in [*first[1:].tolist(), len(order)]:
        if stop - start >= limit or stop == len(order):
            out.append(order[start:stop])
            start = stop
    return out


def _group(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, list[int]]:
    grams, sizes = _column(rows, "items", np.int64, True)
    return grams, _column(rows, "n", np.int64)[0], sizes


def _summary(_: tuple, rows: pa.Table, depth: int) -> pa.Table:
    """Counts and log weights of a group's topmost nodes, summed for the level above them."""
    grams, n, _ = _group(rows)
    out = []
    for i in _pieces(grams):
        tree = _Subtrees(grams[i], n[i].astype(np.float64), depth)
        zeros, ones, _, _ = tree.levels[SHARED]
        name = (((tree.names >> 8) & ((1 << (8 * (SHARED - 1))) - 1)) << 8) | (tree.names & 255)
        names, at = np.unique(name, return_inverse=True)
        out.append(pa.table({"name": names, **{k: np.bincount(at, weights=v) for k, v in (("zeros", zeros), ("ones", ones), ("log_w", tree.weighted))}}))
    return pa.concat_tables(out)


def _gram_scores(key: tuple, rows: pa.Table, depth: int, upper) -> pa.Table:
    grams, n, sizes = _group(rows)
    out = np.empty(len(grams))
    for i in _pieces(grams):
        out[i] = _Subtrees(grams[i], n[i].astype(np.float64), depth).log_p(upper.value)
    group, ends = key[0].as_py(), np.cumsum(sizes).tolist()
    return _packs([(group, p, GRAMS, grams[e - m : e], out[e - m : e]) for p, m, e in zip(rows.column("part").to_pylist(), sizes, ends, strict=True)])


def _returned(key: tuple, asked: pa.Table, scored: pa.Table) -> pa.Table:
    """Scores of a part's grams in the order of each block that asked for them."""
    grams, log_p = _column(scored, "items", np.int64, True)[0], _column(scored, "n", np.float64)[0]
    order = np.argsort(grams)
    grams, log_p = grams[order], log_p[order]
    part = key[0].as_py()
    return _packs(
        [
            (block, part, GRAMS, None, log_p[np.searchsorted(grams, _numbers(items, np.int64, True))])
            for block, items in zip(asked.column("block").to_pylist(), asked.column("items").to_pylist(), strict=True)
        ]
    )


def _upper_levels(summary: DataFrame) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Node names, weights and estimates of the contexts shorter than ``SHARED``, longest first."""
    sums = summary.groupBy("name").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "log_w")]).toArrow()
    names, zeros, ones, children = (sums.column(c).to_numpy() for c in ("name", "zeros", "ones", "log_w"))
    order = np.argsort(names)
    names, zeros, ones, children = names[order], zeros[order], ones[order], children[order]
    out = []
    for d in range(SHARED - 1, -1, -1):
        own = log_kt(zeros, ones)
        out.append((names, _weight(own, children), (ones + 0.5) / (zeros + ones + 1)))
        weighted = np.logaddexp(own, children) - np.log(2)
        if d:
            parent = (((names >> 8) & ((1 << (8 * (d - 1))) - 1)) << 8) | (names & 255)
            names, at = np.unique(parent, return_inverse=True)
            zeros, ones, children = (np.bincount(at, weights=v) for v in (zeros, ones, weighted))
    return out


def _scores(_: tuple, docs: pa.Table, found: pa.Table, depth: int, parts: int) -> pa.Table:
    ids, out, texts = _block_docs(docs.column("docs")[0].as_py())
    codes, words, part, counts = _block_words(texts, parts)
    runs = [byte_grams(texts[i:j], depth) for i, j in _runs(texts)]
    grams, gram_part = _block_grams(runs, parts)
    known, log_p = np.zeros(len(words), np.int64), np.zeros(len(grams))
    cuts, gram_cuts = (np.searchsorted(x, np.arange(parts + 1)) for x in (part, gram_part))
    for p, kind, n in zip(*(found.column(c).to_pylist() for c in ("part", "kind", "n")), strict=True):
        if kind == WORDS:
            known[cuts[p] : cuts[p + 1]] = _numbers(n, np.int64)
        else:
            log_p[gram_cuts[p] : gram_cuts[p + 1]] = _numbers(n, np.float64)
    ends = int(known[words == END][0])
    order = np.argsort(grams)
    grams, log_p = grams[order], log_p[order]
    score = np.concatenate([segment_sums(log_p[np.searchsorted(grams, values)][now], lengths) for now, values, lengths in runs])
    c = known[codes] if len(codes) else codes
    return pa.table(
        {
            "doc_id": ids,
            "held_out": pa.array(out),
            "n_tokens": counts + 1,
            "n_known": segment_sums((c > 0).astype(np.float64), counts).astype(np.int64) + int(ends > 0),
            "log_counts": segment_sums(np.log10(c + 1.0), counts) + np.log10(ends + 1.0),
            "score": score,
            "code_length": -score / np.log10(2) / np.array([len(t) + 1 for t in texts]),
        }
    )


def score_texts(docs: DataFrame, *, depth: int = DEPTH) -> DataFrame:
    """Probabilities of whole texts under a context-tree model and a word model of the training texts.

    ``docs`` has ``doc_id``, ``text``, ``held_out``; texts with held_out are scored
    but not learnt from. Returns ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``,
    ``train_tokens``, ``base_score``, ``score`` and ``code_length`` (bits a byte, the end
    counted as one).

    Texts have A-Z lower-cased. ``score`` is the log10 probability of the text's
    bytes and its end: each bit of a byte, given the bits before it, is predicted
    by Krichevsky-Trofimov estimates in contexts of 0 to ``depth`` bytes (3 to 6),
    weighted by the tree's recursion over all depths. ``base_score`` sums
    log10((c + 1) / (N + V + 1)) over words and one end.

    Method. Each task compresses its texts into blocks of bounded size, in the order in
    which it reads them; no text is shuffled before the end, and rows that are alike
    meet nowhere. One pass counts each block's words and byte grams, packed by hashed
    part: up to ``MOST_PARTS`` rows a block, whatever the input. Beyond ``GROUP_BLOCKS`` blocks, the
    blocks of a group are added up by part first, and these sums are split into as many parts as
    their words and grams need. A part's counts are summed
    over all blocks (or groups), each distinct gram then goes to the task that weights the
    contexts with its last three bytes, and what each block asked for comes back
    to it the same way: its own grams' probabilities and its own words' counts. Nodes of
    contexts under three bytes (at most 2^24, by the alphabet) go through the
    driver and to all tasks. No other corpus table is broadcast.

    Defined cases. Null text is empty: one token, the end. Null doc_id is scored
    as any other. Repeated rows each get a row. Without training texts N and V
    are 0 and each bit has probability 1/2. An empty table gives no rows.
    Other columns are ignored.
    """
    if not SHARED <= depth <= 6:
        raise ValueError("depth must be 3 to 6")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "held_out")
    blocks = durable(docs.mapInArrow(_blocks, "block long, size long, docs binary"))
    total, n_blocks = blocks.agg(F.sum("size"), F.count(F.lit(1))).first()
    parts = min(MOST_PARTS, clamp_partitions(total or 0, PART_BYTES))
    groups = clamp_partitions(n_blocks, GROUP_BLOCKS)

    def grouped(df: DataFrame, key: str, f, schema: str, **more) -> DataFrame:
        return df.groupBy(key).applyInArrow(lambda k, rows: f(k, rows, **more), schema)

    stats = durable(blocks.mapInArrow(partial(_statistics, depth=depth, parts=parts), _PACK))
    counted, per = stats, 1
    if groups > 1:
        kept = stats.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("long"))
        counted = durable(kept.groupBy("group", "part", "kind").applyInArrow(lambda k, rows: _added_up(k, rows.drop_columns(["group"]), parts), _PACK))
        # A group writes at most as many rows as its blocks did, so that rows grow with the input; beyond, parts grow.
        per = min(GROUP_BLOCKS, clamp_partitions(counted.agg(F.sum("distinct")).first()[0] or 0, PART_ITEMS * parts))
        counted = durable(counted.mapInArrow(partial(_parted, per=per), _PACK)) if per > 1 else counted
    words = durable(grouped(counted.where(F.col("kind") == WORDS), "part", _total_words, _PACK))
    distinct, tokens = (x or 0 for x in words.agg(F.sum("distinct"), F.sum("total")).first())

    asked = counted.where(F.col("kind") == GRAMS)
    grams = durable(grouped(asked, "part", _total_grams, _PACK, groups=min(MOST_CONTEXTS, parts * per)).withColumnRenamed("block", "group"))
    upper = _upper_levels(grouped(grams, "group", _summary, "name long, zeros double, ones double, log_w double", depth=depth))
    shared = docs.sparkSession.sparkContext.broadcast(upper)
    scored = grouped(grams, "group", _gram_scores, _PACK, depth=depth, upper=shared)
    returned = asked.groupBy("part").cogroup(scored.groupBy("part")).applyInArrow(lambda k, a, b: _returned(k, a, b), _PACK)

    found = words.where(F.col("kind") != SUMS).union(returned)
    if groups > 1:
        told = found.withColumn("group", F.col("block")).withColumn("whole", F.floor(F.col("part") / per).cast("int"))
        down = lambda k, a, b: _handed_down(k, a, b, parts, per)
        found = kept.groupBy("group", "part", "kind").cogroup(told.groupBy("group", "whole", "kind")).applyInArrow(down, _PACK)
    # Twice as many tasks as blocks, so that few blocks meet in one by their hash.
    tasks = min(2 * max(1, n_blocks), MOST_TASKS)
    blocks, found = (df.repartition(tasks, "block") for df in (blocks, found))
    out = blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(lambda k, a, b: _scores(k, a, b, depth=depth, parts=parts), _SCORES)
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("log_counts") - F.col("n_tokens") * F.log10(F.lit(float(tokens + distinct + 1)))).alias("base_score"),
        "score",
        "code_length",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_texts(docs.withColumn("held_out", held_out(F.col("doc_id"), 7, 2)))
