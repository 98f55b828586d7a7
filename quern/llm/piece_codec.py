"""SentencePiece BPE encoding and decoding in vectorised merge rounds (operator 7)."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import cached_property, lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import ragged, segment_sums, slices, starts_of, table

_SPACE, _SPACE_CHAR = "▁", 0x2581
_FAR = np.iinfo(np.int32).max
#: A round is slow if it merges less than this share of the symbols of the long words; so many slow rounds end the rounds for them.
_SLOW_SHARE, _SLOW_ROUNDS = 1 / 512, 64


def _window_min(x: np.ndarray, before: int, after: int) -> np.ndarray:
    """Least value from ``before`` elements before an element to ``after`` elements after it (``after`` -1: the one before it)."""
    now = np.concatenate((np.full(before, _FAR, x.dtype), x, np.full(max(after, 0), _FAR, x.dtype)))
    length, width = before + after + 1, 1
    while 2 * width <= length:
        now = np.minimum(now[:-width], now[width:])
        width *= 2
    return np.minimum(now[: len(x)], now[length - width :][: len(x)])


class PieceModel:
    """The vocabulary of a sentencepiece BPE model as arrays, and the codec over them.

    Only models like those whose pieces hold the space sign at their beginning
    alone, with identity normalisation and a dummy prefix, are taken: there no
    merge crosses the beginning of a word.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(SentencePieceProcessor(model_file=path).serialized_model_proto())
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or not spec.add_dummy_prefix or spec.remove_extra_whitespaces or not spec.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("the model normalises texts in a way that is not supported")
        kinds = proto.SentencePiece
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.bos, self.eos = proto.trainer_spec.bos_id, proto.trainer_spec.eos_id
        normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        if any(_SPACE in p.lstrip(_SPACE) for p in normal):
            raise ValueError("a piece crosses the beginning of a word")
        symbols = dict(normal)
        for c in sorted({c for p in normal for c in p}):
            symbols.setdefault(c, len(proto.pieces) + len(symbols) - len(normal))
        self.unknown = len(proto.pieces) + len(symbols) - len(normal)
        self.n_ids, self.n_symbols = len(proto.pieces), self.unknown + 1
        self.of_char = np.full(0x110000, self.unknown, np.int32)
        for c, i in symbols.items():
            if len(c) == 1:
                self.of_char[ord(c)] = i

        # Ranks of pieces: equal scores have one rank; the highest score comes first.
        scores = np.array([p.score for p in proto.pieces])
        rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        pairs: dict[int, int] = {}
        careful = np.zeros(self.n_symbols, bool)
        for p, i in normal.items():
            for cut in range(1, len(p)):
                a, b = symbols.get(p[:cut]), symbols.get(p[cut:])
                if a is None or b is None:
                    continue
                pairs[a * self.n_symbols + b] = i
                # A part that is made after the whole could be made: the order of merges matters.
                for part in (a, b):
                    if part < self.n_ids and rank[part] >= rank[i]:
                        careful[part] = True
        shared = np.bincount(rank[list(normal.values())], minlength=len(rank)) > 1
        careful[: self.n_ids] |= shared[rank]
        self.careful = careful
        # No piece reaches further than this many characters; what lies twice as far off has no say in a merge.
        self.reach = 2 * max(len(p) for p in normal) + 2
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        self.ranks = rank[self.merged]

        byte = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        unk = next(i for i, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN)
        self.byte_fallback = proto.trainer_spec.byte_fallback
        self.unk = unk
        self.of_byte = np.array([byte.get(b, unk) for b in range(256)], np.int32)
        self.is_byte = np.array([p.type == kinds.BYTE for p in proto.pieces])
        surface = []
        for p in proto.pieces:
            if p.type == kinds.BYTE:
                surface.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type == kinds.UNKNOWN:
                surface.append(proto.trainer_spec.unk_surface.encode())
            else:
                surface.append(p.piece.replace(_SPACE, " ").encode() if p.type == kinds.NORMAL else b"")
        self.surface_len = np.array([len(s) for s in surface], np.int64)
        self.surface_at = starts_of(self.surface_len)
        self.surface = np.frombuffer(b"".join(surface), np.uint8)

    def _pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of each pair of symbols (no such piece: the farthest rank)."""
        key = a.astype(np.int64) * self.n_symbols + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        return np.where(found, self.ranks[at], _FAR).astype(np.int32), self.merged[at]

    @cached_property
    def _by_pair(self) -> dict[int, tuple[int, int]]:
        return dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.merged.tolist(), strict=True), strict=True))

    def _merge_queued(self, sym: list[int]) -> tuple[list[int], list[int]]:
        """All merges of one word in the order of rank and place, from a queue: the symbols left, and their places in ``sym``."""
        pair, n = self._by_pair, self.n_symbols
        after, before = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        queue = [(found[0], i, found[1], sym[i], sym[i + 1]) for i in range(len(sym) - 1) if (found := pair.get(sym[i] * n + sym[i + 1]))]
        heapq.heapify(queue)
        while queue:
            _, i, merged, a, b = heapq.heappop(queue)
            j = after[i]
            if sym[i] != a or j >= len(sym) or sym[j] != b:
                continue
            sym[i], sym[j] = merged, -1
            after[i] = k = after[j]
            if k < len(sym):
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y < len(sym) and (found := pair.get(sym[x] * n + sym[y])):
                    heapq.heappush(queue, (found[0], x, found[1], sym[x], sym[y]))
        kept = [i for i, x in enumerate(sym) if x >= 0]
        return [sym[i] for i in kept], kept

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one after the other, and the number of ids of each.

        A word here is what follows one space, its further leading spaces included.
        All words' symbols lie in one flat array. Each round finds every word's
        minimum pair rank, merges its leftmost occurrences in all words at once,
        compacts the array and puts words without a pair aside.

        In long words (unspaced text) a pair is also merged when it is the minimum among
        the symbols within ``reach``: no piece is longer than half of that, so no merge that
        comes earlier can touch the pair's symbols, nor what the merge then leads to. So the rounds
        do not grow with the word's length. Where such a word still takes one merge after the
        other (the same few letters repeated), a queue ends it.
        """
        text = b" " + b"\x00 ".join(words)
        chars = np.frombuffer(text.decode().encode("utf-32-le"), np.uint32)
        lengths = np.array([len(w.decode()) if not w.isascii() else len(w) for w in words], np.int64) + 1
        chars = chars[ragged(starts_of(lengths + 1), lengths)]
        chars = np.where(chars == 32, np.uint32(_SPACE_CHAR), chars)
        sym = self.of_char[chars]
        at = np.arange(len(sym), dtype=np.int64)  # the first character of each symbol
        word = np.repeat(np.arange(len(words), dtype=np.int64), lengths)

        done_sym, done_at, done_word = [], [], []
        rank = np.full(len(sym), _FAR, np.int32)
        merged = np.zeros(len(sym), np.int32)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner], merged[inner] = self._pair(sym[inner], sym[inner + 1])
        slow = 0
        while len(sym):
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            lowest = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.append(first, len(sym)))
            ended = np.repeat(lowest == _FAR, sizes)
            if ended.any():
                done_sym.append(sym[ended])
                done_at.append(at[ended])
                done_word.append(word[ended])
                live = ~ended
                sym, at, word, rank, merged = sym[live], at[live], word[live], rank[live], merged[live]
                open_ = lowest != _FAR
                lowest, sizes = lowest[open_], sizes[open_]
                if not len(sym):
                    break
                first = starts_of(sizes)
            hit = rank == np.repeat(lowest, sizes)
            long = np.flatnonzero(np.repeat(sizes > 4 * self.reach, sizes))
            if len(long) and slow < _SLOW_ROUNDS:
                near = rank[long]
                hit[long] |= (near == _window_min(near, self.reach, self.reach)) & (near != _FAR)
            elif len(long):
                for w in np.flatnonzero(sizes > 4 * self.reach).tolist():
                    own = slice(first[w], first[w] + sizes[w])
                    left, kept = self._merge_queued(sym[own].tolist())
                    done_sym.append(np.array(left, sym.dtype))
                    done_at.append(at[own][kept])
                    done_word.append(word[own][kept])
                live, slow = np.repeat(sizes <= 4 * self.reach, sizes), 0
                sym, at, word, rank, merged = sym[live], at[live], word[live], rank[live], merged[live]
                continue
            where = np.flatnonzero(hit)
            # Of hits that overlap, every other one from the left, if the first one is the first of its rank there.
            # Where order matters, a word's first one only; in long words the first one within reach.
            run = np.concatenate(([True], np.diff(where) != 1))
            start = np.maximum.accumulate(np.where(run, np.arange(len(where)), 0))
            begin = where[start]
            whole = (begin == 0) | (rank[begin - 1] != rank[begin])
            owner = word[where]
            leads = np.concatenate(([True], owner[1:] != owner[:-1]))
            if len(long):
                alone = np.zeros(len(sym), bool)
                alone[long] = _window_min(near, self.reach, -1) > near
                leads |= alone[where]
            where = where[np.where(self.careful[merged[where]], leads, whole & ((np.arange(len(where)) - start) % 2 == 0))]
            slow += len(long) > 0 and len(where) < _SLOW_SHARE * len(long)
            sym[where] = merged[where]
            keep = np.ones(len(sym), bool)
            keep[where + 1] = False
            fresh = np.zeros(len(sym), bool)
            fresh[where] = True
            sym, at, word, rank, merged, fresh = sym[keep], at[keep], word[keep], rank[keep], merged[keep], fresh[keep]
            fresh[:-1] |= fresh[1:]  # the pairs to the left and right of a merged symbol
            spot = np.flatnonzero(fresh)
            inside = np.zeros(len(spot), bool)
            before_end = spot < len(sym) - 1
            inside[before_end] = word[spot[before_end]] == word[spot[before_end] + 1]
            rank[spot] = _FAR
            spot = spot[inside]
            rank[spot], merged[spot] = self._pair(sym[spot], sym[spot + 1])

        sym, at, word = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_sym, done_at, done_word))
        order = np.argsort(at, kind="stable")
        sym, at, word = sym[order], at[order], word[order]
        odd = np.flatnonzero(sym >= self.n_ids)
        if len(odd) and self.byte_fallback:
            raw = [chr(c).encode() for c in chars[at[odd]].tolist()]
            spread = np.ones(len(sym), np.int64)
            spread[odd] = [len(r) for r in raw]
            place = starts_of(spread)
            ids = np.repeat(sym, spread).astype(np.int32)
            ids[ragged(place[odd], spread[odd])] = self.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
            word = np.repeat(word, spread)
        else:
            ids = np.where(sym >= self.n_ids, self.unk, sym).astype(np.int32)
        return ids, np.bincount(word, minlength=len(words)).astype(np.int64)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, without begin and end, and the number of ids of each."""
        words: list[bytes] = []
        counts = np.empty(len(texts), np.int64)
        for i, t in enumerate(texts):
            own = t.replace(b"\xe2\x96\x81", b" ").split(b" ") if t else []
            if b"" in own:
                own = _with_runs(own)
            counts[i] = len(own)
            words += own
        if not words:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        flat = np.empty(len(words), object)
        flat[:] = words
        codes, distinct = pd.factorize(flat)
        ids, sizes = self.encode_words(distinct.tolist())
        of_word = sizes[codes]
        return ids[ragged(starts_of(sizes)[codes], of_word)], segment_sums(of_word, counts).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The texts of runs of ids, in UTF-8: the dummy prefix goes, broken byte runs become U+FFFD."""
        lengths = self.surface_len[ids]
        raw = self.surface[ragged(self.surface_at[ids], lengths)].tobytes()
        ends = np.cumsum(segment_sums(lengths, counts)).astype(np.int64)
        last = np.cumsum(counts)
        out = []
        for i, end in enumerate(ends.tolist()):
            start = int(ends[i - 1]) if i else 0
            text = raw[start:end]
            own = ids[last[i] - counts[i] : last[i]]
            spoken = own[self.surface_len[own] > 0]
            if len(spoken) and text[:1] == b" " and not self.is_byte[spoken[0]] and spoken[0] != self.unk:
                text = text[1:]
            if self.is_byte[own].any():
                try:
                    text.decode()
                except UnicodeDecodeError:
                    text = text.decode("utf-8", "surrogateescape").encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace").encode()
            out.append(text)
        return out


def _with_runs(parts: list[bytes]) -> list[bytes]:
    """Join empty parts, which stand for further spaces, to the word after them."""
    out, held = [], 0
    for p in parts:
        if p:
            out.append(b" " * held + p)
            held = 0
        else:
            held += 1
    if held:
        out.append(b" " * (held - 1))
    return out


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def _digests(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = piece_model(path)
    begin, end = (np.array([i], "<u4").tobytes() for i in (model.bos, model.eos))
    for batch in batches:
        for own, texts in slices(batch):
            ids, counts = model.encode(texts)
            raw, ends = ids.astype("<u4").tobytes(), np.cumsum(counts).tolist()
            id_hashes = [hashlib.sha256(begin + raw[4 * (e - n) : 4 * e] + end).hexdigest() for e, n in zip(ends, counts.tolist(), strict=True)]
            decoded = [hashlib.sha256(t).hexdigest() for t in model.decode(ids, counts)]
            yield pa.RecordBatch.from_arrays(
                [own.column(own.schema.get_field_index("doc_id")), pa.array(counts + 2), pa.array(id_hashes), pa.array(decoded)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = piece_model(path)
    for batch in batches:
        for own, texts in slices(batch):
            ids, counts = model.encode(texts)
            sizes = counts + 2
            full = np.empty(int(sizes.sum()), np.int32)
            at = starts_of(sizes)
            full[at], full[at + sizes - 1] = model.bos, model.eos
            full[ragged(at + 1, counts)] = ids
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [own.column(own.schema.get_field_index("doc_id")), pa.ListArray.from_arrays(offsets, pa.array(full))], names=["doc_id", "ids"]
            )


def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = piece_model(path)
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index("ids"))
        ids = np.asarray(pa.compute.list_flatten(lists), dtype=np.int64)
        counts = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0), dtype=np.int64)
        texts = [t.decode() for t in model.decode(ids, counts)]
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(texts, pa.string())], names=["doc_id", "text"])


def encode_pieces(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and ``ids`` (begin and end included) of every row of ``docs`` (``doc_id``, ``text``).

    The ids are those of the sentencepiece library without sampling. Null text
    counts as empty and has begin and end only. Repeated rows each get a row;
    doc_id may be null. Other columns are ignored. Nothing is shuffled; a task
    holds some megabytes of text, or one longer text, at a time.
    """
    return docs.select("doc_id", "text").mapInArrow(partial(_encoded, path=path), "doc_id long, ids array<int>")


def decode_pieces(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and ``text`` of rows of ``doc_id`` and ``ids``; null ids give the empty text."""
    return encoded.select("doc_id", "ids").mapInArrow(partial(_decoded, path=path), "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Digests of the ids of every row's text and of the text decoded from them.

    Returns ``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``; cases as in ``encode_pieces``.
    """
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(
        partial(_digests, path=path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def query(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), path or public_tokenizers.path("piece_bpe_32k.model"))
