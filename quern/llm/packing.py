"""Hierarchical multi-length packing of tokenised documents (operator 6)."""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, ragged, released, segment_sums, slices, starts_of, table

#: Longest window, shortest tier to which documents are routed, tokens of a step group.
LONGEST, SHORTEST, STEP_TOKENS = 4096, 512, 1 << 17
#: Bytes of text that are worked on together.
SLICE = 4 << 20
#: Words whose ids a Python worker remembers.
REMEMBERED = 200_000

_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


#: Letters and other characters whose words are cut without the library, and the cut.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(rf"[!-&(-~{_LETTERS}]+")
_CUT = re.compile(rf"[{_LETTERS}]+|[0-9]|[^0-9{_LETTERS}]+")
#: The cut of words for which the above holds.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_letters() -> dict[int, str]:
    """The character by which byte-level tokenizers write each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Numbered(dict):
    """Numbers keys in the order in which they are first looked up."""

    def __missing__(self, key: bytes) -> int:
        n = self[key] = len(self)
        return n


class WordTokenizer:
    """Ids of texts by a tokenizer of the tokenizers library that drops white space.

    Such a tokenizer never joins what ASCII white space parts, so each distinct
    word is encoded once and remembered. Words of ASCII without an apostrophe and
    of Latin-1 letters are cut here and merged by the library's model, where the
    tokenizer normalises and cuts as expected; the library encodes all others whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        form = json.loads(self.tokenizer.to_str())
        steps, cuts = (form.get("normalizer") or {}).get("normalizers", []), (form.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.expected = [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in cuts] == ["Split", "ByteLevel"] and cuts[0]["pattern"] == {"Regex": _PATTERN}
        self.specials = [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.written = _byte_letters()
        self.known = _Numbered()
        self.merged: dict[str, bytes] = {}
        self.ids, self.used = np.zeros(1 << 20, np.uint32), 0
        self.at, self.size, self.met = (np.zeros(1 << 18, np.int64) for _ in range(3))

    def _forget(self) -> None:
        """Keep the words met most often, half of ``REMEMBERED`` at most; the others are encoded anew when they come again."""
        n = len(self.known)
        least = max(2, int(np.partition(self.met[:n], n - REMEMBERED // 2)[n - REMEMBERED // 2]) + 1)
        keep = np.flatnonzero(self.met[:n] >= least)
        words = list(self.known)
        self.known = _Numbered(zip([words[i] for i in keep.tolist()], range(len(keep)), strict=True))
        at, size = self.at[keep], self.size[keep]
        self.used = int(size.sum())
        self.ids[: self.used] = self.ids[ragged(at, size)]
        self.at[: len(keep)], self.size[: len(keep)] = starts_of(size), size
        self.met[:] = 0
        self.merged = {}

    def _piece(self, piece: str) -> bytes:
        ids = self.merged.get(piece)
        if ids is None:
            written = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.written)
            # Bytes, unlike lists, cost the garbage collector nothing.
            ids = self.merged[piece] = array("I", [t.id for t in self.merge(written)]).tobytes()
        return ids

    def _word(self, word: bytes) -> bytes:
        """Ids of a word as unsigned 32-bit integers."""
        text = word.decode()
        if self.expected and word.isalpha():  # ASCII letters alone
            return self._piece(text.lower())
        if not self.expected or not _PLAIN.fullmatch(text) or (b"<" in word and any(s in word.lower() for s in self.specials)):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        text = text.lower()
        if text.isalpha():
            return self._piece(text)
        return b"".join([self._piece(piece) for piece in _CUT.findall(text)])

    def _learn(self, first: int) -> None:
        """Encode the words from number ``first`` on."""
        found = [self._word(w) for w in islice(self.known, first, None)]
        sizes = np.array([len(x) // 4 for x in found], np.int64)
        n, m = first + len(found), int(sizes.sum())
        while self.used + m > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while n > len(self.at):
            self.at, self.size, self.met = (np.concatenate((x, np.zeros_like(x))) for x in (self.at, self.size, self.met))
        self.ids[self.used : self.used + m] = np.frombuffer(b"".join(found), np.uint32)
        self.at[first:n], self.size[first:n] = self.used + starts_of(sizes), sizes
        self.used += m

    def encode(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with ``end_id`` after it, and the number of ids of each."""
        if len(self.known) > REMEMBERED:
            self._forget()
        first = len(self.known)
        words: list[bytes] = []
        in_text = np.empty(len(texts), np.int64)
        for i, t in enumerate(texts):
            # Case is folded anyway; folding it here leaves fewer distinct words.
            own = (t.lower() if self.expected and b"<" not in t else t).split()
            in_text[i] = len(own)
            words += own
        known = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        self._learn(first)
        self.met[: len(self.known)] += np.bincount(known, minlength=len(self.known))
        sizes = self.size[known]
        counts = segment_sums(sizes, in_text).astype(np.int64)
        out = np.full(int(counts.sum()) + len(texts), end_id, np.uint32)
        out[ragged(starts_of(counts + 1), counts)] = self.ids[ragged(self.at[known], sizes)]
        return out, counts + 1


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


class Packer:
    """Packs runs of ids into windows whose lengths are powers of two.

    A document gives full windows of the longest tier and a rest, which goes to
    the shortest tier that holds it. The longest waiting rest opens a window of
    its tier; the gap is filled by the longest rests of shorter tiers that fit,
    and closed by a cut from the shortest rest that is longer. So every window is
    full. A window that cannot be filled waits for the next documents; at the end
    the waiting rests are cut into powers of two. Waiting rests of one length are
    taken last in, first out.

    The last field of a row numbers the windows of a tier. Steps are made of them
    over all tasks, so ``step_tokens`` decides nothing here.
    """

    def __init__(self, first_id: int, longest: int = LONGEST, shortest: int = SHORTEST, step_tokens: int = STEP_TOKENS):
        self.first_id, self.longest, self.shortest, self.step_tokens = first_id, longest, shortest, step_tokens
        self.waiting: list[list[tuple]] = [[] for _ in range(longest + 1)]
        self.lengths = 0  # bit n: a rest of n ids waits
        self.total = 0
        self.windows = 0
        self.in_tier: dict[int, int] = {}
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """Ids as unsigned 32-bit little-endian integers."""
        n = len(ids) // 4
        whole = n - n % self.longest
        for start in range(0, whole, self.longest):
            self._emit([(doc_id, n, start, self.longest, ids)], self.longest)
        if n > whole:
            self._wait((doc_id, n, whole, n - whole, ids))

    def _wait(self, rest: tuple) -> None:
        self.waiting[rest[3]].append(rest)
        self.lengths |= 1 << rest[3]
        self.total += rest[3]

    def _take(self, length: int) -> tuple:
        rest = self.waiting[length].pop()
        if not self.waiting[length]:
            self.lengths &= ~(1 << length)
        self.total -= length
        return rest

    def _tier(self, length: int) -> int:
        return max(self.shortest, 1 << (length - 1).bit_length())

    def pack(self) -> None:
        """Close all windows that the waiting rests can fill."""
        while self.lengths:
            longest = self.lengths.bit_length() - 1
            tier = self._tier(longest)
            if self.total < tier:
                return
            self._window(tier)

    def _window(self, tier: int) -> None:
        parts = [self._take(self.lengths.bit_length() - 1)]
        gap = tier - parts[0][3]
        while gap:
            fitting = self.lengths & ((2 << gap) - 1)
            if fitting:
                parts.append(self._take(fitting.bit_length() - 1))
            else:
                longer = self.lengths >> (gap + 1)
                doc_id, n, start, length, ids = self._take(gap + (longer & -longer).bit_length())
                parts.append((doc_id, n, start, gap, ids))
                self._wait((doc_id, n, start + gap, length - gap, ids))
            gap -= parts[-1][3]
        self._emit(parts, tier)

    def finish(self) -> None:
        """Cut what still waits into windows of powers of two, the longest first."""
        self.pack()
        rests = [r for length in range(self.longest, 0, -1) for r in self.waiting[length]]
        left = sum(r[3] for r in rests)
        self.waiting, self.lengths, self.total = [[] for _ in range(self.longest + 1)], 0, 0
        while left:
            tier = min(self.longest, 1 << (left.bit_length() - 1))
            left -= tier
            parts, gap = [], tier
            while gap:
                doc_id, n, start, length, ids = rests.pop(0)
                parts.append((doc_id, n, start, min(gap, length), ids))
                if length > gap:
                    rests.insert(0, (doc_id, n, start + gap, length - gap, ids))
                gap -= parts[-1][3]
            self._emit(parts, tier)

    def _emit(self, parts: list[tuple], tier: int) -> None:
        sequence = self.first_id + self.windows
        self.windows += 1
        nth = self.in_tier.get(tier, 0)
        self.in_tier[tier] = nth + 1
        offset = 0
        for doc_id, n, start, length, ids in parts:
            self.rows.append((doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, sequence, offset, tier, nth))
            offset += length

    def drain(self) -> pa.RecordBatch:
        kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
        columns = zip(*self.rows, strict=True) if self.rows else [[]] * len(kinds)
        names = [part.split()[0] for part in _SCHEMA.split(", ")]
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
        self.rows = []
        return out


def _packed(batches: Iterator[pa.RecordBatch], path: str, end_id: int, longest: int, shortest: int) -> Iterator[pa.RecordBatch]:
    tokenizer = word_tokenizer(path)
    packer = Packer(TaskContext.get().partitionId() << 40, longest, shortest)
    for batch in batches:
        for own, texts in slices(batch, limit=SLICE):
            ids, counts = tokenizer.encode(texts, end_id)
            raw, ends = ids.astype("<u4").tobytes(), np.cumsum(counts).tolist()
            for doc_id, e, n in zip(own.column(own.schema.get_field_index("doc_id")).to_pylist(), ends, counts.tolist(), strict=True):
                packer.add(doc_id, raw[4 * (e - n) : 4 * e])
            packer.pack()
            yield packer.drain()
    packer.finish()
    yield packer.drain()
    released()


def _stepped(pieces: DataFrame, step_tokens: int) -> DataFrame:
    """Number the steps of a tier through all tasks: ``step_group`` is the window's number in its task and tier before, its step after."""
    columns = pieces.columns
    pieces = durable(pieces).withColumn("task", F.shiftright("sequence_id", 40))
    before = W.partitionBy("tier").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    counts = pieces.groupBy("task", "tier").agg((F.max("step_group") + 1).alias("windows"))
    counts = counts.select("task", "tier", F.coalesce(F.sum("windows").over(before), F.lit(0)).alias("before"))
    step = F.floor((F.col("before") + F.col("step_group")) / F.greatest(F.lit(1), F.floor(F.lit(step_tokens) / F.col("tier"))))
    step = F.shiftleft(F.bit_count(F.col("tier") - 1).cast("long"), 40) + step
    return pieces.join(counts, ["task", "tier"]).withColumn("step_group", step).select(columns)


def pack_documents(
    docs: DataFrame,
    path: str,
    *,
    end_id: int = 2,
    longest: int = LONGEST,
    shortest: int = SHORTEST,
    step_tokens: int = STEP_TOKENS,
) -> DataFrame:
    """Pack the ids of all rows of ``docs`` (``doc_id``, ``text``) into training windows.

    Returns one row a piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``,
    ``doc_tokens``, ``sequence_id``, ``offset`` (gapless in the window), ``tier`` (the
    window's length) and ``step_group`` (windows of one tier that fill
    ``step_tokens`` together, so all steps but the last of a tier are even).

    Tiers are the powers of two from ``shortest`` to ``longest`` (both powers of
    two). All windows are full, so nothing is padded; the last ids of a task go to
    windows of smaller powers of two. Each task packs its own input in one pass
    and holds one slice of text and the rests of one window. The pieces are cut to
    disk, and their windows counted by task and tier; from the counts follow the
    steps, which go through all tasks. No text or id is shuffled.
    Sequence ids are unique: the task's number, shifted left by 40, and a count.
    So are step groups: the tier's logarithm, shifted alike, and a count.

    Defined cases. Null or empty text: the end id alone. A null doc_id stays null.
    Repeated rows are packed each. No documents: no rows. Other columns are ignored.
    """
    fn = partial(_packed, path=path, end_id=end_id, longest=longest, shortest=shortest)
    return _stepped(docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(fn, _SCHEMA), step_tokens)


def query(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), path or public_tokenizers.path("word_bpe_49k.json"))
