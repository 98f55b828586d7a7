"""Chroma audio fingerprints and their alignment (operator 2)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, ragged, segment_sums, slices, starts_of, table

#: Samples a second, of an analysis window, and between windows.
RATE, WINDOW, HOP = 4096, 1024, 512
#: Range of pitches that count, in hertz.
LOWEST, HIGHEST = 55.0, 1760.0
#: Frames under the widest filter, and the share of wrong bits up to which recordings match.
WIDEST, MOST_ERRORS = 8, 0.2
#: Wrong bits of a print up to which it is looked up, the bits of it that may be the wrong ones (those nearest to their
#: thresholds), and the bits of the filter of prints: 2^20 words at most.
NEAR, WEAK, FILTER_BITS = 2, 10, 1 << 26
#: Prints on each side of a print that must be near too, and the wrong bits that they may have on the average.
CONTEXT, CONTEXT_BITS = 4, 7
#: Frames that are compared together, frames whose spectra are held at once, bytes of recordings that are worked on together.
SLICE, SPECTRA, PCM_BYTES = 1 << 20, 1 << 12, 4 << 20


def filter_bank() -> list[tuple[int, int, int, int]]:
    """Sixteen filters as (kind, first pitch class, height, width), spread over kinds, places and sizes."""
    return [(k % 6, (5 * k) % 12, 2 + k % 5, (2, 4, 6, 8)[k // 4]) for k in range(16)]


def chroma(pcm: np.ndarray, rate: int = RATE, window: int = WINDOW, hop: int = HOP) -> np.ndarray:
    """Energy of the twelve pitch classes in each window of samples, as shares of the window's energy.

    Spectra are made for ``SPECTRA`` windows at a time, so a long recording needs little more than its samples.
    """
    freq = np.fft.rfftfreq(window, 1 / rate)
    used = np.flatnonzero((freq >= LOWEST) & (freq <= HIGHEST))
    to_class = np.zeros((len(used), 12))
    to_class[np.arange(len(used)), np.round(12 * np.log2(freq[used] / 440.0)).astype(int) % 12] = 1
    windows = np.lib.stride_tricks.sliding_window_view(pcm, window)[::hop]
    out = np.empty((len(windows), 12))
    for i in range(0, len(windows), SPECTRA):
        frames = windows[i : i + SPECTRA].astype(np.float32) * np.hanning(window).astype(np.float32)
        out[i : i + SPECTRA] = (np.abs(np.fft.rfft(frames, axis=1)) ** 2)[:, used] @ to_class
    return out / np.maximum(out.sum(axis=1, keepdims=True), 1e-12)


def fingerprint(frames: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A packed 32-bit integer for each frame under the filters, two Gray-coded bits a filter, and a mask of its ``WEAK`` weakest bits.

    A bit is the weaker the nearer the filter's value lies to the level that would turn it. Filters compare sums of rectangles of the frames' integral image. Pitch classes
    go round: the image holds them twice. Fewer frames than the widest filter give none.
    """
    n = len(frames) - WIDEST + 1
    if n <= 0:
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    image = np.zeros((len(frames) + 1, 25))
    image[1:, 1:] = np.cumsum(np.cumsum(np.hstack((frames, frames)), axis=0), axis=1)

    def area(t0: int, t1: int, c0: int, c1: int) -> np.ndarray:
        at = np.arange(n)
        return image[at + t1, c1] - image[at + t0, c1] - image[at + t1, c0] + image[at + t0, c0]

    out, margins = np.zeros(n, np.uint32), []
    for kind, c, h, w in filter_bank():
        whole, half_c, half_w = area(0, w, c, c + h), c + (h + 1) // 2, w // 2
        if kind == 0:  # a rectangle against its mean
            a, b = whole, np.full(n, w * h / 12)
        elif kind == 1:  # lower against upper pitches
            a = area(0, w, c, half_c)
            b = whole - a
        elif kind == 2:  # earlier against later frames
            a = area(0, half_w, c, c + h)
            b = whole - a
        elif kind == 3:  # diagonal quarters
            a = area(0, half_w, c, half_c) + area(half_w, w, half_c, c + h)
            b = whole - a
        elif kind == 4:  # middle against outer frames
            a = area(w // 4, w - w // 4, c, c + h)
            b = whole - a
        else:  # middle against outer pitches
            a = area(0, w, c + h // 3, c + h - h // 3)
            b = whole - a
        value = np.log1p(8 * np.maximum(a, 0)) - np.log1p(8 * np.maximum(b, 0))
        level = np.digitize(value, (-0.5, 0.0, 0.5))
        out = (out << np.uint32(2)) | np.array((0, 1, 3, 2), np.uint32)[level]
        margins += [np.abs(value), np.abs(np.abs(value) - 0.5)]
    weakest = np.argsort(np.stack(margins, axis=1), axis=1, kind="stable")[:, :WEAK]
    return out, np.bitwise_or.reduce(np.uint32(1) << (31 - weakest).astype(np.uint32), axis=1)


def tones(values: np.ndarray, rate: int = RATE, samples: int = HOP) -> np.ndarray:
    """A melody with one note a number: 0 is 440 Hz, and 1/40 is a semitone, within an octave up and down."""
    step = np.clip(np.round(np.nan_to_num(values) * 40), -12, 12).astype(int)
    wave = np.sin(2 * np.pi * 440 * 2 ** (np.arange(-12, 13)[:, None] / 12) * np.arange(samples) / rate).astype(np.float32)
    return wave[step + 12].reshape(-1)


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for own, recordings in slices(batch, "pcm", PCM_BYTES):
            found = []
            for pcm in recordings:
                x = np.frombuffer(pcm, "<i2", count=len(pcm) // 2)
                found.append(fingerprint(chroma(x) if len(x) >= WINDOW else np.zeros((0, 12))))
            arrays = [pa.array([f[i].astype("<u4").tobytes() for f in found], pa.binary()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([own.column(0), *arrays], names=["rec_id", "prints", "weak"])


def fingerprint_audio(recordings: DataFrame) -> DataFrame:
    """``rec_id``, ``prints`` and ``weak`` (packed unsigned 32-bit integers, see ``fingerprint``) of recordings (``rec_id``, ``pcm``).

    ``pcm`` is one channel of signed 16-bit little-endian samples at ``RATE``. Null,
    empty and very short recordings have no prints. Repeated rows each get a row;
    other columns are ignored.
    """
    return recordings.selectExpr("cast(rec_id as long) rec_id", "pcm").mapInArrow(_prints, "rec_id long, prints binary, weak binary")


_SIDES = [d for d in range(-CONTEXT, CONTEXT + 1) if d]
_AROUND = [f"c{i}" for i in range(len(_SIDES) // 2)]


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prints of each class with their places, and the prints around them: two to a number, with a bit for each that is there."""
    for batch in batches:
        for own, blobs in slices(batch, "prints", PCM_BYTES):
            counts = np.array([len(b) // 4 for b in blobs], np.int64)
            owner = np.repeat(np.arange(len(blobs)), counts)
            prints = np.frombuffer(b"".join(blobs), "<u4").astype(np.int64)
            weak = np.frombuffer(b"".join(own.column(own.schema.get_field_index("weak")).to_pylist()), "<u4").astype(np.int64)
            places = ragged(np.zeros(len(counts), np.int64), counts)
            here, around = np.zeros(len(prints), np.int32), np.zeros((len(_AROUND), len(prints)), np.int64)
            for i, d in enumerate(_SIDES):
                there = (places + d >= 0) & (places + d < counts[owner])
                here |= there.astype(np.int32) << i
                around[i // 2] |= np.where(there, np.roll(prints, -d), 0) << (32 * (i % 2))
            arrays = [own.column(0).take(pa.array(owner)), pa.array(prints), pa.array(weak), pa.array(places.astype(np.int32)), pa.array(here), *map(pa.array, around)]
            yield pa.RecordBatch.from_arrays(arrays, names=["class_id", "print", "weak", "place", "here", *_AROUND])


def _near_context() -> Column:
    """The prints around two prints, as far as both recordings have them, differ in few bits on the average."""
    both = F.col("here").bitwiseAND(F.col("q_here"))
    wrong = F.bit_count("flipped")
    for i, c in enumerate(_AROUND):
        lanes = [F.when(F.shiftright(both, 2 * i + k).bitwiseAND(F.lit(1)) == 1, F.lit((0xFFFFFFFF << (32 * k)) - (1 << 64 if k else 0))).otherwise(F.lit(0)) for k in (0, 1)]
        wrong = wrong + F.bit_count(F.col(c).bitwiseXOR(F.col(f"q_{c}")).bitwiseAND(lanes[0].bitwiseOR(lanes[1])))
    return wrong <= CONTEXT_BITS * (F.bit_count(both) + 1)


def _errors(batches: Iterator[pa.RecordBatch], most_errors: float) -> Iterator[pa.RecordBatch]:
    """Pairs of recordings that match, at the offset with most votes (then: the longest overlap, the least offset) among those that do."""
    for batch in batches:
        queries, others = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("query_prints", "prints"))
        tries = batch.column(batch.schema.get_field_index("tries"))
        shift, votes, equal = (tries.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(3))
        pair = np.repeat(np.arange(batch.num_rows), np.asarray(pa.compute.list_value_length(tries), np.int64))
        counts_x, counts_y = (np.array([len(b) // 4 for b in blobs], np.int64) for blobs in (queries, others))
        x, y = (np.frombuffer(b"".join(blobs), "<u4") for blobs in (queries, others))
        skip_x, skip_y = np.maximum(0, -shift).astype(np.int64), np.maximum(0, shift).astype(np.int64)
        overlap = np.minimum(counts_x[pair] - skip_x, counts_y[pair] - skip_y)
        from_x, from_y = starts_of(counts_x)[pair] + skip_x, starts_of(counts_y)[pair] + skip_y
        wrong, ends, start = np.zeros(len(pair), np.int64), np.cumsum(overlap), 0
        while start < len(pair):
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + SLICE, side="right")))
            part = slice(start, stop)
            bits = np.bitwise_count(x[ragged(from_x[part], overlap[part])] ^ y[ragged(from_y[part], overlap[part])])
            wrong[part] = segment_sums(bits, overlap[part])
            start = stop
        good = np.flatnonzero((wrong <= most_errors * 32 * overlap) & (equal | (overlap >= WIDEST)))
        good = good[np.lexsort((shift[good], -overlap[good], -votes[good], pair[good]))]
        good = good[np.unique(pair[good], return_index=True)[1]]
        ids = [batch.column(batch.schema.get_field_index(c)).take(pa.array(pair[good])) for c in ("query_class", "class_id")]
        own = [pa.array(shift[good], pa.int32()), pa.array(votes[good], pa.int64()), pa.array(overlap[good], pa.int32()), pa.array(wrong[good], pa.int64())]
        yield pa.RecordBatch.from_arrays(ids + own, names=["query_class", "class_id", "offset", "votes", "overlap", "wrong_bits"])


def _words(cells: DataFrame) -> DataFrame:
    """A filter as rows (word, bits) with 64 cells to a word."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("cell", F.lit(64)).cast("int"))
    return cells.groupBy(F.floor(F.col("cell") / 64).alias("word")).agg(F.bit_or(bit).alias("bits"))


def _probes(wanted: DataFrame, postings: DataFrame) -> DataFrame:
    """Prints that differ from those wanted in up to ``NEAR`` of their weak bits, less most that no posting has.

    The filter of the postings' prints has a fixed size; a fuller one lets more
    probes through but never misses a print.
    """
    cell = F.pmod(F.xxhash64("print"), F.lit(FILTER_BITS))
    words = durable(_words(postings.select(cell.alias("cell"))))
    one = F.lit(1).cast("long")
    singles = F.filter(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda b: F.call_function("shiftleft", one, b)), lambda b: F.col("weak").bitwiseAND(b) != 0)
    probes = wanted.withColumn("singles", singles)
    pairs = F.flatten(F.transform("singles", lambda a: F.transform(F.filter("singles", lambda b: b > a), lambda b: a.bitwiseOR(b))))
    probes = probes.withColumn("flipped", F.explode(F.concat(F.array(F.lit(0).cast("long")), "singles", pairs))).drop("singles", "weak")
    probes = probes.withColumn("print", F.col("print").bitwiseXOR(F.col("flipped")))
    bit = F.call_function("shiftright", F.col("bits"), F.pmod(cell, F.lit(64)).cast("int")).bitwiseAND(F.lit(1))
    return probes.join(F.broadcast(words), (F.floor(cell / 64) == F.col("word")) & (bit == 1)).drop("word", "bits")


def align_recordings(prints: DataFrame, *, every: int = 50, most_errors: float = MOST_ERRORS) -> DataFrame:
    """Find the queries' recordings in all recordings (``rec_id``, ``prints``, ``weak``).

    Queries are the rows whose rec_id is divisible by ``every``. Rows with equal prints
    form a class, named by its least rec_id. Returns two kinds of rows. ``member``:
    ``rec_id`` and its ``class_id``. ``match``: a ``query_class`` found in another
    ``class_id`` at ``offset`` (frames of the class before the query's first), with
    ``votes``, ``overlap`` (frames) and ``wrong_bits``, of which the share is at most ``most_errors``.

    Method. Prints of queries meet prints of all classes that differ in ``NEAR`` of their
    ``WEAK`` weakest bits at most and have prints around them (``CONTEXT`` on each side) that differ in ``CONTEXT_BITS``
    bits on the average at most, which few meets by chance have; the histogram of their
    offsets is summed before the shuffle. At every offset with a vote the bit errors are counted; of those within the bound the one with most votes is reported
    (ties: the longest overlap, then the least offset).
    An overlap of fewer than ``WIDEST`` frames needs an equal print, as few frames are
    near by chance. Equal recordings count once, so copies do not multiply. Every
    class is indexed, no posting is capped; classes without such votes are not
    compared with a query. That loses few pairs, most of them near ``most_errors``
    (the recall test compares with all offsets).

    Defined cases. Null rec_id: a member row without a class. No prints: a
    class of its own id that matches nothing. Repeated rows each get a
    row. Empty tables give no rows. Other columns are ignored.
    """
    rows = durable(prints.selectExpr("cast(rec_id as long) rec_id", "coalesce(prints, X'') prints", "weak"))
    heard = rows.where("rec_id is not null and length(prints) > 0").withColumn("sha", F.unhex(F.sha2("prints", 256)))
    classes = heard.groupBy("sha").agg(F.min("rec_id").alias("class_id"), F.bool_or(F.pmod("rec_id", F.lit(every)) == 0).alias("asked"), F.min("prints").alias("prints"), F.max("weak").alias("weak"))
    classes = durable(classes)
    own = classes.select("class_id", "prints")
    around = "here int, " + ", ".join(f"{c} long" for c in _AROUND)
    postings = durable(classes.select("class_id", "prints", "weak").mapInArrow(_postings, f"class_id long, print long, weak long, place int, {around}"))
    asked = durable(classes.where("asked").select(F.col("class_id").alias("query_class"), F.col("prints").alias("query_prints")))
    wanted = postings.join(asked.select(F.col("query_class").alias("class_id")), "class_id", "left_semi")
    wanted = durable(wanted.select(F.col("class_id").alias("query_class"), "print", F.col("place").alias("query_place"), "weak", *[F.col(c).alias(f"q_{c}") for c in ("here", *_AROUND)]))
    near = _probes(wanted, postings).withColumnRenamed("print", "probe")
    votes = postings.drop("weak").join(near, (F.col("print") == F.col("probe")) & (F.col("class_id") != F.col("query_class")) & _near_context())
    votes = votes.groupBy("query_class", "class_id", (F.col("place") - F.col("query_place")).alias("offset")).agg(
        F.count(F.lit(1)).alias("votes"), F.min(F.bit_count("flipped")).alias("bits")
    )
    votes = votes.withColumn("equal", F.col("bits") == 0)
    tried = durable(votes.groupBy("query_class", "class_id").agg(F.collect_list(F.struct("offset", "votes", "equal")).alias("tries")))
    pairs = tried.join(own, "class_id").join(asked, "query_class").select("query_class", "class_id", "tries", "query_prints", "prints")
    found = pairs.mapInArrow(partial(_errors, most_errors=most_errors), "query_class long, class_id long, offset int, votes long, overlap int, wrong_bits long")
    member = rows.withColumn("sha", F.when(F.length("prints") > 0, F.unhex(F.sha2("prints", 256)))).join(classes.select("sha", F.col("class_id").alias("named")), "sha", "left")
    member = member.select(
        F.lit("member").alias("kind"), "rec_id", F.when(F.col("rec_id").isNotNull(), F.coalesce("named", "rec_id")).alias("class_id"), *[F.lit(None).cast(t).alias(c) for c, t in _MATCH]
    )
    return member.union(found.select(F.lit("match"), F.lit(None).cast("long"), "class_id", *[F.col(c) for c, _ in _MATCH]))


_MATCH = (("query_class", "long"), ("offset", "int"), ("votes", "long"), ("overlap", "int"), ("wrong_bits", "long"))


def _rendered(batches: Iterator[pa.RecordBatch], excerpts: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            part = batch.slice(i, 64)
            pcm = []
            for rec_id, notes in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                wave = tones(np.array(notes or [], np.float64)) * 16000
                if excerpts:
                    wave = wave[len(wave) // 4 : len(wave) - len(wave) // 4]
                    wave = wave + np.random.default_rng(abs(rec_id or 0)).normal(0, 300, len(wave))
                pcm.append(np.clip(wave, -32768, 32767).astype("<i2").tobytes())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pcm, pa.binary())], names=["rec_id", "pcm"])


def melodies(vectors: DataFrame, *, excerpts: bool = False) -> DataFrame:
    """``rec_id`` and ``pcm`` of vectors (``vec_id``, ``embedding``): a note a number. The tables hold no audio of their own.

    With ``excerpts`` the middle half of each melody under some noise.
    """
    return vectors.selectExpr("cast(vec_id as long) vec_id", "embedding").mapInArrow(partial(_rendered, excerpts=excerpts), "rec_id long, pcm binary")


def recorded(vectors: DataFrame, every: int = 50) -> DataFrame:
    """All vectors as melodies, and a noisy excerpt of each whose id is divisible by ``every``.

    The excerpt of vector v is a recording of its own, with the id -v - ``every``, so that
    every table holds recordings that truly belong together.
    """
    asked = vectors.where(F.pmod("vec_id", F.lit(every)) == 0).withColumn("vec_id", -F.col("vec_id") - every)
    return melodies(vectors).union(melodies(asked, excerpts=True))


def query(spark: SparkSession, sf_dir: str, every: int = 50) -> DataFrame:
    """All embeddings, played as melodies, against the queries among them and a noisy excerpt of each query."""
    return align_recordings(fingerprint_audio(recorded(table(spark, sf_dir, "embeddings"), every)), every=every).withColumnRenamed("rec_id", "vec_id")
