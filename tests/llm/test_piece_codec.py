from __future__ import annotations

import hashlib
import random
import string
import time

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from quern.llm import piece_codec
from tests.llm import cases

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


def some_texts():
    rng = random.Random(3)
    letters = "aaab e th\n\t\r  ▁▁é漢字🙂́ß<0x0A>\x00\x01İ . 1234567890 <s></s>"
    fixed = ["", " ", "  ", " a", "a ", "  a  b  ", "▁", "▁▁a", "a▁b", "\n\n", "a" * 40, "ab" * 30, "<s> x </s>", "\x00", "   \n  x", "the" * 500]
    drawn = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    return fixed + drawn + ["".join(rng.choice("acdehilnorst ") for _ in range(rng.randint(0, 80))) for _ in range(800)]


def test_ids_and_texts_equal_the_library():
    model, texts = piece_codec.piece_model(PATH), some_texts()
    ids, counts = model.encode([t.encode() for t in texts])
    expected = LIBRARY.encode(texts)
    assert np.cumsum(counts).tolist() == np.cumsum([len(x) for x in expected]).tolist()
    assert ids.tolist() == [i for x in expected for i in x]
    assert [t.decode() for t in model.decode(ids, counts)] == LIBRARY.decode(expected)


def test_any_ids_decode_as_in_the_library():
    rng = np.random.default_rng(0)
    model = piece_codec.piece_model(PATH)
    lists = [rng.integers(0, 700, rng.integers(0, 30)) for _ in range(1500)]
    found = model.decode(np.concatenate(lists), np.array([len(x) for x in lists]))
    assert [t.decode() for t in found] == [LIBRARY.decode(x.tolist()) for x in lists]


def test_digests_and_round_trip_in_spark(spark):
    docs = cases.documents(spark)
    expected = []
    for r in cases.rows():
        ids = LIBRARY.encode(r[1] or "", add_bos=True, add_eos=True)
        expected.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, piece_codec.round_trip(docs, PATH).collect()), key=str) == sorted(expected, key=str)
    back = piece_codec.decode_pieces(piece_codec.encode_pieces(docs, PATH), PATH).collect()
    assert sorted(map(tuple, back), key=str) == sorted(((r[0], r[1] or "") for r in cases.rows()), key=str)


def test_empty_table(spark):
    assert piece_codec.round_trip(cases.empty(spark), PATH).count() == 0


@pytest.mark.parametrize("letters", ["the", "her", "ab", "=-", "aeinrst", "0123456789", "abcdefghijklmnopqrstuvwxyz", "A.", "aAbB1_", "漢字かな"])
def test_long_unspaced_words_equal_the_library(letters):
    rng = random.Random(letters)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(100, 2500))) for _ in range(25)]
    texts += [(t[: rng.randint(1, 7)] * 2500)[: rng.randint(200, 2500)] for t in texts[:12]]
    ids, counts = piece_codec.piece_model(PATH).encode([t.encode() for t in texts])
    expected = LIBRARY.encode(texts)
    assert counts.tolist() == [len(x) for x in expected] and ids.tolist() == [i for x in expected for i in x]


@pytest.mark.parametrize("kind", ["random", "base64", "a", "he", "the", "="])
def test_a_megabyte_without_spaces_takes_seconds(kind):
    rng = random.Random(1)
    drawn = {"random": string.ascii_lowercase, "base64": string.ascii_letters + string.digits + "+/"}
    text = "".join(rng.choices(drawn[kind], k=1 << 20)) if kind in drawn else (kind * (1 << 20))[: 1 << 20]
    model = piece_codec.piece_model(PATH)
    began = time.perf_counter()
    ids, _ = model.encode([text.encode()])
    assert time.perf_counter() - began < 30
    assert ids.tolist() == LIBRARY.encode(text)
