from __future__ import annotations

from collections import defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import minhash, packing, piece_codec

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
MODEL = piece_codec.piece_model(PATH)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=("Cs",)), max_size=40), max_size=6))
def test_pieces_of_any_text_equal_the_library(texts):
    ids, counts = MODEL.encode([t.encode() for t in texts])
    assert ids.tolist() == [i for t in texts for i in LIBRARY.encode(t)]
    assert [t.decode() for t in MODEL.decode(ids, counts)] == [LIBRARY.decode(LIBRARY.encode(t)) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=40), st.sampled_from([4, 8]), st.sampled_from([16, 64]), st.integers(1, 10))
def test_packer_fills_every_window(lengths, shortest, longest, often):
    packer = packing.Packer(0, longest, shortest, 256)
    for i, n in enumerate(lengths):
        packer.add(i, np.arange(n, dtype="<u4").tobytes())
        if i % often == 0:
            packer.pack()
    packer.finish()
    windows, docs = defaultdict(int), defaultdict(list)
    for doc_id, start, length, _, _, sequence, offset, tier, _ in packer.rows:
        assert offset == windows[sequence] and length > 0
        windows[sequence] += length
        docs[doc_id].append((start, length))
        assert windows[sequence] <= tier <= longest
    assert all(n & (n - 1) == 0 for n in windows.values())
    for i, n in enumerate(lengths):
        at = 0
        for start, length in sorted(docs[i]):
            assert start == at
            at += length
        assert at == n


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 40), min_size=1, max_size=12), min_size=2, max_size=12), st.sampled_from([(85, 100), (1, 2)]))
def test_forest_joins_what_links_join(sets, least):
    num, den = least
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    root = list(range(len(sets)))

    def joined(edges):
        root = list(range(len(sets)))
        for a, b in edges:
            old, new = root[a], root[b]
            root = [new if r == old else r for r in root]
        return {frozenset(i for i in range(len(sets)) if root[i] == r) for r in root}

    links = [(i, j) for i in range(len(sets)) for j in range(i) if den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    found = minhash.confirmed_forest(arrays, num, den, minhash.hash_family(200, 1), 0.0)
    assert joined(found) == joined(links) and len(found) < len(root)
