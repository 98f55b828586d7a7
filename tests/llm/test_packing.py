from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quern.llm import packing
from tests.llm import cases

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, found, longest=packing.LONGEST):
    library = Tokenizer.from_file(PATH)
    ids = [np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4") for r in rows]
    by_doc, windows = defaultdict(list), defaultdict(list)
    for p in found:
        by_doc[p.doc_id].append(p)
        windows[p.sequence_id].append(p)
    expected = defaultdict(Counter)
    for r, x in zip(rows, ids, strict=True):
        expected[r[0]][len(x)] += 1
    assert set(by_doc) == set(expected)
    for own in windows.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [sum(q.length for q in own[:i]) for i in range(len(own))]
        total = sum(p.length for p in own)
        assert total == own[0].tier <= longest and total & (total - 1) == 0
    single = {r[0]: x for r, x in zip(rows, ids, strict=True) if sum(expected[r[0]].values()) == 1}
    for doc_id, pieces in by_doc.items():
        assert sum(p.length for p in pieces) == sum(n * k for n, k in expected[doc_id].items())
        if doc_id in single:
            pieces.sort(key=lambda p: p.start)
            assert [p.start for p in pieces] == [sum(q.length for q in pieces[:i]) for i in range(len(pieces))]
            for p in pieces:
                assert p.doc_tokens == len(single[doc_id])
                assert p.ids_crc32 == zlib.crc32(single[doc_id][p.start : p.start + p.length].tobytes())


def test_every_id_lies_in_one_full_window(spark):
    check(cases.rows(), packing.pack_documents(cases.documents(spark), PATH).collect())


def test_other_tiers_and_even_steps(spark):
    found = packing.pack_documents(cases.documents(spark).coalesce(1), PATH, longest=256, shortest=16, step_tokens=1024).collect()
    check(cases.rows(), found, 256)
    steps, tiers = Counter(), {}
    for p in found:
        steps[p.step_group] += p.length
        assert tiers.setdefault(p.step_group, p.tier) == p.tier
    short = [n for n in steps.values() if n != 1024]
    assert max(steps.values()) == 1024 and len(short) <= 9


def test_steps_are_even_over_all_tasks(spark):
    docs = cases.documents(spark).repartition(7)
    found = packing.pack_documents(docs, PATH, longest=256, shortest=16, step_tokens=1024).collect()
    check(cases.rows(), found, 256)
    assert len({p.sequence_id >> 40 for p in found}) > 3
    steps, tiers = Counter(), {}
    for p in found:
        steps[p.step_group] += p.length
        assert tiers.setdefault(p.step_group, p.tier) == p.tier
    assert max(steps.values()) == 1024
    assert max(Counter(tiers[g] for g, n in steps.items() if n != 1024).values()) == 1


def test_empty_table(spark):
    assert packing.pack_documents(cases.empty(spark), PATH).count() == 0


@pytest.mark.parametrize("remembered", [10, 1_000_000])
def test_word_tokenizer_equals_the_library(monkeypatch, remembered):
    import random

    monkeypatch.setattr(packing, "REMEMBERED", remembered)
    rng = random.Random(7)
    letters = "aBé ß́İΣσ漢🙂'sll\n\t\x85\x1c　<|endoftext|>.,12$-"
    odd = ["<|ENDOFTEXT|>", "a<|endoftext|>b <|startoftext|>", "don't won'T x's", "a..b .) x.", "ªµº", "ﬁ Ǆ", "é É"]
    odd += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + [t or "" for t in cases.texts()]
    own, library = packing.WordTokenizer(PATH), Tokenizer.from_file(PATH)
    assert own.expected
    for part in (odd[:700], odd[700:]):
        ids, counts = own.encode([t.encode() for t in part], 2)
        ends = np.cumsum(counts)
        for t, e, n in zip(part, ends.tolist(), counts.tolist(), strict=True):
            assert ids[e - n : e].tolist() == [*library.encode(t, add_special_tokens=False).ids, 2], repr(t)


def plainly(batches, longest, shortest):
    """The packing rule by lists that are searched from end to end: (document, start, length, window, offset, tier)."""
    waiting, out, windows = [], [], 0

    def emit(parts, tier):
        nonlocal windows
        offset = 0
        for doc, start, length in parts:
            out.append((doc, start, length, windows, offset, tier))
            offset += length
        windows += 1

    def take(length):
        at = max(i for i, r in enumerate(waiting) if r[2] == length)
        return waiting.pop(at)

    def tier_of(length):
        tier = shortest
        while tier < length:
            tier *= 2
        return tier

    def pack():
        while waiting:
            top = max(r[2] for r in waiting)
            if sum(r[2] for r in waiting) < tier_of(top):
                return
            parts = [take(top)]
            gap = tier_of(top) - top
            while gap:
                fitting = [r[2] for r in waiting if r[2] <= gap]
                if fitting:
                    parts.append(take(max(fitting)))
                else:
                    doc, start, length = take(min(r[2] for r in waiting))
                    parts.append((doc, start, gap))
                    waiting.append((doc, start + gap, length - gap))
                gap -= parts[-1][2]
            emit(parts, tier_of(top))

    for batch in batches:
        for doc, n in batch:
            for start in range(0, n - n % longest, longest):
                emit([(doc, start, longest)], longest)
            if n % longest:
                waiting.append((doc, n - n % longest, n % longest))
        pack()
    left, rests = sum(r[2] for r in waiting), sorted(waiting, key=lambda r: -r[2])
    while left:
        tier = longest
        while tier > left:
            tier //= 2
        left, parts, gap = left - tier, [], tier
        while gap:
            doc, start, length = rests.pop(0)
            parts.append((doc, start, min(gap, length)))
            if length > gap:
                rests.insert(0, (doc, start + gap, length - gap))
            gap -= parts[-1][2]
        emit(parts, tier)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_routes_and_gaps_equal_the_rule_by_brute_force(seed):
    import random

    rng = random.Random(seed)
    batches = [[(f * 1000 + i, rng.choice([rng.randint(1, 40), rng.randint(1, 300), 64, 16])) for i in range(rng.randint(0, 60))] for f in range(5)]
    packer = packing.Packer(0, 64, 8)
    for batch in batches:
        for doc, n in batch:
            packer.add(doc, bytes(4 * n))
        packer.pack()
    packer.finish()
    found = [(doc, start, length, window, offset, tier) for doc, start, length, _, _, window, offset, tier, _ in packer.rows]
    assert found == plainly(batches, 64, 8)
