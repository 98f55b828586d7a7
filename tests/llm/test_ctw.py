from __future__ import annotations

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern.llm import ctw
from quern.llm.common import clamp_partitions
from tests.llm import cases


def kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


class Tree:
    """Context-tree weighting by its definition, with a dictionary of nodes."""

    def __init__(self, texts, depth):
        self.depth, self.counts, self.children, self.memo = depth, Counter(), {}, {}
        for t in texts:
            for context, x in self.steps(t):
                for k in range(8):
                    node, bit = (1 << k) | (x >> (8 - k)), (x >> (7 - k)) & 1
                    for d in range(depth + 1):
                        self.counts[context[depth - d :], node, bit] += 1
                        if d:
                            self.children.setdefault((context[depth - d + 1 :], node), set()).add(context[depth - d :])

    def steps(self, t):
        t = b"\xff" * self.depth + t + b"\xff"
        return [(t[i - self.depth : i], t[i]) for i in range(self.depth, len(t))]

    def own(self, context, node):
        return kt(self.counts[context, node, 0], self.counts[context, node, 1])

    def below(self, context, node):
        return sum(self.weighted(c, node) for c in self.children.get((context, node), ()))

    def weighted(self, context, node):
        if (context, node) not in self.memo:
            own = self.own(context, node)
            if len(context) < self.depth:
                low, high = sorted((own, self.below(context, node)))
                own = high + math.log1p(math.exp(low - high)) - math.log(2)
            self.memo[context, node] = own
        return self.memo[context, node]

    def log10(self, t):
        total = 0.0
        for context, x in self.steps(t):
            for k in range(8):
                node, bit = (1 << k) | (x >> (8 - k)), (x >> (7 - k)) & 1
                p = None
                for d in range(self.depth, -1, -1):
                    c = context[self.depth - d :]
                    n = self.counts[c, node, 0], self.counts[c, node, 1]
                    own = (n[bit] + 0.5) / (sum(n) + 1)
                    w = 1 / (1 + math.exp(max(-700, min(700, self.below(c, node) - self.own(c, node))))) if d < self.depth else 1
                    p = own if p is None else w * own + (1 - w) * p
                total += math.log10(p)
        return total


def scored(spark, rows, depth=ctw.DEPTH):
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean, block int, part string, gram int, n string")
    return ctw.score_texts(docs.repartition(3), depth=depth).collect()


def small_blocks(monkeypatch, size: int) -> list[int]:
    """Let the workers, which have the module of their own, cut blocks of ``size`` bytes; gives the numbers of groups that follow."""

    def cut(batches):
        from quern.llm import ctw as own

        before, own.BLOCK_BYTES = own.BLOCK_BYTES, size
        try:
            yield from own._blocks(batches)
        finally:
            own.BLOCK_BYTES = before

    groups: list[int] = []

    def counted(total, each, least=1):
        n = clamp_partitions(total, each, least)
        if each == ctw.GROUP_BLOCKS:
            groups.append(n)
        return n

    monkeypatch.setattr(ctw, "_blocks", cut)
    monkeypatch.setattr(ctw, "clamp_partitions", counted)
    return groups


@pytest.mark.parametrize(
    ("depth", "block", "part", "blocks", "items"),
    [(5, 1 << 24, 1 << 24, 256, 1 << 22), (3, 300, 200, 256, 1 << 22), (4, 1 << 24, 100, 256, 1 << 22), (5, 300, 1000, 4, 1 << 22), (4, 200, 1000, 3, 40)],
)
def test_equals_the_definition(spark, monkeypatch, depth, block, part, blocks, items):
    """Also with several blocks to a group, and the groups' parts split again."""
    groups = small_blocks(monkeypatch, block)
    monkeypatch.setattr(ctw, "PART_BYTES", part)
    monkeypatch.setattr(ctw, "GROUP_BLOCKS", blocks)
    monkeypatch.setattr(ctw, "PART_ITEMS", items)
    texts = [t for t in cases.texts() if len(t or "") < 3000]
    texts += [texts[5], None]
    rows = [(i, t, i % 4 == 1, 1, "p", 2, "n") for i, t in enumerate(texts)]
    rows += [rows[9], (None, "no id", False, 1, "p", 2, "n")]
    lower = lambda t: (t or "").encode().lower()
    train = [lower(t) for _, t, out, *_ in rows if not out]
    tree = Tree(train, depth)
    c = Counter(w for t in train for w in t.split())
    n, v, ends = sum(c.values()) + len(train), len(c) + 1, len(train)
    expected = Counter()
    for i, t, out, *_ in rows:
        w = lower(t).split()
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
        expected[i, out, len(w) + 1, sum(c[x] > 0 for x in w) + 1, n, round(base, 6)] += 1
    found = scored(spark, rows, depth)
    assert (groups[0] > 3) == (blocks < 256)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == expected
    by_text = {}
    for i, t, *_ in rows:
        by_text.setdefault(i, set()).add(tree.log10(lower(t)))
    for r in found:
        assert min(abs(r.score - x) / abs(x) for x in by_text[r.doc_id]) < 1e-9
    for r in found:
        size = len(lower(dict((x[0], x[1]) for x in rows)[r.doc_id])) + 1
        assert abs(r.code_length + r.score / math.log10(2) / size) < 1e-9


def test_long_texts_equal_the_definition(spark):
    """Texts of some 100,000 characters, alone in their blocks or not."""
    texts = [t for t in cases.texts() if len(t or "") >= 3000] + ["short one", None]
    rows = [(i, t, i == 1, 1, "p", 2, "n") for i, t in enumerate(texts)]
    tree = Tree([(t or "").encode().lower() for i, t in enumerate(texts) if i != 1], 3)
    for r in scored(spark, rows, 3):
        x = tree.log10((texts[r.doc_id] or "").encode().lower())
        assert abs(r.score - x) <= 1e-9 * abs(x)


def _rows_a_block(spark, monkeypatch, n) -> float:
    """Packed rows between the steps for each block, counted where they are written."""
    seen = []
    monkeypatch.setattr(ctw, "durable", lambda df: seen.append(ctw_durable(df)) or seen[-1])
    docs = spark.range(0, n, 1, 4).selectExpr("id doc_id", "concat_ws(' ', sequence(id, id + 60)) text", "false held_out")
    ctw.score_texts(docs).count()
    blocks, *packs = seen
    return sum(p.count() for p in packs) / blocks.count()


ctw_durable = ctw.durable


def test_packed_rows_grow_with_the_input(spark, monkeypatch):
    """Four times the blocks do not make four times the rows a block."""
    groups = small_blocks(monkeypatch, 2000)
    for name, value in {"PART_BYTES": 2000, "MOST_PARTS": 8, "GROUP_BLOCKS": 8, "PART_ITEMS": 4000, "MOST_CONTEXTS": 8}.items():
        monkeypatch.setattr(ctw, name, value)
    few, many = (_rows_a_block(spark, monkeypatch, n) for n in (150, 600))
    assert 1 < groups[0] < groups[1]
    assert many < 1.3 * few, (few, many)


def test_without_training_texts_each_bit_is_even(spark):
    (r,) = scored(spark, [(1, "ab", True, 1, "", 1, "")])
    assert abs(r.score + 24 * math.log10(2)) < 1e-6 and r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0


def test_empty_table(spark):
    assert scored(spark, []) == []


def test_beats_the_word_model_on_held_out_documents(spark):
    held = ctw.query(spark, "/root/testdata/sf0.1").where("held_out").agg(F.sum("score"), F.sum("base_score"), F.count(F.lit(1))).first()
    assert held[0] > held[1] and held[2] > 1000


def test_depth_is_checked(spark):
    with pytest.raises(ValueError):
        ctw.score_texts(spark.range(1).select(F.col("id").alias("doc_id"), F.lit("").alias("text"), F.lit(False).alias("held_out")), depth=9)
