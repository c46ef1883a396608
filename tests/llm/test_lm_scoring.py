import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditlens.llm import lm_scoring as op


def tokens(text):
    text = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", text) + ["</s>"]


class Reference:
    """The same model by plain recursion over dictionaries."""

    def __init__(self, texts, order, beta):
        self.order, self.beta, self.c = order, beta, Counter()
        for t in texts:
            t = ["<s>", *t]
            for k in range(1, order + 1):
                self.c.update(tuple(t[i:i + k]) for i in range(len(t) - k + 1))
        words = {g: n for g, n in self.c.items() if len(g) == 1 and g != ("<s>",)}
        self.n, self.v = sum(words.values()), len(words)

    def p(self, gram):
        if len(gram) == 1:
            if self.n == 0:
                return 1.0
            return (self.c[gram] or self.v / (self.v + 1)) / (self.n + self.v)
        context = self.c[gram[:-1]]
        if context == 0:
            return self.p(gram[1:])
        return (self.c[gram] + self.beta * self.p(gram[1:])) / (context + self.beta)

    def score(self, t):
        t = ["<s>", *t]
        return sum(math.log10(self.p(tuple(t[max(0, i - self.order + 1):i + 1]))) for i in range(1, len(t)))

    def base(self, t):
        return sum(math.log10((self.c[(w,)] + 1) / (self.n + self.v + 1)) for w in t)


def compare(frame, rows, held, order, beta):
    texts = {i: tokens(t) for i, t in rows}
    model = Reference([texts[i] for i, _ in rows if not held(i)], order, beta)
    out = frame.collect()
    assert len(out) == len(rows)
    for r in out:
        t = texts[r.doc_id]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held(r.doc_id), len(t), model.n)
        assert r.n_known == sum(model.c[(w,)] > 0 for w in t)
        assert r.base_score == pytest.approx(model.base(t), rel=1e-9)
        assert r.score == pytest.approx(model.score(t), rel=1e-9)


def split(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2


def test_whole_table_against_plain_recursion(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    out = op.op4_lm_scoring(spark, sf_dir)
    compare(out, rows, split, 2, 50.0)
    held = out.where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]  # true probabilities on both sides: unseen words have their own small part


@pytest.mark.parametrize("order", [1, 2, 3])
def test_many_blocks_and_orders(docs_of, order):
    rows = [(i, " ".join(f"w{(i * k * 7) % (3 + i % 11)}" for k in range(i % 50))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "\t W1 w1\x0bW2"), (None, "w1 w2"), (1003, "w1 " * 100_000)]
    docs = docs_of(rows).selectExpr("*", "1 AS block", "false AS held_out", "2 AS row", "'x' AS file")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    compare(op.lm_score(docs, held, order=order, beta=3.0, block_bytes=20_000), rows, split, order, 3.0)


def test_no_training_and_empty(docs_of):
    docs = docs_of([(1, "a b"), (1, "a b")])
    out = op.lm_score(docs, F.lit(True)).collect()
    assert [(r.n_known, r.train_tokens, r.score, r.base_score) for r in out] == [(0, 0, 0.0, 0.0)] * 2
    assert op.lm_score(docs.where("doc_id = 2"), F.lit(False)).count() == 0


@pytest.mark.parametrize("order", [1, 2, 4])
def test_lanes_change_nothing(monkeypatch, order):
    texts = [" ".join(f"w{(i * k) % 13}" for k in range(n)).encode() for i, n in enumerate((0, 1, 2, 255, 256, 257, 1000, 30))]
    block = op.Block(texts, order)
    totals = [block.counts(k, np.ones(len(texts), bool)) for k in range(order)]
    word = block.keys[0] != op.START
    machine = op.Automaton(block, totals, int(totals[0][word].sum()), int(word.sum()), 2.0)
    whole = machine.scores(block.tokens, block.lengths)
    monkeypatch.setattr(op, "LANE", 5)
    assert machine.scores(block.tokens, block.lengths) == pytest.approx(whole, rel=1e-12)


def test_probabilities_sum_to_one():
    model = Reference([["a", "b", "</s>"], ["a", "c", "a", "</s>"]], 3, 2.0)
    words = ["a", "b", "c", "</s>", *(f"u{i}" for i in range(model.v + 1))]  # and V + 1 unseen words
    for context in ((), ("a",), ("<s>", "a"), ("c", "a"), ("b",)):
        assert sum(model.p((*context, w)) for w in words) == pytest.approx(1.0)


def test_random_words_score_below_a_clean_text(docs_of):
    text = "the cat sat on the mat and the dog sat on the cat"
    n = len(text.split())
    docs = docs_of([(i, text + f" w{i}") for i in range(40)] + [(100, text), (101, " ".join(f"zq{k}" for k in range(n)))])
    rows = {r.doc_id: r for r in op.lm_score(docs, F.col("doc_id") >= 100).collect()}
    clean, noise = rows[100], rows[101]
    assert clean.n_known == n + 1 and noise.n_known == 1
    assert noise.score < noise.base_score + 1 and noise.score < clean.score


@pytest.mark.parametrize("order", [1, 2, 3])
def test_words_and_unseen_words_sum_to_one(docs_of, order):
    words = ["a", "b", "c", "</s>"]
    docs = docs_of([(0, "a b"), (1, "a c a"), *((2 + i, f"a {w}") for i, w in enumerate([*words[:3], "u0"])), (9, "a")])
    rows = {r.doc_id: r for r in op.lm_score(docs, F.col("doc_id") >= 2, order=order, beta=2.0).collect()}
    model = Reference([tokens("a b"), tokens("a c a")], order, 2.0)
    before, after = math.log10(model.p(("<s>", "a")[-order:])), math.log10(model.p(("</s>",)))
    unseen = 10 ** (rows[5].score - before - after)
    known = [model.p(("<s>", "a", w)[-order:]) for w in words]
    assert model.v == len(words) and sum(known) + (model.v + 1) * unseen == pytest.approx(1.0)
