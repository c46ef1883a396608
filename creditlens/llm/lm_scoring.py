"""Operator 4 - language-model scoring with a weighted backoff automaton.

The model is an n-gram model with Dirichlet smoothing,
p(w | u) = (c(uw) + beta p(w | u')) / (c(u) + beta) where u' drops u's first
token, over a Witten-Bell unigram model c(w) / (N + V) whose share V / (N + V)
goes to unseen words, V + 1 of which have equal parts of it.  ``score`` is the
log10 probability of the text under it, its unseen words included.  As an
automaton: every context seen in training is a state; every seen n-gram is an
arc from its context's state, weighted with its log-probability; a state's
failure arc leads to the context without its first token and is weighted with
log(beta / (c(u) + beta)).  A document is read once from left to right; the
traversal carries the state and adds up weights.  The documents of a block are
read in lockstep, a step of all of them being one numpy operation; a long one
is cut into lanes of ``LANE`` tokens, each of which first reads the order - 1
tokens before it, which fix its state.

The automaton of a whole corpus fits in no memory, so it is dealt out.
Documents are hashed into blocks of bounded size.  Each block sends its
distinct n-grams with their training counts to the shards (ranges of n-gram
hashes), where counts are added up over all blocks; the totals go back to the
blocks that asked.  A block so gets exactly the part of the automaton that its
own documents can reach.

Defined results: a null or empty text is the end token alone; a null id counts
as the empty string for the split; with no training text every word is unknown
and scores come from the unknown share alone; repeated rows are scored each,
and nothing is ordered, so there are no ties; a very long text makes its block
as long as itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditlens.llm.common import Scratch, fold_words, located, table
from creditlens.llm.near_dedup import mixed

START, END = np.uint64(0x5354415254), np.uint64(0x454E44)  # words have no such hashes but by chance 2^-64
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
LANE = 256


class Block:
    """The n-grams of a block of texts: token numbers, distinct n-grams by order, and where each occurs."""

    def __init__(self, texts: list[bytes | None], order: int):
        lists = [fold_words(t) for t in texts]
        words = [w for x in lists for w in x]
        numbers = dict.fromkeys(words)
        for i, w in enumerate(numbers):
            numbers[w] = i + 2
        flat = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
        self.lengths = [len(x) + 1 for x in lists]
        sizes = np.array(self.lengths, np.int64) + 1  # with the start mark
        self.doc = np.repeat(np.arange(len(texts)), sizes)
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.tokens = np.zeros(int(sizes.sum()), np.int64)  # 0 begins a text, 1 ends it
        ends = np.cumsum(sizes) - 1
        self.tokens[ends] = 1
        inner = np.ones(len(self.tokens), bool)
        inner[ends] = inner[ends - sizes + 1] = False
        self.tokens[inner] = flat
        depth = np.arange(len(self.tokens)) - first  # tokens before this one, the start mark included
        self.is_token = depth > 0
        hashes = np.concatenate([np.array([START, END], np.uint64),
                                 np.fromiter(map(xxhash.xxh3_64_intdigest, numbers), np.uint64, len(numbers))])
        own = hashes[self.tokens]
        self.n_words = len(numbers) + 2
        #: per order: sorted distinct keys, the number of each position's n-gram (-1: none), a position of each n-gram
        self.keys, self.at, self.where = [], [], []
        key = own
        for k in range(1, order + 1):
            if k > 1:
                before = np.concatenate([key[:1], key[:-1]])
                with np.errstate(over="ignore"):
                    key = mixed(before * GOLDEN + own + np.uint64(k))
            place = np.flatnonzero(depth >= k - 1)
            keys, where, at = np.unique(key[place], return_index=True, return_inverse=True)
            number = np.full(len(self.tokens), -1, np.int64)
            number[place] = at
            self.keys.append(keys)
            self.at.append(number)
            self.where.append(place[where])

    def counts(self, k: int, train: np.ndarray) -> np.ndarray:
        """How often each distinct (k+1)-gram occurs in the texts marked in ``train``."""
        at = self.at[k]
        use = (at >= 0) & train[self.doc]
        return np.bincount(at[use], minlength=len(self.keys[k]))


def _planes(x: np.ndarray) -> bytes:
    """Integers byte plane by byte plane: planes of high bytes are nearly constant and compress away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes() if len(x) else b""


def _integers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def _steps(keys: np.ndarray) -> bytes:
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _texts(t: pa.Table) -> list[bytes | None]:
    return t.column("text").cast(pa.binary()).to_pylist()


def _ordered(t: pa.Table) -> pa.Table:
    return t.sort_by([("file", "ascending"), ("row", "ascending")])


REQUEST = "kind int, shard long, block long, grams long, steps binary, counts binary"
ANSWER = "block long, kind int, shard long, grams long, totals binary, v long, tokens long"


def _requests(order: int, bits: int):
    def ask(t: pa.Table) -> pa.Table:
        t = _ordered(t)
        block = Block(_texts(t), order)
        train = ~np.array(t.column("held_out").to_pylist(), bool)
        out, of = [], t.column("block")[0].as_py()
        for k in range(order):
            keys, counts = block.keys[k], block.counts(k, train).astype(np.uint64)
            shards = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
            cuts = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), len(keys)]
            out += [(k, int(shards[a]), of, b - a, _steps(keys[a:b]), _planes(counts[a:b]))
                    for a, b in zip(cuts, cuts[1:]) if a < b]
        names = [c.split()[0] for c in REQUEST.split(", ")]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), [pa.int32(), pa.int64(), pa.int64(), pa.int64(),
                                                                    pa.binary(), pa.binary()])], names)

    return ask


def _answer(t: pa.Table) -> pa.Table:
    """Totals of one shard's n-grams over all blocks, for each block in the order it asked."""
    keys = [np.cumsum(_integers(x.as_py()), dtype=np.uint64) for x in t.column("steps")]
    counts = [_integers(x.as_py()) for x in t.column("counts")]
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(every), np.uint64)
    np.add.at(total, at, np.concatenate(counts))
    ends = np.cumsum([len(k) for k in keys])
    kind, shard = t.column("kind")[0].as_py(), t.column("shard")[0].as_py()
    word = (every != START) & (total > 0)
    v, tokens = (int(word.sum()), int(total[word].sum())) if kind == 0 else (0, 0)
    n = t.num_rows
    return pa.table({
        "block": pa.concat_arrays([*t.column("block").chunks, pa.array([-1], pa.int64())]),
        "kind": pa.array([kind] * (n + 1), pa.int32()), "shard": pa.array([shard] * (n + 1), pa.int64()),
        "grams": pa.array([len(k) for k in keys] + [0], pa.int64()),
        "totals": pa.array([_planes(total[at[e - len(k):e]]) for k, e in zip(keys, ends)] + [b""], pa.binary()),
        "v": pa.array([0] * n + [v], pa.int64()), "tokens": pa.array([0] * n + [tokens], pa.int64())})


class Automaton:
    """States, arcs and failure arcs that a block's texts can reach."""

    def __init__(self, block: Block, totals: list[np.ndarray], n: int, v: int, beta: float):
        order = len(totals)
        c = [t.astype(float) for t in totals]
        word = block.tokens[block.where[0]]
        known = c[0] > 0
        unknown = v / (n + v) / (v + 1) if n + v else 1.0  # the share of one unseen word
        p = [np.where(known, c[0] / max(n + v, 1), unknown)]
        for k in range(1, order):
            context, suffix = block.at[k - 1][block.where[k] - 1], block.at[k - 1][block.where[k]]
            p.append((c[k] + beta * p[k - 1][suffix]) / (c[k - 1][context] + beta))
        # state 0 is the root; then the seen contexts, shortest first
        state, size = [], 1
        for k in range(order - 1):
            seen = c[k] > 0
            number = np.zeros(len(seen), np.int64)
            number[seen] = size + np.arange(int(seen.sum()))
            size += int(seen.sum())
            state.append(number)
        fail, weight = np.zeros(size, np.int64), np.zeros(size)
        for k in range(order - 1):
            seen = np.flatnonzero(c[k] > 0)
            weight[state[k][seen]] = np.log10(beta / (c[k][seen] + beta))
            if k:
                fail[state[k][seen]] = state[k - 1][block.at[k - 1][block.where[k][seen]]]
        self.fail, self.fail_weight = fail, weight
        self.width, self.order = block.n_words, order
        self.root_weight, self.root_to = np.zeros(self.width), np.zeros(self.width, np.int64)
        self.root_weight[word] = np.log10(np.maximum(p[0], 1e-300))
        if order > 1:
            self.root_to[word] = state[0]
        self.start = int(self.root_to[0]) if self.width > 0 and order > 1 else 0
        none = np.empty(0, np.int64)
        arcs, arc_weight, arc_to = [none], [np.empty(0)], [none]
        for k in range(1, order):
            seen = np.flatnonzero(c[k] > 0)
            where = block.where[k][seen]
            source, token = state[k - 1][block.at[k - 1][where - 1]], block.tokens[where]
            arcs.append(source * self.width + token)
            arc_weight.append(np.log10(p[k][seen]))
            arc_to.append(state[k][seen] if k < order - 1 else state[k - 1][block.at[k - 1][where]])
        arcs = np.concatenate(arcs)
        by = np.argsort(arcs, kind="stable")
        self.arcs, self.arc_weight, self.arc_to = arcs[by], np.concatenate(arc_weight)[by], np.concatenate(arc_to)[by]

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every lane reads one token: (new states, weights of the arcs and failure arcs taken)."""
        weight, to = np.zeros(len(state)), np.zeros(len(state), np.int64)
        at, lanes = state.copy(), np.flatnonzero(state)
        while len(lanes):
            key = at[lanes] * self.width + token[lanes]
            arc = np.searchsorted(self.arcs, key)
            found = self.arcs[np.minimum(arc, len(self.arcs) - 1)] == key if len(self.arcs) else np.zeros(len(key), bool)
            there = lanes[found]
            weight[there] += self.arc_weight[arc[found]]
            to[there] = self.arc_to[arc[found]]
            at[there] = -1
            lanes = lanes[~found]
            weight[lanes] += self.fail_weight[at[lanes]]
            at[lanes] = self.fail[at[lanes]]
            lanes = lanes[at[lanes] > 0]
        root = np.flatnonzero(at == 0)
        weight[root] += self.root_weight[token[root]]
        to[root] = self.root_to[token[root]]
        return to, weight

    def scores(self, tokens: np.ndarray, lengths: list[int]) -> np.ndarray:
        """log10 probability of each text; ``tokens`` has all texts, each behind its start mark."""
        length = np.array(lengths, np.int64)
        first = np.cumsum(length + 1) - length  # the token after the start mark
        n = -(-length // LANE)
        doc = np.repeat(np.arange(len(length)), n)
        part = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        begin, end = first[doc] + part * LANE, np.minimum(first[doc] + (part + 1) * LANE, (first + length)[doc])
        read = np.maximum(begin - (self.order - 1), first[doc])  # where the lane starts to read
        steps = end - read
        by = np.argsort(-steps, kind="stable")
        doc, begin, read, steps = doc[by], begin[by], read[by], steps[by]
        state = np.where(read == first[doc], self.start, 0)
        total = np.zeros(len(doc))
        for j in range(int(steps[0]) if len(steps) else 0):
            active = np.searchsorted(-steps, -j, side="left")
            place = read[:active] + j
            state[:active], weight = self.step(state[:active], tokens[place])
            total[:active] += np.where(place >= begin[:active], weight, 0.0)
        return np.bincount(doc, weights=total, minlength=len(length))


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scorer(order: int, n: int, v: int, beta: float):
    def score(t: pa.Table, answers: pa.Table) -> pa.Table:
        t = _ordered(t)
        block = Block(_texts(t), order)
        answers = answers.sort_by([("kind", "ascending"), ("shard", "ascending")])
        kinds, blobs = answers.column("kind").to_pylist(), answers.column("totals").to_pylist()
        totals = [np.concatenate([_integers(b) for kind, b in zip(kinds, blobs) if kind == k]) for k in range(order)]
        if [len(x) for x in totals] != [len(x) for x in block.keys]:
            raise ValueError("a block's n-grams changed between two reads of the documents")
        machine = Automaton(block, totals, n, v, beta)
        count = totals[0].astype(np.int64)[block.at[0]]
        base = np.where(block.is_token, np.log10((count + 1.0) / (n + v + 1)), 0.0)
        docs = len(block.lengths)
        known = np.bincount(block.doc, weights=(count > 0) & block.is_token, minlength=docs).astype(np.int64)
        return pa.table({
            "doc_id": t.column("doc_id"), "held_out": t.column("held_out"), "n_tokens": pa.array(block.lengths, pa.int64()),
            "n_known": pa.array(known), "train_tokens": pa.array([n] * docs, pa.int64()),
            "base_score": pa.array(np.bincount(block.doc, weights=base, minlength=docs)),
            "score": pa.array(machine.scores(block.tokens, block.lengths))})

    return score


def lm_score(docs: DataFrame, held_out: Column, order: int = 2, beta: float = 50.0,
             block_bytes: int = 3_000_000) -> DataFrame:
    """Score all texts with a model of the rows where ``held_out`` is false.

    One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score (add-one unigram model) and score, the automaton's log10
    probability of the whole text.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm-scoring")
    try:
        rows = located(docs, scratch, F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"),
                       F.col("text").cast("string").alias("text"))
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        blocks = max(1, math.ceil(size / block_bytes))
        bits = math.ceil(math.log2(blocks))
        rows = rows.withColumn("block", F.expr(f"pmod(xxhash64(file, row), {blocks}L)"))
        asked = rows.groupBy("block").applyInArrow(_requests(order, bits), REQUEST)
        answers = scratch.write(asked.groupBy("kind", "shard").applyInArrow(_answer, ANSWER), "totals")
        total = answers.where("block = -1").agg(F.sum("tokens"), F.sum("v")).first()
        n, v = (int(x or 0) for x in total)
        out = (rows.groupBy("block").cogroup(answers.where("block >= 0").drop("v", "tokens").groupBy("block"))
               .applyInArrow(_scorer(order, n, v, beta), SCORES))
        return scratch.finish(out)
    except BaseException:
        scratch.remove()
        raise


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    return lm_score(table(spark, sf_dir, "documents"), split)
