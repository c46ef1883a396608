"""Operator 3 - quality classifier on random-indexing word vectors.

A word becomes a few features: its letters (or "other" outside the vocabulary),
the marks before and after it, its shape, and whether it repeats one of the
three words before it.  Every feature has a fixed sparse random index vector;
its word vector is the sum of the index vectors found around it in the fitting
sample (random indexing).  A document is the mean of its words' vectors, over
its whole text, and goes through a two-layer network in numpy.  A temperature
fitted on rows set aside makes the scores calibrated probabilities.

Only the fit is bounded: at most ``fit_rows`` labelled documents of each label
(the smallest hashes of their ids) and ``fit_bytes`` of their texts, and
``vocabulary`` words.  The model's size
depends on these two alone, so it travels with the tasks.  All documents are
scored.

Defined results: a null or empty text is scored too (its vector is zero);
without any labelled row, or with one label only, every score is the share of
label 1 (0.5 without rows); null or unknown labels are ignored and a document
labelled twice counts with its smallest label; repeated rows are scored each,
and of the texts of a repeated id the first in code-point order is learnt from;
a very long text is scored whole, and learnt from only if it fits
``fit_bytes``; equal hashes go by id; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditlens.llm.common import Scratch, table

DIMENSIONS, NONZERO, WINDOW, LAGS = 64, 8, 2, 3
HIDDEN = 32
CACHED_WORDS = 300_000


def parts(word: bytes) -> tuple[str, ...]:
    """Features of one word: letters, marks before and after, shape."""
    text = word.decode("utf-8", "replace")
    inner = [i for i, ch in enumerate(text) if ch.isalnum()]
    if not inner:
        return ("s:" + text[:3], "h:none")
    first, last = inner[0], inner[-1] + 1
    core = text[first:last]
    if core.isdigit():
        shape, core = "digits", "0"
    elif core.isupper():
        shape = "upper" if len(core) > 1 else "one"
    elif core.islower():
        shape = "lower"
    else:
        shape = "title" if core[0].isupper() and core[1:].islower() else "mixed"
    out = ["w:" + core.lower(), "h:" + shape]
    if first:
        out.append("p:" + text[:first][:3])
    if last < len(text):
        out.append("s:" + text[last:][:3])
    return tuple(out)


FIT_BYTES = 64_000_000


def index_vector(feature: str) -> np.ndarray:
    """The feature's fixed sparse vector of +1 and -1."""
    draw = np.random.default_rng(zlib.crc32(feature.encode()))
    out = np.zeros(DIMENSIONS, np.float32)
    out[draw.choice(DIMENSIONS, NONZERO, replace=False)] = draw.choice([-1.0, 1.0], NONZERO)
    return out


REPEATS = [f"r:{k}" for k in range(1, LAGS + 1)]


def repeats(words: list[bytes]) -> list[int]:
    """How many words equal the word 1, 2, 3 places before."""
    h = np.fromiter(map(hash, words), np.int64, len(words))
    return [int((h[k:] == h[:-k]).sum()) if len(h) > k else 0 for k in range(1, LAGS + 1)]


class Vectors:
    """Word vectors by random indexing over a sample of texts."""

    def __init__(self, texts: list[bytes], vocabulary: int):
        count: Counter = Counter()
        for text in texts:
            for word, n in Counter(text.split()).items():
                for f in parts(word):
                    count[f] += n
        known = [f for f, n in count.most_common() if n >= 3][:vocabulary]
        known += [f for f in ("w:?", "p:?", "s:?", "h:?", *REPEATS) if f not in count]
        self.number = {f: i for i, f in enumerate(dict.fromkeys([*known, "w:?", "p:?", "s:?", "h:?", *REPEATS]))}
        index = np.stack([index_vector(f) for f in self.number])
        context = index.copy()  # a feature's own index vector belongs to its context
        for text in texts:
            words = text.split()
            if not words:
                continue
            slots = [self.features(w) for w in words]
            own = np.stack([index[s].sum(axis=0) for s in slots])
            around = np.zeros_like(own)
            for k in range(1, WINDOW + 1):
                around[k:] += own[:-k]
                around[:-k] += own[k:]
            which = np.concatenate(slots)
            rows = np.repeat(np.arange(len(words)), [len(s) for s in slots])
            order = np.argsort(which, kind="stable")
            starts = np.flatnonzero(np.diff(which[order], prepend=-1))
            context[which[order][starts]] += np.add.reduceat(around[rows[order]], starts, axis=0)
        self.table = context / np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
        self._reset()

    def _reset(self):
        self.words: dict[bytes, int] = {}
        self.kinds: dict[tuple, int] = {}
        self.matrix = np.zeros((1024, DIMENSIONS), np.float32)

    def __getstate__(self):
        return {"number": self.number, "table": self.table}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._reset()

    def features(self, word: bytes) -> np.ndarray:
        return np.array([self.number.get(f, self.number[f[:2] + "?"]) for f in parts(word)])

    def _learn(self, word: bytes) -> int:
        slots = self.features(word)
        kind = self.kinds.setdefault(tuple(slots.tolist()), len(self.kinds))
        if kind >= len(self.matrix):
            self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
        self.matrix[kind] = self.table[slots].sum(axis=0)
        self.words[word] = kind
        return kind

    def document(self, text: bytes | None, step: int = 65_536) -> np.ndarray:
        """Mean of the vectors of all words of the text."""
        words = (text or b"").split()
        total = np.zeros(DIMENSIONS)
        if not words:
            return total
        if len(self.words) > CACHED_WORDS:
            self._reset()
        for w in set(words).difference(self.words):
            self._learn(w)
        kinds = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        for k in range(0, len(kinds), step):
            total += self.matrix[kinds[k:k + step]].sum(axis=0, dtype=np.float64)
        for f, n in zip(REPEATS, repeats(words)):
            total += n * self.table[self.number[f]].astype(np.float64)
        return total / len(words)


class Network:
    """Two layers, trained with Adam on weighted log loss; a temperature divides its output."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int = 3, rounds: int = 400):
        draw = np.random.default_rng(seed)
        aside = draw.random(len(y)) < 0.25
        if len({*y[~aside]}) < 2 or len({*y[aside]}) < 2:
            aside[:] = False
        self.mean, self.scale = x[~aside].mean(axis=0), x[~aside].std(axis=0) + 1e-6
        z, t, w = self._scaled(x), y.astype(float), weight / weight[~aside].sum()
        p = [draw.normal(0, z.shape[1] ** -0.5, (z.shape[1], HIDDEN)), np.zeros(HIDDEN),
             draw.normal(0, HIDDEN ** -0.5, (HIDDEN, 1)), np.zeros(1)]
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        a, b = z[~aside], t[~aside]
        for k in range(1, rounds + 1):
            hidden = np.tanh(a @ p[0] + p[1])
            out = 1 / (1 + np.exp(-(hidden @ p[2] + p[3])[:, 0].clip(-30, 30)))
            error = ((out - b) * w[~aside])[:, None]
            back = error @ p[2].T * (1 - hidden ** 2)
            grads = [a.T @ back + 1e-4 * p[0], back.sum(axis=0), hidden.T @ error + 1e-4 * p[2], error.sum(axis=0)]
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - 0.01 * (m[i] / (1 - 0.9 ** k)) / (np.sqrt(v[i] / (1 - 0.999 ** k)) + 1e-8)
        self.p, self.temperature = p, 1.0
        if aside.any():
            raw, b, wa = self.raw(x[aside]), t[aside], weight[aside]
            grid = np.geomspace(0.25, 8, 60)
            loss = [(wa * np.logaddexp(0, np.where(b > 0, -raw, raw) / g)).sum() for g in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale).clip(-8, 8)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return (np.tanh(self._scaled(x) @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3])[:, 0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.raw(x) / self.temperature).clip(-500, 500)))


class Classifier:
    def __init__(self, texts: list[bytes], y: list[int], share: float, vocabulary: int):
        self.share, self.vectors = share, None
        if len({*y}) == 2:
            y = np.array(y)
            self.vectors = Vectors(texts, vocabulary)
            weight = np.where(y == 1, share / (y == 1).mean(), (1 - share) / (y == 0).mean())
            self.network = Network(np.stack([self.vectors.document(t) for t in texts]), y, weight)

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        if self.vectors is None or not texts:
            return np.full(len(texts), self.share)
        return self.network.probability(np.stack([self.vectors.document(t) for t in texts]))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int, vocabulary: int, fit_bytes: int = FIT_BYTES) -> Classifier:
    """Fit on at most ``fit_rows`` documents of each label (0 and 1), by the smallest hashes of their ids, and at most
    ``fit_bytes`` of text, which is what the driver collects."""
    marked = (labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
              .agg(F.min("quality").alias("quality")))
    counts = {r.quality: r.n for r in marked.where("quality IN (0, 1)").groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.5
    chosen = None
    for q in (0, 1):
        part = marked.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.join(F.broadcast(chosen), "doc_id")  # fit_rows bounds the broadcast
    scratch = Scratch(docs.sparkSession, "quality-sample")
    try:  # of rows that repeat an id the first text in code-point order stands for it
        sample = scratch.write(texts.groupBy("doc_id", "quality").agg(F.min("text").alias("text")), "sample")
        room, taken = fit_bytes, []
        for r in sorted(sample.select("doc_id", F.octet_length("text").alias("n")).collect(),
                        key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id)):
            if r.n <= room:  # whole texts only; one that does not fit is left out
                room -= r.n
                taken.append(r.doc_id)
        rows = sorted(sample.where(F.col("doc_id").isin(taken)).collect(), key=lambda r: r.doc_id)
    finally:
        scratch.remove()
    return Classifier([r.text.encode() for r in rows], [r.quality for r in rows], share, vocabulary)


def score_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = 1500, vocabulary: int = 20_000,
                  fit_bytes: int = FIT_BYTES) -> DataFrame:
    """One row per input row: doc_id, score (probability of label 1).  Only ``labels`` are learnt from."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, fit_rows, vocabulary, fit_bytes))

    def score(batches):
        classifier = model.value
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(classifier.scores(texts), pa.float64())],
                                             ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(score, "doc_id long, score double")


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~held_out()))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
