"""Operator 12 - target-distribution importance resampling over hashed word n-grams.

Features are all runs of 1 to ``max_n`` consecutive words, joined by a space;
a feature's bucket is its CRC-32 modulo ``buckets``.  The corpus and a target
sample are counted by bucket, a bucket's gain is the log ratio of its smoothed
shares, a document's weight the sum over its features, and a Gumbel-perturbed
top-k draws documents as by importance sampling without replacement.

Buckets come from Aho-Corasick dictionaries.  A block of texts is normalised
to lower-case words between single delimiters; its distinct words, each
bounded by delimiters on both sides, are the keys of an automaton (pyahocorasick)
and carry their CRC and byte length as payload.  One scan of a text then emits
the payloads of its words in order, and a longer feature is composed from the
payloads of its neighbours alone: CRC(a ' ' b) follows from CRC(a), CRC(b) and
the length of b.  Texts are read once: bucket lists are stored, and counting
and scoring read the stored lists.

A dictionary never holds more than the words of ``BLOCK`` characters of text
(longer texts are scanned piece by piece, the last max_n - 1 payloads carried
on); a word longer than ``LONG`` characters stands in the scanned text as a
short mark that no word can contain.  What the driver and the tasks get is the
table of ``buckets`` gains.

Defined results: a null or empty text has no feature, weight 0 and its random
part as score; a null id is hashed as the empty string and comes before
others in ties; rows that repeat an id are drawn each on their own; an empty
table gives no rows, an empty target equal gains; a very long text is scanned
whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditlens.llm.common import LOWER, UPPER, Scratch, table
from creditlens.operators.segments import positions

BLOCK, LONG = 2_000_000, 200
#: ASCII but letters and digits delimits words; A-Z become a-z.
NORMAL = {c: " " for c in range(128) if not chr(c).isalnum()} | dict(zip(map(ord, UPPER), LOWER))
LONG_WORD = re.compile(rf"[^ ]{{{LONG + 1},}}")
CRC_POLYNOMIAL = 0xEDB88320


def _advance_one_byte() -> np.ndarray:
    """Rows of the GF(2) matrix that carries a CRC register over one zero byte: images of its 32 bits."""
    rows = []
    for bit in range(32):
        x = 1 << bit
        for _ in range(8):
            x = (x >> 1) ^ (CRC_POLYNOMIAL if x & 1 else 0)
        rows.append(x)
    return np.array(rows, np.uint32)


def _times(matrix: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The image of every register in ``x`` (uint32)."""
    out = np.zeros(len(x), np.uint32)
    for bit in range(32):
        out ^= np.where((x >> np.uint32(bit)) & np.uint32(1), matrix[bit], np.uint32(0))
    return out


_STEPS = [_advance_one_byte()]  # over 1, 2, 4, ... zero bytes
while len(_STEPS) < 32:
    _STEPS.append(_times(_STEPS[-1], _STEPS[-1]))


def compose(crc_a: np.ndarray, crc_b: np.ndarray, len_b: np.ndarray) -> np.ndarray:
    """CRC-32 of the concatenations a + b from the parts' CRCs and the lengths of b in bytes."""
    out = crc_a.astype(np.uint32)
    for k, step in enumerate(_STEPS):
        move = (len_b >> k) & 1 == 1
        if move.any():
            out[move] = _times(step, out[move])
        elif not (len_b >> k).any():
            break
    return out ^ crc_b.astype(np.uint32)


SPACE_CRC = zlib.crc32(b" ")


class Dictionary:
    """Automaton over the delimiter-bounded distinct words of some normalised texts."""

    def __init__(self, texts: list[str]):
        self.marks: dict[str, str] = {}
        self.texts = [self._bounded(t) for t in texts]
        words = {w for t in self.texts for w in t.split(" ")}
        words.discard("")
        real = {mark: word for word, mark in self.marks.items()}
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for w in words:
            data = real.get(w, w).encode()
            self.machine.add_word(f" {w} ", len(data) << 32 | zlib.crc32(data))
        if words:
            self.machine.make_automaton()

    def _bounded(self, text: str) -> str:
        """The text with a delimiter at both ends and each very long word as a mark of its own."""
        if LONG_WORD.search(text):
            text = LONG_WORD.sub(lambda m: self.marks.setdefault(m.group(), f"\x01{len(self.marks)}"), text)
        return f" {text} "

    def scan(self, i: int) -> np.ndarray:
        """Payloads (byte length << 32 | CRC) of the words of text ``i``, in order."""
        if not len(self.machine):
            return np.empty(0, np.int64)
        return np.array([payload for _, payload in self.machine.iter(self.texts[i])], np.int64)


def _kind(buckets: int) -> type:
    return np.uint16 if buckets <= 1 << 16 else np.uint32


def pieces(text: str, size: int) -> Iterator[str]:
    """Parts of a normalised text of about ``size`` characters, cut at delimiters."""
    at = 0
    while len(text) - at > size:
        end = text.find(" ", at + size)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:]


def features(payloads: np.ndarray, max_n: int, buckets: int, fresh: int) -> np.ndarray:
    """Buckets of all runs of 1 to ``max_n`` words that end at or after payload ``fresh``."""
    crc = (payloads & 0xFFFFFFFF).astype(np.uint32)
    size = payloads >> 32
    out, run, run_size = [], crc, size
    for n in range(1, max_n + 1):
        if n > 1:  # a word before the run of n - 1 words that starts at the next place
            space = compose(np.full(len(run) - 1, SPACE_CRC, np.uint32), run[1:], run_size[1:])
            run = compose(crc[:len(run) - 1], space, run_size[1:] + 1)
            run_size = size[:len(run)] + 1 + run_size[1:]
        out.append(run[max(0, fresh - n + 1):])
        if len(run) <= 1:
            break
    return np.concatenate(out).astype(np.int64) % buckets


def blocks(texts: Iterable[str | None], size: int) -> Iterator[tuple[list[int], list[str]]]:
    """(document numbers, normalised pieces): pieces in order, about ``size`` characters at a time."""
    of, held, room = [], [], size
    for i, text in enumerate(texts):
        for piece in pieces((text or "").translate(NORMAL), size):
            of.append(i)
            held.append(piece)
            room -= len(piece)
            if room <= 0:
                yield of, held
                of, held, room = [], [], size
    if held:
        yield of, held


def bucket_lists(texts: Iterable[str | None], n: int, max_n: int, buckets: int,
                 size: int = BLOCK) -> list[tuple[int, np.ndarray]]:
    """(number of words, buckets of all features) of each of the ``n`` texts."""
    kind = _kind(buckets)
    words, found = [0] * n, [[] for _ in range(n)]
    doc, tail = -1, np.empty(0, np.int64)
    for of, held in blocks(texts, size):
        dictionary = Dictionary(held)
        for k, i in enumerate(of):
            if i != doc:
                doc, tail = i, np.empty(0, np.int64)
            emitted = dictionary.scan(k)
            if len(emitted):
                words[i] += len(emitted)
                line = np.concatenate([tail, emitted])
                found[i].append(features(line, max_n, buckets, len(tail)).astype(kind))
                tail = line[max(0, len(line) - max_n + 1):] if max_n > 1 else tail
    return [(k, np.concatenate(f) if f else np.empty(0, kind)) for k, f in zip(words, found)]


LISTS = "doc_id long, n_words long, n_features long, buckets binary"


def _lister(max_n: int, buckets: int):
    def run(batches):
        for batch in batches:
            lists = bucket_lists((t.as_py() for t in batch.column("text")), batch.num_rows, max_n, buckets)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([k for k, _ in lists], pa.int64()),
                 pa.array([len(f) for _, f in lists], pa.int64()), pa.array([f.tobytes() for _, f in lists], pa.binary())],
                ["doc_id", "n_words", "n_features", "buckets"])

    return run


def _counter(buckets: int):
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for data in batch.column("buckets"):
                total += np.bincount(np.frombuffer(data.as_buffer() or b"", _kind(buckets)), minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["bucket", "n"])

    return run


def hashed(docs: DataFrame, max_n: int, buckets: int) -> DataFrame:
    """(doc_id, n_words, n_features, buckets) of every row's whole text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_lister(max_n, buckets), LISTS)


def counts(lists: DataFrame, buckets: int) -> np.ndarray:
    """Features per bucket over all rows: one row a bucket and task is shuffled, ``buckets`` rows reach the driver."""
    part = lists.select("buckets").mapInArrow(_counter(buckets), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in part.groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of smoothed shares) per bucket, target over corpus."""
    width = len(corpus)
    s_all, t_all = int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((int(t) + 1.0) * (s_all + width) / ((int(s) + 1.0) * (t_all + width))))
                     for s, t in zip(corpus, target)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """The document's Gumbel noise in thousandths, from a digest of its id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


SCORED = "doc_id long, n_words long, n_features long, weight long, score long"


def _scorer(gain: np.ndarray, buckets: int, seed: int):
    def run(batches):
        for batch in batches:
            weight = np.array([gain[np.frombuffer(d.as_buffer() or b"", _kind(buckets))].sum() for d in batch.column("buckets")],
                              np.int64)
            extra = np.array([noise(d, seed) for d in batch.column("doc_id").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "n_words", "n_features")), pa.array(weight), pa.array(weight + extra)],
                ["doc_id", "n_words", "n_features", "weight", "score"])

    return run


def resample(docs: DataFrame, target: DataFrame, share: float = 0.1, max_n: int = 1, buckets: int = 10_000,
             min_words: int = 20, seed: int = 2024) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_features, weight, score and, if it is drawn, its rank.

    floor(share * N) of the N rows of at least ``min_words`` words are drawn,
    highest scores first.
    """
    scratch = Scratch(docs.sparkSession, "resampling")
    try:
        lists = scratch.write(hashed(docs, max_n, buckets), "lists")
        aim = target.select(F.lit(None).cast("long").alias("doc_id"), "text")
        gain = gains(counts(lists, buckets), counts(hashed(aim, max_n, buckets), buckets))
        scored = scratch.write(lists.mapInArrow(_scorer(gain, buckets, seed), SCORED), "scored")
        long_enough = scored.where(F.col("n_words") >= min_words)
        drawn = math.floor(round(share * 1_000_000) * long_enough.count() / 1_000_000)
        ranked = positions(long_enough, [], ["-score", "doc_id", "n_features", "weight"], rank_col="rank", store=False)
        ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
        rest = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
        return scratch.finish(ranked.unionByName(rest))
    except BaseException:
        scratch.remove()
        raise


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return docs.select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 by a table that the statement builds itself, once per distinct word.
ORACLE = f"""
WITH crc_table AS (
  SELECT list(list_reduce(list_prepend(i, [0,1,2,3,4,5,6,7]), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x >> 1, {CRC_POLYNOMIAL})
    ELSE x >> 1 END) ORDER BY i) AS crcs FROM range(256) r(i)),
docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), {{word}}) AS words
  FROM documents),
aims AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), {{word}})) AS word FROM benchmark),
of_docs AS MATERIALIZED (SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM docs) GROUP BY word),
of_aims AS MATERIALIZED (SELECT word, count(*) AS n FROM aims GROUP BY word),
vocabulary AS (SELECT word FROM of_docs UNION SELECT word FROM of_aims),
bytes AS (
  SELECT word, hex(encode(word)) AS digits FROM vocabulary),
bucketed AS MATERIALIZED (
  SELECT word, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, strlen(digits), 2),
    lambda i: CAST(('0x' || substr(digits, i, 2)) AS BIGINT))),
    lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM bytes, crc_table),
filled AS (
  SELECT bucket, sum(coalesce(d.n, 0)) AS s, sum(coalesce(a.n, 0)) AS t
  FROM bucketed LEFT JOIN of_docs d USING (word) LEFT JOIN of_aims a USING (word) GROUP BY bucket),
totals AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM filled),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1.0::DOUBLE) * (s_all + 10000) / ((s + 1.0::DOUBLE) * (t_all + 10000)))) AS BIGINT) AS g
  FROM filled, totals),
weights AS (
  SELECT r, sum(g) AS weight FROM (SELECT r, unnest(words) AS word FROM docs) JOIN bucketed USING (word) JOIN gain USING (bucket)
  GROUP BY r),
scored AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)
      AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM docs LEFT JOIN weights USING (r)),
placed AS (
  SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20
    ORDER BY score DESC, doc_id NULLS FIRST, n_features, weight) END AS place,
    count(*) FILTER (n_features >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM placed""".replace(
    "{word}", r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'")
