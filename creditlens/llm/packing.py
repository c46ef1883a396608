"""Operator 10 - mixture-controlled packing by deficit round-robin.

Documents become token ids once (a stored table).  A hash deals them to
partitions; a source's queue is its documents partition by partition.  The
queues are served by tokens, not by whole documents: every window takes of each
source its target share of the window, and what rounding left over or took too
much is carried to the next window.  Token x of a queue is due at
(x + 0.5) / target, so how many tokens of each queue lie before a window has a
closed form, and prefix sums over (partition, source) totals give each document
its place in its queue: a partition finds windows and offsets of its own
documents without the others, and only the very last window can be short.
Documents are cut where their source's part of a window ends.

Targets are given by source, or are the sources' shares of all tokens.  Every
token is packed: with given targets a source that has run out leaves its part to
the others, in proportion to their targets.  The totals of the sources, a number
each, are held by the driver and every task.

Defined results: a null text is empty and has the end id alone; a null source
is a queue of its own; repeated rows are packed each; ties follow the row's
place in its file; a very long text is tokenised whole and cut over as many
windows as it needs; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from creditlens.llm.common import Scratch, cleaned, located, table

WINDOW = 2048
CACHED_WORDS, CACHED_PIECES = 350_000, 350_000  # in each of two halves


#: Words of Latin letters with marks behind: one lower-cased piece of letters, one of marks.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")


class WordEncoder:
    """Token ids of texts, encoded word by word.

    Holds for tokenizers whose pieces never cross ASCII white space and that
    drop it (as word_bpe_49k.json).  Plain words skip the tokenizer's
    normaliser and splitter and give their pieces to its model at once; that
    is used only if both ways agree on probes of every letter and mark.  The
    ids of words and pieces are remembered up to a bound: a full half becomes
    the old one, and what is not used again goes with the next old half.
    """

    def __init__(self, path: str, cached: tuple[int, int] | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.most_words, self.most_pieces = cached or (CACHED_WORDS, CACHED_PIECES)
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.old_words, self.old_pieces = {}, {}
        letters = [chr(c) for c in range(0x41, 0x100) if PLAIN.fullmatch(chr(c))]
        marks = [chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum()]
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.mapped = {ord(x): level.pre_tokenize_str(x)[0][0] for x in letters if not x.isascii()}
        probes = [x * n + y for x in letters for n in (1, 3) for y in ("", "ab", "Z!")] + ["Ab" + m + "," for m in marks]
        self.skip = True
        self.skip = all(self._plain(w) == self._whole(w) for w in probes)

    def _whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, self.type).tobytes()

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            if len(self.pieces) >= self.most_pieces:
                self.old_pieces, self.pieces = self.pieces, {}
            ids = self.old_pieces.get(piece)
            if ids is None:
                found = self.tokenizer.model.tokenize(piece.translate(self.mapped))
                ids = np.array([t.id for t in found], self.type).tobytes()
            self.pieces[piece] = ids
        return ids

    def _plain(self, word: str) -> bytes | None:
        parts = PLAIN.fullmatch(word)
        if parts is None:
            return None
        letters, marks = parts.groups()
        return self._piece(letters.lower()) + (self._piece(marks) if marks else b"")

    def encode(self, word: bytes) -> bytes:
        text = word.decode()
        ids = self._plain(text) if self.skip else None
        return self._whole(text) if ids is None else ids

    def ids(self, texts: list[bytes | None], end_id: int) -> list[bytes]:
        end, out = np.array([end_id], self.type).tobytes(), []
        for text in texts:
            words = (text or b"").split()
            missing = set(words).difference(self.words)
            if missing:
                if len(self.words) >= self.most_words:
                    self.old_words, self.words = self.words, {}
                    missing = set(words)
                for w in missing:
                    known = self.old_words.get(w)
                    self.words[w] = self.encode(w) if known is None else known
            out.append(b"".join(map(self.words.__getitem__, words)) + end)
        return out


_ENCODERS: dict[tuple, WordEncoder] = {}  # one per Python worker


def encoder(path: str, cached: tuple[int, int] | None = None) -> WordEncoder:
    if (path, cached) not in _ENCODERS:
        _ENCODERS[path, cached] = WordEncoder(path, cached)
    return _ENCODERS[path, cached]


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, cached: tuple[int, int] | None = None) -> DataFrame:
    """``docs`` with ``text`` replaced by (n, ids): the token ids with the end id, as little-endian integers."""
    keep = [c for c in docs.columns if c != "text"]
    schema = ", ".join(f"{c} {t}" for c, t in docs.dtypes if c != "text") + ", n long, ids binary"

    def encode(batches):
        code = encoder(tokenizer, cached)
        for batch in batches:
            step = 256  # a few documents' ids at a time
            for k in range(0, batch.num_rows, step):
                b = batch.slice(k, step)
                ids = code.ids(b.column("text").cast(pa.binary()).to_pylist(), end_id)
                n = pa.array([len(x) // code.type.itemsize for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), n, pa.array(ids, pa.binary())],
                                                 [*keep, "n", "ids"])

    return docs.mapInArrow(encode, schema)


def filled(totals: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(due, places): the times at which queues run out, and how long the stream is by then."""
    ends = totals / targets
    order = np.argsort(ends, kind="stable")
    others = np.maximum(targets.sum() - np.cumsum(targets[order]), 0)
    places = np.cumsum(totals[order]) + ends[order] * others
    places[-1:] = totals.sum()
    return np.concatenate([[0.0], ends[order]]), np.concatenate([[0.0], np.maximum.accumulate(places)])


def served_before(places: np.ndarray, totals: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """How many tokens of each queue lie before the given places of the stream: a row per place.

    The stream holds all tokens by the time they are due; of equal times the
    queue in front goes first.
    """
    due, ends = filled(totals, targets)
    x = np.clip(np.floor(np.interp(places, ends, due)[:, None] * targets + 0.5), 0, totals).astype(np.int64)
    while True:  # rounding leaves a row at most half as many tokens off as there are queues
        over = x.sum(axis=1) - places
        many, few = np.flatnonzero(over > 0), np.flatnonzero(over < 0)
        if not len(many) and not len(few):
            return x
        last = np.where(x[many] > 0, (x[many] - 0.5) / targets, -np.inf)
        x[many, len(totals) - 1 - last[:, ::-1].argmax(axis=1)] -= 1
        x[few, np.where(x[few] < totals, (x[few] + 0.5) / targets, np.inf).argmin(axis=1)] += 1


def cuts(queue: np.ndarray, lengths: np.ndarray, had: np.ndarray, totals: np.ndarray, targets: np.ndarray,
         window: int) -> list[tuple[np.ndarray, ...]]:
    """(document, start, length, window, offset) of the pieces of documents given queue by queue.

    ``had`` tells how many tokens of each queue lie before these documents.
    """
    due, ends = filled(totals, targets)
    total, slack, spans = int(totals.sum()), len(totals) + 1, []
    for q in np.unique(queue).tolist():
        docs = np.flatnonzero(queue == q)
        starts = had[q] + np.cumsum(lengths[docs]) - lengths[docs]
        end = int(starts[-1] + lengths[docs[-1]])
        first, last = np.interp([starts[0] / targets[q], end / targets[q]], due, ends)
        spans.append((q, docs, starts, end, max(0, int((first - slack) // window)), int((last + slack) // window) + 1))
    if not spans:
        return []
    rows = np.unique(np.concatenate([np.arange(a, b + 1) for *_, a, b in spans]))
    x = served_before(np.minimum(rows * window, total), totals, targets)
    out = []
    for q, docs, starts, end, a, b in spans:
        at = np.searchsorted(rows, a)
        before = x[at:at + b - a + 1]
        bounds, taken = before[:, q], np.diff(before[:, :q].sum(axis=1))  # taken: what queues in front have of each window
        cut = np.union1d(starts, bounds[(bounds > starts[0]) & (bounds < end)])
        doc, k = np.searchsorted(starts, cut, "right") - 1, np.searchsorted(bounds, cut, "right") - 1
        out.append((docs[doc], cut - starts[doc], np.diff(cut, append=end), a + k, taken[k] + cut - bounds[k]))
    return out


@cleaned
def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = 1,
         partition_tokens: int = 2_000_000, targets: dict[str | None, float] | None = None,
         cached: tuple[int, int] | None = None) -> DataFrame:
    """One row per piece: doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``targets`` gives each source its part of a window (any positive numbers).
    ``cached`` bounds the words and pieces a worker remembers, in each of two
    halves: fewer take less memory and more time, with the same result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing", batch=1000)
    rows = located(docs, scratch, F.col("doc_id").cast("long").alias("doc_id"),
                   F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("draw", F.xxhash64("doc_id", "row")).drop("file")
    tokens = scratch.write(tokenized(rows, tokenizer, end_id, cached), "tokens")
    total = tokens.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-total // partition_tokens))
    queue = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))  # a null source differs from every name
    dealt = tokens.withColumns({"part": F.expr(f"pmod(draw, {parts}L)"), "queue": queue})

    # totals per (partition, source), and what of each source lies before a partition
    sums = scratch.write(dealt.groupBy("part", "queue").agg(F.sum("n").alias("n")), "sums")
    by_queue = sorted((r["queue"], r["n"]) for r in sums.groupBy("queue").agg(F.sum("n").alias("n")).collect())
    number = {name: i for i, (name, _) in enumerate(by_queue)}
    totals = np.array([n for _, n in by_queue], np.int64)
    weights = totals.astype(float)
    if targets is not None:
        given = {"" if source is None else "=" + source: float(share) for source, share in targets.items()}
        weights = np.array([given.get(name, 0.0) for name in number])
        if not (np.isfinite(weights) & (weights > 0)).all():
            raise ValueError("every source needs a positive target")
    own = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select("part", "queue", F.coalesce(F.sum("n").over(own), F.lit(0)).alias("had"))

    def fill(d: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        had = np.zeros(len(totals), np.int64)
        had[c["queue"].map(number).to_numpy()] = c["had"].to_numpy()
        d = d.assign(q=d["queue"].map(number)).sort_values(["q", "draw", "row", "doc_id"], ignore_index=True)
        n, ids, crcs, last = d["n"].to_numpy(), d["ids"].tolist(), [], None
        pieces = cuts(d["q"].to_numpy(), n, had, totals, weights, window)
        i, start, length, k, offset = map(np.concatenate, zip(*pieces)) if pieces else [np.zeros(0, np.int64)] * 5
        for x, first, end in zip(i.tolist(), start.tolist(), (start + length).tolist()):
            if x != last:  # a document's pieces follow each other
                last, whole = x, np.frombuffer(ids[x], "<u2" if len(ids[x]) == 2 * n[x] else "<u4").astype("<u4")
            crcs.append(zlib.crc32(whole[first:end]))
        return pd.DataFrame({
            "doc_id": d["doc_id"].astype("Int64").array[i], "source": d["source"].to_numpy()[i], "start": start,
            "length": length, "ids_crc32": np.array(crcs, np.int64), "doc_tokens": n[i], "sequence_id": k, "offset": offset})

    pieces = dealt.groupBy("part").cogroup(carry.groupBy("part")).applyInPandas(
        fill, "doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
              "offset long")
    return scratch.finish(pieces, raw=True)


def vocabulary() -> str:
    """Where the public word vocabulary lies; the operator takes any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary()).drop("source")
