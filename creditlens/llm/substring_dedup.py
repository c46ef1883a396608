"""Operator 13 - removal of repeated passages with sharded phrase automata.

A phrase is a run of ``window`` words; a word goes if a phrase that covers it
also starts in a row with a smaller doc_id.

1. *Suspects.*  Every phrase has an anchor, the smallest hash of its runs of
   ``anchor`` words.  Equal phrases have equal anchors, and neighbouring
   phrases mostly share theirs, so there are about 2 / (window - anchor + 2)
   anchors a word.  Rows are cut into blocks of ``BLOCK_ROWS`` neighbours;
   each block sends its distinct anchors to shards (ranges of hashes), which
   return those found in two rows or more.
2. *Confirmed phrases.*  Only phrases with such an anchor are sent on, as 96
   bits of hash and the smallest id of the block's rows that hold them.  Their
   shards return, for every phrase found in rows of different ids, its
   smallest id.
3. *Automata.*  The passages of a block are the maximal runs of its confirmed
   phrases.  Every block compiles its distinct passages into Aho-Corasick
   automata (pyahocorasick) of about ``PASSAGE_WORDS`` words each, a word being
   two characters, and streams all its documents through them.  A match yields
   for each phrase of the passage the smallest id that holds it, and phrases
   that belong to a larger id are cut.

A block only ever meets passages of its own texts, so no task holds the
phrases of the corpus, and the work grows with the input.  A phrase held by a
third of all rows costs each block that has it one hash.

Defined results: a null or empty text has no words and keeps the empty text;
a text shorter than a window keeps all; a null id is larger than any other, and
rows that repeat an id (or have none) take nothing from each other; phrases
repeated within one row alone stay; a very long text is one row of its block and is
read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditlens.llm.common import Scratch, located, table
from creditlens.llm.near_dedup import mixed

WINDOW, ANCHOR = 13, 7
BLOCK_ROWS, PASSAGE_WORDS = 512, 200_000
SHARD_BYTES = 16_000_000  # of text per range of hashes
GOLDEN, OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
NO_ID = np.iinfo(np.int64).max


class Words:
    """The words of some texts in one row: their numbers, 64-bit hashes, and the text each belongs to."""

    def __init__(self, texts: list[bytes | None]):
        self.lists = [(t or b"").split() for t in texts]
        self.sizes = np.fromiter(map(len, self.lists), np.int64, len(self.lists))
        self.first = np.cumsum(self.sizes) - self.sizes
        words = [w for x in self.lists for w in x]
        numbers = dict.fromkeys(words)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, numbers), np.uint64, len(numbers))
        for i, w in enumerate(numbers):
            numbers[w] = i
        self.tokens = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
        self.hashes = hashes[self.tokens]

    def starts(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the phrases of ``window`` words start that lie within one text, and those texts."""
        n = np.maximum(self.sizes - window + 1, 0)
        text = np.repeat(np.arange(len(n)), n)
        return np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n) + self.first[text], text


def run_hashes(h: np.ndarray, size: int, starts: np.ndarray | None = None, factor: np.uint64 = GOLDEN) -> np.ndarray:
    """Hashes of the runs of ``size`` words, all of them or those that begin at ``starts``."""
    n = max(0, len(h) - size + 1)
    out = np.full(n if starts is None else len(starts), size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out *= factor
            out += h[k:n + k] if starts is None else h[starts + k]
    return mixed(out)


def anchors(h: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """The anchor of the phrase that starts at each word."""
    grams = run_hashes(h, anchor)
    n = max(0, len(h) - window + 1)
    out = grams[:n].copy()
    for k in range(1, window - anchor + 1):
        np.minimum(out, grams[k:n + k], out=out)
    return out


def among(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of ``x`` are among the sorted, non-empty ``keys``."""
    return keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x


def _shards(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(shard, from, to) of sorted hashes, the shard being their first ``bits`` bits."""
    shard = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(keys)]
    return ((int(shard[a]), a, b) for a, b in zip(cuts, cuts[1:]) if a < b)


def _array(data: pa.Scalar, kind: type) -> np.ndarray:
    return np.frombuffer(data.as_buffer(), kind)


def _planes(x: np.ndarray) -> bytes:
    """Ids byte plane by byte plane, so that their high bytes compress away."""
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _ids(data: pa.Scalar) -> np.ndarray:
    return np.ascontiguousarray(_array(data, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    fields = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


SUSPECT = "shard long, block long, keys binary"


def _ask_anchors(window: int, anchor: int, bits: int):
    def cells(block: int, texts: list[bytes | None]) -> pa.RecordBatch:
        words = Words(texts)
        starts, of = words.starts(window)
        keys = anchors(words.hashes, window, anchor)[starts]
        new = np.ones(len(keys), bool)  # neighbours mostly share their anchor
        new[1:] = (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])
        keys, of = keys[new], of[new]
        order = np.lexsort((of, keys))
        keys, of = keys[order], of[order]
        if len(keys):
            keys = keys[np.concatenate([[True], (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])])]
        if len(keys) > 2:  # twice if in two rows or more
            keys = keys[np.concatenate([[True, True], keys[2:] != keys[:-2]])]
        return _batch([(s, block, keys[a:b].tobytes()) for s, a, b in _shards(keys, bits)], SUSPECT)

    def run(batches):
        block, held = None, []
        for batch in batches:
            for of, text in zip(batch.column("block").to_pylist(), batch.column("text").cast(pa.binary())):
                if of != block and held:
                    yield cells(block, held)
                    held = []
                block = of
                held.append(text.as_py())
        if held:
            yield cells(block, held)

    return run


REPLY = "block long, keys binary"


def _recurring_anchors(t: pa.Table) -> pa.Table:
    """For each block the anchors of one shard that two rows or more hold."""
    cells = [_array(x, np.uint64) for x in t.column("keys")]
    every = np.sort(np.concatenate(cells))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    held = (np.unique(c[among(c, twice)]) if len(twice) else twice for c in cells)
    return pa.Table.from_batches([_batch([(b, k.tobytes()) for b, k in zip(t.column("block").to_pylist(), held) if len(k)], REPLY)])


PACK = "block long, rows binary"


def _packer(batches):
    """Rows of a block as one compressed Arrow stream: texts shrink to a third before they are shuffled."""
    for batch in batches:
        block = batch.column("block").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(batch.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([pa.array([block[a]], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                                                 ["block", "rows"])


def _rows_of(packs: pa.Table) -> tuple[pa.Table, np.ndarray, Words]:
    """A block's rows in the order of the file, their ids and words."""
    t = pa.concat_tables(pa.ipc.open_stream(x.as_buffer()).read_all() for x in packs.column("rows"))
    t = t.sort_by([("file", "ascending"), ("row", "ascending")])
    ids = np.array([NO_ID if d is None else d for d in t.column("doc_id").to_pylist()], np.int64)
    return t, ids, Words(t.column("text").cast(pa.binary()).to_pylist())


def _phrases(h: np.ndarray, window: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of hash of the phrases that start there: 64 as key, 32 as check."""
    return run_hashes(h, window, starts), (run_hashes(h, window, starts, OTHER) >> np.uint64(32)).astype(np.uint32)


PHRASE = "shard long, block long, keys binary, checks binary, ids binary"


def _ask_phrases(window: int, anchor: int, bits: int):
    def run(t: pa.Table, replies: pa.Table) -> pa.Table:
        if not t.num_rows or not replies.num_rows:
            return pa.Table.from_batches([_batch([], PHRASE)])
        recurring = np.unique(np.concatenate([_array(x, np.uint64) for x in replies.column("keys")]))
        t, ids, words = _rows_of(t)
        starts, text = words.starts(window)
        use = among(anchors(words.hashes, window, anchor)[starts], recurring)
        key, check = _phrases(words.hashes, window, starts[use])
        owner = ids[text[use]]
        order = np.lexsort((owner, check, key))
        key, check, owner = key[order], check[order], owner[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1])
        # the smallest id of each phrase, and the largest where it differs (the phrase is then listed twice)
        last = np.append(new[1:], True) if len(new) else new
        kept = new | (last & (owner != owner[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]))
        key, check, owner, of = key[kept], check[kept], owner[kept], t.column("block")[0].as_py()
        return pa.Table.from_batches([_batch(
            [(s, of, key[a:b].tobytes(), check[a:b].tobytes(), _planes(owner[a:b])) for s, a, b in _shards(key, bits)], PHRASE)])

    return run


CONFIRMED = "block long, keys binary, checks binary, ids binary"


def _confirmed_phrases(t: pa.Table) -> pa.Table:
    """For each block the phrases of one shard that rows of different ids hold, with the smallest id."""
    cells = [(_array(k, np.uint64), _array(c, np.uint32), _ids(i)) for k, c, i in zip(*(t.column(x) for x in ("keys", "checks", "ids")))]
    key, check, ids = (np.concatenate(x) for x in zip(*cells))
    order = np.lexsort((ids, check, key))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(key[order]) != 0) | (check[order][1:] != check[order][:-1])
    number = np.cumsum(new) - 1
    first, last = ids[order][new], ids[order][np.append(np.flatnonzero(new)[1:], len(order)) - 1]
    of = np.empty(len(order), np.int64)
    of[order] = number
    out, at = [], 0
    for block, (k, c, _) in zip(t.column("block").to_pylist(), cells):
        mine = of[at:at + len(k)]
        at += len(k)
        use = (first != last)[mine] & np.append(True, mine[1:] != mine[:-1])
        if use.any():
            out.append((block, k[use].tobytes(), c[use].tobytes(), _planes(first[mine[use]])))
    return pa.Table.from_batches([_batch(out, CONFIRMED)])


class PassageAutomata:
    """Automata over distinct passages, about ``size`` words each; words are two characters of disjoint alphabets."""

    def __init__(self, tokens: np.ndarray, passages: list[tuple[int, int]], ids: np.ndarray, window: int, size: int):
        """``passages`` are (from, to) places of words; ``ids`` has the smallest id of the phrase that starts at each place."""
        self.window, self.ids, self.shards = window, ids, []
        seen, at = set(), 0
        while at < len(passages):
            held, room = [], size
            while at < len(passages) and room > 0:
                a, b = passages[at]
                key = tokens[a:b].tobytes()
                if key not in seen:
                    seen.add(key)
                    held.append((a, b))
                    room -= b - a
                at += 1
            if held:
                self._compile(tokens, held)

    def _compile(self, tokens: np.ndarray, held: list[tuple[int, int]]) -> None:
        known = np.unique(np.concatenate([tokens[a:b] for a, b in held]))
        machine = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        base = int(len(known) ** 0.5) + 1  # a state's arcs are searched one by one: few letters, short searches
        for a, b in held:
            machine.add_word(self._text(tokens[a:b], known, base), (a, b))
        machine.make_automaton()
        self.shards.append((known, base, machine))

    @staticmethod
    def _text(tokens: np.ndarray, known: np.ndarray, base: int) -> str:
        at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
        letters = np.zeros((len(tokens), 2), "<u4")  # letter 0 is in no passage
        mine = known[at] == tokens
        letters[mine, 0] = 0x10000 + at[mine] // base
        letters[mine, 1] = 0x10000 + base + at[mine] % base
        return letters.tobytes().decode("utf-32-le")

    def removed(self, tokens: np.ndarray, own: int) -> np.ndarray:
        """Which words of a document lie in a phrase that a smaller id holds."""
        cover = np.zeros(len(tokens) + 1, np.int64)
        for known, base, machine in self.shards:
            before = upto = -1  # start of the last match, and the first phrase after it
            for end, (a, b) in machine.iter(self._text(tokens, known, base)):
                begin, stop = (end + 1) // 2 - (b - a), (end + 1) // 2 - self.window + 1
                # a phrase has the same smallest id in every passage, so those of the last match are done
                start = max(begin, upto) if begin >= before else begin
                if start < stop:
                    cut = start + np.flatnonzero(self.ids[a + start - begin:b - self.window + 1] < own)
                    cover[cut] += 1
                    cover[cut + self.window] -= 1
                    before, upto = begin, stop
        return np.cumsum(cover[:-1]) > 0


OUT = "doc_id long, n_words long, n_removed long, starts array<int>, stops array<int>, kept_sha256 string"


def _compiled(words: Words, confirmed: pa.Table, window: int, size: int) -> PassageAutomata | None:
    """Automata of the passages of a block, from its words and the confirmed phrases (key, check, smallest id)."""
    key, check, smallest = (np.concatenate([f(x) for x in confirmed.column(c)]) for c, f in (
        ("keys", lambda x: _array(x, np.uint64)), ("checks", lambda x: _array(x, np.uint32)), ("ids", _ids)))
    order = np.lexsort((check, key))
    key, check, smallest = key[order], check[order], smallest[order]
    starts, text = words.starts(window)
    use = among(run_hashes(words.hashes, window)[starts], key)
    starts, text = starts[use], text[use]
    k, c = _phrases(words.hashes, window, starts)
    place = np.searchsorted(key, k)
    while True:  # phrases of equal keys lie next to each other, ordered by check
        near = np.minimum(place, len(key) - 1)
        step = (key[near] == k) & (check[near] < c) & (place < len(key))
        if not step.any():
            break
        place = place + step
    exact = (key[near] == k) & (check[near] == c)
    starts, text, near = starts[exact], text[exact], near[exact]
    if not len(starts):
        return None
    ids = np.full(len(words.tokens), NO_ID, np.int64)
    ids[starts] = smallest[near]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(starts) != 1) | (np.diff(text) != 0)]))
    last = np.append(new[1:], len(starts)) - 1
    passages = list(zip(starts[new].tolist(), (starts[last] + window).tolist()))
    return PassageAutomata(words.tokens, passages, ids, window, size)


def _remover(window: int, size: int, with_text: bool):
    def run(t: pa.Table, confirmed: pa.Table) -> pa.Table:
        t, ids, words = _rows_of(t)
        machine = _compiled(words, confirmed, window, size) if confirmed.num_rows else None
        cols, kept = [[], [], [], [], []], []
        for own, of, a in zip(ids.tolist(), words.lists, words.first.tolist()):
            gone = machine.removed(words.tokens[a:a + len(of)], own) if machine else np.zeros(len(of), bool)
            edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
            left = b" ".join(w for w, x in zip(of, gone.tolist()) if not x) if len(edges) else b" ".join(of)
            for c, v in zip(cols, (len(of), int(gone.sum()), edges[::2].tolist(), edges[1::2].tolist(),
                                   hashlib.sha256(left).hexdigest())):
                c.append(v)
            if with_text:
                kept.append(left.decode())
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string())
        arrays = [t.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))] + ([pa.array(kept, pa.string())] if with_text else [])
        return pa.table(arrays, [c.split()[0] for c in OUT.split(", ")] + (["kept"] if with_text else []))

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, with_text: bool = False,
                   block_rows: int = BLOCK_ROWS, passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """One row per row: doc_id, n_words, n_removed, the removed runs of words (starts, stops) and kept_sha256.

    ``with_text`` adds ``kept``, the words that stay, joined by one space.
    """
    scratch = Scratch(docs.sparkSession, "substring-dedup")
    try:
        rows = located(docs, scratch, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = max(0, (size // SHARD_BYTES).bit_length())
        rows = rows.withColumn("block", F.expr(f"xxhash64(file, row div {block_rows}L)"))

        asked = rows.select("block", "text").mapInArrow(_ask_anchors(window, anchor, bits), SUSPECT)
        recurring = scratch.write(asked.groupBy("shard").applyInArrow(_recurring_anchors, REPLY), "anchors")
        by_block = rows.mapInArrow(_packer, PACK).groupBy("block")
        suspects = by_block.cogroup(recurring.groupBy("block")).applyInArrow(_ask_phrases(window, anchor, bits), PHRASE)
        confirmed = scratch.write(suspects.groupBy("shard").applyInArrow(_confirmed_phrases, CONFIRMED), "phrases")
        out = by_block.cogroup(confirmed.groupBy("block")).applyInArrow(
            _remover(window, passage_words, with_text), OUT + (", kept string" if with_text else ""))
        return scratch.finish(out)
    except BaseException:
        scratch.remove()
        raise


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
