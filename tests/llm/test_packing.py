import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from creditlens.llm import packing as op

PATH = op.vocabulary()


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="aÉéßİΣσẞ'sтж日 \t\n\r\x0b\x0c\x1c\x85 ​　̧́<|>1२!*#.", max_size=40), max_size=4))
def test_words_give_the_whole_texts_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    got = op.encoder(PATH).ids([x.encode() for x in texts], 1)
    for x, b in zip(texts, got):
        assert np.frombuffer(b, "<u2").tolist() == t.encode(x, add_special_tokens=False).ids + [1]


def test_special_strings_and_cache_bound(whole, monkeypatch):
    monkeypatch.setattr(op, "CACHED_WORDS", 3)
    code = op.WordEncoder(PATH)
    texts = ["x<|endoftext|>y <|startoftext|>", "a b c d e f", "g a b h", "", None]
    got = code.ids([t and t.encode() for t in texts], 1)
    assert [np.frombuffer(b, "<u2").tolist() for b in got] == [
        whole.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]


def test_common_words_outlive_a_full_cache(monkeypatch):
    monkeypatch.setattr(op, "CACHED_WORDS", 4)
    monkeypatch.setattr(op, "CACHED_PIECES", 4, raising=False)
    code, encoded = op.WordEncoder(PATH), []
    whole_word = code.encode
    code.encode = lambda word: encoded.append(word) or whole_word(word)
    plain = op.WordEncoder(PATH)
    for k in range(40):
        text = b"the %s of" % bytes([97 + k % 26, 97 + k // 26])
        assert code.ids([text], 1) == plain.ids([text], 1)
    assert encoded.count(b"the") == encoded.count(b"of") == 1
    assert max(map(len, (code.words, code.old_words, code.pieces, code.old_pieces))) <= 7


def check(rows, docs, whole, window):
    ids = {d.doc_id: whole.encode(d.text or "", add_special_tokens=False).ids + [1] for d in docs}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id]) and 0 < r.length
        part = np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4")
        assert r.ids_crc32 == zlib.crc32(part.tobytes())
        by_doc[r.doc_id].append((r.start, r.length))
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert by_doc.keys() == ids.keys()
    for x, pieces in by_doc.items():
        at = 0
        for s, n in sorted(pieces):
            assert s == at
            at += n
        assert at == len(ids[x])
    last = max(by_seq, default=-1)
    for k, pieces in by_seq.items():
        at = 0
        for s, n in sorted(pieces):
            assert s == at
            at += n
        assert at == window or (k == last and at < window)
    assert sorted(by_seq) == list(range(last + 1))


@pytest.mark.parametrize("partition_tokens", [2_000_000, 9_000])
def test_whole_table(spark, sf_dir, whole, partition_tokens):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(op.pack(docs, PATH, partition_tokens=partition_tokens).collect(), docs.collect(), whole, 2048)


def test_windows_keep_the_mixture(spark, docs_of):
    docs = docs_of([(i, "the cat " * (20 + i % 60), "en", "a" if i % 4 else "b") for i in range(3000)])
    rows = op.pack(docs, PATH, partition_tokens=30_000).collect()
    total, b, seqs = sum(r.length for r in rows), sum(r.length for r in rows if r.source == "b"), defaultdict(int)
    for r in rows:
        if r.source == "b":
            seqs[r.sequence_id] += r.length
    n, run, worst = total // 2048, 0, 0
    for k in range(n):  # served so far stays near the target at every window
        run += seqs[k]
        worst = max(worst, abs(run - b / total * 2048 * (k + 1)))
    assert worst < 2 * 2048


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 300), st.floats(0.01, 5)), min_size=1, max_size=6), st.integers(1, 60))
def test_served_before_is_the_order_of_due_tokens(queues, window):
    totals, weights = np.array([n for n, _ in queues]), np.array([w for _, w in queues])
    due = np.concatenate([(np.arange(n) + 0.5) / w for n, w in queues])
    stream = np.repeat(np.arange(len(queues)), totals)[np.argsort(due, kind="stable")]
    places = np.minimum(np.arange(0, totals.sum() + window, window), totals.sum())
    want = [np.bincount(stream[:p], minlength=len(queues)).tolist() for p in places]
    assert op.served_before(places, totals, weights).tolist() == want


@pytest.mark.parametrize("targets", [None, {"a": 5, "b": 3, None: 2}])
def test_every_window_has_the_target_proportions(docs_of, whole, targets):
    docs = docs_of([(i, "the cat " * (14_000 if i == 7 else 20 + i % 60), "en", ["a", "a", "b", None][i % 4]) for i in range(2000)])
    rows = op.pack(docs, PATH, partition_tokens=30_000, targets=targets).collect()
    check(rows, docs.collect(), whole, 2048)
    sums, seqs = defaultdict(int), defaultdict(lambda: defaultdict(int))
    for r in rows:
        sums[r.source] += r.length
        seqs[r.sequence_id][r.source] += r.length
    shares = targets or sums
    until = min(sums[s] * sum(shares.values()) / shares[s] for s in sums)  # then a source has run out
    for k in range(int(until // 2048) - 1):
        for s in sums:
            assert abs(seqs[k][s] - 2048 * shares[s] / sum(shares.values())) <= 3, (k, s)


def test_every_source_needs_a_target(docs_of):
    with pytest.raises(ValueError):
        op.pack(docs_of([(1, "x", "en", "a"), (2, "y", "en", "b")]), PATH, targets={"a": 1.0})


def test_odd_rows(docs_of, whole):
    docs = docs_of([(1, None), (2, ""), (3, "a " * 30_000, "en", "s"), (4, "x", None, "s")])
    check(op.pack(docs.selectExpr("*", "1 AS n", "2 AS part", "3 AS queue", "4 AS ids"), PATH).collect(), docs.collect(), whole, 2048)
    assert op.pack(docs.where("doc_id = 9"), PATH).count() == 0
    twice = docs_of([(1, "a b"), (1, "a b"), (None, "c")])
    assert sorted((str(r.doc_id), r.length) for r in op.pack(twice, PATH).collect()) == [("1", 3), ("1", 3), ("None", 2)]


def test_plain_words_skip_the_splitter_and_agree(whole, sf_dir):
    import pyarrow.parquet as pq

    code = op.encoder(PATH)
    assert code.skip
    texts = pq.read_table(f"{sf_dir}/documents.parquet", columns=["text"])["text"].to_pylist()
    for text, ids in zip(texts, code.ids([t.encode() for t in texts], 1)):
        assert np.frombuffer(ids, "<u2").tolist() == whole.encode(text, add_special_tokens=False).ids + [1]
