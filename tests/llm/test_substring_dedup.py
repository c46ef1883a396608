"""Operator 13 against brute force in plain Python."""

import hashlib
import random

import numpy as np
import pytest

from creditlens.llm import substring_dedup as op

COLS = ["doc_id", "n_words", "n_removed", "kept_sha256"]


def words_of(text):
    return (text or "").encode().split()


def brute(rows, window=13):
    first = {}
    for doc, text in rows:
        w = words_of(text)
        for i in range(len(w) - window + 1):
            key, own = tuple(w[i:i + window]), op.NO_ID if doc is None else doc
            first[key] = min(first.get(key, own), own)
    out = []
    for doc, text in rows:
        w, own = words_of(text), op.NO_ID if doc is None else doc
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i:i + window])] < own:
                gone[i:i + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((doc, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r[c] for c in COLS) for r in df.collect()), key=repr)


def text(seed, n, vocabulary=2000):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def test_anchors_are_shared_by_equal_phrases():
    shared = text(1, 13)
    (lone,) = op.anchors(op.Words([shared.encode()]).hashes, 13, 7)
    for before, after in ((0, 0), (3, 9), (20, 1)):
        found = op.anchors(op.Words([f"{text(2, before)} {shared} {text(3, after)}".encode()]).hashes, 13, 7)
        assert found[before] == lone
    dense = np.unique(op.anchors(op.Words([text(4, 50_000, 10**6).encode()]).hashes, 13, 7))
    assert len(dense) < 0.3 * 50_000


@pytest.mark.parametrize("words", [30, 200_000])  # many automata a block, and one
def test_odd_cases(docs_of, words):
    p = [text(i, 40) for i in range(6)]
    rows = [(7, f"{text(90, 30)} {p[0]} {text(91, 5)}"), (3, f"x {p[0]}\n\t {p[1]}"), (9, p[0]), (9, p[0]), (9, f"{p[0]} {p[0]}"),
            (None, p[1]), (None, p[1]), (None, p[5]), (None, p[5]), (12, ""), (13, None), (14, "a b c"), (15, " ".join(p[0].split()[:12])),
            (16, " ".join(p[0].split()[:13])), (17, "same " * 60), (18, "same " * 13), (19, "same " * 12), (-4, p[2]), (20, p[2].upper()),
            (21, p[2] + " x"), (22, f"{p[3]} {p[3]}"), (23, text(77, 60_000, 10**6)), (24, text(77, 60_000, 10**6) + " end"),
            (25, p[4]), (26, " ".join(p[4].split()[5:30]) + " " + " ".join(p[4].split()[10:35]))]
    docs = docs_of(rows, parts=4)
    assert got(op.remove_repeats(docs, passage_words=words)) == brute(rows)


def test_one_word_over_and_over(docs_of):
    rows = [(i, "same " * (5 + 7 * (i % 30))) for i in range(90)] + [(200 + i, "same " * 15 + f"x{i % 2} " + "same " * 14) for i in range(4)]
    assert got(op.remove_repeats(docs_of(rows))) == brute(rows)


def test_spans_and_text(docs_of):
    p = text(5, 20)
    rows = [(1, p), (2, f"a {p} b {p} c")]
    by_id = {r.doc_id: r for r in op.remove_repeats(docs_of(rows), with_text=True).collect()}
    assert by_id[2].kept == "a b c" and by_id[2].starts == [1, 22] and by_id[2].stops == [21, 42] and by_id[1].kept == p


@pytest.mark.parametrize("window,anchor", [(13, 13), (4, 2), (1, 1)])
def test_other_windows(docs_of, window, anchor):
    rng = random.Random(window)
    rows = [(rng.randrange(40), text(rng.randrange(10), rng.randrange(30), 6)) for _ in range(60)]
    assert got(op.remove_repeats(docs_of(rows), window, anchor)) == brute(rows, window)


def test_empty_table_clashing_columns_and_no_files(spark, docs_of):
    import os

    base = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    assert op.remove_repeats(docs_of([])).collect() == []
    clash = docs_of([(1, text(1, 20)), (2, text(1, 20))]).selectExpr("*", "1 AS block", "2 AS shard", "3 AS file", "4 AS keys")
    assert [n for _, _, n, _ in got(op.remove_repeats(clash))] == [0, 20]
    assert not [f for f in os.listdir(base) if f.startswith("substring-dedup")]


def test_whole_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in table.collect()]
    ours = got(op.op13_substring_dedup(spark, sf_dir))
    assert ours == got(op.remove_repeats(table, block_rows=7))  # many blocks
    assert ours == brute(docs) and sum(n for _, _, n, _ in ours) > 0
