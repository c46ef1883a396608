"""Operator 12 against brute force in plain Python."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from creditlens.llm import resampling as op
from creditlens.llm.queries import ORACLES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
COLS = ["doc_id", "n_features", "weight", "score", "rank"]


def runs(text, max_n, buckets):
    words = WORD.findall((text or "").translate(str.maketrans(op.UPPER, op.LOWER)))
    return len(words), sorted(zlib.crc32(" ".join(words[i:i + n]).encode()) % buckets
                              for n in range(1, max_n + 1) for i in range(len(words) - n + 1))


def brute(docs, aims, max_n=1, buckets=10_000, share=10, min_words=20):
    lists = [(d, *runs(t, max_n, buckets)) for d, t in docs]
    s = collections.Counter(b for _, _, x in lists for b in x)
    t = collections.Counter(b for a in aims for b in runs(a, max_n, buckets)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    out = []
    for d, n, x in lists:
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in x)
        out.append([d, len(x), w, w + math.floor(-1000 * math.log(-math.log((h + .5) / 4294967296))), None, n])
    able = sorted((o for o in out if o[5] >= min_words), key=lambda o: (-o[3], o[0] is not None, o[0] or 0, o[1], o[2]))
    for i in range(share * len(able) // 100):
        able[i][4] = i + 1
    return sorted((tuple(o[:5]) for o in out), key=repr)


def got(df):
    return sorted((tuple(r[c] for c in COLS) for r in df.collect()), key=repr)


ODD = [None, "", "... \n", "One two--Two éÀ 3x", "\x01 a\x010 b \x00", "x" * 5000 + " y " + "x" * 5000, "K K İ  w",
       " ".join(random.Random(3).choice(["a", "Bc", "d e", "é", "日本", "it's"]) for _ in range(500))]


@pytest.mark.parametrize("max_n", [1, 2, 5])
@pytest.mark.parametrize("size", [7, 50, 10**6])
def test_buckets_of_odd_texts(max_n, size):
    found = [(n, sorted(f.tolist())) for n, f in op.bucket_lists(ODD, len(ODD), max_n, 10007, size)]
    assert found == [runs(t, max_n, 10007) for t in ODD]


def test_composed_crc():
    rng = random.Random(4)
    parts = [(rng.randbytes(rng.randrange(1, 40)), rng.randbytes(rng.choice([0, 1, 3, 300, 70_000]))) for _ in range(50)]
    out = op.compose(np.array([zlib.crc32(a) for a, _ in parts], np.uint32), np.array([zlib.crc32(b) for _, b in parts], np.uint32),
                     np.array([len(b) for _, b in parts], np.int64))
    assert out.tolist() == [zlib.crc32(a + b) for a, b in parts]


def test_a_long_word_is_no_key_of_the_automaton():
    d = op.Dictionary(["x" * 5000 + " y"])
    assert max(map(len, d.machine.keys())) < op.LONG and len(d.scan(0)) == 2


def test_ties_repeats_nulls_and_ngrams(docs_of, spark):
    rows = [(i, f"alpha beta {'gamma ' * (i % 4)}" * 12) for i in range(40)] + [(5, "same " * 25), (5, "same " * 25), (None, "beta " * 30),
            (None, "beta " * 30), (100, "short"), (101, None), (102, ""), (103, "gamma " * 120_000)]
    docs, aims = docs_of(rows), docs_of([(None, "beta gamma"), (None, None)])
    for max_n in (1, 3):
        out = op.resample(docs, aims, max_n=max_n, buckets=70_000 if max_n == 3 else 10_000)
        assert got(out) == brute(rows, ["beta gamma", None], max_n, 70_000 if max_n == 3 else 10_000)


def test_empty_tables_and_clashing_columns(docs_of):
    none, some = docs_of([]), docs_of([(1, "a b")])
    assert op.resample(none, some).collect() == []
    (row,) = op.resample(some.selectExpr("*", "1 AS weight", "2 AS rank", "3 AS buckets"), none).collect()
    assert row.n_features == 2 and row["rank"] is None


def test_whole_table_and_oracle(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    docs = con.execute("SELECT doc_id, text FROM documents").fetchall()
    aims = [t for t, in con.execute("SELECT text FROM benchmark").fetchall()]
    ours = got(op.op12_importance_resampling(spark, sf_dir))
    assert ours == brute(docs, aims)
    want = con.execute(f"SELECT {', '.join(COLS)} FROM ({ORACLES['op12_importance_resampling']})").fetchall()
    assert sorted(want, key=repr) == ours
