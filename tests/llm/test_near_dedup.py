import random
import re

import numpy as np
import pytest

from creditlens.llm import graph
from creditlens.llm import near_dedup as op
from creditlens.llm.common import Scratch


def shingles(text):
    text = "".join(c.lower() if c.isascii() else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, percent):
    """(component, n) of every row by comparing all pairs."""
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    parent[root(i)] = root(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(root(i), []).append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in ids.items()}
    return sorted(((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows)), key=str)


def got(frame):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in frame.collect()), key=str)


def family(seed, copies, words=120, edits=3):
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(copies):
        w = list(base)
        for _ in range(rnd.randrange(edits + 1)):
            w[rnd.randrange(words)] = f"x{rnd.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("percent", [80, 85])
def test_families_against_all_pairs(docs_of, percent, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 8)  # several blocks a bucket
    texts = [t for s in range(6) for t in family(s, 25)] + family(99, 40, words=30, edits=1) + family(7, 60, edits=8)
    random.Random(5).shuffle(texts)
    rows = list(enumerate(texts)) + [(9000, None), (9001, ""), (9002, " \t"), (9003, "a b"), (9004, "A  B"), (9005, "a b c"),
                                     (9006, "a b"), (None, "a b"), (9003, "a b"), (9007, "q " * 50_000)]
    docs = docs_of(rows)
    out = op.near_dedup(docs.selectExpr("*", "1 AS n", "2 AS id", "3 AS digest", "4 AS keys"), percent)
    assert got(out) == brute(rows, percent)
    kept = [r for r in out.collect() if r.kept]
    assert len(kept) == len({(r.component_id, r.n_shingles == 0, r.doc_id if r.n_shingles == 0 else 0) for r in out.collect()})
    assert all(r.doc_id == r.component_id for r in kept)


def test_whole_table_against_all_pairs(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    out = op.op9_near_dedup(spark, sf_dir)
    assert got(out) == brute(rows, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out.collect())


def test_empty_and_keep_one(docs_of):
    docs = docs_of([(3, "a b c d e f"), (1, "A b c d e f"), (2, None)])
    assert op.near_dedup(docs.where("doc_id = 9")).count() == 0
    kept = op.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]


def test_signatures_estimate_similarity():
    rnd = np.random.default_rng(1)
    for n in (20, 400, 5000):
        base = rnd.integers(0, 2**63, n * 2, dtype=np.uint64)
        a, b = np.unique(base[:n]), np.unique(base[n // 5: n + n // 5])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((op.signature(a) == op.signature(b)).mean() - true) < 0.2


def test_union_find_against_brute_force(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    scratch = Scratch(spark, "test")
    found = graph.components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()
    assert {(r.id, r.component) for r in found} == {(x, root(x)) for a, b in edges if a != b for x in (a, b)}
    assert len(found) == len({r.id for r in found})
    assert graph.components(spark.createDataFrame([], "a long, b long"), scratch, "none").count() == 0
    scratch.remove()


def test_no_words_are_held_after_a_task():
    """Workers live on between tasks; what one remembers counts against its executor for as long."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "file": ["f"], "row": [0], "id": [1], "text": ["some words of a text here"]})
    assert [len(list(f([batch]))) for f in (op._sketch, op._sets)] == [1, 1]
    assert not op._HASHES
