"""Operator 11 against a brute-force tree in plain Python."""

import hashlib
import random
import zlib

import duckdb
import pytest

from creditlens.llm import merkle as op
from creditlens.llm.queries import ORACLES


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(r, text="same"):
    return H(*(enc(r[c]) for c in ("doc_id", "source", "lang", "n_chars")), enc(r["text"] if text == "same" else text))


def climb(nodes, fanout):
    """(root, siblings of each node level by level, left and right)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i:i + fanout] for i in range(0, len(nodes), fanout)]
        for k, i in enumerate(at):
            run = runs[i // fanout]
            paths[k].append(("".join(run[:i % fanout]), "".join(run[i % fanout + 1:])))
            at[k] = i // fanout
        nodes = [H(*r) for r in runs]
    return nodes[0], paths


def brute(rows, fanout=8):
    order = sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        mine = [r for r in order if r["lang"] == lang]
        trees[lang] = (mine, *climb([leaf_of(r) for r in mine], fanout))
    root, above = climb([trees[x][1] for x in langs], fanout) if langs else (None, [])
    out = []
    for x, up in zip(langs, above):
        mine, subroot, paths = trees[x]
        for r, p in zip(mine, paths):
            p = p + up
            at = leaf_of(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None:
                at = leaf_of(r, r["text"].translate(str.maketrans(op.UPPER, op.LOWER)))
            for left, right in p:
                at = H(left, at, right)
            out.append((r["doc_id"], leaf_of(r), subroot, root, H(*(a + b for a, b in p)), at, at == root))
    return sorted(out, key=repr)


COLS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def got(df):
    return sorted((tuple(r[c] for c in COLS) for r in df.collect()), key=repr)


def run(docs, **kw):
    third = op.F.crc32(op.F.col("doc_id").cast("string")) % 3 == 0
    return op.merkle(docs, tamper=third, tampered={"text": op.F.translate("text", op.UPPER, op.LOWER)}, **kw)


def as_dicts(docs):
    return [r.asDict() for r in docs.collect()]


@pytest.mark.parametrize("fanout", [2, 8])
def test_odd_cases(docs_of, fanout):
    docs = docs_of([(1, "Ab c", "en", "s"), (1, "Ab c", "en", "s"), (None, "X", "en"), (None, None, None), (3, "", "fr", "é"),
                    (4, "ÄBé " * 3, "fr", None, 7), (-5, "low", "en"), (9, "Z" * 300_000, "en", "s", 300_000)]
                   + [(i, f"Text {i}", "en", "s", i) for i in range(10, 85)])
    assert got(run(docs, fanout=fanout)) == brute(as_dicts(docs), fanout)


def test_one_row_no_row_and_clashing_columns(spark, docs_of):
    one = docs_of([(7, "A", "en", "s", 1)])
    (row,) = run(one).collect()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == hashlib.sha256(b"").hexdigest()
    assert run(docs_of([])).collect() == [] and run(docs_of([])).columns == COLS
    clash = docs_of([(i, "T", "en", "s", 1) for i in range(9)]).selectExpr("*", "1 AS pos", "2 AS n", "3 AS grp", "4 AS s0", "5 AS path")
    assert len(got(run(clash))) == 9


def test_path_is_the_proof(docs_of):
    docs = docs_of([(i, f"T{i}", "en" if i % 3 else "de", "s", i) for i in range(30)])
    for r in op.merkle(docs, with_path=True).collect():
        at = r.leaf
        for step in r.path:
            at = H(step.left, at, step.right)
        assert at == r.root and r.verified


def test_random_sizes(docs_of):
    rng = random.Random(5)
    for n in (8, 9, 65):
        docs = docs_of([(rng.randrange(10**6), f"Wort {i}", rng.choice(["de", "en", "ä", None]), "s", i) for i in range(n)])
        assert got(run(docs)) == brute(as_dicts(docs))


def test_whole_table(spark, sf_dir):
    rows = op.op11_merkle_manifest(spark, sf_dir)
    assert got(rows) == brute(as_dicts(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def test_oracle(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.execute(f"SELECT {', '.join(COLS)} FROM ({ORACLES['op11_merkle_manifest']})").fetchall()
    assert sorted(want, key=repr) == got(op.op11_merkle_manifest(spark, sf_dir))


def test_leaves_no_files(spark, docs_of):
    import os

    base = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = {f for f in os.listdir(base) if f.startswith("merkle")}
    run(docs_of([(i, "t", "en", "s", 1) for i in range(20)])).collect()
    assert {f for f in os.listdir(base) if f.startswith("merkle")} == before
