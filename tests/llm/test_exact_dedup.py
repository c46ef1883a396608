import re
from collections import defaultdict

import pytest

from creditlens.llm import exact_dedup as op


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for ids in groups.values():
        known = [i for i in ids if i is not None]
        ids = sorted(ids, key=lambda i: (i is None, i or 0))
        out += [(i, min(known) if known else None, len(ids), k == 0) for k, i in enumerate(ids)]
    return sorted(out, key=str)


ROWS = [(1, "a  b"), (2, "a b"), (3, "a\t\nb"), (4, None), (5, ""), (6, " "), (7, "a b "), (8, " "), (9, "A b"),
        (2, "a b"), (None, "a b"), (None, "solo"), (10, "x" * 200_000), (11, "x" * 200_000)]


@pytest.mark.parametrize("few", [200_000, 0])  # hits broadcast, and shuffled
@pytest.mark.parametrize("key_hex", [64, 1])
def test_small_cases_and_collisions(docs_of, monkeypatch, key_hex, few):
    monkeypatch.setattr(op, "FEW_HITS", few)
    got = op.exact_dedup(docs_of(ROWS), key_hex=key_hex)
    rows = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got.collect()), key=str)
    assert rows == brute(ROWS)


def test_unwritten_frame_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a", 5, "x"), (2, "a", 6, "y")], "doc_id long, text string, digest int, norm string")
    assert sorted((r.doc_id, r.kept) for r in op.exact_dedup(df).collect()) == [(1, True), (2, False)]
    assert op.exact_dedup(df.where("doc_id > 5")).count() == 0


def test_state_goes_on_over_later_files(spark, tmp_path):
    staged, state = str(tmp_path / "staged"), str(tmp_path / "state")

    def stage(rows):
        spark.createDataFrame(rows, op.STAGED).write.mode("append").parquet(staged)

    stage([(5, "aa", 1, "f", 0), (6, "bb", 2, "f", 1)])
    op.run_state(spark, staged, state)
    stage([(3, "aa", 3, "g", 0), (9, "aa", 4, "g", 1)])
    got = {r.digest: (r.keep_id, r.keep_loc, r.n) for r in op.run_state(spark, staged, state).collect()}
    assert got == {"aa": (3, 3, 3), "bb": (6, 2, 1)}


def test_the_stream_leaves_the_session_as_it_was(spark, docs_of):
    before = {k: spark.conf.get(k, None) for k in op.STORE}
    op.exact_dedup(docs_of([(1, "a")])).collect()
    assert {k: spark.conf.get(k, None) for k in op.STORE} == before


def test_whole_table_against_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = sorted(map(tuple, con.sql(op.ORACLE).fetchall()))
    cols = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, op.op8_exact_dedup(spark, sf_dir).select(cols).collect())) == want


def test_keep_first_returns_whole_rows(docs_of):
    docs = docs_of([(1, "a", "en", "s", 1), (2, "a ", "en", "s", 1), (2, "a ", "en", "s", 1), (3, "a", "de", "s", 1)])
    got = op.keep_first(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [1, 2]


def test_stores_of_an_ended_stream_are_closed_soon(spark, docs_of):
    """An executor holds as many stores as it has partitions; they keep native memory until they are closed."""
    import time

    op.exact_dedup(docs_of([(k, f"text {k % 7}") for k in range(50)])).collect()
    memory = spark._jvm.org.apache.spark.sql.execution.streaming.state.RocksDBMemoryManager
    until = time.time() + 25
    while memory.getNumRocksDBInstances(True) and time.time() < until:
        time.sleep(1)
    assert memory.getNumRocksDBInstances(True) == 0
    assert int(op.STORE["spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB"]) <= 128
