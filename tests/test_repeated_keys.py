"""Repeated keys are found exactly, and keys that occur once are not shuffled."""

import contextlib
import io
import random

import pytest
from pyspark.sql import functions as F

from creditlens.operators import repeated_keys as op
from creditlens.operators.audit import audit_primary_key
from creditlens.plans.catalog import load, run

SF = "/root/testdata/sf0.001"


def plain(df, keys):
    return sorted((tuple(r) for r in df.groupBy(*keys).count().where("count > 1").collect()), key=repr)


def ours(df, keys, **kw):
    return sorted((tuple(r) for r in op.duplicates(df, keys, "n", **kw).collect()), key=repr)


@pytest.mark.parametrize("row_bytes", [0, 10**9])  # grouped at once, and by bitmaps
def test_one_and_two_keys(spark, row_bytes):
    rng = random.Random(2)
    rows = [(i, i % 7) for i in range(-2000, 90_000, 3)] + [(rng.randrange(-3000, 200_000), rng.choice([0, 6, None])) for _ in range(300)]
    rows += [(None, 1), (None, 1), (5, None), (5, None)]
    df = spark.createDataFrame(rows, "k long, j int").repartition(5).sortWithinPartitions("k")
    assert ours(df, ["k"], row_bytes=row_bytes) == plain(df, ["k"]) != []
    assert ours(df, ["k", "j"], row_bytes=row_bytes) == plain(df, ["k", "j"]) != []


def test_only_pages_with_a_repeat_are_grouped(spark):
    df = spark.range(400_000).unionByName(spark.createDataFrame([(70_000,)], "id long"))
    kept = op.suspects(df, ["id"])
    assert kept.count() <= op.PAGE + 1  # one page of twelve
    assert ours(df, ["id"]) == [(70_000, 2)]
    assert op.suspects(spark.range(400_000), ["id"]).isEmpty()
    assert op.suspects(spark.range(400_000), ["id"], small=400_000).count() == 400_000


def test_scattered_wide_and_text_keys_are_grouped_at_once(spark):
    far = spark.createDataFrame([(-2**62, 1), (2**62, 1), (2**62, 1)], "k long, j int")
    assert op.key_number(far, ["k"]) is None and ours(far, ["k"]) == [(2**62, 2)]
    thin = spark.range(100).select((F.col("id") * 10**9).alias("k"))
    assert op.key_number(thin, ["k"])[1] > op.ROW_BYTES and op.suspects(thin, ["k"]).count() == 100
    text = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "k string")
    assert ours(text, ["k"]) == [("a", 2)]
    empty = text.where("k = 'z'")
    assert ours(empty, ["k"]) == [] and ours(far.where("j = 0"), ["k"]) == []


def test_audit_reports_nulls_and_repeats(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (None,), (3,)], "k long")
    assert sorted((tuple(r) for r in audit_primary_key(df, "k").collect()), key=repr) == [(2, 2), (None, 1)]


def test_the_instalment_audit_shuffles_suspects_only(spark):
    t = load(spark, SF)
    assert op.suspects(t.emprestimo, ["id_emprestimo"]).isEmpty()
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        run("audit_pk_parcela", spark, SF).explain()
    lines = text.getvalue().splitlines()
    scan = next(i for i, l in enumerate(lines) if "lineitem.parquet" in l)
    # below the only exchange of keys, rows have passed the broadcast list of suspect pages
    above = [l for l in lines[:scan] if "Exchange hashpartitioning" in l or "LeftSemi" in l]
    assert any("LeftSemi" in l and "Broadcast" in l for l in above) and len([l for l in above if "Exchange" in l]) == 1
