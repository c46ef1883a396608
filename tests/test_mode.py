"""The exact mode: proven by the sketch, tied, NULL, or grouped where nothing is frequent."""

import contextlib
import io
import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from creditlens.operators.mode import mode, proven_mode
from creditlens.plans import stats
from tests.fixtures import ag, co, ct, em, md, tables


def frame(spark, values, kind="decimal(15,2)"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}").repartition(5)


def naive(values):
    counts = Counter(values)
    best = max(counts.values())
    tied = [v for v, n in counts.items() if n == best]
    return None if None in tied else min(tied)


def test_a_frequent_value_among_many_is_proven(spark):
    values = [Decimal(i) for i in range(20_000)] + [Decimal("777.50")] * 400 + [Decimal("12.25")] * 399 + [None] * 30
    assert proven_mode(frame(spark, values), "v", tracked=3000, candidates=20) == [Decimal("777.50")]
    assert proven_mode(frame(spark, values + [None] * 400), "v", tracked=3000, candidates=20) == [None]


def test_ties_give_the_smallest(spark):
    values = [Decimal(i) for i in range(5000)] + [Decimal(9)] * 200 + [Decimal(3)] * 200 + [Decimal(7)] * 150
    assert proven_mode(frame(spark, values), "v", tracked=1000) == [Decimal(3)]
    with_null = values + [None] * 201
    assert proven_mode(frame(spark, with_null), "v", tracked=1000) == [None]


def test_nothing_frequent_is_not_proven_but_right(spark):
    values = [Decimal(i % 9000) for i in range(18_001)]
    df = frame(spark, values)
    assert proven_mode(df, "v", tracked=1000, candidates=50) is None
    assert mode(df, "v", "m", tracked=1000, candidates=50).first().m == naive(values) == 0
    empty = df.where("v < 0")
    assert proven_mode(empty, "v") is None and mode(empty, "v", "m").collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_equals_counting(spark, seed):
    rng = random.Random(seed)
    values = [rng.choice([None, *range(rng.choice([2, 40, 900]))]) for _ in range(3000)]
    assert mode(frame(spark, values, "int"), "v", "m", tracked=rng.choice([60, 500]), candidates=rng.choice([3, 40])).first().m == naive(values)


def test_report_groups_nothing_once_proven(spark):
    t = tables(spark, agencia=[ag(1)], cooperado=[co(1)], conta=[ct(10, 1)], modalidade=[md(1)],
               emprestimo=[em(i, 10, 500 if i % 4 == 0 else 1000 + i) for i in range(400)])
    df = stats.distribution_summary(t)
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        mode(t.emprestimo, "valor_contratado", "moda").explain()
    assert df.first().moda == 500 and "hashpartitioning" not in text.getvalue()
    assert t.emprestimo.groupBy("valor_contratado").agg(F.count("*").alias("n")).orderBy(F.desc("n")).first().valor_contratado == 500
