"""Exact mergeable moments: large close values, merging, overflow, empty and NULL groups."""

import math
import random
import statistics
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from creditlens.operators.moments import central, merged, merged_with, power_sums
from creditlens.plans import crm, stats
from tests.fixtures import D, ag, co, ct, em, md, tables


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, x long, v decimal(15,2)")


def test_large_close_values_do_not_cancel(spark):
    df = frame(spark, [(1, i, Decimal(10**8 + i)) for i in range(3)])
    r = central(df.groupBy("k").agg(*power_sums("v"))).first()
    assert (r.n, r["mean"]) == (3, 100000001.0) and math.isclose(r.var_pop, 2 / 3, rel_tol=1e-12)
    big = frame(spark, [(1, i, Decimal("9999999999999.00") - i) for i in range(5)])
    assert math.isclose(central(big.agg(*power_sums("v"))).first().var_pop, 2.0, rel_tol=1e-12)


def test_merging_parts_changes_nothing(spark):
    rng = random.Random(1)
    rows = [(i % 17, rng.randrange(-3, 40), Decimal(rng.randrange(-10**9, 10**9)) / 100) for i in range(2000)]
    df = frame(spark, rows)
    whole = central(df.agg(*power_sums("v"))).first()
    parts = df.groupBy("k", "x").agg(*power_sums("v"))
    r = central(parts.repartition(7).agg(*merged_with(F.col("x")))).first()
    assert (r.n, r["mean"], r.var_pop, r.stddev_pop) == (whole.n, whole["mean"], whole.var_pop, whole.stddev_pop)
    v, x = [float(a) for _, _, a in rows], [a for _, a, _ in rows]
    assert math.isclose(r.var_pop, statistics.pvariance(v), rel_tol=1e-9)
    assert math.isclose(r["corr"], statistics.correlation(x, v), rel_tol=1e-9)


def test_null_values_empty_groups_and_constants(spark):
    df = frame(spark, [(1, 1, None), (2, 1, Decimal("5.00")), (2, 2, Decimal("5.00")), (None, 1, Decimal("-1.50"))])
    by = {r.k: r for r in central(df.groupBy("k").agg(*power_sums("v")).groupBy("k").agg(*merged())).collect()}
    assert by[1].n == 0 and by[1]["mean"] is None and by[1].var_pop is None
    assert by[2].var_pop == 0.0 and by[None]["mean"] == -1.5
    constant = central(df.groupBy("k", "x").agg(*power_sums("v")).where("k = 2").agg(*merged_with(F.col("x")))).first()
    assert constant["corr"] is None  # no spread, no correlation
    assert central(df.where("k = 9").groupBy("x").agg(*power_sums("v")).agg(*merged_with(F.col("x")))).first()["corr"] is None


def credit(spark, values, profile="Pequeno"):
    n = len(values)
    return tables(spark, agencia=[ag(1)], cooperado=[co(1, 1, perfil=profile, assoc=D(2020, 1, 1))], conta=[ct(10, 1)],
                  modalidade=[md(1)], emprestimo=[em(i, 10, values[i], data=D(2021 + i, 6, 1)) for i in range(n)])


def test_perfect_correlation_of_large_values(spark):
    t = credit(spark, [100_000_000 + i for i in range(4)])
    assert crm.tenure_value_correlation(t).first().correlacao == 1.0
    assert crm.tenure_value_correlation(t, full_years=True).first().correlacao == 1.0
    down = credit(spark, [100_000_000 - i for i in range(4)])
    assert crm.tenure_value_correlation(down).first().correlacao == -1.0


def test_cv_of_large_close_values(spark):
    # spread of one thousandth of the mean: two decimals of a percentage would hide a cancelled variance of zero
    t = credit(spark, [10**8, 10**8 + 100_000, 10**8 + 200_000])
    want = round(math.sqrt(2 / 3) * 100_000 / (10**8 + 100_000) * 100, 2)
    assert stats.cv_by_profile(t).first().coeficiente_variacao == pytest.approx(want)


def test_still_aggregated_before_the_member_join(spark):
    import contextlib
    import io

    t = credit(spark, [1, 2])
    for df in (stats.cv_by_profile(t), crm.tenure_value_correlation(t)):
        text = io.StringIO()
        with contextlib.redirect_stdout(text):
            df.explain()
        # partial and final by account below the join, partial and final by group above it
        assert text.getvalue().count("HashAggregate") >= 4 and text.getvalue().rindex("HashAggregate") > text.getvalue().index("Join")
