"""Tier 3: properties of the reports on the driver's data (sf0.01)."""

import pytest
from pyspark.sql import functions as F

from creditlens.operators.chain import loan_chain
from creditlens.plans import finance, ranking, risk, stats
from creditlens.plans.catalog import load

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def t(spark):
    return load(spark, SF)


def test_q20_columns_add_up_to_all_instalments(t):
    pivot = finance.instalment_pivot(t)
    got = {r[0]: r[1] + r[2] + r[3] for r in pivot.collect()}
    chain = loan_chain(t, "columns").join(t.parcela, "id_emprestimo")
    expected = {r[0]: r[1] for r in chain.groupBy("nome_agencia").agg(F.sum("valor_parcela")).collect()}
    assert got == expected and len(got) > 0


def test_q27_last_cumulative_is_the_year_total(t):
    out = finance.daily_running_total(t, year=1998).orderBy("data_contratacao").collect()
    assert out[-1]["soma_acumulada"] == sum(r["total"] for r in out)


def test_q03_rate_is_a_percentage(t):
    rates = [r["taxa_inadimplencia_financeira"] for r in risk.default_rate_by_profile(t).collect()]
    assert rates and all(0 <= x <= 100 for x in rates)


def test_q35_squared_is_q34(t):
    var = stats.variance(t).first()[0]
    sd = stats.stddev(t).first()[0]
    assert sd * sd == pytest.approx(var, rel=1e-4)


def test_q14_tiles_are_balanced(t):
    sizes = [r["count"] for r in ranking.member_tiers(t, n=4).groupBy("tier").count().collect()]
    assert len(sizes) == 4 and max(sizes) - min(sizes) <= 1


@pytest.mark.parametrize("fn", [
    lambda t: ranking.member_tiers(t),
    lambda t: ranking.running_total_by_agency(t, id_agencia=1),
    lambda t: finance.moving_average(t, id_modalidade=4),
    lambda t: finance.moving_average(t, id_modalidade=4, bucket_rows=7),
    lambda t: stats.distribution_summary(t),
])
def test_independent_of_shuffle_partitions(spark, t, fn):
    results = []
    for parts in ("1", "4", "200"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            results.append(sorted(tuple(r) for r in fn(t).collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1] == results[2]
    assert len(results[0]) > 0
