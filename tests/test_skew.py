"""A key holding a third of the rows: results do not depend on how Spark splits it."""

import datetime as dt

import pytest

from creditlens.plans import audit, crm, finance, ranking, risk, stats
from tests.fixtures import D, ag, co, ct, em, md, pa, tables

REPORTS = [
    lambda t: ranking.top_loans_per_agency(t, D(2024, 1, 1), D(2025, 1, 1), k=2),
    lambda t: ranking.member_tiers(t),
    lambda t: ranking.next_due_instalment(t),
    lambda t: ranking.running_total_by_agency(t, id_agencia=1),
    lambda t: risk.outliers_vs_profile_mean(t, factor=1.5),
    lambda t: risk.hidden_risk(t),
    lambda t: risk.risk_score_summary(t),
    lambda t: finance.instalment_pivot(t),
    lambda t: finance.moving_average(t, id_modalidade=1, bucket_rows=50),
    lambda t: audit.contract_instalment_mismatch(t),
    lambda t: crm.ghost_members(t),
    lambda t: stats.distribution_summary(t),
    lambda t: stats.zscore_outliers(t, z=1.0),
]


@pytest.fixture(scope="module")
def skewed(spark):
    # account 10 (member 1, agency 1) holds a third of the loans; loan 1 a third of the instalments
    n = 600
    loans, inst = [], []
    for i in range(1, n + 1):
        acct = 10 if i % 3 == 0 else 10 * (1 + i % 40)
        loans.append(em(i, acct, 100 + (i * 37) % 500, data=D(2024, 1, 1) + dt.timedelta(days=i % 300),
                        status=("Ativo", "Quitado", "Inadimplente")[(i // 2) % 3]))
    for j in range(1, 3 * n + 1):
        loan = 1 if j % 3 == 0 else 1 + j % n
        inst.append(pa(j, loan, num=1 + j % 7, valor=10 + j % 13, venc=D(2024, 2, 1) + dt.timedelta(days=j % 90),
                       status=("Pendente", "Paga", "Atrasada")[(j // 2) % 3]))
    return tables(spark, agencia=[ag(1), ag(2)],
                  cooperado=[co(m, agencia=1 if m == 1 else 1 + m % 2) for m in range(1, 42)],
                  conta=[ct(10 * m, m, saldo=m - 20) for m in range(1, 42)],
                  modalidade=[md(1)], emprestimo=loans, parcela=inst)


def _collect(spark, t, conf):
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        return [sorted(tuple(r) for r in fn(t).collect()) for fn in REPORTS]
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_results_do_not_depend_on_skew_handling(spark, skewed):
    base = _collect(spark, skewed, {"spark.sql.adaptive.enabled": "false",
                                    "spark.sql.autoBroadcastJoinThreshold": "-1"})
    split = _collect(spark, skewed, {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256",
        "spark.sql.shuffle.partitions": "16",
    })
    assert all(len(r) > 0 for r in base)
    assert base == split
