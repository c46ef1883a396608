"""NULL groups and values, the order of reports, audits of every kind and key, options that differ from their reports."""

import datetime as dt
import random

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from creditlens.operators.audit import audit_domain, audit_foreign_key, audit_primary_key
from creditlens.operators.global_order import global_rank
from creditlens.plans import crm, finance, ranking, risk, stats
from creditlens.plans.catalog import REPORTS, run
from creditlens.plans.oracle import ORACLE_SQL
from creditlens.sources.schema import DOMAINS, FOREIGN_KEYS, PRIMARY_KEYS
from tests.fixtures import D, ag, co, ct, em, md, money, pa, rows, tables

SF = "/root/testdata/sf0.01"


def test_q02_keeps_loans_of_a_null_modality_name(spark):
    t = tables(spark, cooperado=[co(1)], conta=[ct(10, 1)], modalidade=[(1, None, money(10), 12), md(2, "B")],
               emprestimo=[em(1, 10, 100), em(2, 10, 200), em(3, 10, 300), em(4, 10, 50, modalidade=2)])
    out = risk.ticket_vs_modality_mean(t, with_mean=True)
    assert rows(out, "nome_modalidade", "contrato_atual", "media_historica") == [
        ("B", money(50), 50.0), (None, money(100), 200.0), (None, money(200), 200.0), (None, money(300), 200.0)]


def test_q04_finds_the_outlier_of_a_null_profile(spark):
    t = tables(spark, cooperado=[(1, "M", None, D(2020, 1, 1), 1)], conta=[ct(10, 1)],
               emprestimo=[em(i, 10, 10) for i in range(9)] + [em(99, 10, 1000)])
    assert rows(risk.outliers_vs_profile_mean(t), "perfil_produtor", "valor_contratado") == [(None, money(1000))]


def test_q10_late_payer_of_a_nameless_branch_is_not_low_risk(spark):
    t = tables(spark, agencia=[(1, None, "C")], cooperado=[co(1), co(2)], conta=[ct(10, 1)], emprestimo=[em(1, 10, 100)],
               parcela=[pa(1, 1, status="Atrasada"), pa(2, 1, 2, status="Atrasada")])
    assert rows(risk.risk_score_summary(t, include_no_history=True)) == [(None, "Risco Alto", 1), (None, "Risco Baixo", 1)]


def test_q18_mean_skips_null_values(spark):
    t = tables(spark, emprestimo=[em(1, 10, 10, D(2024, 1, 1)), (2, 10, 1, None, D(2024, 1, 2), "Ativo"), em(3, 10, 30, D(2024, 1, 3))])
    assert [r.media_movel for r in finance.moving_average(t, id_modalidade=1).collect()] == [10.0, 10.0, 20.0]


@pytest.mark.parametrize("parts", [4, 9])
def test_running_sum_over_real_partitions_with_null_runs(spark, parts):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(4000).select("id", F.when((F.col("id") >= 900) & ((F.col("id") < 2700) | (F.col("id") % 3 == 0)), None)
                                      .otherwise(F.col("id") % 50).alias("v"))
        order = [F.asc("id")]
        ours = global_rank(df, order, rank_col="rn", running_sum="v", running_col="rs", partitions=parts)
        assert df.repartitionByRange(parts, *order).select(F.spark_partition_id()).distinct().count() == parts
        w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        naive = df.select("id", F.row_number().over(Window.orderBy(*order)).alias("a"), F.sum("v").over(w).alias("b"))
        wrong = ours.join(naive, "id").where(~(F.col("rn").eqNullSafe(F.col("a")) & F.col("rs").eqNullSafe(F.col("b"))))
        assert wrong.count() == 0
        nothing = spark.range(40).select("id", F.when(F.col("id") >= 30, F.col("id")).alias("v"))
        got = global_rank(nothing, order, running_sum="v", running_col="rs", partitions=parts).orderBy("id").collect()
        assert [r.rs for r in got][:31] == [None] * 30 + [30]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def in_order(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_reports_come_in_their_order(spark):
    rnd = random.Random(8)
    t = tables(spark, agencia=[ag(i, f"A{i}") for i in range(6)],
               cooperado=[co(i, agencia=i % 6, assoc=D(2015 + i % 7, 1, 1)) for i in range(60)], conta=[ct(i, i) for i in range(60)],
               emprestimo=[em(i, rnd.randrange(60), rnd.randrange(1, 9) * 10, D(2023, rnd.randrange(1, 13), 1)) for i in range(400)],
               parcela=[pa(i, rnd.randrange(400), status=rnd.choice(["Paga", "Atrasada"])) for i in range(500)])
    for frame, cols, descending in (
            (finance.mom_growth(t, 2023), ["mes"], False), (finance.mom_growth(t, 2023, fill_calendar=True), ["mes"], False),
            (ranking.running_total_by_agency(t), ["valor_contratado"], True), (ranking.running_total_by_agency(t), ["running_total"], False),
            (risk.risk_score_summary(t), ["agencia"], False), (risk.risk_score_summary(t, include_no_history=True), ["agencia"], False),
            (risk.weighted_rate_by_agency(t), ["taxa_media_ponderada"], True), (finance.moving_average(t, 1), ["data_contratacao"], False),
            (risk.loan_range_by_agency(t, 1), ["amplitude"], True), (crm.mean_ticket_by_tenure(t), ["anos"], False),
            (crm.mean_ticket_by_tenure(t, full_years=True), ["anos"], False)):
        got = in_order(frame, *cols)
        assert len(got) > 1 and got == sorted(got, reverse=descending), cols


ORDERED = ["q05_mom_growth", "q05_fill_calendar", "q07_running_total_by_agency", "q07_with_share", "q10_risk_score_summary",
           "q10_include_no_history", "q16_weighted_rate_by_agency", "q18_moving_average", "q32_loan_range_by_agency",
           "q39_mean_ticket_by_tenure", "q39_full_years"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", ORDERED)
def test_sequence_equals_the_oracles(spark, duck, name):
    res = duck.execute(ORACLE_SQL[name])
    cols = [d[0] for d in res.description]
    assert in_order(run(name, spark, SF), *cols) == res.fetchall()


@pytest.mark.parametrize("option,report", [
    ("q05_fill_calendar", "q05_mom_growth"), ("q08_strict", "q08_good_payers"), ("q11_distinct", "q11_ghost_members"),
    ("q23_as_asked", "q23_golden_month"), ("q21_min_value", "q21_flash_association")])
def test_option_differs_from_its_report(spark, option, report):
    a, b = rows(run(option, spark, SF)), rows(run(report, spark, SF))
    assert a and b and a != b


def test_every_order_is_a_loan(spark):
    from creditlens.sources.star_mapping import from_star_schema

    assert from_star_schema(spark, SF).emprestimo.count() == spark.read.parquet(f"{SF}/orders.parquet").count()


@pytest.mark.parametrize("table,key", sorted(PRIMARY_KEYS.items()))
def test_primary_key_audit_of_every_table(spark, table, key):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,)], f"{key} long")
    assert rows(audit_primary_key(df, key)) == [(1, 2), (None, 1)]
    assert f"audit_pk_{table}" in REPORTS


@pytest.mark.parametrize("child,fk,parent,pk", FOREIGN_KEYS)
def test_foreign_key_audit_of_every_key(spark, child, fk, parent, pk):
    kids = spark.createDataFrame([(1,), (7,), (7,), (None,), (8,)], f"{fk} long")
    out = audit_foreign_key(kids, fk, spark.createDataFrame([(1,), (2,)], f"{pk} long"), pk)
    assert rows(out) == [(7, 2), (8, 1)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Anti") < plan.index("partial_count")  # counted below the join
    assert f"audit_fk_{child}_{fk}" in REPORTS


@pytest.mark.parametrize("table,col", sorted(DOMAINS))
def test_domain_audit_of_every_list(spark, table, col):
    ok = DOMAINS[(table, col)][0]
    df = spark.createDataFrame([(ok,), ("?",), ("?",), (None,)], f"{col} string")
    assert rows(audit_domain(df, col, DOMAINS[(table, col)])) == [("?", 2), (None, 1)]


@pytest.mark.parametrize("name", ["q15_next_due_instalment", "q21_flash_association", "q21_min_value"])
def test_first_per_group_uses_hash_aggregates(spark, name):
    assert "SortAggregate" not in run(name, spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["q36_cv_by_profile", "q39_correlation"])
def test_loans_are_summed_before_they_meet_members(spark, name):
    plan = run(name, spark, SF)._jdf.queryExecution().executedPlan().toString().splitlines()
    scan = next(i for i, line in enumerate(plan) if "orders.parquet" in line)
    join = max(i for i, line in enumerate(plan[:scan]) if "Join" in line)
    assert any("partial_sum" in line for line in plan[join:scan])


@pytest.mark.parametrize("name", ["q02_ticket_vs_modality_mean", "q04_outliers_vs_profile_mean"])
def test_group_means_are_planned_once(spark, name):
    plan = run(name, spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" not in plan
    assert plan.count("orders.parquet") <= 4  # rows, means, and the modality names each needs


def test_q15_and_q21_ties_and_nulls(spark):
    t = tables(spark, cooperado=[co(1, assoc=D(2024, 1, 1))], conta=[ct(10, 1), ct(11, 1)],
               emprestimo=[em(1, 10, 100, D(2024, 1, 5)), em(2, 11, 900, D(2024, 1, 5)), em(3, 10, 5000, D(2024, 2, 1))],
               parcela=[pa(5, 1, 1, 50, D(2024, 3, 1)), pa(4, 1, 2, 40, D(2024, 3, 1)), (6, 2, 1, money(60), None, None, "Pendente"),
                        pa(7, 2, 2, 70, D(2024, 1, 1))])
    out = ranking.next_due_instalment(t)
    assert rows(out, "id_emprestimo", "valor_parcela", "data_vencimento") == [(1, money(40), dt.date(2024, 3, 1)), (2, money(60), None)]
    assert rows(ranking.flash_association(t, min_value=900), "diferenca_dias") == [(4,)]
    assert rows(ranking.flash_association(t, min_value=901)) == []


def test_q36_matches_population_deviation(spark):
    t = tables(spark, cooperado=[co(1), co(2)], conta=[ct(10, 1), ct(11, 2)],
               emprestimo=[em(i, 10 + i % 2, v) for i, v in enumerate((10, 20, 30, 40))])
    assert rows(stats.cv_by_profile(t), "coeficiente_variacao") == [(44.72,)]
