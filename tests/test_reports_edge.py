"""Tier 1: hand-made edge fixtures, expected rows written by hand (FIXTURES §3)."""

import datetime as dt
from decimal import Decimal

import pytest

from creditlens.plans import audit, crm, finance, ranking, risk, stats
from tests.fixtures import D, ag, co, ct, em, md, money, pa, rows, tables


def one_member(spark, loans=(), instalments=(), saldo=0, perfil="Pequeno", assoc=D(2020, 1, 1), **kw):
    return tables(spark, cooperado=[co(1, perfil=perfil, assoc=assoc)], conta=[ct(10, 1, saldo)],
                  emprestimo=loans, parcela=instalments, **kw)


def test_q01_ties_share_a_place(spark):
    t = tables(spark, cooperado=[co(1)], conta=[ct(10, 1)],
               emprestimo=[em(1, 10, 100), em(2, 10, 100), em(3, 10, 90), em(4, 10, 80),
                           em(5, 10, 500, data=D(2023, 12, 31))])
    out = ranking.top_loans_per_agency(t, D(2024, 1, 1), D(2025, 1, 1), k=2)
    assert rows(out, "valor_contratado", "posicao") == [(money(100), 1), (money(100), 1), (money(90), 2)]


def test_q01_rank_method_option(spark):
    t = tables(spark, cooperado=[co(1)], conta=[ct(10, 1)],
               emprestimo=[em(1, 10, 100), em(2, 10, 100), em(3, 10, 90)])
    out = ranking.top_loans_per_agency(t, D(2024, 1, 1), D(2025, 1, 1), k=2, method="rank")
    assert rows(out, "valor_contratado", "posicao") == [(money(100), 1), (money(100), 1)]


def test_q02_mean_is_taken_before_the_status_filter(spark):
    t = one_member(spark, loans=[em(1, 10, 100, status="Ativo"), em(2, 10, 300, status="Quitado")])
    out = risk.ticket_vs_modality_mean(t, with_mean=True)
    assert rows(out, "contrato_atual", "media_historica", "diferenca_percentual") == [(money(100), 200.0, -50.0)]


def test_q03_integral_money_is_not_truncated(spark):
    t = one_member(spark, loans=[em(1, 10, 125000), em(2, 10, 50000, status="Inadimplente")])
    out = risk.default_rate_by_profile(t)
    assert rows(out, "perfil_produtor", "taxa_inadimplencia_financeira") == [("Pequeno", 28.57)]


def test_q03_zero_volume_gives_null_rate(spark):
    t = one_member(spark, loans=[em(1, 10, 0)])
    out = risk.default_rate_by_profile(t)
    assert rows(out, "taxa_inadimplencia_financeira") == [(None,)]


def test_q04_outliers_above_factor_times_profile_mean(spark):
    t = one_member(spark, loans=[em(i, 10, 10) for i in range(1, 10)] + [em(99, 10, 1000)])
    out = risk.outliers_vs_profile_mean(t, factor=2)
    assert rows(out, "valor_contratado") == [(money(1000),)]


def test_q05_previous_existing_month(spark):
    t = one_member(spark, loans=[em(1, 10, 100, data=D(2023, 1, 10)), em(2, 10, 150, data=D(2023, 3, 5))])
    out = finance.mom_growth(t, year=2023)
    assert rows(out) == [("2023-01", money(100), None, None), ("2023-03", money(150), money(100), 50.0)]


def test_q05_fill_calendar_option(spark):
    t = one_member(spark, loans=[em(1, 10, 100, data=D(2023, 1, 10)), em(2, 10, 150, data=D(2023, 3, 5))])
    out = finance.mom_growth(t, year=2023, fill_calendar=True)
    got = {r["mes"]: (r["total_atual"], r["crescimento_percentual"]) for r in out.collect()}
    assert len(got) == 12
    assert got["2023-02"] == (money(0), -100.0)
    assert got["2023-03"] == (money(150), None)  # previous month is 0: no growth rate


def test_q06_duplicates_collapse(spark):
    t = one_member(spark, loans=[em(1, 10, 100), em(2, 10, 100)],
                   instalments=[pa(1, 1, status="Atrasada"), pa(2, 2, status="Atrasada")])
    assert risk.hidden_risk(t).count() == 1


def test_q07_running_total(spark):
    t = one_member(spark, loans=[em(1, 10, 50), em(2, 10, 200), em(3, 10, 200), em(4, 10, 10, status="Quitado")])
    out = ranking.running_total_by_agency(t, id_agencia=1, with_share=True)
    assert rows(out, "id_emprestimo", "running_total", "pct_acumulado") == [
        (1, money(450), 100.0), (2, money(200), 44.44), (3, money(400), 88.89)]


def test_q08_zero_balance_and_strict(spark):
    t = one_member(spark, saldo=0, loans=[em(1, 10, 100, status="Quitado")])
    assert crm.good_payers(t).count() == 1
    assert crm.good_payers(t, strict=True).count() == 0


def test_q09_cashflow_by_modality(spark):
    t = tables(spark, cooperado=[co(1)], conta=[ct(10, 1)], modalidade=[md(1), md(2)],
               emprestimo=[em(1, 10, 100, modalidade=1), em(2, 10, 100, modalidade=2)],
               parcela=[pa(1, 1, valor=10, status="Paga"), pa(2, 1, num=2, valor=5, status="Atrasada"),
                        pa(3, 2, valor=7, status="Pendente"), pa(4, 2, num=2, valor=1, status="Pendente"),
                        pa(5, 99, valor=1000, status="Paga")])  # orphan instalment: no loan, not counted
    assert rows(finance.cashflow_by_modality(t)) == [
        ("Modalidade 1", money(10), money(5)), ("Modalidade 2", money(0), money(8))]


def test_q27_daily_running_total(spark):
    t = one_member(spark, loans=[em(1, 10, 10, data=D(2024, 1, 2)), em(2, 10, 5, data=D(2024, 1, 2)),
                                 em(3, 10, 20, data=D(2024, 3, 1)), em(4, 10, 99, data=D(2023, 12, 31))])
    assert rows(finance.daily_running_total(t, year=2024), "data_contratacao", "total", "soma_acumulada") == [
        (D(2024, 1, 2), money(15), money(15)), (D(2024, 3, 1), money(20), money(35))]


def test_q10_and_q22_loan_without_instalments(spark):
    t = tables(spark, cooperado=[co(1), co(2)], conta=[ct(10, 1), ct(20, 2)],
               emprestimo=[em(1, 10, 100), em(2, 20, 100)],
               parcela=[pa(1, 1, valor=100, status="Atrasada")])
    assert rows(risk.risk_score_summary(t)) == [("Agencia 1", "Risco Médio", 1)]
    assert rows(risk.risk_score_summary(t, include_no_history=True)) == [
        ("Agencia 1", "Risco Baixo", 1), ("Agencia 1", "Risco Médio", 1)]
    assert rows(audit.contract_instalment_mismatch(t), "id_emprestimo", "total_parcelas") == [(2, money(0))]


def test_q10_classes(spark):
    t = tables(spark, cooperado=[co(1), co(2), co(3)], conta=[ct(10, 1), ct(20, 2), ct(30, 3)],
               emprestimo=[em(1, 10, 100), em(2, 20, 100), em(3, 30, 100)],
               parcela=[pa(1, 1, status="Paga"), pa(2, 2, status="Atrasada"),
                        pa(3, 3, status="Atrasada"), pa(4, 3, num=2, status="Atrasada")])
    assert rows(risk.risk_score_summary(t), "classificacao_de_risco", "quantidade_cooperados") == [
        ("Risco Alto", 1), ("Risco Baixo", 1), ("Risco Médio", 1)]


def test_q11_two_accounts_no_loan_and_loan_on_second_account(spark):
    t = tables(spark, cooperado=[co(1), co(2)],
               conta=[ct(10, 1), ct(11, 1, status="Inativa"), ct(20, 2), ct(21, 2)],
               emprestimo=[em(1, 21, 100)])
    assert rows(crm.ghost_members(t), "id_cooperado") == [(1,), (1,)]
    assert rows(crm.ghost_members(t, distinct=True), "id_cooperado") == [(1,)]


def test_q12_balance_fan_out(spark):
    t = one_member(spark, saldo=60, loans=[em(1, 10, 1000)],
                   instalments=[pa(1, 1, valor=50), pa(2, 1, num=2, valor=50, status="Atrasada")])
    assert finance.balance_vs_debt(t).count() == 0  # 60 counted twice: 120 < 100 is false
    assert rows(finance.balance_vs_debt(t, as_asked=True)) == [("Membro 1", money(60), money(100))]


def test_q13_null_payment_date_is_ignored(spark):
    t = one_member(spark, loans=[em(1, 10, 100)],
                   instalments=[pa(1, 1, status="Paga", pag=None),
                                pa(2, 1, num=2, venc=D(2024, 3, 1), pag=D(2024, 3, 3), status="Paga")])
    assert rows(finance.avg_payment_delay(t)) == [("Pequeno", 2.0)]


def test_q14_uneven_tiles(spark):
    members = [co(i) for i in range(1, 7)]
    accounts = [ct(10 * i, i) for i in range(1, 7)]
    loans = [em(i, 10 * i, 100 * i) for i in range(1, 7)]
    t = tables(spark, cooperado=members, conta=accounts, emprestimo=loans)
    out = ranking.member_tiers(t, n=4)
    assert rows(out, "id_cooperado", "tier") == [(1, 4), (2, 3), (3, 2), (4, 2), (5, 1), (6, 1)]


def test_q26_q38_fewer_rows_than_tiles(spark):
    t = tables(spark, cooperado=[co(i) for i in (1, 2, 3)], conta=[ct(10 * i, i) for i in (1, 2, 3)],
               emprestimo=[em(i, 10 * i, 100 * i) for i in (1, 2, 3)])
    assert rows(ranking.extreme_deciles(t), "total", "decil") == [(money(300), 1)]
    assert rows(stats.p90_cut(t)) == [(None,)]


def test_q38_p90_cut(spark):
    loans = [em(i, 10, i) for i in range(1, 21)]  # values 1..20, tile 10 = {19, 20}
    t = one_member(spark, loans=loans)
    assert rows(stats.p90_cut(t)) == [(money(19),)]


def test_q15_same_due_date_lowest_id(spark):
    t = one_member(spark, loans=[em(1, 10, 100)],
                   instalments=[pa(7, 1, num=2, valor=20), pa(5, 1, num=1, valor=30),
                                pa(9, 1, num=3, valor=5, venc=D(2023, 1, 1), status="Paga")])
    assert rows(ranking.next_due_instalment(t)) == [(1, "Membro 1", money(30), D(2024, 2, 1))]


def test_q16_zero_denominator(spark):
    t = one_member(spark, loans=[em(1, 10, 0)])
    assert rows(risk.weighted_rate_by_agency(t)) == [("Agencia 1", None)]


def test_q16_weighted_rate(spark):
    t = tables(spark, cooperado=[co(1)], conta=[ct(10, 1)], modalidade=[md(1, taxa=10), md(2, taxa=20)],
               emprestimo=[em(1, 10, 100, modalidade=1), em(2, 10, 300, modalidade=2)])
    assert rows(risk.weighted_rate_by_agency(t)) == [("Agencia 1", 17.5)]


def test_q17_exactly_at_the_limit(spark):
    t = tables(spark, cooperado=[co(1)], conta=[ct(10, 1)],
               modalidade=[md(1, prazo=12), md(2, prazo=12)],
               emprestimo=[em(1, 10, 100, modalidade=1), em(2, 10, 100, modalidade=2)],
               parcela=[pa(1, 1, num=12), pa(2, 2, num=13)])
    assert rows(audit.term_violations(t)) == [("Modalidade 2", 12, 13)]


def test_q18_short_frame(spark):
    loans = [em(i, 10, v, data=D(2024, 1, i), modalidade=4) for i, v in enumerate([10, 20, 60, 30], start=1)]
    loans.append(em(9, 10, 999, modalidade=1))
    t = one_member(spark, loans=loans, modalidade=[md(1), md(4)])
    got = rows(finance.moving_average(t, id_modalidade=4), "data_contratacao", "media_movel")
    assert [g[1] for g in got] == pytest.approx([10.0, 15.0, 30.0, 110 / 3])
    # tiny buckets: every frame crosses a bucket boundary through the halo rows
    for b in (2, 3, 4):
        got = rows(finance.moving_average(t, id_modalidade=4, bucket_rows=b), "data_contratacao", "media_movel")
        assert [g[1] for g in got] == pytest.approx([10.0, 15.0, 30.0, 110 / 3])
    got = rows(finance.moving_average(t, id_modalidade=4, width=1, bucket_rows=1), "data_contratacao", "media_movel")
    assert [g[1] for g in got] == pytest.approx([10.0, 20.0, 60.0, 30.0])


def test_q19_vip_defaulters(spark):
    t = tables(spark, cooperado=[co(1), co(2)], conta=[ct(10, 1, -5), ct(20, 2, 5)],
               emprestimo=[em(1, 10, 150000), em(2, 20, 150000)],
               parcela=[pa(1, 1, status="Atrasada"), pa(2, 2, status="Atrasada")])
    assert rows(risk.vip_defaulters(t, min_volume=100000)) == [("Membro 1", "Cidade 1", money(-5))]
    assert risk.vip_defaulters(t, min_volume=200000).count() == 0


def test_q20_pivot(spark):
    t = one_member(spark, loans=[em(1, 10, 100)],
                   instalments=[pa(1, 1, valor=10, status="Paga"), pa(2, 1, valor=20, status="Pendente"),
                                pa(3, 1, valor=40, status="Atrasada"), pa(4, 1, valor=1, status="Paga")])
    assert rows(finance.instalment_pivot(t)) == [("Agencia 1", money(11), money(20), money(40))]


def test_q21_loan_before_association(spark):
    assoc = D(2024, 1, 1)
    t = tables(spark, cooperado=[co(i, assoc=assoc) for i in (1, 2, 3, 4)],
               conta=[ct(10 * i, i) for i in (1, 2, 3, 4)],
               emprestimo=[em(i, 10 * i, 100, data=assoc + dt.timedelta(days=d))
                           for i, d in zip((1, 2, 3, 4), (-1, 0, 30, 31))])
    assert rows(ranking.flash_association(t), "diferenca_dias") == [(0,), (30,)]


def test_q23_agencies_sharing_a_name(spark):
    t = tables(spark, agencia=[ag(1, "Sede"), ag(2, "Sede")], cooperado=[co(1, agencia=1), co(2, agencia=2)],
               conta=[ct(10, 1), ct(20, 2)],
               emprestimo=[em(1, 10, 100, data=D(2024, 5, 1)), em(2, 20, 300, data=D(2024, 7, 1))])
    assert rows(ranking.golden_month(t, 2024)) == [("Sede", "2024-07", money(300))]
    assert rows(ranking.golden_month(t, 2024, as_asked=True)) == [
        ("Sede", "2024-05", money(100)), ("Sede", "2024-07", money(300))]


def test_q24_time_to_default(spark):
    t = one_member(spark, loans=[em(1, 10, 100, data=D(2024, 1, 1), status="Inadimplente")],
                   instalments=[pa(1, 1, venc=D(2024, 3, 1), status="Atrasada"),
                                pa(2, 1, num=2, venc=D(2024, 2, 1), status="Atrasada"),
                                pa(3, 1, num=3, venc=D(2024, 1, 5), status="Paga")])
    assert rows(risk.time_to_default(t)) == [(1, 31)]


def test_q25_only_settled_is_not_recovered(spark):
    t = tables(spark, cooperado=[co(1), co(2)], conta=[ct(10, 1), ct(20, 2)],
               emprestimo=[em(1, 10, 1, status="Quitado"), em(2, 10, 1, status="Ativo"),
                           em(3, 20, 1, status="Inadimplente"), em(4, 20, 1, status="Ativo")])
    assert rows(risk.recovered_members(t)) == [("Membro 2",)]


def test_q25_ordered_option(spark):
    t = tables(spark, cooperado=[co(1), co(2)], conta=[ct(10, 1), ct(20, 2)],
               emprestimo=[em(1, 10, 1, data=D(2024, 5, 1), status="Inadimplente"),
                           em(2, 10, 1, data=D(2024, 1, 1), status="Ativo"),
                           em(3, 20, 1, data=D(2024, 1, 1), status="Inadimplente"),
                           em(4, 20, 1, data=D(2024, 6, 1), status="Ativo")])
    assert rows(risk.recovered_members(t)) == [("Membro 1",), ("Membro 2",)]
    assert rows(risk.recovered_members(t, ordered=True)) == [("Membro 2",)]


def test_q21_min_value_option(spark):
    assoc = D(2024, 1, 1)
    t = tables(spark, cooperado=[co(1, assoc=assoc), co(2, assoc=assoc)], conta=[ct(10, 1), ct(20, 2)],
               emprestimo=[em(1, 10, 500000, data=D(2024, 1, 5)), em(2, 20, 1000, data=D(2024, 1, 5)),
                           em(3, 20, 900000, data=D(2024, 3, 5))])
    assert rows(ranking.flash_association(t, min_value=100000), "nome_completo") == [("Membro 1",)]


def test_q28_collection_effort(spark):
    t = one_member(spark, loans=[em(1, 10, 100)],
                   instalments=[pa(1, 1, status="Atrasada"), pa(2, 1, num=2), pa(3, 1, num=3)])
    assert rows(risk.collection_effort(t)) == [("Agencia 1", 33.33)]


def test_q29_speculative_risk(spark):
    t = tables(spark, cooperado=[co(1, perfil="Pequeno"), co(2, perfil="Grande")],
               conta=[ct(10, 1), ct(20, 2)], modalidade=[md(1, taxa=12), md(2, taxa=8)],
               emprestimo=[em(1, 10, 1, modalidade=1), em(2, 10, 1, modalidade=2), em(3, 20, 1, modalidade=1)],
               parcela=[pa(100 * l + n, l, num=n) for l in (1, 2, 3) for n in range(1, 4)])
    assert rows(risk.speculative_risk(t, profile="Pequeno", min_rate=10, min_n=2)) == [
        ("Membro 1", "Modalidade 1", 3)]


def test_q30_duplicate_instalments(spark):
    t = one_member(spark, loans=[em(1, 10, 100)],
                   instalments=[pa(i, 1, num=n) for i, n in enumerate([1, 2, 2, 3, 3])])
    assert rows(audit.duplicate_instalments(t)) == [(1,), (1,)]
    assert rows(audit.duplicate_instalments(t, distinct=True)) == [(1,)]


def test_q31_mode_tie_takes_lowest_rate(spark):
    t = tables(spark, cooperado=[co(1)], conta=[ct(10, 1)], modalidade=[md(1, taxa=10), md(2, taxa=9)],
               emprestimo=[em(1, 10, 1, modalidade=1), em(2, 10, 1, modalidade=1),
                           em(3, 10, 1, modalidade=2), em(4, 10, 1, modalidade=2)])
    assert rows(stats.modal_rate(t)) == [(Decimal("9.00"), 2)]


def test_q32_range(spark):
    t = one_member(spark, loans=[em(1, 10, 10), em(2, 10, 60011)])
    assert rows(risk.loan_range_by_agency(t, min_range=50000)) == [("Agencia 1", money(60001))]
    assert risk.loan_range_by_agency(t, min_range=70000).count() == 0


@pytest.mark.parametrize("values,median,q40,q40_asked", [
    ([1, 2, 3, 4], 2, 2.5, 2.5),
    ([1, 2, 3, 4, 5], 3, 2.5, 3.0),
    ([7], 7, 7.0, 7.0),
])
def test_q33_q40_even_odd_median(spark, values, median, q40, q40_asked):
    t = one_member(spark, loans=[em(i, 10, v) for i, v in enumerate(values, start=1)])
    assert rows(stats.lower_median(t)) == [(money(median),)]
    assert rows(stats.distribution_summary(t), "mediana") == [(q40,)]
    assert rows(stats.distribution_summary(t, as_asked=True), "mediana") == [(q40_asked,)]


def test_q40_mean_and_mode(spark):
    t = one_member(spark, loans=[em(i, 10, v) for i, v in enumerate([5, 9, 9, 5, 1], start=1)])
    assert rows(stats.distribution_summary(t)) == [(5.8, 5.0, money(5))]


def test_zero_variance(spark):
    t = one_member(spark, loans=[em(i, 10, 5) for i in (1, 2, 3)])
    assert rows(stats.variance(t)) == [(0.0,)]
    assert rows(stats.stddev(t)) == [(0.0,)]
    assert rows(stats.cv_by_profile(t)) == [("Pequeno", 0.0)]
    assert stats.zscore_outliers(t, z=2).count() == 0


def test_variance_does_not_cancel(spark):
    t = one_member(spark, loans=[em(i, 10, v) for i, v in enumerate([1e8, 1e8 + 1, 1e8 + 2], start=1)])
    assert rows(stats.variance(t)) == [(0.67,)]
    assert rows(stats.stddev(t)) == [(0.82,)]


def test_q37_zscore(spark):
    t = one_member(spark, loans=[em(i, 10, 10) for i in range(1, 10)] + [em(99, 10, 110)])
    out = rows(stats.zscore_outliers(t, z=2))
    assert [r[0] for r in out] == [99] and out[0][2] == pytest.approx(3.0)


def test_q39_calendar_years(spark):
    t = one_member(spark, assoc=D(2023, 12, 31), loans=[em(1, 10, 100, data=D(2024, 1, 1))])
    assert rows(crm.mean_ticket_by_tenure(t)) == [(1, 100.0)]
    assert rows(crm.mean_ticket_by_tenure(t, full_years=True)) == [(0, 100.0)]


def test_q39_correlation_and_q40_skewness_options(spark):
    t = tables(spark, cooperado=[co(1, assoc=D(2020, 6, 1)), co(2, assoc=D(2021, 6, 1)), co(3, assoc=D(2022, 6, 1))],
               conta=[ct(10, 1), ct(20, 2), ct(30, 3)],
               emprestimo=[em(1, 10, 300, data=D(2024, 1, 1)), em(2, 20, 200, data=D(2024, 1, 1)),
                           em(3, 30, 100, data=D(2024, 1, 1))])
    assert rows(crm.tenure_value_correlation(t))[0][0] == pytest.approx(1.0)
    assert rows(stats.distribution_summary(t, with_skewness=True), "assimetria")[0][0] == pytest.approx(0.0, abs=1e-12)
    skewed = one_member(spark, loans=[em(i, 10, v) for i, v in enumerate([1, 1, 1, 10], start=1)])
    assert rows(stats.distribution_summary(skewed, with_skewness=True), "assimetria")[0][0] == 1.154701


def test_member_with_unknown_agency(spark):
    t = tables(spark, cooperado=[co(1, agencia=None), co(2, agencia=1)], conta=[ct(10, 1), ct(20, 2)],
               emprestimo=[em(1, 10, 100, status="Inadimplente"), em(2, 10, 50, status="Ativo"),
                           em(3, 20, 70, status="Ativo")])
    # dropped where the agency is joined ...
    assert rows(risk.default_rate_by_profile(t), "volume_total") == [(money(70),)]
    assert ranking.member_tiers(t).count() == 1
    # ... kept where it is not
    assert rows(risk.recovered_members(t)) == [("Membro 1",)]
    assert rows(crm.mean_ticket_by_tenure(t), "ticket_medio") == [(pytest.approx(220 / 3),)]
    assert risk.ticket_vs_modality_mean(t).count() == 2


def test_constraint_audits(spark):
    t = tables(spark, cooperado=[co(1), co(1)], conta=[ct(10, 1)],
               emprestimo=[em(1, 10, 100), em(2, 99, 100)],
               parcela=[pa(1, 1, status="paga")])
    assert rows(audit.primary_key_audit(t, "cooperado")) == [(1, 2)]
    assert rows(audit.foreign_key_audit(t, "emprestimo", "id_conta")) == [(99, 1)]
    assert rows(audit.domain_audit(t, "parcela", "status_parcela")) == [("paga", 1)]
