"""Risk reports: Q02 Q03 Q04 Q06 Q10 Q16 Q19 Q24 Q25 Q28 Q29 Q32."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditlens.functions.columns import as_double, days_between, pct, ratio, round2
from creditlens.operators.chain import account_owners, loan_chain, loan_key, members, per_loan, with_evidence
from creditlens.operators.deviation import deviation_from_group_mean, means_from_partials
from creditlens.sources.tables import Tables

V = "valor_contratado"
LOAN_STATUS = "status_contrato"
INST_STATUS = "status_parcela"


def ticket_vs_modality_mean(t: Tables, status: str = "Ativo", with_mean: bool = False) -> DataFrame:
    """Q02 — loans in `status` vs the historical mean (all statuses, rounded to
    2) of their modality name: % difference.

    The mean is built from per-(account, modality) partial sums of the loans
    whose account and member exist, so its pass shuffles one row per account
    and modality, not one per loan."""
    partials = (t.emprestimo.groupBy("id_conta", "id_modalidade")
                .agg(F.sum(V).alias("_s"), F.count(V).alias("_n")))
    owned = partials.join(account_owners(t, "none").select("id_conta"), "id_conta")
    means = means_from_partials(owned.join(t.dim("modalidade"), "id_modalidade"),
                                ["nome_modalidade"], "_s", "_n", "media_historica")
    rows = loan_chain(t, "none", t.emprestimo.where(F.col(LOAN_STATUS) == status), modality=True)
    df = deviation_from_group_mean(rows, None, ["nome_modalidade"], V, "media_historica", round_mean=2,
                                   means=means, few=t.is_small("modalidade"))
    diff = round2((ratio(V, "media_historica") - F.lit(1.0)) * F.lit(100.0))
    cols = ["nome_completo", "nome_modalidade", F.col(V).alias("contrato_atual")]
    if with_mean:
        cols.append("media_historica")
    return df.select(*cols, diff.alias("diferenca_percentual"))


def default_rate_by_profile(t: Tables, bad: str = "Inadimplente") -> DataFrame:
    """Q03 — per producer profile: total volume, defaulted volume, default rate %."""
    per_account = t.emprestimo.groupBy("id_conta").agg(
        F.sum(V).alias("volume_total"),
        F.sum(F.when(F.col(LOAN_STATUS) == bad, F.col(V)).otherwise(F.lit(0))).alias("total_inadimplente"))
    df = loan_chain(t, "required", per_account)
    out = df.groupBy("perfil_produtor").agg(F.sum("volume_total").alias("volume_total"),
                                            F.sum("total_inadimplente").alias("total_inadimplente"))
    return out.withColumn("taxa_inadimplencia_financeira",
                          round2(pct("total_inadimplente", "volume_total")))


def outliers_vs_profile_mean(t: Tables, factor: float = 2.0) -> DataFrame:
    """Q04 — loans above `factor` × the mean loan of the member's profile
    (the mean is built from per-account partial sums)."""
    partials = t.emprestimo.groupBy("id_conta").agg(F.sum(V).alias("_s"), F.count(V).alias("_n"))
    means = means_from_partials(loan_chain(t, "required", partials), ["perfil_produtor"], "_s", "_n", "media_perfil")
    rows = loan_chain(t, "required")
    df = deviation_from_group_mean(rows, None, ["perfil_produtor"], V, "media_perfil", means=means,
                                   few=t.few("cooperado", "perfil_produtor"))
    df = df.where(as_double(V) > F.col("media_perfil") * F.lit(float(factor)))
    return df.select("nome_completo", "perfil_produtor", V, "media_perfil")


def hidden_risk(t: Tables, loan_status: str = "Ativo", late: str = "Atrasada") -> DataFrame:
    """Q06 — loans still in `loan_status` with at least one late instalment
    (distinct member name, agency name, value)."""
    evidence = t.parcela.where(F.col(INST_STATUS) == late)
    loans = with_evidence(t.emprestimo.where(F.col(LOAN_STATUS) == loan_status), evidence, loan_key(evidence))
    df = loan_chain(t, "columns", loans)
    return df.select("nome_completo", "nome_agencia", V).distinct()


# The risk classes of Q10 (0, 1, 2 or more late instalments).
RISK_LOW, RISK_MID, RISK_HIGH = "Risco Baixo", "Risco Médio", "Risco Alto"


def _risk_class(n) -> F.Column:
    return (F.when(n == 0, F.lit(RISK_LOW)).when(n == 1, F.lit(RISK_MID)).otherwise(F.lit(RISK_HIGH)))


def risk_score_summary(t: Tables, late: str = "Atrasada", include_no_history: bool = False) -> DataFrame:
    """Q10 — members classified by their number of late instalments
    (0 / 1 / ≥2), counted per agency name × class.

    As written only members with at least one instalment are classified;
    ``include_no_history`` also counts members without any as 'Risco Baixo'."""
    lates = per_loan(t.parcela, F.count_if(F.col(INST_STATUS) == late).alias("n_late"))
    per_account = (t.emprestimo.select("id_emprestimo", "id_conta").join(lates, loan_key(lates))
                   .groupBy("id_conta").agg(F.sum("n_late").alias("n_late")))
    per_member = (loan_chain(t, "columns", per_account)
                  .groupBy("nome_agencia", "id_cooperado").agg(F.sum("n_late").alias("total_atrasos")))
    if include_no_history:
        everyone = members(t, "columns").select("nome_agencia", "id_cooperado")
        per_member = (everyone.join(per_member.drop("nome_agencia"), "id_cooperado", "left")
                      .fillna(0, subset=["total_atrasos"]))
    classified = per_member.select(F.col("nome_agencia").alias("agencia"),
                                   _risk_class(F.col("total_atrasos")).alias("classificacao_de_risco"))
    return classified.groupBy("agencia", "classificacao_de_risco").agg(
        F.count(F.lit(1)).alias("quantidade_cooperados")).orderBy("agencia", "classificacao_de_risco")


def weighted_rate_by_agency(t: Tables, status: str = "Ativo") -> DataFrame:
    """Q16 — Σ(value × annual rate) / Σ value of the loans in `status`, per agency."""
    loans = t.emprestimo.where(F.col(LOAN_STATUS) == status).join(t.dim("modalidade"), "id_modalidade")
    per_account = loans.groupBy("id_conta").agg(
        F.sum(F.col(V) * F.col("taxa_juros_anual")).alias("_vr"), F.sum(V).alias("_v"))
    df = loan_chain(t, "columns", per_account)
    out = df.groupBy("id_agencia", "nome_agencia").agg(F.sum("_vr").alias("_vr"), F.sum("_v").alias("_v"))
    return (out.select("id_agencia", "nome_agencia", round2(ratio("_vr", "_v")).alias("taxa_media_ponderada"))
            .orderBy(F.desc_nulls_last("taxa_media_ponderada"), "id_agencia").drop("id_agencia"))


def vip_defaulters(t: Tables, min_volume=100000, late: str = "Atrasada") -> DataFrame:
    """Q19 — accounts with negative balance and a late instalment on one of
    their loans, whose member's volume on such accounts exceeds `min_volume`
    (grouped by member, city and balance)."""
    late_loans = t.parcela.where(F.col(INST_STATUS) == late)
    late_accounts = with_evidence(t.emprestimo.select("id_emprestimo", "id_conta"), late_loans, loan_key(late_loans))
    accounts = with_evidence(t.conta.where(F.col("saldo_atual") < 0), late_accounts, "id_conta")
    volume = t.emprestimo.groupBy("id_conta").agg(F.sum(V).alias("_v"))
    df = loan_chain(t, "columns", volume, accounts=accounts)
    out = df.groupBy("id_cooperado", "nome_completo", "cidade", "saldo_atual").agg(F.sum("_v").alias("_vol"))
    return out.where(F.col("_vol") > F.lit(min_volume)).select("nome_completo", "cidade", "saldo_atual")


def time_to_default(t: Tables, loan_status: str = "Inadimplente", late: str = "Atrasada") -> DataFrame:
    """Q24 — days from contracting to the earliest late instalment's due date, defaulted loans."""
    first_late = per_loan(t.parcela.where(F.col(INST_STATUS) == late),
                          F.min("data_vencimento").alias("_first"))
    loans = t.emprestimo.where(F.col(LOAN_STATUS) == loan_status).join(first_late, loan_key(first_late))
    return loans.select("id_emprestimo", days_between("_first", "data_contratacao").alias("dias_ate_ruina"))


def recovered_members(t: Tables, bad: str = "Inadimplente", good: str = "Ativo",
                      ordered: bool = False) -> DataFrame:
    """Q25 — members with at least one `bad` and at least one `good` loan.

    As written there is no time condition; ``ordered`` requires a `good` loan
    contracted after the member's first `bad` one."""
    status, d = F.col(LOAN_STATUS), F.col("data_contratacao")
    per_account = t.emprestimo.groupBy("id_conta").agg(
        F.count_if(status == bad).alias("_bad"),
        F.count_if(status == good).alias("_good"),
        F.min(F.when(status == bad, d)).alias("_first_bad"),
        F.max(F.when(status == good, d)).alias("_last_good"))
    df = loan_chain(t, "none", per_account)
    out = df.groupBy("id_cooperado", "nome_completo").agg(
        F.sum("_bad").alias("_bad"), F.sum("_good").alias("_good"),
        F.min("_first_bad").alias("_first_bad"), F.max("_last_good").alias("_last_good"))
    cond = (F.col("_bad") > 0) & (F.col("_good") > 0)
    if ordered:
        cond = cond & (F.col("_last_good") > F.col("_first_bad"))
    return out.where(cond).select("nome_completo")


def collection_effort(t: Tables, late: str = "Atrasada") -> DataFrame:
    """Q28 — late instalments × 100 / all instalments, per agency (counts)."""
    counts = per_loan(t.parcela, F.count_if(F.col(INST_STATUS) == late).alias("_late"),
                      F.count("id_parcela").alias("_all"))
    per_account = (t.emprestimo.select("id_emprestimo", "id_conta").join(counts, loan_key(counts))
                   .groupBy("id_conta").agg(F.sum("_late").alias("_late"), F.sum("_all").alias("_all")))
    df = loan_chain(t, "columns", per_account)
    out = df.groupBy("id_agencia", "nome_agencia").agg(F.sum("_late").alias("_late"), F.sum("_all").alias("_all"))
    rate = F.try_divide(as_double("_late") * F.lit(100.0), as_double("_all"))
    return out.select("nome_agencia", round2(rate).alias("taxa_esforco_cobranca"))


def speculative_risk(t: Tables, profile: str = "Pequeno", min_rate=10, min_n: int = 24,
                     status: str = "Ativo") -> DataFrame:
    """Q29 — loans in `status` of `profile` members, modality rate > min_rate,
    more than `min_n` instalments."""
    n_inst = per_loan(t.parcela, F.count("id_parcela").alias("total_parcelas"))
    modal = t.dim("modalidade").where(F.col("taxa_juros_anual") > F.lit(min_rate))
    loans = (t.emprestimo.where(F.col(LOAN_STATUS) == status)
             .join(modal, "id_modalidade")
             .join(n_inst.where(F.col("total_parcelas") > min_n), loan_key(n_inst)))
    owners = account_owners(t, "none").where(F.col("perfil_produtor") == profile)
    df = loans.join(owners, "id_conta")
    return df.select("nome_completo", "nome_modalidade", "total_parcelas")


def loan_range_by_agency(t: Tables, min_range=50000) -> DataFrame:
    """Q32 — largest minus smallest loan per agency, where it exceeds `min_range`."""
    per_account = t.emprestimo.groupBy("id_conta").agg(F.max(V).alias("_max"), F.min(V).alias("_min"))
    df = loan_chain(t, "columns", per_account)
    out = df.groupBy("id_agencia", "nome_agencia").agg(F.max("_max").alias("_max"), F.min("_min").alias("_min"))
    out = out.withColumn("amplitude", F.col("_max") - F.col("_min"))
    return (out.where(F.col("amplitude") > F.lit(min_range)).select("id_agencia", "nome_agencia", "amplitude")
            .orderBy(F.desc("amplitude"), "id_agencia").drop("id_agencia"))
