"""CRM reports: Q08 Q11 Q39."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditlens.operators.chain import account_owners, loan_chain, with_evidence
from creditlens.operators.moments import central, merged_with, power_sums
from creditlens.sources.tables import Tables

V = "valor_contratado"


def good_payers(t: Tables, strict: bool = False, account_status: str = "Ativa",
                settled: str = "Quitado") -> DataFrame:
    """Q08 — active accounts with balance >= 0 (> 0 with ``strict``) that have
    at least one settled loan: member, agency city, balance (one row per account)."""
    bal = F.col("saldo_atual")
    accounts = t.conta.where((F.col("status_conta") == account_status) & ((bal > 0) if strict else (bal >= 0)))
    evidence = t.emprestimo.where(F.col("status_contrato") == settled)
    accounts = with_evidence(accounts, evidence, "id_conta")
    return account_owners(t, "columns", accounts).select("nome_completo", "cidade", "saldo_atual")


def ghost_members(t: Tables, statuses=("Ativa", "Inativa", "Bloqueada"), distinct: bool = False) -> DataFrame:
    """Q11 — members owning an account (in `statuses`) who never borrowed on any
    of their accounts.  One row per account as written; ``distinct`` collapses."""
    # accounts with a loan, deduplicated map-side before they meet the accounts table
    borrowers = t.emprestimo.select("id_conta").distinct().join(t.conta.select("id_conta", "id_cooperado"), "id_conta")
    accounts = t.conta.where(F.col("status_conta").isin(*statuses))
    owners = account_owners(t, "columns", accounts)
    df = with_evidence(owners, borrowers, "id_cooperado", negate=True)
    df = df.select("id_cooperado", "nome_completo", "cidade", "data_associacao")
    return df.distinct() if distinct else df


def _tenure_years(full_years: bool):
    c, a = F.col("data_contratacao"), F.col("data_associacao")
    anos = F.year(c) - F.year(a)
    if full_years:
        before_anniversary = (F.month(c) < F.month(a)) | ((F.month(c) == F.month(a)) & (F.dayofmonth(c) < F.dayofmonth(a)))
        anos = anos - F.when(before_anniversary, 1).otherwise(0)
    return anos.cast("bigint")


def mean_ticket_by_tenure(t: Tables, full_years: bool = False) -> DataFrame:
    """Q39 — mean loan value by member tenure in years at contracting.

    As written tenure is the difference of calendar years; ``full_years``
    counts completed years (the anniversary must have been reached).  Loans are
    first summed per account and contract year (per contract date for
    ``full_years``), so the member join shuffles partial sums, not loans."""
    if full_years:
        when = F.col("data_contratacao")
    else:
        when = F.make_date(F.year("data_contratacao"), F.lit(1), F.lit(1))  # only the year matters
    partials = (t.emprestimo.groupBy("id_conta", when.alias("data_contratacao"))
                .agg(F.sum(V).alias("_s"), F.count(V).alias("_n")))
    df = loan_chain(t, "none", partials)
    out = df.groupBy(_tenure_years(full_years).alias("anos")).agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
    return out.select("anos", F.try_divide(F.col("_s").cast("double"), F.col("_n").cast("double")).alias("ticket_medio")).orderBy("anos")


def tenure_value_correlation(t: Tables, full_years: bool = False) -> DataFrame:
    """Q39 option — Pearson correlation between tenure (years) and loan value,
    the measure the question's title names; one row, rounded to 6 decimals.

    Loans become exact power sums per account and date before they meet the
    members; the sums merge and are centred without loss (``operators.moments``)."""
    when = F.col("data_contratacao") if full_years else F.make_date(F.year("data_contratacao"), F.lit(1), F.lit(1))
    partials = (t.emprestimo.where(F.col(V).isNotNull())
                .groupBy("id_conta", when.alias("data_contratacao")).agg(*power_sums(V)))
    rows = loan_chain(t, "none", partials).withColumn("_anos", _tenure_years(full_years)).where("_anos IS NOT NULL")
    return central(rows.agg(*merged_with(F.col("_anos")))).select(F.round("corr", 6).alias("correlacao"))
