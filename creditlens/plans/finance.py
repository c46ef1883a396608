"""Finance reports: Q05 Q09 Q12 Q13 Q18 Q20 Q27."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditlens.functions.columns import days_between, month_key, round2
from creditlens.operators.chain import account_owners, loan_chain, loan_key, loans_with_owner, per_loan
from creditlens.operators.conditional import conditional_totals
from creditlens.operators.period import period_change
from creditlens.operators.segments import SMALL, moving_mean
from creditlens.sources.tables import Tables

V = "valor_contratado"
INST_STATUS = "status_parcela"


def mom_growth(t: Tables, year: int = 2023, fill_calendar: bool = False) -> DataFrame:
    """Q05 — monthly volume of `year`, the previous month's volume and growth %.

    As written the previous month is the previous month *with loans*;
    ``fill_calendar`` lists all twelve months (missing ones with volume 0)."""
    # per (account, month) partial sums first: the owner check shuffles one row per account-month
    per_account = (t.loans_of_year(year)
                   .groupBy("id_conta", month_key("data_contratacao").alias("mes"))
                   .agg(F.sum(V).alias("_v")))
    totals = loans_with_owner(t, per_account).groupBy("mes").agg(F.sum("_v").alias("total_atual"))
    if fill_calendar:
        spark = t.spark
        months = spark.range(1, 13).select(
            F.format_string("%04d-%02d", F.lit(year), F.col("id").cast("int")).alias("mes"))
        zero = F.lit(0).cast(totals.schema["total_atual"].dataType)
        totals = months.join(totals, "mes", "left").select("mes", F.coalesce("total_atual", zero).alias("total_atual"))
    return period_change(totals, "mes", "total_atual", "total_mes_anterior", "crescimento_percentual").orderBy("mes")


def cashflow_by_modality(t: Tables) -> DataFrame:
    """Q09 — per modality: Σ paid instalments and Σ pending + late instalments."""
    buckets = {"soma_status_pagas": ["Paga"], "parcelas_atrasadas_pendentes": ["Pendente", "Atrasada"]}
    loans_sums = conditional_totals(t.parcela, loan_key(t.parcela), "valor_parcela", INST_STATUS, buckets)
    df = (t.emprestimo.select("id_emprestimo", "id_conta", "id_modalidade").join(loans_sums, loan_key(loans_sums))
          .join(t.dim("modalidade"), "id_modalidade"))
    return (df.groupBy("nome_modalidade").agg(*[F.sum(b).alias(b) for b in buckets])
            .orderBy(F.desc("soma_status_pagas")))


def balance_vs_debt(t: Tables, unpaid=("Pendente", "Atrasada"), as_asked: bool = False) -> DataFrame:
    """Q12 — members whose balance is below their unpaid instalments.

    As written the balance is summed once per unpaid instalment row (the join
    fans it out): Σ over accounts of balance × number of unpaid instalments.
    ``as_asked`` compares the member's balance (each account once) instead."""
    debt = per_loan(t.parcela.where(F.col(INST_STATUS).isin(*unpaid)),
                    F.sum("valor_parcela").alias("_debt"), F.count(F.lit(1)).alias("_n"))
    per_account = (t.emprestimo.select("id_emprestimo", "id_conta").join(debt, loan_key(debt))
                   .groupBy("id_conta").agg(F.sum("_debt").alias("_debt"), F.sum("_n").alias("_n")))
    df = loan_chain(t, "required", per_account)
    if as_asked:
        members_debt = df.groupBy("id_cooperado", "nome_completo").agg(
            F.sum("_debt").alias("valor_total_dividas_pendentes"))
        balances = account_owners(t, "required").groupBy("id_cooperado").agg(
            F.sum("saldo_atual").alias("saldo_atual"))
        out = members_debt.join(balances, "id_cooperado")
    else:
        out = df.groupBy("id_cooperado", "nome_completo").agg(
            F.sum("_debt").alias("valor_total_dividas_pendentes"),
            F.sum(F.col("saldo_atual") * F.col("_n")).alias("saldo_atual"))
    return (out.where(F.col("saldo_atual") < F.col("valor_total_dividas_pendentes"))
            .select("nome_completo", "saldo_atual", "valor_total_dividas_pendentes"))


def avg_payment_delay(t: Tables, paid: str = "Paga") -> DataFrame:
    """Q13 — mean days between due date and payment of paid instalments, per profile."""
    d = days_between("data_pagamento", "data_vencimento")
    per = per_loan(t.parcela.where(F.col(INST_STATUS) == paid), F.sum(d).alias("_s"), F.count(d).alias("_c"))
    per_account = (t.emprestimo.select("id_emprestimo", "id_conta").join(per, loan_key(per))
                   .groupBy("id_conta").agg(F.sum("_s").alias("_s"), F.sum("_c").alias("_c")))
    df = loan_chain(t, "required", per_account)
    out = df.groupBy("perfil_produtor").agg(F.sum("_s").alias("_s"), F.sum("_c").alias("_c"))
    media = F.try_divide(F.col("_s").cast("double"), F.col("_c").cast("double"))
    return out.select("perfil_produtor", round2(media).alias("media")).orderBy(F.desc("media"))


def moving_average(t: Tables, id_modalidade: int | None = 4, width: int = 3, bucket_rows: int = 1_000_000,
                   small: int = SMALL) -> DataFrame:
    """Q18 — loans of one modality in (date, id) order with the mean of the
    current and `width`-1 preceding loans.

    ``id_modalidade=None`` does so within every modality at once, with the
    modality's id and the loan's place in it.  Positions are exact (S02 within
    groups) and the frames are computed bucket by bucket, so a modality that
    holds a third of the loans is spread over tasks.
    """
    loans = t.emprestimo
    if id_modalidade is not None:
        loans = loans.where(F.col("id_modalidade") == id_modalidade)
    loans = loans.select("id_modalidade", "id_emprestimo", "data_contratacao", V)
    df = moving_mean(loans, ["id_modalidade"], ["data_contratacao", "id_emprestimo"], V, width, "media_movel",
                     rank_col="posicao", bucket_rows=bucket_rows, store=False, small=small)
    cols = ["data_contratacao", V, "media_movel"] + ([] if id_modalidade is not None else ["id_modalidade", "posicao"])
    return df.orderBy("id_modalidade", "posicao").select(*cols)


def instalment_pivot(t: Tables) -> DataFrame:
    """Q20 — per agency name: Σ paid, Σ pending, Σ late instalment values."""
    buckets = {"total_parcelas_pagas": ["Paga"], "total_parcelas_pendentes": ["Pendente"],
               "total_parcelas_atrasadas": ["Atrasada"]}
    sums = conditional_totals(t.parcela, loan_key(t.parcela), "valor_parcela", INST_STATUS, buckets)
    per_account = (t.emprestimo.select("id_emprestimo", "id_conta").join(sums, loan_key(sums))
                   .groupBy("id_conta").agg(*[F.sum(b).alias(b) for b in buckets]))
    df = loan_chain(t, "columns", per_account)
    return df.groupBy("nome_agencia").agg(*[F.sum(b).alias(b) for b in buckets])


def daily_running_total(t: Tables, year: int = 2024) -> DataFrame:
    """Q27 — daily volume in `year` with its cumulative sum since 1 January.

    The window orders at most 366 pre-aggregated rows."""
    per_account = (t.loans_of_year(year)
                   .groupBy("id_conta", "data_contratacao").agg(F.sum(V).alias("_v")))
    daily = loan_chain(t, "required", per_account).groupBy("data_contratacao").agg(F.sum("_v").alias("total"))
    w = Window.orderBy("data_contratacao").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return daily.select("total", "data_contratacao", F.sum("total").over(w).alias("soma_acumulada"))
