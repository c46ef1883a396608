"""Ranking reports: Q01 Q07 Q14 Q15 Q21 Q23 Q26."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditlens.functions.columns import days_between, month_key, pct, tile_from_rank
from creditlens.operators.chain import loan_chain, loan_key, members
from creditlens.operators.global_order import global_rank
from creditlens.operators.ranking import top_n_per_group
from creditlens.operators.segments import SMALL, positions
from creditlens.sources.tables import Tables

V = "valor_contratado"


def top_loans_per_agency(t: Tables, start=dt.date(2024, 1, 1), end=dt.date(2025, 1, 1), k: int = 2,
                         method: str = "dense_rank") -> DataFrame:
    """Q01 — loans contracted in [start, end) whose value is among the top-k
    (dense-ranked: ties share a place) of their agency."""
    df = loan_chain(t, "columns", t.loans_between(start, end))
    ranked = top_n_per_group(df, ["id_agencia"], [F.desc(V)], k, method, "posicao")
    return ranked.select("nome_agencia", "nome_completo", V, F.col("posicao").cast("bigint").alias("posicao"))


def running_total_by_agency(t: Tables, id_agencia: int | None = 1, status: str = "Ativo",
                            with_share: bool = False, small: int = SMALL) -> DataFrame:
    """Q07 — the agency's loans in `status`, by value descending, with the
    running total (and, with ``with_share``, the cumulative % of the total).

    ``id_agencia=None`` gives every agency its own running total, with the
    agency's id and the loan's place in it."""
    loans = t.emprestimo.where(F.col("status_contrato") == status)
    chain = loan_chain(t, "columns", loans)
    if id_agencia is not None:
        chain = chain.where(F.col("id_agencia") == id_agencia)
    df = chain.select("id_agencia", "id_emprestimo", "nome_completo", "nome_agencia", V)
    ranked = positions(df, ["id_agencia"], [f"-{V}", "id_emprestimo"], rank_col="posicao",
                       running_sum=V, running_col="running_total", total_sum_col="_total" if with_share else None, small=small)
    cols = ["id_emprestimo", "nome_completo", "nome_agencia", V, "running_total"]
    if with_share:
        ranked = ranked.withColumn("pct_acumulado", F.round(pct("running_total", "_total"), 2))
        cols.append("pct_acumulado")
    if id_agencia is None:
        cols += ["id_agencia", "posicao"]
    return ranked.orderBy("id_agencia", "posicao").select(*cols)


def member_totals(t: Tables, extra: list[str] = ()) -> DataFrame:
    """Σ loan value per member who has a valid agency (loans summed per account first)."""
    per_account = t.emprestimo.groupBy("id_conta").agg(F.sum(V).alias("_v"))
    df = loan_chain(t, "required", per_account)
    return df.groupBy("id_cooperado", "nome_completo", *extra).agg(F.sum("_v").alias("total"))


def member_tiers(t: Tables, n: int = 4) -> DataFrame:
    """Q14 — NTILE(n) of members by total borrowed; tier 1 = largest."""
    totals = member_totals(t)
    ranked = global_rank(totals, [F.desc("total"), F.asc("id_cooperado")], rank_col="_rn", total_col="_n")
    return ranked.select("id_cooperado", "nome_completo", "total",
                         tile_from_rank("_rn", "_n", n).alias("tier"))


def extreme_deciles(t: Tables, n: int = 10, keep=(1, 10)) -> DataFrame:
    """Q26 — members in the first and last NTILE(n) by total borrowed."""
    totals = member_totals(t, ["perfil_produtor"])
    ranked = global_rank(totals, [F.desc("total"), F.asc("id_cooperado")], rank_col="_rn", total_col="_n")
    tiled = ranked.withColumn("decil", tile_from_rank("_rn", "_n", n))
    return tiled.where(F.col("decil").isin(*keep)).select("nome_completo", "perfil_produtor", "total", "decil")


def next_due_instalment(t: Tables, loan_status: str = "Ativo", pending: str = "Pendente") -> DataFrame:
    """Q15 — for each loan in `loan_status`, its pending instalment with the
    earliest due date (ties: lowest instalment id)."""
    # (due date, id) as one number, no date first: a fixed-width ordering that a hash aggregate can hold
    due = F.coalesce(F.datediff("data_vencimento", F.lit("1970-01-01")), F.lit(-10_000_000)).cast("decimal(18,0)")
    order = due * F.lit(Decimal(10**19)) + F.coalesce("id_parcela", F.lit(0)).cast("decimal(20,0)")
    first = (t.parcela.where(F.col("status_parcela") == pending)
             .groupBy(*loan_key(t.parcela))
             .agg(F.min_by("data_vencimento", order).alias("data_vencimento"),
                  F.min_by("valor_parcela", order).alias("valor_parcela")))
    loans = t.emprestimo.where(F.col("status_contrato") == loan_status).join(first, loan_key(first))
    df = loan_chain(t, "required", loans)
    return df.select("id_emprestimo", "nome_completo",
                     "valor_parcela", "data_vencimento")


def flash_association(t: Tables, max_days: int = 30, min_value=None) -> DataFrame:
    """Q21 — members whose first loan came 0..max_days days after joining.

    ``min_value`` (optional) keeps only members whose first-day loans include
    one of at least that value ("giant" loans in the question)."""
    # earliest date, and the largest value contracted on that date: first per
    # account (partial aggregation), then per member across their accounts
    # (one number, so that hash aggregates hold it: days * 10^18 minus the value in cents)
    days = F.datediff("data_contratacao", F.lit("1970-01-01")).cast("decimal(19,0)") * F.lit(Decimal(10**18))
    cents = F.coalesce(F.col(V), F.lit(0)).cast("decimal(17,2)") * 100
    per_account = t.emprestimo.groupBy("id_conta").agg(F.min((days - cents).cast("decimal(38,0)")).alias("_f"),
                                                       F.min("data_contratacao").alias("data_contratacao"))
    first = (per_account.join(t.conta.select("id_conta", "id_cooperado"), "id_conta")
             .groupBy("id_cooperado").agg(F.min("_f").alias("_f"), F.min("data_contratacao").alias("data_contratacao"))
             .select("id_cooperado", "data_contratacao", ((days - F.col("_f")) / 100).alias("_first_max")))
    df = first.join(members(t, "required"), "id_cooperado")
    df = df.withColumn("diferenca_dias", days_between("data_contratacao", "data_associacao"))
    df = df.where((F.col("diferenca_dias") >= 0) & (F.col("diferenca_dias") <= max_days))
    if min_value is not None:
        df = df.where(F.col("_first_max") >= F.lit(min_value))
    return df.select("nome_completo", "data_associacao", "data_contratacao", "diferenca_dias")


def golden_month(t: Tables, year: int = 2024, as_asked: bool = False) -> DataFrame:
    """Q23 — each agency's month of `year` with the largest volume (ties: earliest month).

    As written the ranking groups agencies by *name*; ``as_asked`` ranks per agency id."""
    per_account = (t.loans_of_year(year)
                   .groupBy("id_conta", month_key("data_contratacao").alias("mes")).agg(F.sum(V).alias("_v")))
    df = loan_chain(t, "columns", per_account)
    totals = df.groupBy("id_agencia", "nome_agencia", "mes").agg(F.sum("_v").alias("total"))
    part = "id_agencia" if as_asked else "nome_agencia"
    best = top_n_per_group(totals, [part], [F.desc("total"), F.asc("mes")], 1, "row_number", "_r")
    return best.select("nome_agencia", "mes", "total")
