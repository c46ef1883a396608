"""Audit reports: Q17 Q22 Q30, and the declared-constraint audits (S07–S09)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditlens.operators.audit import audit_domain, audit_foreign_key, audit_primary_key
from creditlens.operators.chain import loan_chain, loan_key, per_loan, with_evidence
from creditlens.operators.repeated_keys import SMALL, duplicates
from creditlens.sources.schema import DOMAINS, FOREIGN_KEYS, PRIMARY_KEYS
from creditlens.sources.tables import Tables

V = "valor_contratado"


def term_violations(t: Tables, by: str = "max") -> DataFrame:
    """Q17 — modalities whose largest instalment number (``by='count'``: the
    largest number of instalments of one loan) exceeds the maximum term."""
    if by == "max":
        per = per_loan(t.parcela, F.max("numero_parcela").alias("_m"))
    elif by == "count":
        per = per_loan(t.parcela, F.count(F.lit(1)).alias("_m"))
    else:
        raise ValueError("by must be 'max' or 'count'")
    df = (t.emprestimo.select("id_emprestimo", "id_conta", "id_modalidade").join(per, loan_key(per))
          .join(t.dim("modalidade"), "id_modalidade"))
    out = df.groupBy("nome_modalidade", "prazo_maximo_meses").agg(F.max("_m").alias("maximo_parcelas_praticado"))
    return out.where(F.col("maximo_parcelas_praticado") > F.col("prazo_maximo_meses"))


def contract_instalment_mismatch(t: Tables) -> DataFrame:
    """Q22 — loans whose instalments add up to less than the contracted value
    (a loan without instalments counts as 0)."""
    sums = per_loan(t.parcela, F.sum("valor_parcela").alias("_s"))
    loans = t.emprestimo.join(sums, loan_key(sums), "left")
    df = loan_chain(t, "required", loans)
    total = F.coalesce(F.col("_s"), F.lit(0).cast(sums.schema["_s"].dataType))
    return (df.select("id_emprestimo", "nome_completo", V, total.alias("total_parcelas"))
            .where(F.col("total_parcelas") < F.col(V)))


def duplicate_instalments(t: Tables, distinct: bool = False) -> DataFrame:
    """Q30 — loans with two or more instalments carrying the same number.

    As written a loan is listed once per duplicated number; ``distinct`` once.
    Instalments whose number is proven single are never shuffled."""
    dup = duplicates(t.parcela, [*loan_key(t.parcela), "numero_parcela"], "_n", small=SMALL)
    df = with_evidence(dup, t.emprestimo, loan_key(dup)).select("id_emprestimo")
    return df.distinct() if distinct else df


def primary_key_audit(t: Tables, table: str) -> DataFrame:
    """S07 on one table's declared primary key."""
    return audit_primary_key(t.table(table), PRIMARY_KEYS[table])


def foreign_key_audit(t: Tables, child: str, fk: str) -> DataFrame:
    """S08 on one declared foreign key."""
    for c, f, parent, pk in FOREIGN_KEYS:
        if (c, f) == (child, fk):
            return audit_foreign_key(t.table(child), fk, t.table(parent), pk)
    raise KeyError((child, fk))


def domain_audit(t: Tables, table: str, col: str) -> DataFrame:
    """S09 on one declared value list."""
    return audit_domain(t.table(table), col, DOMAINS[(table, col)])
