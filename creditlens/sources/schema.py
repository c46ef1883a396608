"""The six tables of the credit cooperative, as explicit Spark schemas.

Column names are ASCII lower case.  Money is DECIMAL(15,2) (exact sums),
rates DECIMAL(5,2), dates DateType.  Declared keys and value domains are kept
as data so the audit operators can check them (Spark does not enforce them).
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(15, 2)
RATE = T.DecimalType(5, 2)

AGENCIA = T.StructType([
    T.StructField("id_agencia", T.LongType(), False),
    T.StructField("nome_agencia", T.StringType()),
    T.StructField("cidade", T.StringType()),
])

COOPERADO = T.StructType([
    T.StructField("id_cooperado", T.LongType(), False),
    T.StructField("nome_completo", T.StringType()),
    T.StructField("perfil_produtor", T.StringType()),
    T.StructField("data_associacao", T.DateType()),
    T.StructField("id_agencia", T.LongType()),
])

CONTA = T.StructType([
    T.StructField("id_conta", T.LongType(), False),
    T.StructField("id_cooperado", T.LongType()),
    T.StructField("saldo_atual", MONEY),
    T.StructField("status_conta", T.StringType()),
])

MODALIDADE = T.StructType([
    T.StructField("id_modalidade", T.LongType(), False),
    T.StructField("nome_modalidade", T.StringType()),
    T.StructField("taxa_juros_anual", RATE),
    T.StructField("prazo_maximo_meses", T.IntegerType()),
])

EMPRESTIMO = T.StructType([
    T.StructField("id_emprestimo", T.LongType(), False),
    T.StructField("id_conta", T.LongType()),
    T.StructField("id_modalidade", T.LongType()),
    T.StructField("valor_contratado", MONEY),
    T.StructField("data_contratacao", T.DateType()),
    T.StructField("status_contrato", T.StringType()),
])

PARCELA = T.StructType([
    T.StructField("id_parcela", T.LongType(), False),
    T.StructField("id_emprestimo", T.LongType()),
    T.StructField("numero_parcela", T.IntegerType()),
    T.StructField("valor_parcela", MONEY),
    T.StructField("data_vencimento", T.DateType()),
    T.StructField("data_pagamento", T.DateType()),
    T.StructField("status_parcela", T.StringType()),
])

TABLE_NAMES = ("agencia", "cooperado", "conta", "modalidade", "emprestimo", "parcela")

SCHEMAS: dict[str, T.StructType] = {
    "agencia": AGENCIA,
    "cooperado": COOPERADO,
    "conta": CONTA,
    "modalidade": MODALIDADE,
    "emprestimo": EMPRESTIMO,
    "parcela": PARCELA,
}

# The declared domains of the status/profile columns.
PROFILE_VALUES = ("Pequeno", "Médio", "Grande")
ACCOUNT_STATUS = ("Ativa", "Inativa", "Bloqueada")
LOAN_STATUS = ("Ativo", "Quitado", "Inadimplente")
INSTALMENT_STATUS = ("Pendente", "Paga", "Atrasada")

DOMAINS: dict[tuple[str, str], tuple[str, ...]] = {
    ("cooperado", "perfil_produtor"): PROFILE_VALUES,
    ("conta", "status_conta"): ACCOUNT_STATUS,
    ("emprestimo", "status_contrato"): LOAN_STATUS,
    ("parcela", "status_parcela"): INSTALMENT_STATUS,
}

PRIMARY_KEYS: dict[str, str] = {
    "agencia": "id_agencia",
    "cooperado": "id_cooperado",
    "conta": "id_conta",
    "modalidade": "id_modalidade",
    "emprestimo": "id_emprestimo",
    "parcela": "id_parcela",
}

# (child table, fk column, parent table, parent key)
FOREIGN_KEYS: tuple[tuple[str, str, str, str], ...] = (
    ("cooperado", "id_agencia", "agencia", "id_agencia"),
    ("conta", "id_cooperado", "cooperado", "id_cooperado"),
    ("emprestimo", "id_conta", "conta", "id_conta"),
    ("emprestimo", "id_modalidade", "modalidade", "id_modalidade"),
    ("parcela", "id_emprestimo", "emprestimo", "id_emprestimo"),
)
