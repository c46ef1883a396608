"""Tiny hand-made six-table fixtures (schema of creditlens.sources.schema)."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from creditlens.sources.tables import tables_from_rows

D = dt.date


def money(x) -> Decimal:
    return Decimal(str(x)).quantize(Decimal("0.01"))


def ag(i, nome=None, cidade=None):
    return (i, nome or f"Agencia {i}", cidade or f"Cidade {i}")


def co(i, agencia=1, perfil="Pequeno", assoc=D(2020, 1, 1), nome=None):
    return (i, nome or f"Membro {i}", perfil, assoc, agencia)


def ct(i, coop, saldo=0, status="Ativa"):
    return (i, coop, money(saldo), status)


def md(i, nome=None, taxa=10, prazo=12):
    return (i, nome or f"Modalidade {i}", Decimal(str(taxa)).quantize(Decimal("0.01")), prazo)


def em(i, conta, valor, data=D(2024, 1, 15), status="Ativo", modalidade=1):
    return (i, conta, modalidade, money(valor), data, status)


def pa(i, loan, num=1, valor=10, venc=D(2024, 2, 1), pag=None, status="Pendente"):
    return (i, loan, num, money(valor), venc, pag, status)


def tables(spark, agencia=None, cooperado=(), conta=(), modalidade=None, emprestimo=(), parcela=()):
    return tables_from_rows(
        spark,
        agencia=list(agencia if agencia is not None else [ag(1)]),
        cooperado=list(cooperado),
        conta=list(conta),
        modalidade=list(modalidade if modalidade is not None else [md(1)]),
        emprestimo=list(emprestimo),
        parcela=list(parcela),
    )


def rows(df, *cols):
    """Sorted list of tuples of the selected columns (all when none given)."""
    cols = cols or tuple(df.columns)
    out = [tuple(r[c] for c in cols) for r in df.collect()]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))
