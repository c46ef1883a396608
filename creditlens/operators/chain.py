"""S11 loan chain and S10 evidence joins.

Join order is chosen for scale: the member side (account -> member -> agency)
is joined first, because it is far smaller than the loans; loans are then
joined to it on ``id_conta`` with a single shuffle of the loan rows.
Instalments are never joined raw to the chain: the reports aggregate them per
loan first (one row per loan crosses the next shuffle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from creditlens.sources.tables import Tables

OWNED = "tem_titular"  # set in stored accounts whose member exists
AGENCY_MODES = ("columns", "required", "none")


def _attach_agency(df: DataFrame, t: Tables, agency: str) -> DataFrame:
    if agency == "columns":
        return df.join(t.dim("agencia"), "id_agencia")
    if agency == "required":
        # the report joins the agency only to drop members without a valid one
        return df.join(t.dim("agencia").select("id_agencia"), "id_agencia", "left_semi")
    if agency == "none":
        return df
    raise ValueError(f"agency must be one of {AGENCY_MODES}, got {agency!r}")


def members(t: Tables, agency: str = "columns") -> DataFrame:
    """Members, optionally restricted to / enriched with their agency."""
    return _attach_agency(t.cooperado, t, agency)


def account_owners(t: Tables, agency: str = "columns", accounts: DataFrame | None = None) -> DataFrame:
    """Accounts joined to their member (and agency): one row per account.

    Stored tables (``sources.stored``) hold the member's columns in the
    account's row, so nothing is joined but the agency."""
    accounts = t.conta if accounts is None else accounts
    if OWNED in accounts.columns:
        return _attach_agency(accounts.where(OWNED).drop(OWNED), t, agency)
    return accounts.join(members(t, agency), "id_cooperado")


def loan_key(df: DataFrame) -> list[str]:
    """What identifies a loan in ``df``: its id, after the account it is stored with if the rows carry it.

    Instalments of stored tables lie in the bucket of their account; grouping
    and joining on (account, loan) then needs no exchange."""
    return ["id_conta", "id_emprestimo"] if "id_conta" in df.columns else ["id_emprestimo"]


def loan_chain(t: Tables, agency: str = "columns", loans: DataFrame | None = None,
               modality: bool = False, accounts: DataFrame | None = None) -> DataFrame:
    """Loans (or any frame keyed by ``id_conta``) joined to account, member, agency.

    ``loans`` may be a pre-aggregated frame with one row per account; the
    chain only needs its ``id_conta`` column.
    """
    loans = t.emprestimo if loans is None else loans
    df = loans.join(account_owners(t, agency, accounts), "id_conta")
    if modality:
        df = df.join(t.dim("modalidade"), "id_modalidade")
    return df


def with_evidence(df: DataFrame, evidence: DataFrame, key: str | list[str], negate: bool = False) -> DataFrame:
    """Rows of ``df`` that have (``negate``: have no) matching ``key`` in ``evidence``.

    A correlated EXISTS / NOT EXISTS written as a semi / anti join.  The
    evidence is reduced to its distinct keys first: a map-side partial
    aggregate (a key repeated by a third of the rows collapses before the
    shuffle), and its output is already hash-partitioned on the join key, so
    the join adds no exchange on that side.
    """
    keys = [key] if isinstance(key, str) else list(key)
    return df.join(evidence.select(*keys).distinct(), keys, "left_anti" if negate else "left_semi")


def loans_with_owner(t: Tables, loans: DataFrame | None = None) -> DataFrame:
    """Loans whose account and member exist (the inner-join presence filter)."""
    loans = t.emprestimo if loans is None else loans
    if OWNED in t.conta.columns:
        owned = t.conta.where(OWNED)
    else:
        owned = t.conta.select("id_conta", "id_cooperado").join(
            t.cooperado.select("id_cooperado"), "id_cooperado", "left_semi")
    return loans.join(owned.select("id_conta"), "id_conta", "left_semi")


def per_loan(parcela: DataFrame, *aggs) -> DataFrame:
    """Instalments aggregated to one row per loan (map-side partial aggregation)."""
    return parcela.groupBy(*loan_key(parcela)).agg(*aggs)

