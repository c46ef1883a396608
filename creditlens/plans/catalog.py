"""Registered reports: name -> (function, parameters).

``PARAMS`` holds the thresholds used on the driver's data (FIXTURES §2); the
oracle SQL in ``creditlens.plans.oracle`` reads the same dict.  The report
functions' own defaults are the questions' original literals.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from creditlens.functions.columns import report_types
from creditlens.plans import audit, crm, finance, ranking, risk, stats
from creditlens.sources.schema import DOMAINS, FOREIGN_KEYS, PRIMARY_KEYS
from creditlens.sources.star_mapping import from_star_schema
from creditlens.sources.tables import Tables

# Thresholds for the driver's data (orders span 1995..2001; see FIXTURES §2).
PARAMS = {
    "q01_year": 1998,
    "q01_k": 2,
    "q04_factor": 1.9,
    "q05_year": 2001,  # the driver's orders end in August
    "q07_agency": 1,
    "q18_modality": 4,
    "q18_width": 3,
    "q19_min_volume": 1500000,
    "q21_max_days": 30,
    "q21_min_value": 200000,
    "q23_year": 1998,
    "q27_year": 1998,
    "q29_profile": "BUILDING",
    "q29_min_rate": 10,
    "q29_min_n": 5,
    "q32_min_range": 490000,
    "q37_z": 1.7,
    "q14_n": 4,
    "q26_n": 10,
}
P = PARAMS

_year = lambda y: dict(start=dt.date(y, 1, 1), end=dt.date(y + 1, 1, 1))

REPORTS: dict[str, tuple[Callable[..., DataFrame], dict]] = {
    "q01_top_loans_per_agency": (ranking.top_loans_per_agency, dict(**_year(P["q01_year"]), k=P["q01_k"])),
    "q02_ticket_vs_modality_mean": (risk.ticket_vs_modality_mean, {}),
    "q03_default_rate_by_profile": (risk.default_rate_by_profile, {}),
    "q04_outliers_vs_profile_mean": (risk.outliers_vs_profile_mean, dict(factor=P["q04_factor"])),
    "q05_mom_growth": (finance.mom_growth, dict(year=P["q05_year"])),
    "q06_hidden_risk": (risk.hidden_risk, {}),
    "q07_running_total_by_agency": (ranking.running_total_by_agency, dict(id_agencia=P["q07_agency"])),
    "q08_good_payers": (crm.good_payers, {}),
    "q09_cashflow_by_modality": (finance.cashflow_by_modality, {}),
    "q10_risk_score_summary": (risk.risk_score_summary, {}),
    "q11_ghost_members": (crm.ghost_members, {}),
    "q12_balance_vs_debt": (finance.balance_vs_debt, {}),
    "q13_avg_payment_delay": (finance.avg_payment_delay, {}),
    "q14_member_tiers": (ranking.member_tiers, dict(n=P["q14_n"])),
    "q15_next_due_instalment": (ranking.next_due_instalment, {}),
    "q16_weighted_rate_by_agency": (risk.weighted_rate_by_agency, {}),
    "q17_term_violations": (audit.term_violations, {}),
    "q18_moving_average": (finance.moving_average, dict(id_modalidade=P["q18_modality"], width=P["q18_width"])),
    "q19_vip_defaulters": (risk.vip_defaulters, dict(min_volume=P["q19_min_volume"])),
    "q20_instalment_pivot": (finance.instalment_pivot, {}),
    "q21_flash_association": (ranking.flash_association, dict(max_days=P["q21_max_days"])),
    "q22_contract_instalment_mismatch": (audit.contract_instalment_mismatch, {}),
    "q23_golden_month": (ranking.golden_month, dict(year=P["q23_year"])),
    "q24_time_to_default": (risk.time_to_default, {}),
    "q25_recovered_members": (risk.recovered_members, {}),
    "q26_extreme_deciles": (ranking.extreme_deciles, dict(n=P["q26_n"])),
    "q27_daily_running_total": (finance.daily_running_total, dict(year=P["q27_year"])),
    "q28_collection_effort": (risk.collection_effort, {}),
    "q29_speculative_risk": (risk.speculative_risk, dict(profile=P["q29_profile"], min_rate=P["q29_min_rate"],
                                                         min_n=P["q29_min_n"])),
    "q30_duplicate_instalments": (audit.duplicate_instalments, {}),
    "q31_modal_rate": (stats.modal_rate, {}),
    "q32_loan_range_by_agency": (risk.loan_range_by_agency, dict(min_range=P["q32_min_range"])),
    "q33_lower_median": (stats.lower_median, {}),
    "q34_variance": (stats.variance, {}),
    "q35_stddev": (stats.stddev, {}),
    "q36_cv_by_profile": (stats.cv_by_profile, {}),
    "q37_zscore_outliers": (stats.zscore_outliers, dict(z=P["q37_z"])),
    "q38_p90_cut": (stats.p90_cut, {}),
    "q39_mean_ticket_by_tenure": (crm.mean_ticket_by_tenure, {}),
    "q40_distribution_summary": (stats.distribution_summary, {}),
    # options where the question asks for something other than its SQL
    "q02_with_mean": (risk.ticket_vs_modality_mean, dict(with_mean=True)),
    "q05_fill_calendar": (finance.mom_growth, dict(year=P["q05_year"], fill_calendar=True)),
    "q07_with_share": (ranking.running_total_by_agency, dict(id_agencia=P["q07_agency"], with_share=True)),
    "q07_all_agencies": (ranking.running_total_by_agency, dict(id_agencia=None, with_share=True)),
    "q08_strict": (crm.good_payers, dict(strict=True)),
    "q10_include_no_history": (risk.risk_score_summary, dict(include_no_history=True)),
    "q11_distinct": (crm.ghost_members, dict(distinct=True)),
    "q12_as_asked": (finance.balance_vs_debt, dict(as_asked=True)),
    "q17_by_count": (audit.term_violations, dict(by="count")),
    "q18_all_modalities": (finance.moving_average, dict(id_modalidade=None, width=P["q18_width"])),
    "q21_min_value": (ranking.flash_association, dict(max_days=P["q21_max_days"], min_value=P["q21_min_value"])),
    "q23_as_asked": (ranking.golden_month, dict(year=P["q23_year"], as_asked=True)),
    "q25_ordered": (risk.recovered_members, dict(ordered=True)),
    "q30_distinct": (audit.duplicate_instalments, dict(distinct=True)),
    "q39_full_years": (crm.mean_ticket_by_tenure, dict(full_years=True)),
    "q39_correlation": (crm.tenure_value_correlation, {}),
    "q40_as_asked": (stats.distribution_summary, dict(as_asked=True)),
    "q40_with_skewness": (stats.distribution_summary, dict(with_skewness=True)),
}

# declared-constraint audits (S07–S09), one per key / foreign key / value list
for _tbl, _key in PRIMARY_KEYS.items():
    REPORTS[f"audit_pk_{_tbl}"] = (audit.primary_key_audit, dict(table=_tbl))
for _child, _fk, _parent, _pk in FOREIGN_KEYS:
    REPORTS[f"audit_fk_{_child}_{_fk}"] = (audit.foreign_key_audit, dict(child=_child, fk=_fk))
for (_tbl, _col) in DOMAINS:
    REPORTS[f"audit_domain_{_tbl}_{_col}"] = (audit.domain_audit, dict(table=_tbl, col=_col))

_BUNDLES: dict = {}


def load(spark: SparkSession, sf_dir: str) -> Tables:
    """The mapped six tables for ``sf_dir`` (one bundle per session and folder,
    so dimension size checks run once)."""
    key = (id(spark), sf_dir)
    t = _BUNDLES.get(key)
    if t is None or t.spark is not spark:
        t = from_star_schema(spark, sf_dir)
        _BUNDLES[key] = t
    return t


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    fn, params = REPORTS[name]
    return report_types(fn(load(spark, sf_dir), **params))


def query_callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, _n=name: run(_n, spark, sf_dir)) for name in REPORTS}
