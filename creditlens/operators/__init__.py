"""Reusable relational operators (S01–S11)."""

from creditlens.operators.audit import audit_domain, audit_foreign_key, audit_primary_key
from creditlens.operators.broadcast import few_groups, join_groups
from creditlens.operators.chain import (account_owners, loan_chain, loans_with_owner, members,
                                        per_loan, with_evidence)
from creditlens.operators.conditional import conditional_totals
from creditlens.operators.deviation import deviation_from_group_mean, group_means
from creditlens.operators.dispersion import dispersion, exact_moments
from creditlens.operators.repeated_keys import duplicates, suspects
from creditlens.operators.global_order import global_ntile, global_rank
from creditlens.operators.mode import mode, proven_mode
from creditlens.operators.moments import central, merged, merged_with, power_sums
from creditlens.operators.period import period_change
from creditlens.operators.ranking import top_n_per_group
from creditlens.operators.segments import moving_mean, positions
from creditlens.operators.selection import values_at_ranks

__all__ = [
    "audit_domain", "central", "merged", "merged_with", "power_sums", "audit_foreign_key", "audit_primary_key", "few_groups", "join_groups", "account_owners",
    "loan_chain", "loans_with_owner", "members", "per_loan", "with_evidence",
    "conditional_totals", "deviation_from_group_mean", "group_means", "dispersion", "duplicates", "suspects", "exact_moments",
    "global_ntile", "global_rank", "mode", "moving_mean", "proven_mode", "period_change", "positions", "top_n_per_group",
    "values_at_ranks",
]
