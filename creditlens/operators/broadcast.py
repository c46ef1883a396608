"""Joins of rows with one row per group that leave the rows where they are."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEW_GROUPS = 10_000  # proven by a count that stops there; one group is one narrow row
SALTS = 64

_SALT = "_g_salt"


def few_groups(domain: DataFrame, keys: list[str], limit: int = FEW_GROUPS) -> bool:
    """Whether ``domain`` holds at most ``limit`` distinct keys.

    A distinct of narrow keys (partial aggregation: one row a key and task),
    cut off at ``limit`` + 1 rows.  ``domain`` may be any frame that holds
    every key of the groups, such as the dimension they come from.
    """
    return domain.select(*keys).distinct().limit(limit + 1).count() <= limit


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], few: bool | None = None,
                salts: int = SALTS) -> DataFrame:
    """``rows`` joined with ``groups`` (one row per key); a NULL key meets the NULL group.

    ``few`` is a proof (see ``few_groups``) that the groups fit a broadcast,
    so the planner broadcasts them and no row is moved.  Without it
    (``few=False``) rows are dealt over ``salts`` copies of each group, so the
    rows of one hot group meet it in many tasks.  ``few=None`` leaves the join
    to the planner.
    """
    named = groups.withColumnsRenamed({k: f"_g_{k}" for k in keys})
    cond = reduce(lambda a, b: a & b, (rows[k].eqNullSafe(named[f"_g_{k}"]) for k in keys))
    if few is not False:
        return rows.join(F.broadcast(named) if few else named, cond).drop(*(f"_g_{k}" for k in keys))
    dealt = rows.withColumn(_SALT, F.pmod(F.xxhash64(*rows.columns), F.lit(salts)))
    copies = named.withColumn(f"_g{_SALT}", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    cond = reduce(lambda a, b: a & b, (dealt[k].eqNullSafe(copies[f"_g_{k}"]) for k in keys)) & (dealt[_SALT] == copies[f"_g{_SALT}"])
    return dealt.join(copies, cond).drop(_SALT, f"_g{_SALT}", *(f"_g_{k}" for k in keys))
