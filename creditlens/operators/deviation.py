"""S04 deviation from the mean of a group.

The group means are a ``groupBy`` (partial aggregation, skew-proof) joined back
to the rows through ``join_groups`` (NULL is a group too).  With a proof that
the groups are few the rows are not shuffled for it; else they are dealt over
salted copies of the groups.  A window ``AVG() OVER (PARTITION BY g)`` would
instead send every row of a low-cardinality group (a profile, a modality) into
one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditlens.functions.columns import mean_of
from creditlens.operators.broadcast import join_groups


def group_means(df: DataFrame, keys: list[str], value: str, mean_col: str) -> DataFrame:
    return df.groupBy(*keys).agg(mean_of(value).alias(mean_col))


def means_from_partials(df: DataFrame, keys: list[str], sum_col: str, count_col: str, mean_col: str) -> DataFrame:
    """Group means from partial (exact) sums and counts, e.g. one row per account:
    the same value as ``group_means`` over the raw rows, with far fewer rows shuffled."""
    return df.groupBy(*keys).agg(
        F.try_divide(F.sum(sum_col).cast("double"), F.sum(count_col).cast("double")).alias(mean_col))


def deviation_from_group_mean(rows: DataFrame, population: DataFrame | None, keys: list[str], value: str,
                              mean_col: str = "media", round_mean: int | None = None,
                              means: DataFrame | None = None, few: bool | None = None) -> DataFrame:
    """``rows`` with the mean of ``value`` over ``population`` in the same group.

    ``population`` may be larger than ``rows`` (e.g. the mean over every status
    while only active loans are listed): filtering the rows never changes the
    mean.  ``means`` may be given instead (see ``means_from_partials``).
    ``round_mean`` rounds the mean before it is used.  ``few`` says whether
    the groups were proven few (``few_groups``); ``None`` leaves the join to
    the planner.
    """
    if means is None:
        means = group_means(population, keys, value, mean_col)
    if round_mean is not None:
        means = means.withColumn(mean_col, F.round(mean_col, round_mean))
    return join_groups(rows, means, keys, few)
