"""S03 conditional totals: one pass, several status buckets (a manual pivot)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def conditional_totals(df: DataFrame, keys: list[str], value: str | None, status_col: str,
                       buckets: dict[str, list[str]]) -> DataFrame:
    """Per group, SUM(value) (or COUNT when ``value`` is None) for each status bucket.

    Rows outside every bucket add 0; a group with no rows in a bucket gets 0,
    not NULL.  Partial aggregation runs map-side, so a hot group is combined
    before the shuffle.
    """
    st = F.col(status_col)
    aggs = []
    for name, statuses in buckets.items():
        cond = st.isin(*statuses)
        if value is None:
            aggs.append(F.count_if(cond).alias(name))
        else:
            aggs.append(F.sum(F.when(cond, F.col(value)).otherwise(F.lit(0))).alias(name))
    return df.groupBy(*keys).agg(*aggs)
