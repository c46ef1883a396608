"""S05 period-over-period change."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditlens.functions.columns import ratio


def period_change(totals: DataFrame, period: str, value: str, previous_col: str,
                  change_col: str) -> DataFrame:
    """Previous period's value (LAG over existing periods) and the % change.

    ``totals`` has one row per period (already aggregated; a year has at most
    12 months or 366 days), so the un-partitioned window orders a bounded
    handful of rows, never raw data.
    """
    w = Window.orderBy(period)
    prev = F.lag(value).over(w)
    out = totals.withColumn(previous_col, prev)
    change = F.round(ratio(F.col(value) - F.col(previous_col), previous_col) * F.lit(100.0), 2)
    return out.withColumn(change_col, change)
