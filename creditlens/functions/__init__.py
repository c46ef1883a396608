"""Column-expression helpers shared by the operators and reports."""

from creditlens.functions.columns import (
    as_double, days_between, mean_of, month_key, pct, ratio, report_types, round2,
    tile_from_rank, year_range,
)

__all__ = ["as_double", "days_between", "mean_of", "month_key", "pct", "ratio",
           "report_types", "round2", "tile_from_rank", "year_range"]
