"""S01 top-n per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RANKERS = {"dense_rank": F.dense_rank, "rank": F.rank, "row_number": F.row_number}


def top_n_per_group(df: DataFrame, keys: list, order: list[Column], n: int,
                    method: str = "dense_rank", rank_col: str = "posicao") -> DataFrame:
    """Rows whose rank inside their group is <= n.

    ``dense_rank`` keeps ties on the same place (may return more than n rows),
    ``rank`` leaves gaps after ties, ``row_number`` needs a total ``order``.
    Catalyst plans a ``WindowGroupLimit`` below the shuffle for all three, so
    each map task forwards at most n candidates per group: a hot group does
    not pull its raw rows into one task.
    """
    if method not in _RANKERS:
        raise ValueError(f"method must be one of {sorted(_RANKERS)}")
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, _RANKERS[method]().over(w)).where(F.col(rank_col) <= n)
