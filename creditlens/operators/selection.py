"""Exact order statistics without ordering the whole column.

``values_at_ranks`` returns the values at a few 1-based positions of a
column in ascending order (NULLs first, as in SQL), e.g. a median or a
percentile cut.  Instead of range-sorting all rows it runs three one-row
aggregates and then orders only a narrow candidate window:

1. N (all rows) and the non-NULL count, and in the same pass
2. ``percentile_approx`` brackets [lo, hi] around each target position
   (rank error <= N/accuracy, bracket = target ± 2N/accuracy) where the caller
   knows ``around`` which fraction it lies (else one more pass);
3. exact counts of values < lo and <= hi prove that the target position
   falls inside the bracket (otherwise the bracket is dropped: exact fallback);
4. the values inside the bracket are grouped (a value repeated by a third of
   the rows becomes one row) and ranked by cumulative count — by a window over
   a checked, bounded number of rows, or by S02's slices when the window is
   larger than that bound.

Every pass is a scan with partial aggregation; only scalars reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditlens.operators.segments import positions

SELECTION_ACCURACY = 10_000
# candidate rows above this are ranked with the distributed global order
WINDOW_MAX_ROWS = 200_000


def values_at_ranks(df: DataFrame, value: str, ranks: Callable[[int], list[int]],
                    accuracy: int = SELECTION_ACCURACY, window_max_rows: int = WINDOW_MAX_ROWS,
                   around: float | None = None) -> DataFrame:
    """Rows (``rank`` BIGINT, ``value``) for each distinct k in ``ranks(N)`` with 1 <= k <= N."""
    spark = df.sparkSession
    v = F.col(value)
    vtype = df.schema[value].dataType
    out_schema = T.StructType([T.StructField("rank", T.LongType(), False),
                               T.StructField(value, vtype, True)])

    first = [F.count(F.lit(1)), F.count(v)]
    if around is not None:
        first.append(F.percentile_approx(v, F.array(*(F.lit(x) for x in _bracket(around, accuracy))), accuracy))
    n_all, n_nn, *sketch = df.agg(*first).first()
    wanted = sorted({int(k) for k in ranks(int(n_all)) if 1 <= int(k) <= n_all})
    n_null = n_all - n_nn
    null_ranks = [k for k in wanted if k <= n_null]
    targets = [(k, k - n_null) for k in wanted if k > n_null]  # (rank, position among non-NULL)

    parts = []
    if null_ranks:
        parts.append(spark.createDataFrame([(k, None) for k in null_ranks], out_schema))
    if targets:
        parts.append(_select_non_null(df.where(v.isNotNull()).select(value), value, n_nn, targets,
                                      accuracy, window_max_rows,
                                      sketch[0] if sketch and n_null == 0 else None).select("rank", value))
    if not parts:
        return spark.createDataFrame([], out_schema)
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    return res


def _bracket(fraction: float, accuracy: int) -> list[float]:
    return [max(0.0, fraction - 2.0 / accuracy), min(1.0, fraction + 2.0 / accuracy)]


def _select_non_null(df: DataFrame, value: str, n: int, targets: list[tuple[int, int]],
                     accuracy: int, window_max_rows: int, approx: list | None = None) -> DataFrame:
    spark = df.sparkSession
    v = F.col(value)
    if approx is None:
        fracs = [x for _, pos in targets for x in _bracket(pos / n, accuracy)]
        approx = df.agg(F.percentile_approx(v, F.array(*[F.lit(x) for x in fracs]), accuracy)).first()[0]
    lo = min(approx[0::2])
    hi = max(approx[1::2])
    below, upto = df.agg(F.count_if(v < F.lit(lo)), F.count_if(v <= F.lit(hi))).first()
    if not all(below < pos <= upto for _, pos in targets):
        # the sketch's guarantee did not hold: rank every value (still exact)
        cand, below, upto = df, 0, n
    else:
        cand = df.where((v >= F.lit(lo)) & (v <= F.lit(hi)))

    grouped = cand.groupBy(value).agg(F.count(F.lit(1)).alias("_cnt"))
    if upto - below <= window_max_rows:
        # a proven-bounded candidate set: one small sort is cheaper than a range exchange
        w = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cum = grouped.withColumn("_cum", F.sum("_cnt").over(w))
    else:
        cum = positions(grouped, [], [value], rank_col="_r", running_sum="_cnt", running_col="_cum").drop("_r")
    wanted = spark.createDataFrame([(k, pos - below) for k, pos in targets], "rank long, _pos long")
    hit = (F.col("_cum") - F.col("_cnt") < F.col("_pos")) & (F.col("_pos") <= F.col("_cum"))
    # the targets side holds a handful of rows: broadcast is bounded
    return cum.join(F.broadcast(wanted), hit).select("rank", value)
