"""S02 within groups: exact positions and running sums in every group, with one exchange of the rows.

``Window.partitionBy(group).orderBy(...)`` moves a whole group into one task,
so a group that holds a third of the rows does not scale.  Here the total
order (group keys, order) is cut into slices of about equal size and every
slice is a window partition of its own:

1. at most ``SAMPLE`` rows a slice are sampled and sorted; their quantiles are
   the slice bounds (bounded by the number of slices, not by the data);
2. each row finds its slice by a binary search over the bounds, a built-in
   expression over one broadcast row;
3. counts and sums per (group, slice) get an exclusive prefix within the
   group.  A group has at most one such row per slice, and the prefix starts
   anew with every group;
4. each prefix becomes a *carry row*, placed before the rows of its (group,
   slice).  One window partitioned by (group, slice) then yields position and
   running sum, so rows and carries are exchanged once and nothing is joined
   back.  A NULL group key is a group like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditlens.session import materialize

SAMPLE = 20  # sampled rows per slice
SMALL = 200_000  # rows of a report that fit one task

_BOUNDS, _SLICE, _FIRST, _N, _V, _TOT, _TSUM = (f"_sg_{x}" for x in ("bounds", "slice", "first", "n", "v", "tot", "tsum"))


def _named(order: list[str]) -> list[tuple[str, bool]]:
    """('-x' means descending) -> (name, ascending)."""
    return [(o[1:], False) if o.startswith("-") else (o, True) for o in order]


def _sort(along: list[tuple[str, bool]]) -> list[Column]:
    return [F.asc_nulls_first(c) if up else F.desc_nulls_last(c) for c, up in along]


def slice_bounds(rows: DataFrame, along: list[tuple[str, bool]], slices: int, n: int | None = None,
                 seed: int = 7) -> tuple[DataFrame, int]:
    """One row, the sorted lower bounds of all slices but the first as an array of structs, and how many they are."""
    keyed = rows.select(*(c for c, _ in along))
    n = keyed.count() if n is None else n
    if n > SAMPLE * slices:
        keyed = keyed.sample(fraction=SAMPLE * slices / n, seed=seed)
    sample = keyed.orderBy(*_sort(along)).collect()
    at = sorted({len(sample) * i // slices for i in range(1, slices)} - {0})
    schema = f"{_BOUNDS} array<{keyed.schema.simpleString()}>"
    return rows.sparkSession.createDataFrame([([tuple(sample[i]) for i in at],)], schema), len(at)


def _not_before(along: list[tuple[str, bool]], bound: Column) -> Column:
    """Whether the row is at or after ``bound`` in the order (NULL before all values ascending, after all descending)."""
    result = F.lit(True)
    for c, up in reversed(along):
        v, b = F.col(c), bound[c]
        after = (b.isNull() & v.isNotNull()) | (v > b) if up else (v.isNull() & b.isNotNull()) | (v < b)
        result = F.coalesce(after, F.lit(False)) | (v.eqNullSafe(b) & result)
    return result


def with_slice(rows: DataFrame, bounds: DataFrame, k: int, along: list[tuple[str, bool]]) -> DataFrame:
    """``rows`` with the number of the ``k`` bounds at or before them (binary search)."""
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(k.bit_length())))) if k else F.array().cast("array<int>")
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        (at + step <= k) & _not_before(along, F.get(F.col(_BOUNDS), at + step - 1)), at + step).otherwise(at))
    # one row, as large as the number of slices; the array of one keeps the search out of the optimizer's constraints,
    # whose rewriting over a union fails on a lambda that refers to a column dropped here
    return rows.crossJoin(F.broadcast(bounds)).withColumn(_SLICE, F.explode(F.array(found))).drop(_BOUNDS)


def positions(df: DataFrame, keys: list[str], order: list[str], rank_col: str = "rn", total_col: str | None = None,
              running_sum: str | None = None, running_col: str = "running_sum", total_sum_col: str | None = None,
              slices: int | None = None, store: bool = True, small: int = 0) -> DataFrame:
    """``df`` with the 1-based position of each row in its group of ``keys`` (none: one group) under ``order``.

    ``order`` names columns, '-x' descending, and should end in a unique id:
    rows that tie in all of them get consecutive positions in any order.
    Optional: ``total_col`` (rows of the group), ``running_sum`` /
    ``running_col`` (SUM OVER in that order: NULL until the group's first
    value) and ``total_sum_col`` (its total in the group).  ``store`` writes
    ``df`` once to the checkpoint folder, as the passes below read it thrice;
    switch it off for a plain scan.  Up to ``small`` rows, which are counted
    first, every group is one window: it fits a task.
    """
    rows = materialize(df, "segments") if store else df
    along = [(k, True) for k in keys] + _named(order)
    if not slices:
        slices = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = rows.count()
    if n <= small:
        return _windowed(rows, keys, _sort(_named(order)), rank_col, total_col, running_sum, running_col, total_sum_col)
    sliced = with_slice(rows, *slice_bounds(rows, along, slices, n), along)

    aggs = [F.count(F.lit(1)).alias(_N)] + ([F.sum(running_sum).alias(_V)] if running_sum else [])
    stats = sliced.groupBy(*keys, _SLICE).agg(*aggs)
    group = Window.partitionBy(*keys)
    before = group.orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = stats.select(*keys, _SLICE, F.lit(True).alias(_FIRST),
                         F.coalesce(F.sum(_N).over(before), F.lit(0)).alias(_N), F.sum(_N).over(group).alias(_TOT),
                         *([F.sum(_V).over(before).alias(_V), F.sum(_V).over(group).alias(_TSUM)] if running_sum else []))
    own = sliced.withColumns({_FIRST: F.lit(False), _N: F.lit(1).cast("bigint")})
    if running_sum:
        own = own.withColumn(_V, F.col(running_sum).cast(carry.schema[_V].dataType))
    both = own.unionByName(carry, allowMissingColumns=True)

    local = (Window.partitionBy(*keys, _SLICE).orderBy(F.desc(_FIRST), *_sort(_named(order)))
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = {rank_col: F.sum(_N).over(local)}
    if total_col:
        out[total_col] = F.first(_TOT).over(local)
    if running_sum:
        out[running_col] = F.sum(_V).over(local)
        if total_sum_col:
            out[total_sum_col] = F.first(_TSUM).over(local)
    # the carry row's position is the number of rows before it
    ranked = both.withColumns(out).where(~F.col(_FIRST))
    return ranked.select(*df.columns, *out)


def _windowed(rows: DataFrame, keys: list[str], order: list[Column], rank_col: str, total_col: str | None,
              running_sum: str | None, running_col: str, total_sum_col: str | None) -> DataFrame:
    group = Window.partitionBy(*keys)
    so_far = group.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = {rank_col: F.count(F.lit(1)).over(so_far)}
    if total_col:
        out[total_col] = F.count(F.lit(1)).over(group)
    if running_sum:
        out[running_col] = F.sum(running_sum).over(so_far)
        if total_sum_col:
            out[total_sum_col] = F.sum(running_sum).over(group)
    return rows.withColumns(out)


def moving_mean(df: DataFrame, keys: list[str], order: list[str], value: str, width: int, mean_col: str,
                rank_col: str = "rn", bucket_rows: int = 1_000_000, slices: int | None = None,
                store: bool = True, small: int = 0) -> DataFrame:
    """``df`` with position and mean of ``value`` over the row and the ``width`` - 1 rows before it in its group.

    Positions are cut into buckets of ``bucket_rows``; the last ``width`` - 1
    rows of a bucket also go to the next one as a halo, so a window of one
    bucket sees every frame whole and no task holds a whole group.
    """
    if width < 1 or width - 1 > bucket_rows:
        raise ValueError("need width >= 1 and width - 1 <= bucket_rows (the halo must cover a frame)")
    at = F.col(rank_col) - 1
    ranked = positions(df, keys, order, rank_col, slices=slices, store=store, small=small)
    own = ranked.withColumns({_SLICE: F.floor(at / bucket_rows).cast("bigint"), _FIRST: F.lit(True)})
    halo = (ranked.where(at % bucket_rows >= bucket_rows - (width - 1))
            .withColumns({_SLICE: F.floor(at / bucket_rows).cast("bigint") + 1, _FIRST: F.lit(False)}))
    both = own.unionByName(halo) if width > 1 else own
    frame = Window.partitionBy(*keys, _SLICE).orderBy(rank_col).rowsBetween(-(width - 1), Window.currentRow)
    mean = F.try_divide(F.sum(value).over(frame).cast("double"), F.count(value).over(frame).cast("double"))
    return both.withColumn(mean_col, mean).where(_FIRST).drop(_SLICE, _FIRST)
