"""Exact mergeable moments of a 2-decimal money column, alone or against a whole number.

``power_sums`` are sums of whole cents, of their squares and of their products
with a whole number x, all as DECIMAL(38,0): integers, so they merge exactly
over any number of partial aggregates (tasks, accounts, groups) in any order,
and an overflow is an error, never a wrong digit.  ``central`` moves them to
the nearest whole mean, still in integers,

    sum (y - c)^2 = sum y^2 - 2 c sum y + n c^2,

and only then turns to double: what is subtracted there is the square of less
than one cent, so values that are large and close together do not cancel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHOLE = "decimal(38,0)"
POWERS = ("_n", "_y", "_yy")
CROSS = ("_x", "_xx", "_xy")


def cents(value: str) -> Column:
    return (F.col(value) * 100).cast("decimal(18,0)")


def power_sums(value: str) -> list[Column]:
    """Aggregates of the non-NULL values: count, sum of cents, sum of squared cents."""
    y = cents(value)
    return [F.count(y).alias("_n"), F.sum(y).cast(WHOLE).alias("_y"), F.sum((y * y).cast(WHOLE)).cast(WHOLE).alias("_yy")]


def merged() -> list[Column]:
    """Aggregates that add up ``power_sums`` of parts."""
    return [F.sum("_n").alias("_n"), *(F.sum(c).cast(WHOLE).alias(c) for c in ("_y", "_yy"))]


def merged_with(x: Column) -> list[Column]:
    """``merged`` and the sums of x, x^2 and x y, where ``x`` is one whole number per part."""
    x, n = x.cast("decimal(10,0)"), F.col("_n").cast("decimal(20,0)")
    return [*merged(), F.sum((x * n).cast(WHOLE)).cast(WHOLE).alias("_x"), F.sum((x * x * n).cast(WHOLE)).cast(WHOLE).alias("_xx"),
            F.sum((x * F.col("_y")).cast(WHOLE)).cast(WHOLE).alias("_xy")]


def _nearest(total: str) -> Column:
    """The whole number nearest to the mean (any whole number near it would do)."""
    n = F.expr("nullif(cast(_n as decimal(38,0)), 0)")
    half = F.expr("cast(_n div 2 as decimal(38,0))")
    return F.when(F.col(total) >= 0, F.call_function("div", F.col(total) + half, n)).otherwise(
        F.call_function("div", F.col(total) - half, n)).cast(WHOLE)


def _about(a: str, b: str, product: str, ca: Column, cb: Column) -> tuple[Column, Column, Column]:
    """Exact (sum (a - ca)(b - cb), sum (a - ca), sum (b - cb))."""
    n = F.col("_n").cast(WHOLE)
    cross = F.col(product) - (ca * F.col(b)).cast(WHOLE) - (cb * F.col(a)).cast(WHOLE) + (n * (ca * cb).cast(WHOLE)).cast(WHOLE)
    return cross, F.col(a) - (n * ca).cast(WHOLE), F.col(b) - (n * cb).cast(WHOLE)


def _co_moment(a: str, b: str, product: str) -> Column:
    cross, da, db = _about(a, b, product, F.col(f"_c{a}"), F.col(f"_c{b}"))
    n = F.col("_n").cast("double")
    return cross.cast("double") - F.try_divide(da.cast("double"), n) * db.cast("double")


def central(sums: DataFrame) -> DataFrame:
    """``sums`` with n, mean, var_pop, stddev_pop; with x sums also the Pearson correlation ``corr``."""
    paired = "_x" in sums.columns
    df = sums.withColumns({"_c_y": _nearest("_y"), **({"_c_x": _nearest("_x")} if paired else {})})
    m2 = F.greatest(_co_moment("_y", "_y", "_yy"), F.lit(0.0))
    n = F.col("_n").cast("double")
    out = {"n": F.col("_n"), "mean": F.try_divide(F.col("_y").cast("double"), n) / 100.0,
           "var_pop": F.try_divide(m2, n) / 10000.0, "stddev_pop": F.sqrt(F.try_divide(m2, n)) / 100.0}
    if paired:
        x2 = F.greatest(_co_moment("_x", "_x", "_xx"), F.lit(0.0))
        out["corr"] = F.try_divide(_co_moment("_x", "_y", "_xy"), F.sqrt(x2) * F.sqrt(m2))
    return df.withColumns(out).drop(*POWERS, *CROSS, "_c_y", "_c_x")
