"""S06 dispersion statistics in a single aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditlens.functions.columns import mean_of
from creditlens.operators.broadcast import join_groups


def dispersion(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, population variance / std-dev, coefficient of variation (%), min, max, range.

    ``var_pop``/``stddev_pop`` use Spark's merge-stable central moments, not
    E[x^2]-E[x]^2 (which cancels catastrophically for large, close values).
    """
    v = F.col(value)
    out = df.groupBy(*keys).agg(
        F.count(v).alias("n"),
        mean_of(value).alias("mean"),
        F.var_pop(v).alias("var_pop"),
        F.stddev_pop(v).alias("stddev_pop"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    )
    return (out.withColumn("cv_pct", F.try_divide(F.col("stddev_pop"), F.col("mean")) * F.lit(100.0))
            .withColumn("range", F.col("max") - F.col("min")))


def exact_moments(df: DataFrame, value: str, keys: list[str] = ()) -> DataFrame:
    """n, mean, var_pop, stddev_pop of a 2-decimal money column (per group of
    ``keys``, or one row overall), computed exactly and deterministically:
    the result does not depend on partitioning or row order.

    Two passes of partial aggregation: the mean in whole cents
    ``c = Σcents div n``, then exact DECIMAL sums of the shifted cents d = cents - c
    and d².  The shift keeps E[d²] - E[d]² free of cancellation; one fixed
    sequence of IEEE operations turns the exact sums into doubles.  The first
    pass has one row per group and is joined back, matching NULL group keys too.
    """
    keys = list(keys)
    v = F.col(value)
    first = (df.groupBy(*keys).agg(F.count(v).alias("_n"), F.sum(v).alias("_s1"))
             .withColumn("_c", F.expr("cast(_s1 * 100 as decimal(38,0)) div nullif(_n, 0)")))
    joined = join_groups(df, first, keys) if keys else df.crossJoin(F.broadcast(first))
    d = (v * 100).cast("decimal(38,0)") - F.col("_c")
    sums = joined.groupBy(*keys).agg(
        F.max("_n").alias("_n"), F.max("_s1").alias("_s1"),
        F.sum(d).alias("_d1"), F.sum(d * d).alias("_d2"))
    n = F.coalesce(F.col("_n"), F.lit(0)).cast("double")
    e1 = F.try_divide(F.col("_d1").cast("double"), n)
    var_cents = F.try_divide(F.col("_d2").cast("double"), n) - e1 * e1
    return sums.select(
        *keys,
        F.coalesce(F.col("_n"), F.lit(0)).alias("n"),
        F.try_divide(F.col("_s1").cast("double"), n).alias("mean"),
        (var_cents / F.lit(10000.0)).alias("var_pop"),
        (F.sqrt(var_cents) / F.lit(100.0)).alias("stddev_pop"))
