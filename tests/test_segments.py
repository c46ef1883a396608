"""S02 within groups: positions, running sums and moving means equal the windows of one task a group."""

import contextlib
import io

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from creditlens.operators.segments import moving_mean, positions, slice_bounds, with_slice


def rows(spark, n=4000):
    """Group 0 holds a third of the rows and one value a third of those; NULL groups, values and many small groups."""
    return spark.range(n).select(
        "id",
        F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 53 == 0, F.lit(None)).otherwise(F.col("id") % 40).alias("g"),
        F.when(F.col("id") % 9 == 0, F.lit("42.00")).when(F.col("id") % 97 == 0, F.lit(None))
         .otherwise((F.col("id") * 7919 % 1000).cast("string")).cast("decimal(15,2)").alias("v"))


@pytest.mark.parametrize("slices", [1, 3, 64])
def test_equals_the_window_of_a_group(spark, slices):
    df = rows(spark)
    ours = positions(df, ["g"], ["-v", "id"], total_col="n", running_sum="v", running_col="rs", total_sum_col="ts",
                     slices=slices, store=False)
    w = Window.partitionBy("g").orderBy(F.desc("v"), "id")
    every = Window.partitionBy("g")
    naive = df.select("id", F.row_number().over(w).alias("a"), F.count("*").over(every).alias("b"),
                      F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("c"), F.sum("v").over(every).alias("d"))
    both = ours.join(naive, "id")
    assert both.count() == 4000
    assert both.where(~(F.col("rn").eqNullSafe(F.col("a")) & F.col("n").eqNullSafe(F.col("b")) &
                        F.col("rs").eqNullSafe(F.col("c")) & F.col("ts").eqNullSafe(F.col("d")))).isEmpty()


def test_a_hot_group_is_split_and_slices_keep_the_order(spark):
    df = rows(spark, 9000)
    along = [("g", True), ("v", False), ("id", True)]
    sliced = with_slice(df, *slice_bounds(df, along, 16), along)
    sizes = [r["count"] for r in sliced.groupBy("_sg_slice").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 3 * 9000 / 16
    assert sliced.where("g = 0").select("_sg_slice").distinct().count() >= 4
    w = Window.orderBy("g", F.desc("v"), "id")
    stepped = sliced.withColumn("before", F.lag("_sg_slice").over(w))
    assert stepped.where("before > _sg_slice").isEmpty()


def test_one_exchange_of_the_rows(spark):
    df = rows(spark)
    ranked = positions(df, ["g"], ["-v", "id"], running_sum="v")
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        ranked.explain()
    plan = text.getvalue()
    over_rows = [l for l in plan.splitlines() if "Exchange" in l and "Broadcast" not in l and "_sg_" in l]
    # the rows and their carries in one exchange, the statistics in two of one row per (group, slice)
    assert len(over_rows) <= 2 and plan.count("Exchange hashpartitioning") <= 3
    assert "SinglePartition" not in plan


def test_few_rows_take_one_window_a_group(spark):
    df = rows(spark, 900)
    kw = dict(total_col="n", running_sum="v", total_sum_col="ts", store=False)
    a, b = (positions(df, ["g"], ["-v", "id"], small=small, **kw) for small in (900, 899))
    assert a.columns == b.columns
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_reports_over_every_group_by_slices(spark):
    from creditlens.plans import finance, ranking
    from creditlens.plans.catalog import load

    t = load(spark, "/root/testdata/sf0.001")
    for report in (lambda small: ranking.running_total_by_agency(t, None, with_share=True, small=small),
                   lambda small: finance.moving_average(t, None, small=small)):
        a, b = report(0), report(10**6)
        assert a.count() > 100 and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_ungrouped_empty_and_all_null(spark):
    df = rows(spark, 500)
    ours = positions(df, [], ["v", "id"], slices=8)
    naive = df.select("id", F.row_number().over(Window.orderBy("v", "id")).alias("a"))
    assert ours.join(naive, "id").where("rn <> a").isEmpty()
    empty = positions(df.where("id < 0"), ["g"], ["id"], running_sum="v", total_col="n")
    assert empty.columns == ["id", "g", "v", "rn", "n", "running_sum"] and empty.isEmpty()
    nothing = positions(df.withColumn("v", F.lit(None).cast("decimal(15,2)")), ["g"], ["id"], running_sum="v", slices=4)
    assert nothing.where("running_sum IS NOT NULL").isEmpty()


@pytest.mark.parametrize("width,bucket", [(1, 5), (3, 2), (3, 1000), (6, 5)])
def test_moving_mean_in_groups(spark, width, bucket):
    df = rows(spark, 1500)
    ours = moving_mean(df, ["g"], ["id"], "v", width, "m", bucket_rows=bucket, slices=6, store=False)
    w = Window.partitionBy("g").orderBy("id").rowsBetween(1 - width, 0)
    naive = df.select("id", F.try_divide(F.sum("v").over(w).cast("double"), F.count("v").over(w).cast("double")).alias("a"))
    both = ours.join(naive, "id")
    assert both.count() == 1500 and both.where(~F.col("m").eqNullSafe(F.col("a"))).isEmpty()


def test_moving_mean_refuses_a_frame_longer_than_a_bucket(spark):
    with pytest.raises(ValueError):
        moving_mean(rows(spark, 10), ["g"], ["id"], "v", 4, "m", bucket_rows=2)
