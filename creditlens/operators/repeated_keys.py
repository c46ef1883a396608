"""Keys that occur more than once, without shuffling the keys that occur once.

Whole-number keys are marked in bitmaps: the key range is cut into pages of
32,768 numbers, and each page counts its rows and the bits they set
(``bitmap_construct_agg``, built in, combined map-side).  A page whose rows
and bits agree holds every key once, exactly and not just probably, and is
done.  Only rows of the other pages are grouped by key.

Pages pay off while a task's keys lie near each other, as ids given in
sequence do.  One narrow aggregation first measures the keys' ranges by task:
the bitmaps of a task cost its range / 8 bytes, grouping costs ``ROW_BYTES`` a
row, and the cheaper way is taken.  Other key types are grouped at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditlens.session import materialize

ROW_BYTES = 16  # a shuffled (key, count) row, compressed
PAGE = 32_768  # fixed value of the built-in bitmap functions
SMALL = 4_000_000  # rows whose keys are one shuffle partition of 64 MB
FEW_PAGES = 1_000_000  # a page number is 8 bytes: broadcast below, shuffled beyond

_AT, _PAGE = "_dup_at", "_dup_page"


def key_number(df: DataFrame, keys: list[str]) -> tuple[Column, float, int] | None:
    """(one non-negative number per distinct combination of whole-number ``keys``, bytes of its bitmaps a row, rows), or None.

    The keys form a mixed-radix number over their ranges.  None if a key has
    another type, there is no row, or the number would not fit 62 bits.  One
    pass: ranges and rows by task, then one row of them.
    """
    if any(not isinstance(df.schema[k].dataType, T.IntegralType) for k in keys):
        return None
    wide = [F.col(k).cast("long") for k in keys]
    by_task = df.groupBy(F.spark_partition_id().alias("_p")).agg(F.count(F.lit(1)).alias("n"), *(
        f(c).alias(f"{f.__name__}{i}") for i, c in enumerate(wide) for f in (F.min, F.max)))
    r = by_task.agg(F.sum("n").alias("n"), F.sum((F.col("max0") - F.col("min0") + 1).cast("decimal(38,0)")).alias("span"),
                    *(x for i in range(len(keys)) for x in (F.min(f"min{i}").alias(f"lo{i}"), F.max(f"max{i}").alias(f"hi{i}")))).first()
    if not r.n or any(r[f"lo{i}"] is None for i in range(len(keys))):
        return None
    number, room, rest = F.lit(0).cast("long"), 1, 1
    for i, c in enumerate(wide):
        lo, width = r[f"lo{i}"], r[f"hi{i}"] - r[f"lo{i}"] + 1
        room, rest = room * width, rest * (width if i else 1)
        if room >= 1 << 62:
            return None
        number = number * F.lit(width) + (c - F.lit(lo))
    return number, float(r.span) * rest / 8 / r.n, r.n


def suspect_pages(df: DataFrame, number: Column) -> DataFrame:
    """Pages that hold more rows than distinct numbers."""
    at = df.select(number.alias(_AT)).where(F.col(_AT).isNotNull())
    pages = at.groupBy(F.bitmap_bucket_number(_AT).alias(_PAGE)).agg(
        F.count(F.lit(1)).alias("n"), F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position(_AT))).alias("bits"))
    return pages.where("n > bits").select(_PAGE)


def suspects(df: DataFrame, keys: list[str], row_bytes: int = ROW_BYTES, small: int = 0) -> DataFrame:
    """Rows of ``df`` that may share their ``keys`` with another row: none is missing, most others are gone.

    Rows with a NULL key are always among them.  Up to ``small`` rows all stay:
    two more passes would cost more than their shuffle.
    """
    df = df.select(*keys)
    found = key_number(df, keys)
    if found is None:
        return df
    number, cost, n = found
    if cost > row_bytes or n <= small:
        return df
    pages = materialize(suspect_pages(df, number), "duplicate-pages")
    few = pages.limit(FEW_PAGES + 1).count() <= FEW_PAGES
    kept = df.withColumn(_PAGE, F.bitmap_bucket_number(number)).join(F.broadcast(pages) if few else pages, _PAGE, "left_semi")
    return kept.select(*keys).unionByName(df.where(" OR ".join(f"`{k}` IS NULL" for k in keys)))


def duplicates(df: DataFrame, keys: list[str], count_col: str, row_bytes: int = ROW_BYTES, small: int = 0) -> DataFrame:
    """One row per combination of ``keys`` that occurs more than once (NULL is a value here), with its count."""
    return (suspects(df, keys, row_bytes, small).groupBy(*keys).agg(F.count(F.lit(1)).alias(count_col))
            .where(F.col(count_col) > 1))
