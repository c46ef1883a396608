"""S07–S09 data-quality audits of the declared keys and domains.

Spark does not enforce PRIMARY KEY, FOREIGN KEY or value lists; these jobs
report the rows that break them.  All are partial aggregations or anti joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditlens.operators.repeated_keys import suspects


def audit_primary_key(df: DataFrame, key: str) -> DataFrame:
    """Key values that are NULL or occur more than once, with their count.

    Only rows whose key may be repeated are grouped (``operators.repeated_keys``)."""
    return (suspects(df, [key]).groupBy(key).agg(F.count(F.lit(1)).alias("ocorrencias"))
            .where(F.col(key).isNull() | (F.col("ocorrencias") > 1)))


def audit_foreign_key(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Distinct non-NULL foreign-key values of ``child`` with no parent row, and how many rows carry each.

    The child is counted per key first, so one row per key (and task) is shuffled, however hot the key."""
    used = child.where(F.col(fk).isNotNull()).groupBy(fk).agg(F.count(F.lit(1)).alias("ocorrencias"))
    return used.join(parent.select(F.col(pk).alias(fk)), fk, "left_anti")


def audit_domain(df: DataFrame, col: str, allowed: tuple[str, ...] | list[str]) -> DataFrame:
    """Values of ``col`` outside ``allowed`` (NULL included) and their counts."""
    c = F.col(col)
    return (df.where(c.isNull() | ~c.isin(*allowed))
            .groupBy(col).agg(F.count(F.lit(1)).alias("ocorrencias")))
