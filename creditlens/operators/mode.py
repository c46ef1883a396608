"""The exact mode of a column: candidates from a heavy-hitters sketch, an exact recount, a proof.

A frequent-items sketch (``approx_top_k``, a mergeable Misra-Gries summary
combined map-side) proposes values in one pass.  It overlooks no value that
holds more than 7 / M of the rows (twice the error 3.5 / M of a map of size M),
nor one more frequent than the last value proposed.  The candidates are then
counted exactly; if the best count lies above that bound it is the mode, and
all values that tie with it are candidates too.  So a column with a frequent
value, however many others it has, shuffles ``CANDIDATES`` counts a task.
Where no value is frequent enough to be proven, all values are grouped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRACKED, CANDIDATES = 20_000, 200
SKETCHED = "boolean byte short int bigint float double date timestamp decimal string".split()


def proven_mode(df: DataFrame, value: str, tracked: int = TRACKED, candidates: int = CANDIDATES) -> list | None:
    """[the most frequent value (ties: the smallest, NULL before all)], or None if the sketch proves none."""
    v = F.col(value)
    if not df.schema[value].dataType.simpleString().startswith(tuple(SKETCHED)):
        return None
    n, known, top = df.select(v).agg(F.count(F.lit(1)), F.count(v), F.expr(f"approx_top_k(`{value}`, {candidates}, {tracked})")).first()
    nulls = n - known
    overlooked = 7.0 * 0.75 / tracked * known  # M >= tracked / 0.75
    if len(top) == candidates:
        overlooked = max(overlooked, top[-1]["count"])
    if max([nulls, *(r["count"] for r in top)], default=0) <= overlooked or not n:
        return None
    counted = df.where(v.isin([r["item"] for r in top])).groupBy(value).agg(F.count(F.lit(1)).alias("n")).collect() if top else []
    best = max([nulls, *(r["n"] for r in counted)])
    if best <= overlooked:
        return None
    return [None if nulls == best else min(r[value] for r in counted if r["n"] == best)]


def mode(df: DataFrame, value: str, name: str, **sketch) -> DataFrame:
    """One row (none for an empty frame): the most frequent value; ties give the smallest, and NULL counts as a value."""
    proven = proven_mode(df, value, **sketch)
    if proven is not None:
        return df.sparkSession.createDataFrame([tuple(proven)], f"{name} {df.schema[value].dataType.simpleString()}")
    return (df.groupBy(value).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), F.asc(value)).limit(1)
            .select(F.col(value).alias(name)))
