"""Built-in column expressions with the reports' numeric conventions.

Conventions (kept identical in the DuckDB oracle):

* money stays DECIMAL(15,2) until the last step, so sums are exact;
* a mean is ``double(exact sum) / count`` — one IEEE division;
* a ratio is computed in double and is NULL when the denominator is 0
  (``try_divide``: ANSI mode stays on, nothing raises);
* rounding happens once, at the end.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_double(x) -> Column:
    return _c(x).cast("double")


def ratio(num, den) -> Column:
    """num / den in double; NULL when den is 0 or NULL."""
    return F.try_divide(as_double(num), as_double(den))


def pct(num, den) -> Column:
    """(num / den) * 100 in double; NULL when den is 0."""
    return ratio(num, den) * F.lit(100.0)


def round2(x) -> Column:
    return F.round(_c(x), 2)


def mean_of(value) -> Column:
    """Aggregate mean as double(exact sum) / count (avoids decimal(19,6) rounding)."""
    v = _c(value)
    return F.try_divide(F.sum(v).cast("double"), F.count(v).cast("double"))




def month_key(d) -> Column:
    """'yyyy-MM' month key of a date (the reports' month label)."""
    return F.date_format(_c(d), "yyyy-MM")


def days_between(later, earlier) -> Column:
    """Whole days from ``earlier`` to ``later`` as BIGINT (NULL if either is NULL)."""
    return F.datediff(_c(later), _c(earlier)).cast("bigint")


def year_range(d, year: int) -> Column:
    """Half-open date range for a calendar year (sargable: pushed to the scan)."""
    start = _dt.date(year, 1, 1)
    end = _dt.date(year + 1, 1, 1)
    c = _c(d)
    return (c >= F.lit(start)) & (c < F.lit(end))




def tile_from_rank(rank, total, k: int) -> Column:
    """NTILE(k) of the row with 1-based ``rank`` among ``total`` rows.

    Closed form of the standard NTILE split: the first ``total mod k`` tiles
    hold one row more than the others.
    """
    rn = _c(rank).cast("bigint")
    n = _c(total).cast("bigint")
    q = F.floor(n / k).cast("bigint")
    r = n - q * k
    cut = r * (q + 1)
    big = F.floor((rn - 1) / (q + 1)).cast("bigint") + 1
    small = r + F.floor((rn - cut - 1) / F.greatest(q, F.lit(1))).cast("bigint") + 1
    return F.when(rn <= cut, big).otherwise(small)


def report_types(df: DataFrame) -> DataFrame:
    """Final projection of a report: portable output types.

    DECIMAL -> DOUBLE, DATE -> 'yyyy-MM-dd' text (the dates of the original
    reports were text), INT/SMALLINT -> BIGINT.  Applied once, at the end.
    """
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        cols.append(c.alias(f.name))
    return df.select(*cols)
