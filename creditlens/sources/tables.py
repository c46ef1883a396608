"""The six-table bundle every report takes, and its readers."""

from __future__ import annotations

import datetime as dt
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditlens.sources.schema import SCHEMAS, TABLE_NAMES

# A dimension is broadcast only after a bounded count proved it has at most
# this many rows; beyond it the join stays a shuffle join (AQE may still
# convert it at run time from the measured size).
DIM_BROADCAST_MAX_ROWS = 200_000
DIM_BROADCAST_MAX_BYTES = 64 << 20  # of their rows as JSON
MONTH = "mes_contratacao"  # partition column of stored loans
SIZE_VERDICT_SECONDS = 600  # a table may grow under the same path


@dataclass
class Tables:
    agencia: DataFrame
    cooperado: DataFrame
    conta: DataFrame
    modalidade: DataFrame
    emprestimo: DataFrame
    parcela: DataFrame
    broadcast_max_rows: int = DIM_BROADCAST_MAX_ROWS
    _small: dict = field(default_factory=dict, repr=False)

    @property
    def spark(self) -> SparkSession:
        return self.emprestimo.sparkSession

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)

    def loans_between(self, start: dt.date, end: dt.date) -> DataFrame:
        """Loans contracted in [start, end).

        Stored loans lie in one folder per month; the range then also becomes
        a range of months, so that only its folders are listed and read."""
        day = F.col("data_contratacao")
        loans = self.emprestimo.where((day >= F.lit(start)) & (day < F.lit(end)))
        if MONTH not in loans.columns:
            return loans
        last = end - dt.timedelta(days=1)
        return loans.where(F.col(MONTH).between(f"{start:%Y-%m}", f"{last:%Y-%m}"))

    def loans_of_year(self, year: int) -> DataFrame:
        return self.loans_between(dt.date(year, 1, 1), dt.date(year + 1, 1, 1))

    def is_small(self, name: str) -> bool:
        """True when the table provably holds at most ``broadcast_max_rows`` rows
        and ``DIM_BROADCAST_MAX_BYTES`` bytes.

        Only k+1 rows are looked at; a derived table (the credit products) is
        computed for it.  The verdict holds for ten minutes.
        """
        verdict, since = self._small.get(name, (False, None))
        if since is None or time.monotonic() - since > SIZE_VERDICT_SECONDS:
            k = self.broadcast_max_rows
            rows, size = (self.table(name).limit(k + 1).select(F.octet_length(F.to_json(F.struct("*"))).alias("b"))
                          .agg(F.count(F.lit(1)), F.sum("b")).first())
            verdict = rows <= k and (size or 0) <= DIM_BROADCAST_MAX_BYTES
            self._small[name] = (verdict, time.monotonic())
        return verdict

    def few(self, name: str, column: str) -> bool:
        """True when ``column`` of the table provably has few distinct values (``few_groups``); holds for ten minutes."""
        from creditlens.operators.broadcast import few_groups

        verdict, since = self._small.get((name, column), (False, None))
        if since is None or time.monotonic() - since > SIZE_VERDICT_SECONDS:
            verdict = few_groups(self.table(name), [column])
            self._small[(name, column)] = (verdict, time.monotonic())
        return verdict

    def dim(self, name: str) -> DataFrame:
        """The table, broadcast-hinted only when its size bound is proven."""
        df = self.table(name)
        return F.broadcast(df) if self.is_small(name) else df


def read_tables(spark: SparkSession, path: str, fmt: str = "parquet") -> Tables:
    """Read the six tables stored as ``{path}/{name}.{fmt}`` with the declared schemas."""
    reader = spark.read.format(fmt)
    frames = {n: reader.schema(SCHEMAS[n]).load(f"{path}/{n}.{fmt}") for n in TABLE_NAMES}
    return Tables(**frames)


def write_tables(t: Tables, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Store the six tables as ``{path}/{name}.{fmt}`` in the declared schemas."""
    for n in TABLE_NAMES:
        df = t.table(n)
        df.select(*[F.col(f.name).cast(f.dataType) for f in SCHEMAS[n].fields]) \
          .write.mode(mode).format(fmt).save(f"{path}/{n}.{fmt}")


def tables_from_rows(spark: SparkSession, **rows) -> Tables:
    """Build a bundle from Python rows (tests, hand-made fixtures).

    Missing tables are empty.  Rows are tuples in schema order or dicts.
    """
    frames = {}
    for n in TABLE_NAMES:
        data = rows.get(n, [])
        frames[n] = spark.createDataFrame(data, SCHEMAS[n])
    return Tables(**frames)
