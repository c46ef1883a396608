"""The six tables stored for the star join: bucketed by account, loans in a folder per month.

Nearly every report joins instalments to loans, loans to accounts and accounts
to members.  Stored this way all of them meet inside a bucket:

* accounts are bucketed by ``id_conta`` and carry their member's columns
  (``tem_titular`` tells whether the member exists);
* loans are bucketed by ``id_conta`` and partitioned by the month of the
  contract, so a date range reads its months only;
* instalments carry the account of their loan and are bucketed by it; an
  instalment without a loan keeps a NULL account;
* members are bucketed by ``id_cooperado``; agencies and products are small.

The tables live in the session's catalog, which on a cluster is shared.  The
planner takes a bucket as the partitioning of a join on (account, loan) only
with ``spark.sql.requireAllClusterKeysForCoPartition=false``, which
``build_session`` sets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditlens.operators.chain import OWNED
from creditlens.sources.schema import TABLE_NAMES
from creditlens.sources.tables import MONTH, Tables

MEMBER_COLUMNS = ("nome_completo", "perfil_produtor", "data_associacao", "id_agencia")


def _save(df: DataFrame, name: str, path: str | None, mode: str, buckets: int | None = None, by: str | None = None,
          month: bool = False) -> None:
    if buckets:
        df = df.repartition(buckets, by)  # one task writes one bucket: a file per bucket (and month)
    writer = df.write.mode(mode).format("parquet")
    if buckets:
        writer = writer.bucketBy(buckets, by).sortBy(by)
    if month:
        writer = writer.partitionBy(MONTH)
    if path:
        writer = writer.option("path", f"{path}/{name.split('.')[-1]}")
    writer.saveAsTable(name)


def store_tables(t: Tables, prefix: str, buckets: int, path: str | None = None, mode: str = "errorifexists") -> None:
    """Write the tables as ``{prefix}_{table}``; ``path`` makes them external tables below that shared folder.

    Choose ``buckets`` so that a bucket of instalments fits a task (about 1 GB a bucket)."""
    member = t.cooperado.select("id_cooperado", *MEMBER_COLUMNS, F.lit(True).alias(OWNED))
    conta = t.conta.join(member, "id_cooperado", "left").fillna(False, [OWNED])
    parcela = t.parcela.join(t.emprestimo.select("id_emprestimo", "id_conta"), "id_emprestimo", "left")
    emprestimo = t.emprestimo.withColumn(MONTH, F.date_format("data_contratacao", "yyyy-MM"))
    _save(t.agencia, f"{prefix}_agencia", path, mode)
    _save(t.modalidade, f"{prefix}_modalidade", path, mode)
    _save(t.cooperado, f"{prefix}_cooperado", path, mode, buckets, "id_cooperado")
    _save(conta, f"{prefix}_conta", path, mode, buckets, "id_conta")
    _save(emprestimo, f"{prefix}_emprestimo", path, mode, buckets, "id_conta", month=True)
    _save(parcela, f"{prefix}_parcela", path, mode, buckets, "id_conta")


def stored_tables(spark: SparkSession, prefix: str) -> Tables:
    """The tables ``store_tables`` wrote, as every report takes them."""
    return Tables(**{n: spark.table(f"{prefix}_{n}") for n in TABLE_NAMES})


def drop_stored_tables(spark: SparkSession, prefix: str) -> None:
    """Drop the catalog entries (and the files, unless the tables are external)."""
    for n in TABLE_NAMES:
        spark.sql(f"DROP TABLE IF EXISTS {prefix}_{n}")
