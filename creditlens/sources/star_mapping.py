"""Mapping of the driver's TPC-H-like star schema onto the six credit tables.

The same mapping exists twice: as Spark column expressions (``from_star_schema``)
and as a DuckDB ``WITH`` prelude (``DUCKDB_PRELUDE``) used by the oracle SQL.
Both must stay expression-for-expression identical; ``tests/test_mapping.py``
compares them table by table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditlens.sources.schema import MONEY, RATE
from creditlens.sources.tables import Tables

# Fixed values of the mapping (FIXTURES §1).
SECOND_ACCOUNT_OFFSET = 1_000_000_000
SUPPLIER_OFFSET = 2_000_000_000  # suppliers are members (and accounts) that never borrow
ASSOCIATION_EPOCH = "1995-01-01"
LOAN_STATUS_BY_ORDER_STATUS = {"O": "Ativo", "F": "Quitado", "P": "Inadimplente"}
INSTALMENT_STATUS_BY_RETURNFLAG = {"R": "Paga", "N": "Pendente", "A": "Atrasada"}


def _case(col: Column, mapping: dict[str, str]) -> Column:
    out = None
    for k, v in mapping.items():
        out = F.when(col == k, v) if out is None else out.when(col == k, v)
    return out


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _modality_id(priority: Column) -> Column:
    return F.substring(priority, 1, 1).cast("bigint")


def from_star_schema(spark: SparkSession, sf_dir: str) -> Tables:
    """Six lazily-mapped DataFrames over ``{sf_dir}/*.parquet`` (whole tables)."""
    nation = _read(spark, sf_dir, "nation")
    region = _read(spark, sf_dir, "region")
    customer = _read(spark, sf_dir, "customer")
    orders = _read(spark, sf_dir, "orders")
    lineitem = _read(spark, sf_dir, "lineitem")
    supplier = _read(spark, sf_dir, "supplier")

    agencia = (nation.join(region, nation.n_regionkey == region.r_regionkey)
               .select(F.col("n_nationkey").cast("bigint").alias("id_agencia"),
                       # two branches of one name: the last repeats the name of the first
                       F.when(F.col("n_nationkey") == 24, "NATION_0").otherwise(F.col("n_name")).alias("nome_agencia"),
                       F.col("r_name").alias("cidade")))

    cust, supp = F.col("c_custkey"), F.col("s_suppkey").cast("bigint")
    cooperado = customer.select(
        cust.alias("id_cooperado"),
        F.col("c_name").alias("nome_completo"),
        F.col("c_mktsegment").alias("perfil_produtor"),
        F.date_add(F.lit(ASSOCIATION_EPOCH).cast("date"), (cust % 365).cast("int")).alias("data_associacao"),
        F.col("c_nationkey").cast("bigint").alias("id_agencia"),
    ).unionByName(supplier.select(
        (supp + SUPPLIER_OFFSET).alias("id_cooperado"),
        F.col("s_name").alias("nome_completo"),
        F.lit("SUPPLIER").alias("perfil_produtor"),
        F.date_add(F.lit(ASSOCIATION_EPOCH).cast("date"), (supp % 365).cast("int")).alias("data_associacao"),
        F.col("s_nationkey").cast("bigint").alias("id_agencia"),
    ))

    # one pass over customer: every member's account, plus a second account for
    # every tenth member (one scan, no union for the planner to split work over)
    first_account = F.struct(
        cust.alias("id_conta"),
        cust.alias("id_cooperado"),
        F.col("c_acctbal").cast(MONEY).alias("saldo_atual"),
        F.when(cust % 4 == 0, "Inativa").when(cust % 4 == 1, "Bloqueada").otherwise("Ativa").alias("status_conta"))
    second_account = F.when(cust % 10 == 0, F.struct(
        (cust + SECOND_ACCOUNT_OFFSET).alias("id_conta"),
        cust.alias("id_cooperado"),
        # every second one is empty
        F.when(cust % 20 == 0, F.lit(0)).otherwise(-F.col("c_acctbal")).cast(MONEY).alias("saldo_atual"),
        F.lit("Ativa").alias("status_conta")))
    conta = (customer.select(F.explode(F.array(first_account, second_account)).alias("_a"))
             .where(F.col("_a").isNotNull()).select("_a.*"))
    first_account, second_account = (F.struct(
        (supp + SUPPLIER_OFFSET + offset).alias("id_conta"), (supp + SUPPLIER_OFFSET).alias("id_cooperado"),
        (sign * F.col("s_acctbal")).cast(MONEY).alias("saldo_atual"), F.lit(status).alias("status_conta"))
        for offset, sign, status in ((0, 1, "Ativa"), (SECOND_ACCOUNT_OFFSET, -1, "Inativa")))
    conta = conta.unionByName(
        supplier.select(F.explode(F.array(first_account, F.when(supp % 3 == 0, second_account))).alias("_a"))
        .where(F.col("_a").isNotNull()).select("_a.*"))

    prio = F.col("o_orderpriority")
    modalidade = (orders.select(_modality_id(prio).alias("id_modalidade"), prio.alias("nome_modalidade"))
                  .distinct()
                  .select("id_modalidade", "nome_modalidade",
                          (F.lit(4) + F.lit(2.25).cast("decimal(3,2)") * F.col("id_modalidade"))
                          .cast(RATE).alias("taxa_juros_anual"),
                          (F.col("id_modalidade") * 2).cast("int").alias("prazo_maximo_meses")))

    ocust = F.col("o_custkey")
    okey = F.col("o_orderkey")
    emprestimo = orders.select(
        okey.alias("id_emprestimo"),
        F.when((ocust % 10 == 0) & (okey % 2 == 1), ocust + SECOND_ACCOUNT_OFFSET)
         .otherwise(ocust).alias("id_conta"),
        _modality_id(prio).alias("id_modalidade"),
        F.col("o_totalprice").cast(MONEY).alias("valor_contratado"),
        F.col("o_orderdate").cast("date").alias("data_contratacao"),
        _case(F.col("o_orderstatus"), LOAN_STATUS_BY_ORDER_STATUS).alias("status_contrato"),
    )

    ship = F.col("l_shipdate").cast("date")
    flag = F.col("l_returnflag")
    parcela = lineitem.select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id_parcela"),
        F.col("l_orderkey").alias("id_emprestimo"),
        F.col("l_linenumber").cast("int").alias("numero_parcela"),
        F.col("l_extendedprice").cast(MONEY).alias("valor_parcela"),
        ship.alias("data_vencimento"),
        F.when(flag == "R", F.date_add(ship, (F.col("l_partkey") % 31 - 15).cast("int"))).alias("data_pagamento"),
        _case(flag, INSTALMENT_STATUS_BY_RETURNFLAG).alias("status_parcela"),
    )

    return Tables(agencia=agencia, cooperado=cooperado, conta=conta, modalidade=modalidade,
                  emprestimo=emprestimo, parcela=parcela)


DUCKDB_PRELUDE = f"""
agencia AS (
  SELECT CAST(n.n_nationkey AS BIGINT) AS id_agencia,
         CASE WHEN n.n_nationkey = 24 THEN 'NATION_0' ELSE n.n_name END AS nome_agencia, r.r_name AS cidade
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey),
cooperado AS (
  SELECT c_custkey AS id_cooperado, c_name AS nome_completo, c_mktsegment AS perfil_produtor,
         DATE '{ASSOCIATION_EPOCH}' + CAST(c_custkey % 365 AS INTEGER) AS data_associacao,
         CAST(c_nationkey AS BIGINT) AS id_agencia
  FROM customer
  UNION ALL
  SELECT s_suppkey + {SUPPLIER_OFFSET}, s_name, 'SUPPLIER', DATE '{ASSOCIATION_EPOCH}' + CAST(s_suppkey % 365 AS INTEGER),
         CAST(s_nationkey AS BIGINT)
  FROM supplier),
conta AS (
  SELECT c_custkey AS id_conta, c_custkey AS id_cooperado, CAST(c_acctbal AS DECIMAL(15,2)) AS saldo_atual,
         CASE WHEN c_custkey % 4 = 0 THEN 'Inativa' WHEN c_custkey % 4 = 1 THEN 'Bloqueada' ELSE 'Ativa' END AS status_conta
  FROM customer
  UNION ALL
  SELECT c_custkey + {SECOND_ACCOUNT_OFFSET}, c_custkey,
         CAST(CASE WHEN c_custkey % 20 = 0 THEN 0 ELSE -c_acctbal END AS DECIMAL(15,2)), 'Ativa'
  FROM customer WHERE c_custkey % 10 = 0
  UNION ALL
  SELECT s_suppkey + {SUPPLIER_OFFSET}, s_suppkey + {SUPPLIER_OFFSET}, CAST(s_acctbal AS DECIMAL(15,2)), 'Ativa' FROM supplier
  UNION ALL
  SELECT s_suppkey + {SUPPLIER_OFFSET} + {SECOND_ACCOUNT_OFFSET}, s_suppkey + {SUPPLIER_OFFSET}, CAST(-s_acctbal AS DECIMAL(15,2)),
         'Inativa'
  FROM supplier WHERE s_suppkey % 3 = 0),
modalidade AS (
  SELECT id_modalidade, nome_modalidade,
         CAST(4 + CAST(2.25 AS DECIMAL(3,2)) * id_modalidade AS DECIMAL(5,2)) AS taxa_juros_anual,
         CAST(id_modalidade * 2 AS INTEGER) AS prazo_maximo_meses
  FROM (SELECT DISTINCT CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS id_modalidade,
                        o_orderpriority AS nome_modalidade FROM orders)),
emprestimo AS (
  SELECT o_orderkey AS id_emprestimo,
         CASE WHEN o_custkey % 10 = 0 AND o_orderkey % 2 = 1 THEN o_custkey + {SECOND_ACCOUNT_OFFSET}
              ELSE o_custkey END AS id_conta,
         CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS id_modalidade,
         CAST(o_totalprice AS DECIMAL(15,2)) AS valor_contratado,
         CAST(o_orderdate AS DATE) AS data_contratacao,
         CASE o_orderstatus WHEN 'O' THEN 'Ativo' WHEN 'F' THEN 'Quitado' WHEN 'P' THEN 'Inadimplente' END
           AS status_contrato
  FROM orders),
parcela AS (
  SELECT l_orderkey * 100 + l_linenumber AS id_parcela, l_orderkey AS id_emprestimo,
         CAST(l_linenumber AS INTEGER) AS numero_parcela,
         CAST(l_extendedprice AS DECIMAL(15,2)) AS valor_parcela,
         CAST(l_shipdate AS DATE) AS data_vencimento,
         CASE WHEN l_returnflag = 'R'
              THEN CAST(l_shipdate AS DATE) + CAST(l_partkey % 31 - 15 AS INTEGER) END AS data_pagamento,
         CASE l_returnflag WHEN 'R' THEN 'Paga' WHEN 'N' THEN 'Pendente' WHEN 'A' THEN 'Atrasada' END
           AS status_parcela
  FROM lineitem)
"""


def with_prelude(body: str) -> str:
    """Prefix a query over the six mapped tables with the DuckDB mapping CTEs.

    ``body`` may start with its own ``WITH`` list; it is merged into one.
    """
    stripped = body.lstrip()
    if stripped[:4].upper() == "WITH":
        return "WITH" + DUCKDB_PRELUDE + "," + stripped[4:]
    return "WITH" + DUCKDB_PRELUDE + stripped
