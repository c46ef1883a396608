"""The Spark mapping and the DuckDB prelude build identical six tables."""

import duckdb
import pytest

from creditlens.functions.columns import report_types
from creditlens.sources.schema import TABLE_NAMES
from creditlens.sources.star_mapping import from_star_schema, with_prelude

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _norm(v):
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


@pytest.mark.parametrize("name", TABLE_NAMES)
def test_table_matches_prelude(spark, duck, name):
    t = from_star_schema(spark, SF)
    sdf = report_types(t.table(name))
    srows = sorted(tuple(_norm(x) for x in r) for r in sdf.collect())
    cols = ", ".join(
        f"CAST({c} AS DOUBLE)" if name in ("conta", "emprestimo", "parcela", "modalidade")
        and c in ("saldo_atual", "valor_contratado", "valor_parcela", "taxa_juros_anual")
        else f"CAST({c} AS VARCHAR)" if c.startswith("data_") else c
        for c in sdf.columns)
    drows = sorted(tuple(_norm(x) for x in r) for r in duck.execute(with_prelude(f"SELECT {cols} FROM {name}")).fetchall())
    assert len(srows) > 0
    assert srows == drows
