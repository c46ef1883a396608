"""Native six-table parquet source: write the mapped tables, read them back."""

import pytest

from creditlens.functions.columns import report_types
from creditlens.plans.catalog import REPORTS
from creditlens.sources import from_star_schema, read_tables, write_tables
from creditlens.sources.schema import SCHEMAS, TABLE_NAMES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("six"))
    write_tables(from_star_schema(spark, SF), path)
    return path


def test_read_tables_has_declared_schemas(spark, stored):
    t = read_tables(spark, stored)
    for n in TABLE_NAMES:
        assert [f.name for f in t.table(n).schema] == [f.name for f in SCHEMAS[n]]
        assert [f.dataType for f in t.table(n).schema] == [f.dataType for f in SCHEMAS[n]]


@pytest.mark.parametrize("name", ["q01_top_loans_per_agency", "q12_balance_vs_debt", "q14_member_tiers",
                                  "q20_instalment_pivot", "q33_lower_median", "q40_distribution_summary"])
def test_reports_agree_on_stored_tables(spark, stored, name):
    fn, params = REPORTS[name]
    a = sorted(tuple(r) for r in report_types(fn(from_star_schema(spark, SF), **params)).collect())
    b = sorted(tuple(r) for r in report_types(fn(read_tables(spark, stored), **params)).collect())
    assert a == b and len(a) > 0


def test_checkpoint_dir_is_read_from_the_session(spark):
    from creditlens.session import ensure_checkpoint_dir

    d = ensure_checkpoint_dir(spark)
    assert d and d == spark.sparkContext.getCheckpointDir()
