import os

import pytest

SF = os.environ.get("LLM_TEST_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture
def docs_of(spark, tmp_path):
    """Write (doc_id, text, ...) rows as Parquet and read them back."""
    import itertools

    count = itertools.count()

    def make(rows, schema="doc_id long, text string, lang string, source string, n_chars long", parts=3):
        path = str(tmp_path / f"t{next(count)}.parquet")
        width = len(schema.split(","))
        rows = [tuple(r) + (None,) * (width - len(r)) for r in rows]
        spark.createDataFrame(rows, schema).repartition(parts).write.parquet(path)
        return spark.read.parquet(path)

    return make
