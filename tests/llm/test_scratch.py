"""A failed operator leaves no scratch folder and no table."""

import os

import pyarrow as pa
import pytest

from creditlens.llm import line_dedup, mixing, near_dedup, packing, quality_rules
from creditlens.llm.common import BATCH, RAW_FILES, Scratch


@pytest.mark.parametrize("operator", [
    lambda docs: near_dedup.near_dedup(docs), lambda docs: mixing.mix(docs), lambda docs: line_dedup.line_dedup(docs),
    lambda docs: packing.pack(docs, packing.vocabulary()), lambda docs: quality_rules.quality_rules(docs, docs.selectExpr("doc_id", "1 AS quality"))])
@pytest.mark.parametrize("at", [1, 2])
def test_a_failure_is_cleaned_up(spark, docs_of, monkeypatch, operator, at):
    docs = docs_of([(i, f"some words stand here {i % 3}\nand a line more", "en", "s", 1) for i in range(20)])
    base, write, seen = spark.sparkContext.getCheckpointDir().removeprefix("file:"), Scratch.write, []

    def failing(self, *args, **kwargs):
        seen.append(1)
        if len(seen) == at:
            raise RuntimeError("lost")
        return write(self, *args, **kwargs)

    before = set(os.listdir(base))
    monkeypatch.setattr(Scratch, "write", failing)
    with pytest.raises(RuntimeError, match="lost"):
        operator(docs).collect()
        raise RuntimeError("lost")  # fewer tables than ``at``
    names = ("near-", "mixing-", "line-", "packing-", "quality-")
    left = [f for f in set(os.listdir(base)) - before if f.startswith(names)]
    assert len(seen) < at or left == []
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("lines_")]


def test_a_scratch_file_has_no_checksum_file(spark):
    """Nor was a process started for either of the two."""
    scratch = Scratch(spark, "raw")
    assert scratch.write(spark.range(10), "t").count() == 10
    names = os.listdir(scratch.dir("t").removeprefix("file:"))
    assert any(x.endswith(".parquet") for x in names) and not [x for x in names if x.endswith(".crc")]
    scratch.remove()


def test_the_distinct_lines_have_no_checksum_files(spark, docs_of, monkeypatch):
    docs, names, kept = docs_of([(1, "a line\nanother line"), (2, "a line")]), [], line_dedup._kept_lines

    def seen(distinct, rows, lines, keys, percent, scratch):
        names.extend(os.listdir(scratch.dir("lines").removeprefix("file:")))
        return kept(distinct, rows, lines, keys, percent, scratch)

    monkeypatch.setattr(line_dedup, "_kept_lines", seen)
    assert sorted(r["dropped"] for r in line_dedup.line_dedup(docs).collect()) == [[], [0]]
    assert any(x.endswith(".parquet") for x in names) and not [x for x in names if x.endswith(".crc")]


def test_batches_to_python_are_bounded_and_the_sessions_bound_returns(spark):
    def sizes_of(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    before = spark.conf.get(BATCH)
    rows = spark.range(0, 100, 1, 1)
    scratch = Scratch(spark, "batch", batch=7)
    sizes = [r["n"] for r in scratch.write(rows.mapInArrow(sizes_of, "n long"), "t").collect()]
    assert max(sizes) == 7 and sum(sizes) == 100 and spark.conf.get(BATCH) == before
    with pytest.raises(Exception, match="lost"):
        scratch.write(rows.selectExpr("raise_error('lost') AS x"), "failed")
    assert spark.conf.get(BATCH) == before
    assert max(r["n"] for r in scratch.finish(rows.mapInArrow(sizes_of, "n long")).collect()) == 7
    assert spark.conf.get(BATCH) == before


def test_a_result_is_fixed_without_checksum_files_and_the_sessions_options_return(spark):
    """Nor was a process started for a file: an executor shares its memory with it for a moment."""
    base = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = {k: conf.get(k) for k in RAW_FILES}
    seen = set(os.listdir(base))
    out = Scratch(spark, "fixed").finish(spark.range(0, 100, 1, 3), raw=True)
    folder = max(set(os.listdir(base)) - seen)
    names = os.listdir(f"{base}/{folder}")
    assert sum(x.startswith("part-") for x in names) == 3 and not [x for x in names if x.endswith(".crc")]
    assert out.count() == 100 and {k: conf.get(k) for k in RAW_FILES} == before
    with pytest.raises(Exception, match="lost"):
        Scratch(spark, "failed").finish(spark.range(3).selectExpr("raise_error('lost') AS x"), raw=True)
    assert {k: conf.get(k) for k in RAW_FILES} == before
