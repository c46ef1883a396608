"""The corpus pipeline: quality rules, exact dedup, near dedup, mixing, packing.

Every stage works on the whole table its predecessor kept; ``docs`` is that
table as a Parquet scan.  All stages but the last return documents with the
columns of ``documents``; the last returns the pieces of packed sequences.

Defined results are those of the operators: a null or empty text fails the
base rule and goes; repeated rows are equal texts, of which one stays; a null
id comes last; very long texts are read whole in every stage; an empty table
passes through as one; columns besides those of ``documents`` travel along to
the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from creditlens.llm.common import Scratch, cleaned, table
from creditlens.llm.exact_dedup import keep_first
from creditlens.llm.mixing import mix_texts
from creditlens.llm.near_dedup import keep_one
from creditlens.llm.packing import pack, vocabulary
from creditlens.llm.quality_rules import keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a certified rule rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays."""
    return keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more stays."""
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents hold the words the mix takes of them; those it takes nothing of go."""
    return mix_texts(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens; workers keep few words, as the memory they had in other stages stays taken."""
    return pack(docs, vocabulary(), cached=(50_000, 200_000))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: The certified cutoffs, the MinHash groups and the tokenizer are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


@cleaned
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline", batch=1000)
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name, compression="snappy")
    return scratch.finish(STAGES[-1][1](spark, docs, sf_dir))
