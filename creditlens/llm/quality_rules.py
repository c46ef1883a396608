"""Operator 5 - quality rules with risk-controlled thresholds.

Every document gets plain text measures.  For each stratum (language) and each
rule, cutoffs are tested on labelled documents from the most lenient to the
strictest: a cutoff is certified while the exact (Clopper-Pearson) upper bound
of its false-rejection rate, the share of good documents it would reject,
stays within the rule's budget.  Testing in that fixed order needs no
correction over cutoffs; the confidence is split over strata and rules
(Bonferroni), and the false-rejection budget over the rules, so with
probability 1 - ``delta`` no stratum loses more than ``alpha`` of its good
documents.  Of the certified cutoffs the most lenient one that still rejects
nearly as many bad documents as the best is taken; with none certified the
rule rejects nothing in that stratum.

Defined results: a null text has no words; a null stratum is a stratum of its
own; labels that are null or of unknown documents are ignored, and a document
labelled twice counts as bad if any label says so; without labels only the
base rule rejects; repeated rows are judged each; a value equal to a cutoff
falls on the same side everywhere; a very long text is measured whole, in its
row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditlens.llm.common import Scratch, cleaned, join_rows, located, table

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"
CONTINUATION = bytes(range(0x80, 0xC0))
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_lines", "n_marks"]

#: rule -> (ratio, cutoffs from lenient to strict); a document is rejected if its ratio is above the cutoff
RULES = {
    "symbols": ("n_symbols / n_words", [2.0, 1.0, 0.5, 0.3, 0.2, 0.1, 0.05]),
    "marks": ("n_marks / n_words", [2.0, 1.0, 0.5, 0.3, 0.2, 0.1, 0.05]),
    "capitals": ("n_capitals / word_chars", [0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15]),
    "repeats": ("n_repeat_words / n_words", [0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1]),
    "dup_lines": ("n_dup_lines / n_lines", [0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1]),
    "long_words": ("word_chars / n_words", [40, 30, 20, 15, 12, 10, 9, 8]),
}


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found at least twice in the text."""
    n = len(words)
    if n < 4:
        return 0
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    with np.errstate(over="ignore"):
        key = h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(n - 2, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k:n - 2 + k] |= again
    return int(covered.sum())


def measures(text: bytes | None) -> tuple[int, ...]:
    """MEASURES of one UTF-8 text."""
    text = text or b""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (len(words), len(text.translate(None, SPACES + CONTINUATION)), len(text) - len(text.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(words), len(text) - len(text.translate(None, CAPITALS)),
            len(lines), text.count(b"!") + text.count(b"?"))


def _measure(batches):
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        rows = [measures(x) for x in texts]
        columns = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * len(MEASURES)
        rest = [batch.column(c) for c in ("doc_id", "stratum", "file", "row")]
        yield pa.RecordBatch.from_arrays(rest + columns, ["doc_id", "stratum", "file", "row", *MEASURES])


def upper_bound(k: int, n: int, risk: float) -> float:
    """Exact (Clopper-Pearson) upper confidence bound of a rate seen k times in n, at confidence 1 - risk."""
    if k >= n:
        return 1.0
    logs = np.array([math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(k + 1)])
    counts = np.arange(k + 1)

    def tail(p: float) -> float:  # chance of at most k among n
        x = logs + counts * math.log(p) + (n - counts) * math.log1p(-p)
        return float(np.exp(x - x.max()).sum() * math.exp(x.max()))

    low, high = max(k / n, 1e-12), 1.0 - 1e-12
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if tail(mid) > risk else (low, mid)
    return high


def choose(cutoffs: list[float], good: list[int], bad: list[int], n_good: int, budget: float, risk: float,
           share: float = 0.99) -> float | None:
    """The cutoff to use: good and bad hold how many labelled documents each cutoff rejects."""
    certified = 0
    for k in good:
        # a rate seen above the budget can't be certified; this also bounds the exact sum
        if n_good == 0 or k > budget * n_good or upper_bound(k, n_good, risk) > budget:
            break
        certified += 1
    if certified == 0 or bad[certified - 1] == 0:
        return None
    return next(c for c, b in zip(cutoffs, bad) if b >= share * bad[certified - 1])


@cleaned
def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.02,
                  delta: float = 0.05) -> DataFrame:
    """One row per input row: doc_id, measures, base_failed, failed_rules, kept, file, row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality-rules", batch=1000)
    rows = located(docs, scratch, F.col("doc_id").cast("long").alias("doc_id"), F.col(stratum).cast("string").alias("stratum"),
                   F.col("text").cast("string").alias("text"))
    schema = "doc_id long, stratum string, file string, row long, " + ", ".join(f"{m} long" for m in MEASURES)
    rows = scratch.write(rows.mapInArrow(_measure, schema), "measures")
    ratio = {r: F.expr(f"double({x.split(' / ')[0]}) / greatest({x.split(' / ')[1]}, 1)") for r, (x, _) in RULES.items()}

    marked = (labels.where("quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
              .agg(F.min("quality").alias("quality")))
    counts = (rows.select("doc_id", "stratum", *(v.alias(r) for r, v in ratio.items())).join(marked, "doc_id")
              .groupBy("stratum").agg(
                  F.count_if(F.col("quality") == 1).alias("n_good"),
                  *(F.count_if((F.col("quality") == q) & (F.col(r) > c)).alias(f"{r}_{q}_{i}")
                    for r, (_, cutoffs) in RULES.items() for i, c in enumerate(cutoffs) for q in (0, 1))))
    counts = scratch.write(counts, "counts")
    n_strata = counts.count()
    budget, risk = alpha / len(RULES), delta / max(1, n_strata * len(RULES))

    def select(frames):
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                out.append([row["stratum"]] + [
                    choose(cutoffs, *([int(row[f"{r}_{q}_{i}"]) for i in range(len(cutoffs))] for q in (1, 0)),
                           int(row["n_good"]), budget, risk) for r, (_, cutoffs) in RULES.items()])
            yield pd.DataFrame(out, columns=["stratum", *(f"max_{r}" for r in RULES)])

    cutoffs = scratch.write(counts.mapInPandas(select, "stratum string, " + ", ".join(f"max_{r} double" for r in RULES)),
                            "cutoffs").withColumnRenamed("stratum", "of")
    if n_strata <= 10_000:  # one row of a few numbers each
        cutoffs = F.broadcast(cutoffs)
    judged = rows.join(cutoffs, F.col("stratum").eqNullSafe(F.col("of")), "left")
    failed = F.array_compact(F.array(*(F.when(v > F.col(f"max_{r}"), r) for r, v in ratio.items())))
    base = F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    out = judged.select("doc_id", *MEASURES[:5], base.alias("base_failed"), failed.alias("failed_rules"),
                        (~base & (F.size(failed) == 0)).alias("kept"), "file", "row")
    return scratch.finish(out)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    kept = quality_rules(docs, labels).where("kept")
    return join_rows(docs, kept.select("file", "row"), "left_semi")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("file", "row")
