"""Distribution statistics: Q31 Q33 Q34 Q35 Q36 Q37 Q38 Q40.

Order statistics (median, P90) come from the exact selection operator
(``values_at_ranks``): a few one-row aggregates bracket the wanted positions
and only the values inside the bracket are ordered.  No report sorts all
loans inside one task, and no percentile buffers all distinct values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditlens.functions.columns import as_double, mean_of, round2
from creditlens.operators.chain import loan_chain
from creditlens.operators.dispersion import dispersion, exact_moments
from creditlens.operators.mode import mode
from creditlens.operators.moments import central, merged, power_sums
from creditlens.operators.selection import values_at_ranks
from creditlens.sources.tables import Tables

V = "valor_contratado"


def _values(t: Tables) -> DataFrame:
    return t.emprestimo.select("id_emprestimo", V)


def modal_rate(t: Tables) -> DataFrame:
    """Q31 — the annual rate contracted most often and how often (ties: lowest rate)."""
    per_modality = t.emprestimo.groupBy("id_modalidade").agg(F.count(F.lit(1)).alias("_n"))
    df = per_modality.join(t.dim("modalidade"), "id_modalidade")
    counted = df.groupBy("taxa_juros_anual").agg(
        F.sum(F.when(F.col("taxa_juros_anual").isNotNull(), F.col("_n")).otherwise(F.lit(0)))
        .alias("qtde_contratada"))
    return counted.orderBy(F.desc("qtde_contratada"), F.asc("taxa_juros_anual")).limit(1)


def lower_median(t: Tables) -> DataFrame:
    """Q33 — the loan value at position (N+1) div 2 in ascending order."""
    rows = values_at_ranks(t.emprestimo, V, lambda n: [(n + 1) // 2], around=0.5)
    return rows.select(F.col(V).alias("mediana"))


def variance(t: Tables) -> DataFrame:
    """Q34 — population variance of the loan values, rounded to 2."""
    return dispersion(t.emprestimo, [], V).select(round2("var_pop").alias("variancia"))


def stddev(t: Tables) -> DataFrame:
    """Q35 — population standard deviation of the loan values, rounded to 2."""
    return dispersion(t.emprestimo, [], V).select(round2("stddev_pop").alias("desvio_padrao"))


def cv_by_profile(t: Tables) -> DataFrame:
    """Q36 — coefficient of variation (%) of loan values per producer profile.

    Loans become exact power sums per account, which merge per profile
    without loss (``operators.moments``)."""
    per_account = t.emprestimo.groupBy("id_conta").agg(*power_sums(V))
    sums = loan_chain(t, "none", per_account).groupBy("perfil_produtor").agg(*merged())
    cv = round2(F.try_divide("stddev_pop", "mean") * 100.0).alias("coeficiente_variacao")
    return central(sums).select("perfil_produtor", cv).orderBy(F.desc("coeficiente_variacao"), "perfil_produtor")


def zscore_outliers(t: Tables, z: float = 2.0) -> DataFrame:
    """Q37 — loans whose z-score (population std-dev) exceeds `z`.

    Mean and std-dev come from ``exact_moments``: exact sums, and scores that
    do not depend on how the rows were partitioned; they are shown with 8
    decimals.  (Q34 and Q35 round to 2 and use the one-pass ``dispersion``.)"""
    stats = exact_moments(t.emprestimo, V).select(F.col("mean").alias("_m"), F.col("stddev_pop").alias("_sd"))
    # a global aggregate is exactly one row: broadcasting it is bounded
    df = _values(t).crossJoin(F.broadcast(stats))
    score = F.try_divide(as_double(V) - F.col("_m"), F.col("_sd"))
    return (df.select("id_emprestimo", V, score.alias("z_score")).where(F.col("z_score") > F.lit(float(z)))
            .withColumn("z_score", F.round("z_score", 8)))


def p90_cut(t: Tables, k: int = 10) -> DataFrame:
    """Q38 — smallest value of the top NTILE(k) group in ascending order.

    The last tile holds N div k rows, so its first row is at position
    N - N div k + 1; with N < k it is empty and the cut is NULL."""
    rows = values_at_ranks(t.emprestimo, V, lambda n: [n - n // k + 1] if n // k > 0 else [],
                          around=1.0 - 1.0 / k)
    return rows.agg(F.min(V).alias("p90"))


def distribution_summary(t: Tables, as_asked: bool = False, with_skewness: bool = False) -> DataFrame:
    """Q40 — mean, median and mode (ties: lowest value) of the loan values.

    As written the median averages the values at positions {N div 2,
    N div 2 + 1, (N+1) div 2}, which is the true median only for even N (and
    N = 1); ``as_asked`` averages positions (N+1) div 2 and (N+2) div 2.
    ``with_skewness`` adds the population skewness the question's title names
    (rounded to 6 decimals)."""
    aggs = [mean_of(V).alias("media")]
    if with_skewness:
        aggs.append(F.round(F.skewness(F.col(V).cast("double")), 6).alias("assimetria"))
    media = t.emprestimo.agg(*aggs)
    if as_asked:
        ranks = lambda n: [(n + 1) // 2, (n + 2) // 2]
    else:
        ranks = lambda n: [n // 2, n // 2 + 1, (n + 1) // 2]
    # positions form a set (SQL ``rank IN (...)``): each distinct position counts once
    mediana = values_at_ranks(t.emprestimo, V, ranks, around=0.5).agg(mean_of(V).alias("mediana"))
    moda = mode(t.emprestimo, V, "moda")
    return media.crossJoin(mediana).crossJoin(moda)
