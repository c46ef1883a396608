"""

usage: python scripts/measure_baseline.py [sf_dir] [runs]

Per report: median of `runs` timed runs after one warm-up (noop sink), rows out,
number of Exchange nodes in the final adaptive plan, whether any
``Exchange SinglePartition`` sits directly over un-aggregated rows, and the
DuckDB time of the oracle statement.  Also times the naive single-partition
windows against the scalable forms for Q14, Q38 and Q02.
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
from pyspark.sql import Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from creditlens.plans.catalog import REPORTS, load, run  # noqa: E402
from creditlens.plans.oracle import ORACLE_SQL  # noqa: E402
from creditlens.session import build_session  # noqa: E402


def force(df):
    df.write.format("noop").mode("overwrite").save()


def timed(make, runs):
    force(make())
    ts = []
    for _ in range(runs):
        t0 = time.perf_counter()
        force(make())
        ts.append(time.perf_counter() - t0)
    return statistics.median(ts)


def final_plan(df):
    force(df)
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def single_partition_over_raw(text):
    lines = text.splitlines()
    for i, l in enumerate(lines):
        if "Exchange SinglePartition" in l and i + 1 < len(lines):
            child = re.sub(r"^[\s:+\-]*", "", lines[i + 1])
            if not child.startswith(("HashAggregate", "ObjectHashAggregate", "SortAggregate")):
                return True
    return False


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    runs = int(sys.argv[2]) if len(sys.argv) > 2 else 5
    cpus = os.cpu_count()
    spark = build_session("local[*]", 16)
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")

    keys, seen = [], set()
    for n in REPORTS:
        if n[:1] == "q" and n[:3] not in seen:
            seen.add(n[:3])
            keys.append(n)

    print(f"sf_dir={sf_dir} runs={runs} cpus={cpus} spark={spark.version} "
          f"shuffle.partitions={spark.conf.get('spark.sql.shuffle.partitions')}")
    print("| query | seconds (median of %d) | rows out | exchanges | SinglePartition over un-aggregated rows? "
          "| DuckDB seconds |" % runs)
    print("|---|---|---|---|---|---|")
    total = dtotal = 0.0
    for name in keys:
        sec = timed(lambda: run(name, spark, sf_dir), runs)
        df = run(name, spark, sf_dir)
        text = final_plan(df)
        n_ex = len(re.findall(r"\bExchange\b|ReusedExchange", text))
        rows = df.count()
        con.execute(ORACLE_SQL[name]).fetchall()
        ds = []
        for _ in range(runs):
            t0 = time.perf_counter()
            con.execute(ORACLE_SQL[name]).fetchall()
            ds.append(time.perf_counter() - t0)
        dsec = statistics.median(ds)
        total += sec
        dtotal += dsec
        sp = "yes" if single_partition_over_raw(text) else "no"
        print(f"| {name} | {sec:.3f} | {rows} | {n_ex} | {sp} | {dsec:.3f} |")
    print(f"| **total** | **{total:.2f}** | | | | **{dtotal:.2f}** |")

    # naive single-task windows vs the scalable forms
    from creditlens.plans import ranking
    t = load(spark, sf_dir)
    totals = ranking.member_totals(t)
    naive14 = lambda: totals.select("id_cooperado", "nome_completo", "total",
                                    F.ntile(4).over(Window.orderBy(F.desc("total"), "id_cooperado")).alias("tier"))
    vals = t.emprestimo.select("id_emprestimo", "valor_contratado")
    naive38 = lambda: (vals.select("valor_contratado", F.ntile(10).over(
        Window.orderBy("valor_contratado", "id_emprestimo")).alias("r")).where("r = 10")
        .agg(F.min("valor_contratado").alias("p90")))
    from creditlens.operators.chain import loan_chain
    pop = loan_chain(t, "none", modality=True)
    naive02 = lambda: (pop.withColumn("m", F.round(
        F.sum("valor_contratado").over(Window.partitionBy("nome_modalidade")).cast("double")
        / F.count("valor_contratado").over(Window.partitionBy("nome_modalidade")), 2))
        .where(F.col("status_contrato") == "Ativo"))
    print()
    print("| comparison | naive seconds | scalable seconds |")
    print("|---|---|---|")
    for label, naive, key in [("q14 naive NTILE window vs range-partitioned tiles (S02)", naive14, "q14_member_tiers"),
                              ("q38 naive NTILE window vs rank selection", naive38, "q38_p90_cut"),
                              ("q02 AVG OVER window vs group-mean join-back (S04)", naive02,
                               "q02_ticket_vs_modality_mean")]:
        a = timed(naive, runs)
        b = timed(lambda: run(key, spark, sf_dir), runs)
        print(f"| {label} | {a:.3f} | {b:.3f} |")
    spark.stop()


if __name__ == "__main__":
    main()
