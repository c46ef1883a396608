"""Benchmark the forty reports.

Runs every headline report (q01..q40) on ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) with ``local[$BENCH_CPUS]``: one warm-up plus
``$BENCH_RUNS`` timed runs each, forced with the ``noop`` sink, and prints ONE
JSON line: {"metric", "value" (sum of per-query medians), "unit", "queries",
"sf", ...}.  It also times each oracle statement in DuckDB on the same files
("duckdb_queries", "duckdb_total"; ``BENCH_DUCKDB=0`` skips that).
``BENCH_CONF`` may hold a JSON object of extra Spark settings.
"""

from __future__ import annotations

import json
import os
import platform
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def _sf_value(sf_dir: str):
    tag = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    try:
        return float(tag)
    except ValueError:
        return tag


def _force(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = os.environ.get("BENCH_ONLY")
    parts = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", str(max(8, 2 * int(cpus) if cpus.isdigit() else 16))))

    from creditlens.session import build_session
    from creditlens.plans.catalog import REPORTS, run

    extra = json.loads(os.environ.get("BENCH_CONF", "{}"))  # optional extra Spark settings
    spark = build_session(f"local[{cpus}]", parts, app_name="creditlens-bench", extra=extra)
    # one entry per question: the as-written report (options are separate keys)
    questions = {f"q{i:02d}" for i in range(1, 41)}
    keys, seen = [], set()
    for n in REPORTS:
        if n[:3] in questions and n[:3] not in seen:
            seen.add(n[:3])
            keys.append(n)
    if only:
        keys = [k for k in keys if any(o in k for o in only.split(","))]

    timings, rows = {}, {}
    for name in keys:
        _force(run(name, spark, sf_dir))  # warm-up (also runs dimension size checks)
        ts = []
        for _ in range(runs):
            t0 = time.perf_counter()
            df = run(name, spark, sf_dir)
            _force(df)
            ts.append(time.perf_counter() - t0)
        timings[name[:3]] = round(statistics.median(ts), 4)
        rows[name[:3]] = run(name, spark, sf_dir).count()

    out = {
        "metric": "sum_of_median_query_seconds",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "rows": rows,
        "sf": _sf_value(sf_dir),
        "runs": runs,
        "cpus": cpus,
        "shuffle_partitions": parts,
        "spark": spark.version,
        "python": platform.python_version(),
    }
    spark.stop()

    if os.environ.get("BENCH_DUCKDB", "1") == "1":
        import duckdb

        from creditlens.plans.oracle import ORACLE_SQL
        con = duckdb.connect()
        for t in ("region", "nation", "customer", "supplier", "orders", "lineitem"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
        dq = {}
        for name in keys:
            con.execute(ORACLE_SQL[name]).fetchall()
            ts = []
            for _ in range(runs):
                t0 = time.perf_counter()
                con.execute(ORACLE_SQL[name]).fetchall()
                ts.append(time.perf_counter() - t0)
            dq[name[:3]] = round(statistics.median(ts), 4)
        out["duckdb_queries"] = dq
        out["duckdb_total"] = round(sum(dq.values()), 3)

    print(json.dumps(out))


if __name__ == "__main__":
    main()
