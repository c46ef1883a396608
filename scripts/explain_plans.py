"""Print the physical plan of registered reports.

usage: python scripts/explain_plans.py [sf_dir] [mode] [name-substring ...]

mode is an ``explain`` mode (simple, formatted, cost, ...; default formatted).
With ``--executed`` among the arguments the report runs first (noop sink), so
the adaptive plan shown is the final one chosen at run time.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from creditlens.plans.catalog import REPORTS, run  # noqa: E402
from creditlens.session import build_session  # noqa: E402


def main():
    args = [a for a in sys.argv[1:] if a != "--executed"]
    executed = "--executed" in sys.argv
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    mode = args[1] if len(args) > 1 else "formatted"
    filters = args[2:]
    spark = build_session("local[*]", 16)
    for name in REPORTS:
        if filters and not any(f in name for f in filters):
            continue
        df = run(name, spark, sf_dir)
        if executed:
            df.write.format("noop").mode("overwrite").save()
        print(f"===== {name} =====")
        df.explain(mode=mode)
    spark.stop()


if __name__ == "__main__":
    main()
