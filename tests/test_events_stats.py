"""Statistics operators on a column with real tails (events.value, FIXTURES §2)."""

import duckdb
import pytest
from pyspark.sql import functions as F

from creditlens.operators.dispersion import dispersion
from creditlens.operators.selection import values_at_ranks

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet(f"{SF}/events.parquet").select("event_id", "value")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SF}/events.parquet')")
    return con


def test_order_statistics_match_duckdb(events, duck):
    n = duck.execute("SELECT count(*) FROM events").fetchone()[0]
    picks = [(n + 1) // 2, n - n // 10 + 1, 1, n]
    got = {r["rank"]: r["value"] for r in values_at_ranks(events, "value", lambda _: picks).collect()}
    expected = dict(duck.execute(f"""
        SELECT rk, value FROM (
          SELECT value, row_number() OVER (ORDER BY value ASC NULLS FIRST, event_id) AS rk FROM events)
        WHERE rk IN ({', '.join(map(str, picks))})""").fetchall())
    assert got == expected


def test_dispersion_and_tail_match_duckdb(events, duck):
    d = dispersion(events, [], "value").first()
    var, sd, mean = duck.execute("SELECT var_pop(value), stddev_pop(value), avg(value) FROM events").fetchone()
    assert d["var_pop"] == pytest.approx(var, rel=1e-12)
    assert d["stddev_pop"] == pytest.approx(sd, rel=1e-12)
    z = (F.col("value") - F.lit(d["mean"])) / F.lit(d["stddev_pop"])
    tail = events.where(z > 2).count()
    expected = duck.execute(f"SELECT count(*) FROM events WHERE (value - {mean!r}) / {sd!r} > 2").fetchone()[0]
    assert tail == expected and tail > 0
