"""Operator 6 - mixing sources to target weights by Sainte-Lague apportionment.

Sources get target word counts from their weights, with no target above twice
the source's own words (water-filling).  The mix is taken in blocks of equal
length: each source's documents, in a seeded order, form streams of words (its
shards) that are cut every ``block`` words.  The seats - blocks to take - go
to sources by highest quotients votes / (2 seats + 1), then inside each source
to its shards, so every shard gets a whole quota.  A quota of q among m blocks
takes every block q // m times and a seeded, evenly spaced choice of q % m
blocks once more.  How many words of a document were taken follows from its
place in the stream alone, so no block is ever listed.

Rows are drawn by their id and text, so rows without an id, or of one id,
spread over the shards like any others.

Defined results: a null text has no words; a null source is a source of its
own, ordered last; repeated rows are separate documents; a very long text may
fill many blocks and is taken in part or whole like any run of words; ties follow
code-point and shard order; an empty table, or one without words, takes
nothing; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from creditlens.llm.common import Scratch, cleaned, join_rows, located, table, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"


def sainte_lague(votes: np.ndarray, seats: int, caps: np.ndarray) -> np.ndarray:
    """Whole seats by highest quotients votes / (2 s + 1), none above its cap; ties go to the earlier."""
    votes, caps = np.where(caps > 0, votes, 0.0).astype(float), caps.astype(np.int64)
    seats = int(min(seats, caps[votes > 0].sum()))
    got = np.zeros(len(votes), np.int64)
    if seats <= 0:
        return got

    def at(divisor: float) -> np.ndarray:  # seats whose quotients are above the divisor
        return np.minimum(np.ceil(votes / divisor - 0.5).clip(0), caps).astype(np.int64)

    low, high = 0.0, 2 * votes.max() + 1  # at(high) fits; halve towards the largest fit
    for _ in range(200):
        mid = (low + high) / 2
        if mid <= 0 or mid in (low, high):
            break
        low, high = (low, mid) if at(mid).sum() <= seats else (mid, high)
    got = at(high)
    queue = [(-v / (2 * s + 1), i) for i, (v, s, c) in enumerate(zip(votes, got, caps)) if v > 0 and s < c]
    heapq.heapify(queue)
    for _ in range(seats - int(got.sum())):  # the few that tie at the last quotient
        _, i = heapq.heappop(queue)
        got[i] += 1
        if got[i] < caps[i]:
            heapq.heappush(queue, (-votes[i] / (2 * got[i] + 1), i))
    return got


def targets(sizes: np.ndarray, weights: np.ndarray, share: float, most: float) -> np.ndarray:
    """share * all words dealt by weight; no source above most * its size, the excess dealt anew by weight."""
    out = np.zeros(len(sizes))
    left, caps, open_ = share * float(sizes.sum()), most * sizes.astype(float), sizes > 0
    while open_.any():
        level = left / weights[open_].sum()
        over = open_ & (weights * level > caps)
        if not over.any():
            out[open_] = weights[open_] * level
            break
        out[over] = caps[over]
        left -= caps[over].sum()
        open_ &= ~over
    return out


def _extra(k):
    """Among the first k blocks of a shard, those taken once more (m blocks, r of them chosen, seeded start u)."""
    return F.expr(f"(({k}) * r + u) div m")


@cleaned
def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, block: int = 256,
        shard_words: int = 1_000_000, seed: int = 17) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken; then full (whole repeats), start (place in
    the shard's stream), m, r, u (the shard's blocks, those taken once more, seeded start), file, row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    sizes = scratch.write(located(
        docs, scratch, F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(F.col("doc_id").cast("long"), text_or_empty(), F.lit(seed)).alias("draw")), "sizes")
    sources = scratch.write(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    n_shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long")
    sources = sources.withColumn("shards", n_shards).withColumnRenamed("source", "of")
    few = sources.count() <= 10_000  # a checked size: then a row of numbers each is broadcast

    def with_source(df: DataFrame, right: DataFrame) -> DataFrame:
        return df.join(F.broadcast(right) if few else right, F.col("source").eqNullSafe(F.col("of"))).drop("of")

    sharded = with_source(sizes, sources.drop("source_size")).withColumn("shard", F.expr("pmod(draw, shards)")).drop("shards")
    shards = scratch.write(sharded.groupBy("source", "shard").agg(F.sum("size").alias("words")).where("words > 0")
                           .withColumn("m", F.expr(f"(words + {block - 1}) div {block}")), "shards")

    def seats_of_sources(frames):
        frames = [f for f in frames if len(f)]
        if not frames:
            return
        f = pd.concat(frames, ignore_index=True)
        order = sorted(range(len(f)), key=lambda i: (pd.isna(f["of"][i]), f["of"][i] if not pd.isna(f["of"][i]) else ""))
        f = f.iloc[order].reset_index(drop=True)
        w = np.array([float(weights[i % len(weights)]) for i in range(len(f))])
        size, blocks = f["source_size"].to_numpy(), f["blocks"].to_numpy()
        f["target"] = targets(size, w, share, most)
        votes = f["target"].to_numpy() * blocks / np.maximum(size, 1)  # in blocks, as the last block of a shard is shorter
        f["seats"] = sainte_lague(votes, int(round(votes.sum())), most * blocks)
        yield f[["of", "source_size", "target", "seats"]]

    blocks = shards.groupBy(F.col("source").alias("b")).agg(F.sum("m").alias("blocks"))
    named = (sources.join(blocks, F.col("of").eqNullSafe(F.col("b")), "left")
             .select("of", "source_size", F.coalesce("blocks", F.lit(0)).alias("blocks")))
    plan = scratch.write(named.repartition(1).mapInPandas(
        seats_of_sources, "of string, source_size long, target double, seats long"), "plan")

    def seats_of_shards(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("shard")
        f["quota"] = sainte_lague(f["m"].to_numpy(), int(f["seats"].iloc[0]), most * f["m"].to_numpy())
        return f[["source", "shard", "m", "quota"]]

    quotas = with_source(shards, plan).groupBy("source").applyInPandas(
        seats_of_shards, "source string, shard long, m long, quota long")
    quotas = quotas.select(
        F.col("source").alias("q_source"), F.col("shard").alias("q_shard"), "m", F.expr("quota div m").alias("full"),
        F.expr("quota % m").alias("r"), F.expr(f"pmod(xxhash64(source, shard, {seed}), m)").alias("u"))

    stream = Window.partitionBy("source", "shard").orderBy("draw", "doc_id", "file", "row")
    placed = sharded.withColumn("start", F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    placed = placed.join(quotas, F.col("source").eqNullSafe(F.col("q_source")) & (F.col("shard") == F.col("q_shard")), "left")
    placed = placed.fillna({"m": 1, "full": 0, "r": 0, "u": 0})

    def before(x: str):  # words taken once more before place x of the stream
        k = f"(({x}) div {block})"
        chosen = _extra(f"{k} + 1") - _extra(k)
        return _extra(k) * block + chosen * F.expr(f"({x}) - {k} * {block}")

    taken = F.col("full") * F.col("size") + before("start + size") - before("start")
    out = with_source(placed.withColumn("taken", taken), plan.drop("seats")).select(
        "doc_id", "size", "source_size", "target", "taken", "full", "start", "m", "r", "u", "file", "row")
    return scratch.finish(out)


def taken_text(text: str, full: int, start: int, m: int, r: int, u: int, block: int) -> str | None:
    """The text a document contributes: ``full`` whole copies and the words of blocks taken once more."""
    parts = [text] * full
    if r:
        spans = _spans(text.encode())
        k, end = start // block, start + len(spans)
        while k * block < end:
            if ((k + 1) * r + u) // m > (k * r + u) // m:
                first, last = max(start, k * block) - start, min(end, (k + 1) * block) - start
                parts.append(text.encode()[spans[first][0]:spans[last - 1][1]].decode())
            k += 1
    return "\n".join(parts) if parts else None


def _spans(text: bytes) -> list[tuple[int, int]]:
    """Byte spans of the words."""
    space = np.isin(np.frombuffer(text, np.uint8), np.frombuffer(b" \t\n\v\f\r", np.uint8))
    edges = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def mix_texts(docs: DataFrame, block: int = 256, **params) -> DataFrame:
    """The mix as documents: rows with no word taken go, the others hold the words taken; n_chars follows the text."""
    plan = mix(docs, block=block, **params).where("taken > 0").select("full", "start", "m", "r", "u", "file", "row")
    names = {c: f"__{c}" for c in ("full", "start", "m", "r", "u")}
    joined = join_rows(docs, plan.withColumnsRenamed(names))
    columns_of = docs.columns
    place, arguments = columns_of.index("text"), ["text", *names.values()]

    def cut(batches):
        for b in batches:
            args = [b.column(c).to_pylist() for c in arguments]
            texts = [taken_text(*x, block) for x in zip(*args)]
            columns = [b.column(c) for c in columns_of]
            columns[place] = pa.array(texts, columns[place].type)
            yield pa.RecordBatch.from_arrays(columns, columns_of)

    out = joined.mapInArrow(cut, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
