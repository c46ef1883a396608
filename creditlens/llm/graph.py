"""Links between near copies: star edges of buckets, blocks of strangers, distributed union-find.

Nothing here lists all pairs of a bucket.  A bucket's members are linked to
its most central member (a star).  Members that the confirmed stars leave in
different components are then compared in blocks, so that a bucket costs its
size plus the strangers it holds, and no task meets more than two blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditlens.llm.common import Scratch

BLOCK = 256


def distinct_buckets(buckets: DataFrame, hashed: bool = False) -> DataFrame:
    """(key, id) without buckets of one member, and with one bucket of those that hold the same members.

    ``hashed``: few keys stay, so that a partition's can be hashed and its rows need not be sorted.
    """
    mark = F.xxhash64("id", F.lit(1))
    of = (buckets.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("id")).alias("x"),
                                     F.bit_xor(mark).alias("y")).where("k > 1"))
    kept = of.groupBy("k", "x", "y").agg(F.min("key").alias("key")).select("key")
    return buckets.join(kept.hint("shuffle_hash") if hashed else kept, "key")


def bucket_hubs(buckets: DataFrame) -> DataFrame:
    """(key, a) from (key, id): each bucket's hub.

    The hub is the member that shares most buckets with others (ties: the
    smallest): of a family of copies, that is the original they all resemble.
    """
    width = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("k"))
    weight = buckets.join(width, "key").groupBy("id").agg(F.sum("k").alias("w"))
    return buckets.join(weight, "id").groupBy("key").agg(F.max_by("id", F.struct("w", -F.col("id"))).alias("a"))


def star_edges(buckets: DataFrame) -> DataFrame:
    """(a, b) from (key, id): each bucket's hub a with its other members, each pair once."""
    return buckets.join(bucket_hubs(buckets), "key").where("a <> id").select("a", F.col("id").alias("b")).distinct()


def star_tasks(edges: DataFrame, block: int | None = None) -> DataFrame:
    """(task, blk, c, id) to compare each a with its b: a hub and at most about BLOCK members a task."""
    fans = edges.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / (block or BLOCK)).alias("n"))
    dealt = edges.join(fans, "a").withColumn("task", F.xxhash64("a", F.expr("pmod(xxhash64(b), n)")))
    hubs = dealt.select("task", F.lit(0).alias("blk"), F.col("a").alias("c"), F.col("a").alias("id")).distinct()
    return hubs.unionByName(dealt.select("task", F.lit(1).alias("blk"), F.col("b").alias("c"), F.col("b").alias("id")))


def cross_tasks(buckets: DataFrame, found: DataFrame, block: int | None = None) -> DataFrame:
    """(task, blk, c, id, key) to compare members of bucket ``key`` that ``found`` (id, component) leaves apart.

    A bucket within one component costs nothing.  Otherwise the members
    outside its largest component (the strangers) form blocks, and so do the
    others; every block of strangers meets every block.
    """
    block = block or BLOCK
    member = buckets.join(found, "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    parts = member.groupBy("key", "c").agg(F.count(F.lit(1)).alias("n"))
    mixed = (parts.groupBy("key").agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.sum("n").alias("n"),
                                      F.max("n").alias("n_main"), F.count(F.lit(1)).alias("cs")).where("cs > 1"))
    mixed = mixed.select("key", "main", (F.col("n") <= block).alias("whole"),
                         F.ceil((F.col("n") - F.col("n_main")) / block).alias("odd"),
                         F.ceil(F.col("n_main") / block).alias("even"))
    placed = member.join(mixed, "key").withColumn("blk", F.expr(
        "CASE WHEN whole THEN 0 WHEN c <> main THEN pmod(xxhash64(id), odd) ELSE odd + pmod(xxhash64(id), even) END"))
    # block i of strangers meets all blocks; a later block is met by the strangers' blocks only
    partner = F.expr("CASE WHEN whole THEN array(0L) WHEN blk < odd THEN sequence(0L, odd + even - 1) "
                     "ELSE sequence(0L, odd - 1) END")
    sent = placed.withColumn("other", F.explode(partner))
    return sent.select(F.xxhash64("key", F.least("blk", "other"), F.greatest("blk", "other")).alias("task"),
                       F.col("blk").cast("int").alias("blk"), "c", "id", "key")


def components(edges: DataFrame, scratch: Scratch, label: str = "cc") -> DataFrame:
    """(id, component) of every node of ``edges`` (a, b): the smallest id it is linked with.

    Large-star / small-star union-find (Kiveris et al., 2014): each round every
    node links its larger neighbours, then its smaller ones, to its smallest
    neighbour.  Stars are the fixed point.  Each round is a written table; a
    node with very many neighbours only meets a hash aggregate and a join.
    """
    links = scratch.write(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                          .distinct(), f"{label}-0")

    def state():
        return links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()

    k, before = 0, state()
    while before[0]:
        k += 1
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nearest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(nearest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = scratch.write(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), f"{label}-{k}")
        before, last = state(), before
        if before == last:
            break
    roots = links.select(F.col("v").alias("id")).distinct()
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        roots.select("id", F.col("id").alias("component")))


def linked(buckets: DataFrame, verify_stars, verify_cross, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(components, confirmed edges) of the members of ``buckets`` (key, id).

    ``verify_stars`` gets the star edges (a, b), ``verify_cross`` the buckets
    and the components so far; both return the edges (a, b) they confirm.
    """
    stars = scratch.write(verify_stars(star_edges(buckets)), "stars")
    first = scratch.write(components(stars, scratch, "first"), "first-components")
    more = scratch.write(verify_cross(buckets, first), "more")
    edges = stars.unionByName(more)
    if more.isEmpty():
        return first, edges
    joined = more.select("a", "b").unionByName(first.select(F.col("component").alias("a"), F.col("id").alias("b")))
    return scratch.write(components(joined, scratch, "second"), "second-components"), edges
