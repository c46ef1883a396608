"""Operator 1 [native] - fuzzy line deduplication by MinHash.

Lines (white space collapsed) are grouped exactly first.  Each distinct line
is cut into overlapping character shingles; each shingle is hashed once, and
the hash deals it to one of the bands.  A band's signature holds the smallest
hashes of its shingles after fixed XORs (permutations of the hash values).
The signatures are one hash aggregation over exploded shingles; the distinct
lines lie in a bucketed table, so that aggregation moves no row.  Equal bands
are buckets.
Star edges to each bucket's most central line, then blocks of lines that the
confirmed stars left apart, are confirmed by the exact Jaccard similarity of
whole shingle sets.  A sketch of bits rules out most pairs without a set: two
sets differ in at least as many shingles as their sketches in bits.  The sets
of the other pairs are built from the lines where they are compared, each pair
in one of its buckets, and distributed union-find gives the components.  Of every
component the occurrence with the smallest (document id, line number) stays.
Only built-in functions run.

10 bands of 4 find a pair at similarity 0.8 with probability 0.995.

Defined results: a null or empty text has no lines; lines without a word are
neither compared nor dropped; a line shorter than a shingle is one shingle; a
null id sorts last; repeated rows are documents of their own; of equal ids the
line that stands first by file, row and line stays; a very long text is cut
into its lines, and a very long line is shingled whole, in one row; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import random
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditlens.llm.common import RAW_FILES, SPACE_CLASS, Scratch, cleaned, join_rows, located, table
from creditlens.llm.graph import bucket_hubs, cross_tasks, distinct_buckets, linked, star_tasks

SHINGLE, BANDS, ROWS = 8, 10, 4
BLOCK = 64
WORDS = 16  # of 64 bits in a sketch
_DRAW = random.Random(1997)
MASKS = [_DRAW.getrandbits(64) - 2**63 for _ in range(ROWS)]


def _starts(units):
    """Start numbers of the shingles of a line given as UTF-16 units, which allow constant-time cuts."""
    return F.sequence(F.lit(0), F.greatest(F.floor(F.length(units) / 2).cast("int") - SHINGLE, F.lit(0)))


def _hash(units, i):
    return F.xxhash64(F.substring(units, i * 2 + 1, F.lit(2 * SHINGLE)))


def keyed(signed: DataFrame) -> DataFrame:
    """(id, key) dealt by the key once: to count a bucket and to take its members needs no further shuffle."""
    return signed.select("id", F.explode("keys").alias("key")).where("key IS NOT NULL").repartition("key")


def has_word(raw: Column) -> Column:
    return F.btrim(raw, F.lit(" \t\x0b\x0c\r")) != ""


def cleaned_line(raw: Column) -> Column:
    """A line with its white space collapsed; the pattern runs only on lines that hold more than single spaces."""
    odd = functools.reduce(Column.__or__, (F.contains(raw, F.lit(x)) for x in ("  ", "\t", "\x0b", "\x0c", "\r")))
    return F.trim(F.when(odd, F.regexp_replace(raw, SPACE_CLASS, " ")).otherwise(raw))


def sketched(lines: DataFrame) -> DataFrame:
    """(id, line) with n, the number of shingles, repeats counted, and bits, a sketch: a shingle sets one bit by its hash."""
    units = lines.select("id", F.encode("line", "UTF-16BE").alias("u"))
    hashed = (units.select("id", "u", F.explode(_starts(F.col("u"))).alias("i"))
              .select("id", _hash(F.col("u"), F.col("i")).alias("h")))
    hashed = hashed.select("id", F.expr(f"int(shiftrightunsigned(h, 6) & {WORDS - 1})").alias("w"),
                           F.expr("shiftleft(1L, int(h & 63))").alias("bit"))
    bits = hashed.groupBy("id").agg(F.count(F.lit(1)).alias("n"),
                                    *(F.bit_or(F.when(F.col("w") == k, F.col("bit"))).alias(f"w{k}") for k in range(WORDS)))
    return lines.join(bits.select("id", "n", F.array(*(F.coalesce(f"w{k}", F.lit(0).cast("long")) for k in range(WORDS)))
                                  .alias("bits")), "id")


#: The shingle set of a line ``{0}``; the outer lambda holds its units.
SET = f"""transform(array(encode({{0}}, 'UTF-16BE')), u -> array_distinct(transform(
          sequence(1, greatest(length(u) - {2 * SHINGLE - 1}, 1), 2), i -> xxhash64(substring(u, i, {2 * SHINGLE})))))[0]"""

#: Bits in which the sketches of x and y differ: in their first words, which rule out most pairs, and in all.
APART = [" + ".join(f"bit_count(x.bits[{k}] ^ y.bits[{k}])" for k in range(n)) for n in (3, WORDS)]


def confirmed(tasks: DataFrame, lines: DataFrame, percent: int) -> DataFrame:
    """Similar pairs (a, b) of ``tasks`` (task, blk, c, id, maybe key) on whole sets of ``lines`` (id, line, maybe n,
    bits and keys).

    A task is one row of at most two blocks of bounded length, and only its
    similar pairs leave it.  Lines travel, not their sets, which are eight
    bytes a character; a set is built where its task is, and only if the
    sketches leave open whether the line is similar to another of the task.
    With keys, a pair is compared in the first of the buckets that both lines are in.
    """
    # of sets with n and m shingles that are similar enough, at most (n + m) * (100 - percent) / (100 + percent) are not common
    more = [c for c in lines.columns if c in ("n", "bits")]
    may = " ".join(f"AND {100 + percent} * ({bits}) <= {100 - percent} * (x.n + y.n)" for bits in APART) if more else ""
    key = []
    if "key" in tasks.columns and "keys" in lines.columns:
        key, more = [F.min("key").alias("key")], [*more, "keys"]
        may += " AND array_min(array_intersect(x.keys, y.keys)) = key"
    met = (tasks.join(lines, "id").groupBy("task")
           .agg(F.min("blk").alias("lo"), F.max("blk").alias("hi"), *key,
                F.collect_list(F.struct("blk", "id", "c", "line", *more)).alias("members")))
    pairs = f"""flatten(transform(filter(members, x -> x.blk = lo), x -> transform(
        filter(members, y -> y.blk = hi AND x.c <> y.c AND (lo < hi OR x.id < y.id) {may}),
        y -> struct(least(x.id, y.id) AS a, greatest(x.id, y.id) AS b))))"""
    met = met.select("members", F.expr(pairs).alias("open"))
    met = met.select("members", "open", F.expr("array_distinct(concat(open.a, open.b))").alias("ids"))
    sets = F.expr(f"transform(ids, v -> {SET.format('filter(members, m -> m.id = v)[0].line')})")
    met = met.select("open", "ids", sets.alias("sets"))
    similar = F.expr(f"""filter(open, p -> exists(array(struct(
        sets[int(array_position(ids, p.a)) - 1] AS x, sets[int(array_position(ids, p.b)) - 1] AS y)), s ->
        100 * least(size(s.x), size(s.y)) >= {percent} * greatest(size(s.x), size(s.y))
        AND {100 + percent} * size(array_intersect(s.x, s.y)) >= {percent} * (size(s.x) + size(s.y))))""")
    return met.select(F.explode(similar).alias("p")).select("p.*").distinct()


def without_hubs(buckets: DataFrame) -> DataFrame:
    """(key, id) of the members but the hubs, which the stars have compared with every other member."""
    return buckets.join(bucket_hubs(buckets), "key").where("a <> id").select("key", "id")


@cleaned
def line_dedup(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_lines (with a word), dropped (numbers of the lines that go, from 0), file, row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "line-dedup")
    rows = located(docs, scratch, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cut = rows.select("doc_id", "file", "row", F.posexplode_outer(F.split("text", "\n", -1)).alias("no", "raw"))
    lines = (cut.where(has_word(F.col("raw")))
             .select("doc_id", "file", "row", "no", cleaned_line(F.col("raw")).alias("line")))
    keys = [F.xxhash64("line").alias("d1"), F.xxhash64(F.lit(1), "line").alias("d2")]  # 128 bits, two seeds

    # distinct lines in buckets of their key: later groupings by the key need no shuffle
    name = f"lines_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (lines.select(*keys, "line").groupBy("d1", "d2").agg(F.first("line").alias("line"), F.count(F.lit(1)).alias("n"))
     .write.options(path=scratch.dir("lines"), compression="zstd", **RAW_FILES).bucketBy(parts, "d1", "d2").saveAsTable(name))
    try:
        out = _kept_lines(spark.table(name), rows, lines, keys, percent, scratch).checkpoint(eager=True)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    scratch.remove()
    return out


def _kept_lines(distinct: DataFrame, rows: DataFrame, lines: DataFrame, keys: list[Column], percent: int,
                scratch: Scratch) -> DataFrame:
    """The rows with the numbers of their lines that go, from the distinct lines and where they stand."""
    # the units are a column of their own below the explode: encoded once a line, not once a shingle
    units = distinct.select("d1", "d2", F.encode("line", "UTF-16BE").alias("u"))
    hashed = (units.select("d1", "d2", "u", F.explode(_starts(F.col("u"))).alias("i"))
              .select("d1", "d2", _hash(F.col("u"), F.col("i")).alias("h")))
    # a shingle counts in one band, so it costs ROWS comparisons; a band without shingles is no bucket
    least = hashed.groupBy("d1", "d2", F.expr(f"pmod(h, {BANDS}L)").alias("band")).agg(
        *(F.min(F.col("h").bitwiseXOR(F.lit(m))).alias(f"m{k}") for k, m in enumerate(MASKS)))
    bands = least.select("d1", "d2", F.xxhash64("band", *(f"m{k}" for k in range(ROWS))).alias("key"))
    signed = scratch.write(bands.groupBy("d1", "d2").agg(F.collect_list("key").alias("keys"))
                           .withColumn("id", F.monotonically_increasing_id()), "signed")
    buckets = scratch.write(distinct_buckets(keyed(signed), hashed=True), "buckets")
    # hashed joins: the smaller side is a part of each partition's lines, and the larger need not be sorted
    keys_of = buckets.groupBy("id").agg(F.collect_list("key").alias("keys"))
    wanted = signed.select("id", "d1", "d2").join(keys_of.hint("shuffle_hash"), "id")
    texts = scratch.write(distinct.join(wanted.hint("shuffle_hash"), ["d1", "d2"]).select("id", "line", "keys"), "texts")
    texts = scratch.write(sketched(texts), "sketched")
    found, _ = linked(buckets, lambda edges: confirmed(star_tasks(edges, BLOCK), texts, percent),
                      lambda b, first: confirmed(cross_tasks(without_hubs(b), first, BLOCK), texts, percent), scratch)

    # lines that occur twice or are linked with another; the rest stay as they are
    group = (signed.select("id", "d1", "d2").join(found, "id").select("d1", "d2", "component")
             .join(distinct.select("d1", "d2", "n"), ["d1", "d2"], "full")
             .where("component IS NOT NULL OR n > 1"))
    near = F.col("component").isNotNull()
    group = group.select("d1", "d2", F.struct(
        near.alias("near"), F.when(near, F.col("component")).otherwise(F.col("d1")).alias("x"),
        F.when(near, F.lit(0)).otherwise(F.col("d2")).alias("y")).alias("g"))
    group = scratch.write(group, "group").hint("shuffle_hash")
    placed = scratch.write(lines.select("doc_id", "file", "row", "no", *keys).join(group, ["d1", "d2"])
                           .select("doc_id", "file", "row", "no", "g"), "placed")
    order = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), "file", "row", "no")
    first = scratch.write(placed.groupBy("g").agg(F.min(order).alias("first")), "first")
    gone = (placed.join(first, "g").where(order != F.col("first")).groupBy("file", "row")
            .agg(F.array_sort(F.collect_list("no")).alias("dropped")))
    counts = rows.select("doc_id", "file", "row", F.size(F.filter(
        F.split(F.coalesce("text", F.lit("")), "\n", -1), has_word)).cast("long").alias("n_lines"))
    return counts.join(gone, ["file", "row"], "left").select(
        "doc_id", "n_lines", F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"), "file", "row")


def without_dropped(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` (a file scan) with the dropped lines taken out of the texts; a text may become empty."""
    gone = line_dedup(docs, percent).select(F.col("dropped").alias("__dropped"), "file", "row")
    left = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("__dropped", i))
    return join_rows(docs, gone).withColumn("text", F.array_join(left, "\n")).drop("__dropped")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).drop("file", "row")
