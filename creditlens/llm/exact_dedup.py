"""Operator 8 [native] - exact deduplication by a stateful stream.

Digests of the normalised texts are staged as a small table (digest, stable
id, content locator) and run through Structured Streaming.  The stream keeps
one state row per digest in the RocksDB state store, without a watermark, so
nothing expires: the smallest document id, the locator of that row and the
number of rows.  The finished state is read back with Spark's ``statestore``
source.  Full bytes are compared on hits: only rows whose digest the state
counts twice or more are grouped by (digest, whole text), collapsed on the map
side; texts that occur once are never shuffled.  A digest that stands for two
different texts is regrouped by the texts themselves.

Defined results: a null text counts as empty; a null id sorts after every
other id; of rows that repeat both id and text one stays; a very long text is
normalised, hashed and, on a hit, compared whole; an empty table gives no
rows; other columns of the input are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditlens.llm.common import SPACE_CLASS, Scratch, join_rows, located, table, text_or_empty

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Many small stores: memory bounded over all of an executor's, small blocks set aside in each, none on disk in
#: advance.  Maintenance is what closes the stores of an ended stream; until then they keep their memory.
STORE = {
    PROVIDER: ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    "spark.sql.streaming.stateStore.maintenanceInterval": "5s",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
LAST = 2**63 - 1  # a null id sorts last
FEW_HITS = 200_000  # digests of 64 characters: broadcast up to here, shuffled beyond

STAGED = "id long, digest string, loc long, file string, row long"


def normalised(text_col: str = "text"):
    """The text with every run of white space replaced by one space."""
    return F.regexp_replace(text_or_empty(text_col), SPACE_CLASS, " ")


def run_state(spark: SparkSession, staged_dir: str, state_dir: str, files_per_trigger: int = 1000) -> DataFrame:
    """Stream all staged files not seen before into the keyed state; returns the state.

    May be called again after more files were staged: the state in
    ``state_dir`` goes on from where it was, also after a failed run.
    """
    session = spark.newSession()  # the store's settings are the stream's own
    for k, v in STORE.items():
        session.conf.set(k, v)
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    staged = session.readStream.schema(STAGED).option("maxFilesPerTrigger", files_per_trigger).parquet(staged_dir)
    order = F.coalesce("id", F.lit(LAST))
    keyed = staged.groupBy("digest").agg(F.min("id").alias("keep_id"), F.min_by("loc", order).alias("keep_loc"),
                                         F.count(F.lit(1)).alias("n"))
    (keyed.writeStream.format("noop").outputMode("update").option("checkpointLocation", state_dir)
     .trigger(availableNow=True).start().awaitTermination())
    return (spark.read.format("statestore").load(state_dir)
            .select(F.col("key.digest").alias("digest"), F.col("value.min").alias("keep_id"),
                    F.col("value.valueWithExtremumOrdering").alias("keep_loc"), F.col("value.count").alias("n")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_hex: int = 64,
                files_per_trigger: int = 1000) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, file, row.

    ``file`` and ``row`` locate the row's content.  ``key_hex`` is the number
    of hex digits of the state's key (64: the whole SHA-256); fewer make
    collisions likely and are for tests of the full-bytes check.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    try:
        rows = located(docs, scratch, F.col(id_col).cast("long").alias("id"), normalised(text_col).alias("norm"))
        rows = rows.withColumn("sha", F.sha2("norm", 256)).withColumn("digest", F.substring("sha", 1, key_hex))
        staged = scratch.write(rows.select("id", "digest", F.monotonically_increasing_id().alias("loc"), "file", "row",
                                           *(["sha"] if key_hex < 64 else [])), "staged")
        state = run_state(spark, scratch.dir("staged"), scratch.dir("state"), files_per_trigger)

        # full bytes on hits: copies collapse before the shuffle, so a hot text crosses it once per task
        hits = scratch.write(state.where("n > 1").select("digest"), "hits")
        few = hits.limit(FEW_HITS + 1).count() <= FEW_HITS
        texts = (rows.join(F.broadcast(hits) if few else hits, "digest", "left_semi")
                 .groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("n")))
        mixed = scratch.write(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
                              .select("digest"), "mixed")
        sha = F.col("sha" if key_hex < 64 else "digest").alias("text_sha256")
        out = staged.join(state, "digest").select(
            F.col("id").alias("doc_id"), "keep_id", F.col("n").alias("group_size"),
            (F.col("loc") == F.col("keep_loc")).alias("kept"), sha, "file", "row", "digest")
        if not mixed.isEmpty():
            odd = rows.join(mixed, "digest", "left_semi")
            groups = odd.groupBy("digest", "norm").agg(
                F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"),
                F.min(F.struct(F.coalesce("id", F.lit(LAST)).alias("id"), "file", "row")).alias("first"))
            split = odd.join(groups, ["digest", "norm"]).select(
                F.col("id").alias("doc_id"), "keep_id", "group_size",
                ((F.col("file") == F.col("first.file")) & (F.col("row") == F.col("first.row"))).alias("kept"),
                F.col("sha").alias("text_sha256"), "file", "row", "digest")
            out = out.join(mixed, "digest", "left_anti").unionByName(split)
        return scratch.finish(out.drop("digest"))
    except BaseException:
        scratch.remove()
        raise


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` (a file scan) that stay, with all their columns."""
    kept = exact_dedup(docs, id_col, text_col).where("kept")
    return join_rows(docs, kept.select("file", "row"), "left_semi")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("file", "row")


ORACLE = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
), ranked AS (
  SELECT *, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size,
         row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) AS place
  FROM t
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM ranked
"""
