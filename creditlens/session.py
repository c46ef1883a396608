"""Session helpers: the builder used by tests/bench and checkpoint-dir policy."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "creditlens", extra: dict | None = None) -> SparkSession:
    """A session configured the way the reports expect to run.

    AQE stays on (runtime broadcast conversion, skew-join splitting and
    partition coalescing); ANSI mode stays on (the reports use
    ``try_divide`` instead of relying on silent NULLs).
    """
    b = (SparkSession.builder.master(master).appName(app_name)
         .config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.requireAllClusterKeysForCoPartition", "false")  # buckets by account serve (account, loan)
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
         .config("spark.driver.memory", os.environ.get("CREDITLENS_DRIVER_MEMORY", "8g")))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory of this session.

    On a cluster the directory must be a shared folder named by
    ``spark.checkpoint.dir`` (set by whoever runs the cluster); it is read,
    never overridden.  Only a local-mode session without one (tests, the
    bench) gets a private scratch folder.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no SparkContext; the server owns the setting
        conf_dir = spark.conf.get("spark.checkpoint.dir", None)
        if not conf_dir:
            raise RuntimeError("spark.checkpoint.dir must be set on the Spark Connect server")
        return conf_dir
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; exact global rankings cut lineage "
            "with a reliable checkpoint and need a shared folder on a cluster")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="creditlens-ckpt-"))
    return sc.getCheckpointDir()


def materialize(df: DataFrame, label: str = "") -> DataFrame:
    """Cut lineage with a reliable ``checkpoint()`` to the session's
    ``spark.checkpoint.dir`` (shared storage on a cluster).

    The rows are computed once and fixed: non-deterministic tags (such as
    ``monotonically_increasing_id``) are never re-evaluated, and a lost
    executor re-reads the files instead of recomputing the lineage.  With
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` (set by
    ``build_session``) Spark deletes the files once no plan references them.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
