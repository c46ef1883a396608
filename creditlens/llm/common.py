"""Helpers shared by the training-data operators: word rules, scratch tables, file access."""

from __future__ import annotations

import contextlib
import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditlens.session import ensure_checkpoint_dir

#: White space of every word rule here: space and the five ASCII controls 9-13 (what bytes.split() splits on).
SPACE_CLASS = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def fold_words(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text with A-Z lower-cased; a null text has none."""
    return text.translate(FOLD).split() if text else []


#: Options of scratch tables on a local file system, where Hadoop else starts two processes (chmod) for each file
#: written: of the file and of its checksums, which are left out here.  Other file systems do not look at them.
RAW_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

_open: set[Scratch] = set()


def cleaned(operator):
    """The operator, whose scratch folders are removed if it fails."""
    @functools.wraps(operator)
    def run(*args, **kwargs):
        before = set(_open)
        try:
            return operator(*args, **kwargs)
        except BaseException:
            for scratch in _open - before:
                scratch.remove()
            raise

    return run


def fixed(df: DataFrame) -> DataFrame:
    """A reliable ``checkpoint()`` of ``df`` whose files are written as ``RAW_FILES``.

    A process that an executor starts shares its memory until it runs its own
    program, so that the executor seems to take twice what it does.  Checkpoints
    take no options of their own: the session's are set while one is written, so
    this is for plans over scratch tables alone.  A state store, for one, cannot
    be read meanwhile.
    """
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    before = {k: conf.get(k) for k in RAW_FILES}
    try:
        for k, v in RAW_FILES.items():
            conf.set(k, v)
        return df.checkpoint(eager=True)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


class Scratch:
    """A folder of this run under the session's shared checkpoint folder.

    Tables written here survive lost executors.  ``finish(df)`` fixes a result
    with a reliable ``checkpoint()`` and then removes the folder, so callers
    leave no scratch data behind.  ``batch`` bounds the rows that travel to
    Python and back at once, for operators that send whole texts or sets: a
    batch is held several times, in the executor and in its Python worker.
    """

    def __init__(self, spark: SparkSession, label: str, batch: int | None = None):
        self.spark, self.batch = spark, batch
        self.path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        _open.add(self)

    def dir(self, name: str) -> str:
        return f"{self.path}/{name}"

    def write(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        """Write ``df`` as Parquet and read it back."""
        with self.batched():
            df.write.options(**RAW_FILES).option("compression", compression).parquet(self.dir(name))
        return self.spark.read.schema(df.schema).parquet(self.dir(name))

    @contextlib.contextmanager
    def batched(self):
        """Within it no more than ``batch`` rows travel to Python at once; the session's own bound holds again after it."""
        before = self.spark.conf.get(BATCH)
        try:
            if self.batch and not 0 < int(before) <= self.batch:
                self.spark.conf.set(BATCH, self.batch)
            yield
        finally:
            self.spark.conf.set(BATCH, before)

    def holds(self, name: str) -> bool:
        """Whether a table of that name was written."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.dir(name))
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(path)

    def finish(self, df: DataFrame, raw: bool = False) -> DataFrame:
        with self.batched():
            out = fixed(df) if raw else df.checkpoint(eager=True)
        self.remove()
        return out

    def remove(self) -> None:
        _open.discard(self)
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def located(docs: DataFrame, scratch: Scratch, *columns: Column) -> DataFrame:
    """The given columns with ``file`` and ``row``: the file and row number that hold each row.

    The pair identifies a row even if its id is null or repeated, and stays
    the same on every scan.  A frame that is not a plain file scan is written
    to the scratch folder first.
    """
    try:
        meta = docs.metadataColumn("_metadata")
        return docs.select(*columns, meta["file_path"].alias("file"), meta["row_index"].alias("row"))
    except Exception as e:
        if "UNRESOLVED" not in str(e) and "_metadata" not in str(e):
            raise
    return located(scratch.write(docs, "copy"), scratch, *columns)


def join_rows(docs: DataFrame, decisions: DataFrame, how: str = "inner") -> DataFrame:
    """``docs`` (a file scan) joined with ``decisions`` by their (file, row)."""
    meta = docs.metadataColumn("_metadata")
    at = docs.withColumns({"__file": meta["file_path"], "__row": meta["row_index"]})
    keyed = decisions.withColumnsRenamed({"file": "__file", "row": "__row"})
    return at.join(keyed, ["__file", "__row"], how).drop("__file", "__row")
