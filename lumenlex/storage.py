"""Lineage cuts: tables written to the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the setting is absent, a temporary folder is used, but only on a
    local master: on a cluster the executors would not see each other's files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    global _own
    if _own is None:
        _own = tempfile.mkdtemp(prefix="lumenlex-")
        atexit.register(_forget, spark, _own)
    return _own


_own: str | None = None


def _forget(spark: SparkSession, path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared file system, whichever that is."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: Session setting by which a query's shuffle files go when it ends, rather than when the driver's garbage is collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Session setting for the most bytes of a batch of rows that a Python worker gets, and its value where those rows are whole texts:
#: a batch is in memory outside the JVM's heap, and again in the worker while the next one comes. Spark's own value is 64 MB.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def _store(df: DataFrame, path: str, small_batches: bool = False) -> DataFrame:
    """Writes ``df`` and reads it back; nothing reads the shuffle files behind it again, so they go at once."""
    conf = df.sparkSession.conf
    settings = {CLEANUP: "true"} | ({BATCH: BATCH_BYTES} if small_batches else {})
    before = {k: conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            conf.set(k, v)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one operator's run in a folder of their own, deleted when the block ends or earlier.

    A result that leaves the block is written by :func:`materialize` first.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.folder = spark, fresh_path(spark, label)
        self.paths: list[tuple[DataFrame, str]] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error: object) -> None:
        delete(self.spark, self.folder)

    def table(self, df: DataFrame, label: str, small_batches: bool = False) -> DataFrame:
        path = f"{self.folder}/{label}-{len(self.paths)}"
        out = _store(df, path, small_batches)
        self.paths.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        for df, path in self.paths:
            if any(df is x for x in tables):
                delete(self.spark, path)


def materialize(df: DataFrame, label: str = "table", small_batches: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Unlike a cached or locally checkpointed frame, the files outlive any
    executor, so nothing upstream is ever computed again.  ``small_batches`` is
    for frames that send whole texts to Python workers, see ``BATCH_BYTES``.
    """
    return _store(df, fresh_path(df.sparkSession, label), small_batches)
