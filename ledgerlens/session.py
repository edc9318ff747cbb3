"""Session defaults and staging of intermediate tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_TIDY_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def build_session(master: str | None = None, app: str = "ledgerlens", **conf: str) -> SparkSession:
    """Session with adaptive execution on. `conf` keys use `__` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Split a hot join key even when the next step reuses the join's partitioning.
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.session.timeZone": "UTC",
        # Plans of so many finished queries stay in the driver's memory; a run has hundreds, and some are long.
        "spark.sql.ui.retainedExecutions": "20",
        # Recording a Python call site per column costs more than small plans take to run.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def small_batches(spark: SparkSession) -> None:
    """Rows reach Python workers in batches of about BATCH_BYTES, unless the session names a size.

    Spark's own limit is 64 MB. A batch of texts is then a whole partition, which the executor and the worker
    both hold, and neither gives all of that memory back.
    """
    if _BATCH_KEY not in spark.conf.getAll:
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """This application's folder for staged tables, below `spark.checkpoint.dir` or else the warehouse.

    Both are places that every executor reaches; nothing is put into a temporary folder.
    """
    named = spark.conf.get(_CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    root = named or spark.conf.get("spark.sql.warehouse.dir")
    return os.path.join(root, f"staged-{spark.sparkContext.applicationId}")


def _located(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def delete(spark: SparkSession, path: str) -> None:
    """Remove a file or folder of the session's file system, if it is there."""
    files, where = _located(spark, path)
    files.delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _located(spark, path)
    return files.exists(where)


def rename(spark: SparkSession, path: str, to: str) -> None:
    files, where = _located(spark, path)
    if not files.rename(where, _located(spark, to)[1]):
        raise OSError(f"{path} could not become {to}")


def listed(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(name below `path`, length, modification time) of all files; one file has the empty name."""
    files, where = _located(spark, path)
    root, found = files.makeQualified(where).toString(), []
    every = files.listFiles(where, True)
    while every.hasNext():
        one = every.next()
        found.append((one.getPath().toString().removeprefix(root).lstrip("/"), one.getLen(), one.getModificationTime()))
    return found


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file: written aside first, so a reader never sees half of it."""
    aside = f"{path}.{uuid.uuid4().hex}"
    files, where = _located(spark, aside)
    out = files.create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    delete(spark, path)
    rename(spark, aside, path)


def read_text(spark: SparkSession, path: str) -> str:
    return "".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def release(spark: SparkSession) -> None:
    """Remove all tables that this application has staged. Tables that read them can't be used afterwards."""
    delete(spark, shared_folder(spark))


def stage(df: DataFrame, tidy: bool = False) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Cuts the lineage without pinning data to an executor, so a lost executor
    costs a re-read and not a recomputation. Parquet keeps column pruning and
    gives the planner a real size for broadcast decisions. Staged tables stay
    until `release`. With `tidy` Spark removes the shuffle files of the write
    at its end, not when the driver next collects garbage.
    """
    spark = df.sparkSession
    path = os.path.join(shared_folder(spark), uuid.uuid4().hex)
    before = spark.conf.get(_TIDY_KEY, None)
    if tidy:
        spark.conf.set(_TIDY_KEY, "true")
    try:
        df.write.parquet(path)
    finally:
        if tidy:
            spark.conf.unset(_TIDY_KEY) if before is None else spark.conf.set(_TIDY_KEY, before)
    return spark.read.schema(df.schema).parquet(path)
