"""Session defaults. Cluster-level settings (master, memory, checkpoint dir) stay with spark-submit."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings every job wants; each is only a default and never overrides the caller's session.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # explode-heavy tables are far larger than their inputs suggest: broadcast on measured sizes only
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}

#: Where it is set, Spark removes the shuffle files of an action when the action ends. Otherwise they stay until the
#: driver happens to collect its garbage, which may never happen while a large table goes through many steps.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def build_session(master: str | None = None, app: str = "placewise", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def on_workers(spark: SparkSession) -> None:
    """Let Python workers find this package where it runs in place, without an installation or --py-files."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[1]))


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    Only a session whose driver and tasks are one process may go without: there, and only there, a folder of this
    machine serves. Elsewhere other machines would not find the files, so an unset folder is an error.
    """
    context = spark.sparkContext
    named = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="placewise-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named.rstrip("/")


def shared_path(spark: SparkSession, name: str = "table") -> str:
    """A new path in the shared folder; what is written there goes when the session ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Actions inside leave no shuffle files behind; the session's own setting comes back."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written as parquet into the shared folder and read back.

    Later steps read their columns only, and lost executors take nothing with them.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    with shuffles_removed(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[table] = path
    return table


def let_go(*tables: DataFrame) -> None:
    """Delete tables of :func:`written` that no later step reads, not even one that is still to run."""
    for table in tables:
        spark = table.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(_paths.pop(table))
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialised(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared checkpoint folder.

    For tables that several later steps read; they survive the loss of executors.
    """
    return written(df)
