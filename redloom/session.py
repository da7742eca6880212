"""Session builder and the shared working folder.

Long plans are cut by written tables, never by local checkpoints: a lost executor then only costs the tasks it was
running.  The folder comes from ``spark.checkpoint.dir``; one is made only where that setting is missing (tests,
single-machine runs).
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.speculation": "false",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "redloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are designed for; ``conf`` wins over the defaults."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULTS, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach; one of this machine is made only where all executors are on it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        where = spark.sparkContext.getCheckpointDir()
    if where is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        local = tempfile.mkdtemp(prefix="redloom-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        where = "file://" + local
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; what is written there goes when the application ends, if nothing deleted it before."""
    p = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/redloom/{spark.sparkContext.applicationId}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete every table this application staged so far; for applications that go on."""
    p = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write ``df``; the shuffle files of its plan are deleted as soon as the table is whole."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.mode(mode).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, which cuts its lineage."""
    path = scratch(df.sparkSession, name)
    write_table(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`staged` whose rows no plan will read again."""
    spark = df.sparkSession
    for name in {os.path.dirname(f) for f in df.inputFiles()}:
        if "/redloom/" in name:
            p = spark._jvm.org.apache.hadoop.fs.Path(name)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
