"""Spark session and shared-storage helpers.

Cluster rules: the checkpoint folder comes from the session
(``spark.checkpoint.dir``); a local default is only set when it is unset,
which is the case in tests and local benches.
"""
from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

TABLES = ("documents", "embeddings", "labels", "conversations", "benchmark")


def get_spark(master: str | None = None, partitions: int = 8, app: str = "quillmark") -> SparkSession:
    builder = (
        SparkSession.builder.master(master or os.environ.get("QUILL_MASTER", "local[8]"))
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.memory", os.environ.get("QUILL_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder of the session.

    A cluster must name one in ``spark.checkpoint.dir``; only a local master,
    whose tasks share the driver's disk, gets a scratch folder of its own.
    """
    cur = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not cur:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        cur = tempfile.mkdtemp(prefix="quill-ckpt-")
        spark.conf.set("spark.checkpoint.dir", cur)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(cur)
    return cur


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint dir for written tables."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


_KEPT: list[DataFrame] = []


def keep(df: DataFrame) -> DataFrame:
    """Persist a frame that several parts of one query read."""
    _KEPT.append(df.persist(StorageLevel.MEMORY_AND_DISK))
    return df


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder.  The jobs of an iterative fit on it
    know one stage, not every stage it came from: the driver keeps those of each job."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def release() -> None:
    """Unpersist what ``keep`` holds (a caller's own cached frames stay)."""
    while _KEPT:
        _KEPT.pop().unpersist()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
