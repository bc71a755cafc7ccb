"""Small helpers shared by the operators of this subpackage."""
from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path

#: Bytes of a batch between Spark and Python where texts pass.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bounds this session's Arrow batches by bytes: whole texts of 10,000 rows a batch
    would be held several times over by a task and its Python worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key, "64m"))
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def save(df: DataFrame, name: str) -> DataFrame:
    """Write to the session's shared folder and read again (cuts the lineage)."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Returns memory that earlier tasks of this worker freed to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a Python task, after which its worker does not sit on the memory it used."""
    def inner(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return inner
