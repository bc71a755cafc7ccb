"""Skew-safe ranking inside groups.

A window partitioned only by the group key sends a whole group to one task;
with an author that holds a third of all rows that task holds a third of the
data.  The helpers here salt every group into buckets of bounded size along a
key that is monotone in the wanted order, rank inside each bucket and add the
bucket offsets (computed from a per-(group, bucket) count table, whose size is
rows / rows_per_bucket + groups).  The result equals
``row_number() over (partition by group order by ...)``.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import uniform

# rows one window task ranks at most (dense global indexes)
ROWS_PER_BUCKET = 1 << 20


def group_counts(df: DataFrame, group_cols: Sequence[str], name: str = "n_group") -> DataFrame:
    return df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias(name))


def task_count(df: DataFrame) -> int:
    """Into how many tasks the session deals a shuffle."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def bucketed_rank(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str | Column],
                  bucket: Column, out: str = "rank", count_col: str | None = None) -> DataFrame:
    """row_number() over (partition by group_cols order by order_cols), computed
    per (group, bucket); ``bucket`` must be non-decreasing along the order.  Also
    the group's size, if ``count_col`` is given."""
    group_cols = list(group_cols)
    d = df.withColumn("__b", bucket.cast("long"))
    ranked = d.withColumn("__r0", F.row_number().over(Window.partitionBy(*group_cols, "__b").orderBy(*order_cols)))
    per_bucket = d.groupBy(*group_cols, "__b").agg(F.count(F.lit(1)).alias("__bn"))
    whole = Window.partitionBy(*group_cols) if group_cols else Window.partitionBy()
    offsets = per_bucket.select(
        *group_cols, "__b", (F.sum("__bn").over(whole.orderBy("__b")) - F.col("__bn")).alias("__off"),
        *([F.sum("__bn").over(whole).alias(count_col)] if count_col else []))
    res = ranked.join(offsets, [*group_cols, "__b"]).withColumn(out, (F.col("__off") + F.col("__r0")).cast("long"))
    return res.drop("__b", "__r0", "__off")


def hash_rank(
    df: DataFrame,
    group_cols: Sequence[str],
    seed,
    key_cols: Sequence[str],
    out: str = "rank",
    count_col: str | None = "n_group",
) -> DataFrame:
    """Add ``out`` = 1-based position of each row in its group's seeded shuffle.

    Order is ``uniform(seed, *key_cols)`` then the keys (tie-break).  Also adds
    the group size as ``count_col`` (kept if a name is given).  Every group,
    large or small, is dealt into as many buckets as a shuffle has tasks, so one
    author with a third of all rows is ranked by all of them.
    """
    key_cols, group_cols = list(key_cols), list(group_cols)
    whole = not group_cols
    d = df.withColumn("__u", uniform(seed, *key_cols))
    if whole:
        d, group_cols = d.withColumn("__all", F.lit(0)), ["__all"]
    buckets = F.lit(float(task_count(df)))
    res = bucketed_rank(d, group_cols, ["__u", *key_cols], F.floor(F.col("__u") * buckets), out, count_col)
    return res.drop("__u", *(["__all"] if whole else []))


def int_rank(df: DataFrame, group_cols: Sequence[str], key: str, out: str = "rank") -> DataFrame:
    """Rank by a non-negative integer key, salted by key ranges."""
    return bucketed_rank(df, group_cols, [key], F.floor(F.col(key) / F.lit(ROWS_PER_BUCKET)), out)


def global_index(df: DataFrame, order_cols: Sequence[str], out: str = "idx", rows_per_bucket: int = ROWS_PER_BUCKET,
                 base: int = 0) -> DataFrame:
    """Dense ``row_number() over (order by order_cols) - 1 + base`` without one task
    holding the whole table: above ``rows_per_bucket`` rows the table is range
    partitioned on the order (sampled split points), the partition id is a bucket
    that follows the order, and each bucket is ranked on its own plus the counts
    of the buckets before it."""
    n = int(df.count())
    if n <= rows_per_bucket:
        w = Window.orderBy(*order_cols)
        return df.withColumn(out, (F.row_number().over(w) - 1 + base).cast("long"))
    parts = max(2, -(-n // rows_per_bucket) * 2)
    d = df.repartitionByRange(parts, *order_cols).withColumn("__pid", F.spark_partition_id())
    r = bucketed_rank(d, [], list(order_cols), F.col("__pid"), "__gi")
    return r.withColumn(out, (F.col("__gi") - 1 + base).cast("long")).drop("__gi", "__pid")
