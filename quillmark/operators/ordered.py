"""Running totals and quantiles over a whole order, without one task that holds it.

Rows are dealt into ranges of the order, a range per shuffle task; totals run inside
each range, and the totals of the ranges before it are added from a table with a row
per range.  The ranges are cut by a checkpoint: split points are sampled, so a range
computed anew after a lost executor might not hold the rows that were counted.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .grouping import task_count


def running_totals(df: DataFrame, order: Sequence[str | Column], sums: Sequence[str]) -> DataFrame:
    """``df`` with, for each column c of ``sums``, c_before (sum over the rows before this
    one) and c_all (sum over all rows).  ``order`` should leave no ties (their order is
    not defined) and spread the rows; null sums count 0."""
    ensure_checkpoint_dir(df.sparkSession)
    d = df.repartitionByRange(task_count(df), *order).withColumn("__range", F.spark_partition_id()).checkpoint()
    per_range = d.groupBy("__range").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"__{c}") for c in sums])
    # a row per shuffle task, whatever the size of the data
    upto = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select("__range", *[e for c in sums for e in (
        F.coalesce(F.sum(f"__{c}").over(upto), F.lit(0)).alias(f"__{c}_off"),
        F.sum(f"__{c}").over(Window.partitionBy()).alias(f"{c}_all"))])
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumns({f"__{c}_in": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums})
    d = d.join(F.broadcast(offsets), "__range")
    return d.select(*df.columns, *[e for c in sums for e in (
        (F.col(f"__{c}_off") + F.col(f"__{c}_in")).alias(f"{c}_before"), F.col(f"{c}_all"))])


def exact_quantiles(df: DataFrame, col: str, shares: Sequence[float], out: str = "quantiles") -> DataFrame:
    """One row: the exact quantiles of ``col`` at ``shares`` (linear between neighbours, nulls
    left out), in the order given; no row if there is no value."""
    g = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    r = running_totals(g, ["v"], ["n"])
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(s)) * (F.col("n_all") - 1)).alias("at"))
                       for i, s in enumerate(shares)])

    def holds(rank):
        return (rank >= F.col("n_before")) & (rank < F.col("n_before") + F.col("n"))

    hits = r.select("v", "n", "n_before", F.explode(F.filter(
        wanted, lambda w: holds(F.floor(w["at"])) | holds(F.ceil(w["at"])))).alias("w"))
    at = F.col("w.at")
    ends = hits.groupBy("w.i", "w.at").agg(F.max(F.when(holds(F.floor(at)), F.col("v"))).alias("lo"),
                                           F.max(F.when(holds(F.ceil(at)), F.col("v"))).alias("hi"))
    value = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(
        (F.ceil("at") - F.col("at")) * F.col("lo") + (F.col("at") - F.floor("at")) * F.col("hi"))
    # a row per share
    rows = ends.groupBy().agg(F.array_sort(F.collect_list(F.struct("i", value.alias("v")))).alias("s"))
    return rows.where(F.size("s") > 0).select(F.transform("s", lambda e: e["v"]).alias(out))
