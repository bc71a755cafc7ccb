"""Experiment logs and report tables.

The log is a DataFrame with the SAV result schema; text logs are TSV with a
header, ints as text and floats as '%.4f'.  Reports are pivots, windows and a
pooled Student t-test whose p-value integral is evaluated with higher-order
SQL functions (no SciPy).
"""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAV_LOG_SCHEMA = T.StructType([
    T.StructField("dataset", T.StringType()), T.StructField("seed", T.IntegerType()),
    T.StructField("mode", T.StringType()), T.StructField("n_authors", T.IntegerType()),
    T.StructField("docs_by_author", T.IntegerType()), T.StructField("n_authors_te", T.IntegerType()),
    T.StructField("docs_by_author_te", T.IntegerType()), T.StructField("method", T.StringType()),
    T.StructField("acc", T.DoubleType()), T.StructField("p", T.DoubleType()), T.StructField("r", T.DoubleType()),
    T.StructField("f1", T.DoubleType()), T.StructField("notes", T.StringType()),
])

# fixed values: report renames (part of a name -> replacement), all applied, in this order
METHOD_RENAMES = [
    ("LR-close", "STD-2xAA"),
    ("Dist-cos", "STD-CosDist"),
    ("Impostors-open", "Impostors"),
    ("-close", ""),
    ("-open", ""),
]


# ------------------------------------------------------------------ S10 / S11 text logs

def to_text_log(log: DataFrame) -> DataFrame:
    """Render a log as text columns: ints as text, floats as '%.4f'."""
    cols = []
    for f in log.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.DoubleType):
            c = F.format_string("%.4f", c)
        cols.append(c.cast("string").alias(f.name))
    return log.select(*cols)


def append_log(log: DataFrame, path: str) -> None:
    """Append rows to a TSV log (header written with every part file)."""
    to_text_log(log).write.mode("append").option("sep", "\t").option("header", True).csv(path)


def read_logs(spark: SparkSession, paths: Sequence[str], schema: T.StructType = SAV_LOG_SCHEMA,
              exclude_suffix: str | None = None) -> DataFrame:
    """Read several TSV logs with a fixed schema, leaving out logs whose path
    ends with a suffix; keeps the source file name."""
    paths = [p for p in paths if not (exclude_suffix and p.rstrip("/").endswith(exclude_suffix))]
    if not paths:
        return spark.createDataFrame([], schema).withColumn("source_file", F.lit(None).cast("string"))
    df = spark.read.schema(schema).option("sep", "\t").option("header", True).csv(paths)
    return df.withColumn("source_file", F.col("_metadata.file_name"))


# ------------------------------------------------------------------ J12 / J13

def pending_experiments(grid: DataFrame, log: DataFrame) -> DataFrame:
    """Grid rows (dataset, seed, n_authors, docs_by_author, method) not in the log."""
    keys = ["dataset", "seed", "n_authors", "docs_by_author", "method"]
    return grid.join(log.select(*keys).distinct(), keys, "left_anti")


def completed_count(grid: DataFrame, log: DataFrame, expected: int) -> DataFrame:
    """Logged rows per (dataset, seed, n_authors) and whether the run is complete."""
    keys = ["dataset", "seed", "n_authors"]
    c = log.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    g = grid.select(*keys).distinct().join(c, keys, "left").fillna({"n_rows": 0})
    return g.withColumn("complete", (F.col("n_rows") >= expected).cast("int"))


# ------------------------------------------------------------------ P19 / G10-G16

def rename_methods(df: DataFrame, col: str = "method", renames=METHOD_RENAMES) -> DataFrame:
    """Every rule (part, replacement) in turn, each on what the one before left.
    A report with its own method labels passes its own rules."""
    c = F.col(col)
    for src, dst in renames:
        c = F.replace(c, F.lit(src), F.lit(dst))
    return df.withColumn(col, c)


def report_pivot(log: DataFrame, value: str = "acc", index: Sequence[str] = ("method",),
                 columns: str = "dataset", names: Sequence[str] | None = None, percent_to_fraction: bool = False) -> DataFrame:
    """G10 (+G16): mean / sample std / count of a value by index x column; ``names``
    are the column values to show (else they are looked up first)."""
    v = F.col(value) / 100.0 if percent_to_fraction else F.col(value)
    d = log.withColumn("__v", v)
    return d.groupBy(*index).pivot(columns, list(names) if names else None).agg(F.avg("__v").alias("mean"), F.stddev_samp("__v").alias("std"),
                                                F.count("__v").alias("n"))


def method_stats(log: DataFrame, value: str = "acc") -> DataFrame:
    return log.groupBy("dataset", "method").agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(F.lit(1)).alias("n"))


def report_best(stats: DataFrame) -> DataFrame:
    """Per dataset the method with the highest mean (method name breaks ties)."""
    w = Window.partitionBy("dataset").orderBy(F.round("mean", 9).desc(), "method")
    return stats.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def student_t_pvalue(t: str, nu: str, steps: int = 2000):
    """Two-sided p of Student's t: 1 - I(theta) / I(pi/2), theta = atan(|t| / sqrt(nu)),
    I(x) = integral_0^x cos^(nu-1); Simpson's rule with ``steps`` (even) intervals."""
    def integral(upper):
        h = upper / steps
        terms = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: (
            F.when((i == 0) | (i == steps), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
            * F.pow(F.cos(i * h), F.col(nu) - 1)))
        return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) * h / 3
    theta = F.atan(F.abs(F.col(t)) / F.sqrt(F.col(nu)))
    return F.lit(1.0) - integral(theta) / integral(F.lit(math.pi / 2))


def report_ttest(stats: DataFrame, levels=(0.05, 0.005)) -> DataFrame:
    """Pooled two-sample t-test of every method against its dataset's best;
    marks '=' (p = 1, the best itself), '**' (p > 0.05), '*' (p > 0.005), ''."""
    best = report_best(stats).select("dataset", F.col("mean").alias("m2"), F.col("std").alias("s2"),
                                     F.col("n").alias("n2"), F.col("method").alias("best"))
    d = stats.join(best, "dataset")
    nu = F.col("n") + F.col("n2") - 2
    sp2 = ((F.col("n") - 1) * F.col("std") * F.col("std") + (F.col("n2") - 1) * F.col("s2") * F.col("s2")) / nu
    se = F.sqrt(sp2 * (F.lit(1.0) / F.col("n") + F.lit(1.0) / F.col("n2")))
    # means rounded to 9 digits: equal means give t = 0 exactly, whatever the summation order
    diff = F.round("mean", 9) - F.round("m2", 9)
    d = d.withColumn("nu", nu.cast("double")).withColumn("t", F.when(se == 0, F.lit(0.0)).otherwise(diff / se))
    d = d.withColumn("pvalue", F.when(F.col("method") == F.col("best"), F.lit(1.0)).otherwise(student_t_pvalue("t", "nu")))
    pv = F.round("pvalue", 9)  # equal means up to float noise count as equal
    mark = (F.when(pv == 1, "=").when(pv > levels[0], "**").when(pv > levels[1], "*").otherwise(""))
    return d.select("dataset", "method", "mean", "std", "n", "t", "pvalue", mark.alias("mark"))


def score_histogram(scores: DataFrame, bins: int = 20, log_scale: bool = False) -> DataFrame:
    """G13 (+P18): density histogram of scores for SAME and DIFFERENT pairs on
    common edges [min, max] (last edge closed); log variant uses ln(score + 0.01)."""
    s = scores.select("same", (F.log(F.col("score") + 0.01) if log_scale else F.col("score")).alias("x"))
    mm = s.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).withColumn("__k", F.lit(1))
    d = s.withColumn("__k", F.lit(1)).join(F.broadcast(mm), "__k")  # one-row table
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(F.col("x") >= F.col("hi"), bins - 1).otherwise(F.floor((F.col("x") - F.col("lo")) / width))
    d = d.withColumn("bin", F.when(width == 0, 0).otherwise(b).cast("int")).withColumn("width", width)
    n = Window.partitionBy("same")
    g = d.groupBy("same", "bin").agg(F.count(F.lit(1)).alias("cnt"), F.first("width").alias("width"),
                                     F.first("lo").alias("lo"))
    g = g.withColumn("n", F.sum("cnt").over(n))
    return g.select("same", "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("left"), "cnt",
                    F.when(F.col("width") == 0, F.lit(None)).otherwise(F.col("cnt") / (F.col("n") * F.col("width"))).alias("density"))


def report_series(log: DataFrame, value: str = "acc") -> DataFrame:
    """Mean and mean +- std over docs_by_author per (dataset, mode, n_authors, method)."""
    g = log.groupBy("dataset", "mode", "n_authors", "method", "docs_by_author").agg(
        F.avg(value).alias("y_mean"), F.stddev_samp(value).alias("y_std"))
    return g.withColumn("y_low", F.col("y_mean") - F.col("y_std")).withColumn("y_high", F.col("y_mean") + F.col("y_std"))
