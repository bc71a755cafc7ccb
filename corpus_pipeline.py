"""Corpus pipeline: toxicity filter, quality filter, near-duplicates, source mix, packing.

Each stage takes the documents that the stage before kept, as (spark, docs,
sf_dir), and returns a DataFrame; ``run`` writes each result as Parquet and
reads it again.  All but the last return the columns of ``documents``.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.llm import mixing, near_dup, packing, quality, toxicity
from quillmark.llm.common import bound_batches, save

#: Words a packing worker keeps: fewer than alone, as its executor still holds what the stages before took.
PACKING_WORDS = 200_000


def labels_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def shielded(docs: DataFrame, needed: list[str], step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``step`` on ``docs`` whose other columns are renamed meanwhile, so that none
    clashes with a column the step adds; returns the columns of ``docs``."""
    inner = [c if c in needed else f"__other{i}" for i, c in enumerate(docs.columns)]
    out = step(docs.toDF(*inner))
    return out.select(*[F.col(i).alias(c) for i, c in zip(inner, docs.columns)])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the counterfactual-regularised classifier scores below its threshold."""
    bound_batches(spark)
    weights, intercept = toxicity.train(docs, labels_of(spark, sf_dir))
    return shielded(docs, ["text"], lambda d: toxicity.score(d, weights, intercept).where(
        F.col("score") < toxicity.THRESHOLD))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality posterior, with their host's and path's, is good."""
    bound_batches(spark)
    return shielded(docs, ["doc_id", "text", "source", "lang"],
                    lambda d: quality.quality(d, labels_of(spark, sf_dir)).where("kept"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (5-word shingles, 80 %); of rows
    that share a doc_id the first text; rows without a doc_id stay."""
    bound_batches(spark)
    kept = near_dup.near_duplicates(docs, width=5, percent=80).where("kept").select(F.col("doc_id").alias("__id")).distinct()
    found = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    return found.withColumn("__n", first).where("__n = 1 or doc_id is null").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated as often as the mix by source weights takes them; equal
    rows (same doc_id, source and size) are taken alike."""
    size = mixing.word_count("text")
    sized = save(docs.select(F.col("doc_id").alias("doc_id"), F.col("source").alias("source"), size.alias("size")), "sizes")
    taken, _, _ = mixing.mix(sized.withColumn("sources", F.array(F.col("source").cast("string"))), mixing.by_weight)
    copies = (taken.where("copies > 0").groupBy(F.col("doc_id").alias("__id"), F.col("source").alias("__source"),
                                                F.col("size").alias("__size")).agg(F.max("copies").alias("__copies")))
    same = (F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source"))
            & (size == F.col("__size")))
    repeated = docs.join(copies, same).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return repeated.select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of at most 2048 tokens, a row per piece."""
    bound_batches(spark)
    return packing.pack(docs, kept_words=PACKING_WORDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: The classifiers and the tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None
