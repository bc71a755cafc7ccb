"""Corpus views over the driver tables (schemas in FIXTURES.md §D).

The corpus model is ``corpus(doc_id bigint, author string, text string, lang string)``;
null texts are dropped at the scan.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table


def documents_corpus(spark: SparkSession, sf_dir: str, author: str = "source") -> DataFrame:
    """``documents`` as a labelled corpus; author = source (equal groups) or
    ``lang_source`` (unequal groups)."""
    d = read_table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    if author == "lang_source":
        a = F.concat_ws("/", F.col("lang"), F.col("source"))
    else:
        a = F.col(author)
    return d.select("doc_id", a.alias("author"), "text", "lang")


def embedding_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as ``vectors(doc_id, author, vec array<double>)``; author = label."""
    e = read_table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("doc_id"),
        F.col("label").cast("string").alias("author"),
        F.transform("embedding", lambda x: x.cast("double")).alias("vec"),
    )


# SQL twins (DuckDB) of the views above
SQL_CORPUS = "SELECT doc_id, source AS author, text, lang FROM documents WHERE text IS NOT NULL"
SQL_CORPUS_LS = (
    "SELECT doc_id, lang || '/' || source AS author, text, lang FROM documents WHERE text IS NOT NULL"
)
SQL_VECTORS = (
    "SELECT vec_id AS doc_id, CAST(label AS VARCHAR) AS author, "
    "list_transform(embedding, x -> CAST(x AS DOUBLE)) AS vec FROM embeddings"
)
