"""Registered source/sink queries: fixtures written from the driver tables into
the shared scratch folder by Spark, read back with the format readers."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..session import read_table, scratch_path
from ..sources import corpora as K
from ..sources.testbed import documents_corpus
from .queries import chain_pairs, q


@q("scan_tsv_corpus")
def scan_tsv_corpus(spark, sf):
    path = scratch_path(spark, "tsv")
    K.write_tsv_corpus(documents_corpus(spark, sf), path)
    return K.read_tsv_corpus(spark, path).select("doc_id", "author", "label", "text")


@q("scan_csv_corpus")
def scan_csv_corpus(spark, sf):
    path = scratch_path(spark, "csv")
    K.write_csv_corpus(documents_corpus(spark, sf), path)
    return K.read_csv_corpus(spark, path)


@q("scan_jsonl_pairs")
def scan_jsonl_pairs(spark, sf):
    c = documents_corpus(spark, sf)
    pp, pt = scratch_path(spark, "pairs"), scratch_path(spark, "truth")
    K.write_jsonl_pairs(chain_pairs(c.select("doc_id", "author")), c, pp, pt)
    return K.read_jsonl_pairs(spark, pp, pt).select("id", F.col("pos").cast("int").alias("pos"), "author", "text")


@q("scan_tagged_records")
def scan_tagged_records(spark, sf):
    path = scratch_path(spark, "tagged")
    K.write_tagged(documents_corpus(spark, sf), path)
    return K.read_tagged(spark, path)


@q("scan_dir_corpus")
def scan_dir_corpus(spark, sf):
    path = scratch_path(spark, "dirs")
    K.write_dir_corpus(documents_corpus(spark, sf), path)
    return K.read_dir_corpus(spark, path)


@q("scan_filename_corpus")
def scan_filename_corpus(spark, sf):
    path = scratch_path(spark, "names")
    K.write_filename_corpus(documents_corpus(spark, sf), path)
    return K.read_filename_corpus(spark, path)


@q("message_body_corpus")
def message_body_corpus(spark, sf):
    m = read_table(spark, sf, "conversations").select(
        "conv_id", "turn", F.col("role").alias("author"), F.col("text").alias("body"))
    return K.message_body_corpus(m, 10, 5).select("conv_id", "turn", "author", "text")


@q("merge_dedup_requests")
def merge_dedup_requests(spark, sf):
    d = read_table(spark, sf, "documents").where(F.col("text").isNotNull()).select(
        F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("title"), F.col("text").alias("abstract"),
        F.col("source").alias("author"), "lang")
    reqs = [d.where(F.col("lang").isin(*langs)) for langs in (["en", "fr"], ["fr", "de"], ["de", "es", "en"])]
    return K.merge_requests(reqs, 10)
