"""Corpus shaping: splits, samples, author filters, label codes.

All functions take and return DataFrames with at least
``doc_id bigint, author string`` and never collect data.  Sampled choices use
the seeded md5 order of ``hash_rank`` so a plain-SQL twin picks the same rows.
"""
from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hkey
from .grouping import global_index, group_counts, hash_rank

SEED = 42


def stratified_split(corpus: DataFrame, test_size: float = 0.3, seed=SEED) -> DataFrame:
    """Per author, the first round(test_size * n) docs of the seeded shuffle go to test.

    Only (author, doc_id) is ranked; the flag is joined to the rows, so texts are never
    sorted.  Rows that share an author and a doc_id share a flag (test, if any is in it)."""
    r = hash_rank(corpus.select("author", "doc_id"), ["author"], seed, ["doc_id"], out="__rk", count_col="__n")
    split = F.when(F.col("__rk") <= F.round(F.col("__n") * F.lit(test_size)), "test").otherwise("train")
    flags = r.select("author", "doc_id", split.alias("split")).groupBy("author", "doc_id").agg(F.min("split").alias("split"))
    return corpus.join(flags, ["author", "doc_id"]).select(*corpus.columns, "split")


def _require(df: DataFrame, facts: DataFrame, holds: str, message: str) -> DataFrame:
    """``df``, or an error when run if the one-row table ``facts`` does not fulfil
    ``holds`` (a second branch that never gives a row makes the check)."""
    failed = F.when(F.expr(holds), False).otherwise(F.raise_error(F.lit(message)).cast("boolean"))
    nothing = facts.where(failed).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields])
    return df.unionByName(nothing)


def min_docs_filter(split_corpus: DataFrame, min_docs: int) -> DataFrame:
    """Keep authors with >= min_docs training docs, in every split; an error if none remains."""
    keep = (
        split_corpus.where(F.col("split") == "train")
        .groupBy("author")
        .agg(F.count(F.lit(1)).alias("__n"))
        .where(F.col("__n") >= min_docs)
        .select("author")
    )
    return _require(split_corpus.join(keep, "author", "left_semi"), keep.agg(F.count(F.lit(1)).alias("n")), "n > 0",
                    f"no author has {min_docs} training documents")


def author_min_count(corpus: DataFrame, min_docs: int) -> DataFrame:
    """Keep authors with at least ``min_docs`` documents (partial aggregate + semi join)."""
    keep = group_counts(corpus, ["author"], "__n").where(F.col("__n") >= min_docs).select("author")
    return corpus.join(keep, "author", "left_semi")


def sample_docs_per_author(split_corpus: DataFrame, n: int, seed=SEED) -> DataFrame:
    """C4: exactly n train docs per author (authors with fewer are dropped from train); test untouched."""
    tr = split_corpus.where(F.col("split") == "train")
    r = hash_rank(tr, ["author"], seed, ["doc_id"], out="__rk", count_col="__n")
    tr = r.where((F.col("__n") >= n) & (F.col("__rk") <= n)).drop("__rk", "__n")
    return tr.unionByName(split_corpus.where(F.col("split") != "train"))


def author_order(corpus: DataFrame, seed=SEED) -> DataFrame:
    """Distinct authors with their seeded order key."""
    return corpus.select("author").distinct().withColumn("__h", hkey(seed, "author"))


def sample_authors(corpus: DataFrame, n_authors: int, n_open: int = 0, seed=SEED) -> DataFrame:
    """Keep the first n_authors + n_open authors of the seeded author order; an
    error if the corpus has fewer.

    The chosen author list is a top-k (TakeOrderedAndProject) of size
    n_authors + n_open, a bound given by the caller, so it is broadcast.
    """
    k = n_authors + n_open
    chosen = author_order(corpus, seed).orderBy("__h", "author").limit(k).select("author")
    return _require(corpus.join(F.broadcast(chosen), "author", "left_semi"), chosen.agg(F.count(F.lit(1)).alias("n")),
                    f"n >= {k}", f"the corpus has fewer than {k} authors")


def attach_labels(docs: DataFrame, labels: DataFrame, required: bool = True) -> DataFrame:
    """``docs`` with their row of ``labels`` (doc_id, ...); every document stays.
    A document without one is an error, or, unless ``required``, has null labels."""
    found = docs.join(labels.withColumn("__has", F.lit(True)), "doc_id", "left")
    if required:
        lost = F.raise_error(F.concat(F.lit("no label for document "), F.col("doc_id").cast("string"))).cast("boolean")
        found = found.where(F.when(F.col("__has").isNull(), lost).otherwise(True))
    return found.drop("__has")


def open_set_split(split_corpus: DataFrame, n_open: int, seed=SEED) -> DataFrame:
    """The first n_open authors (seeded order) become open-set authors:
    their test docs get split 'test_out', their train docs are dropped."""
    open_a = (
        author_order(split_corpus, seed).orderBy("__h", "author").limit(n_open).select("author")
        .withColumn("__open", F.lit(True))
    )
    d = split_corpus.join(F.broadcast(open_a), "author", "left")
    is_open = F.coalesce(F.col("__open"), F.lit(False))
    d = d.where(~(is_open & (F.col("split") == "train")))
    return d.withColumn("split", F.when(is_open, F.lit("test_out")).otherwise(F.col("split"))).drop("__open")


def label_reindex(split_corpus: DataFrame) -> DataFrame:
    """Gap-free label codes from sorted train authors; open-set authors continue
    after them; a closed-test author unseen in train raises.

    Codes come from a distributed dense index over the distinct authors.
    """
    tr_auth = split_corpus.where(F.col("split") == "train").select("author").distinct()
    out_auth = (
        split_corpus.where(F.col("split") == "test_out").select("author").distinct()
        .join(tr_auth, "author", "left_anti")
    )
    # train authors first (flag 0), open-set authors after them (flag 1)
    codes = global_index(tr_auth.withColumn("__f", F.lit(0)).unionByName(out_auth.withColumn("__f", F.lit(1))),
                         ["__f", "author"], "__c")
    tr_codes = codes.where(F.col("__f") == 0).select("author", F.col("__c").alias("__lab"))
    out_codes = codes.where(F.col("__f") == 1).select("author", F.col("__c").alias("__olab"))
    d = split_corpus.join(tr_codes, "author", "left").join(out_codes, "author", "left")
    label = (
        F.when(F.col("split") == "test_out", F.coalesce("__olab", "__lab"))
        .when(F.col("__lab").isNull(), F.raise_error(F.lit("test author not seen in training")))
        .otherwise(F.col("__lab"))
        .cast("int")
    )
    return d.withColumn("label", label).drop("__lab", "__olab")


def label_drop(corpus: DataFrame, to_drop: DataFrame | Iterable[str]) -> DataFrame:
    """Drop rows whose author is in a set (a DataFrame of authors or a literal list)."""
    if isinstance(to_drop, DataFrame):
        return corpus.join(to_drop.select("author"), "author", "left_anti")
    return corpus.where(~F.col("author").isin(list(to_drop)))


def group_docs(corpus: DataFrame, seed=SEED) -> DataFrame:
    """Author -> documents as a long table (author, doc_id, pos, n_docs).

    ``pos`` is the 1-based position in the author's seeded shuffle.  The long
    form replaces ``collect_list`` so no group is ever gathered into one row.
    """
    return hash_rank(corpus.select("author", "doc_id"), ["author"], seed, ["doc_id"], out="pos", count_col="n_docs")


def sample_per_class(corpus: DataFrame, cat_size: int, seed=SEED) -> DataFrame:
    """Up to cat_size docs per class (a permutation prefix); -1 keeps all."""
    if cat_size == -1:
        return corpus
    r = hash_rank(corpus, ["author"], seed, ["doc_id"], out="__rk", count_col=None)
    return r.where(F.col("__rk") <= cat_size).drop("__rk")


def nested_sizes(start: int, step: int = 10, minimum: int = 5) -> list[int]:
    sizes, n = [], start
    while n >= minimum:
        sizes.append(n)
        n -= step
    return sizes


def nested_samples(corpus: DataFrame, start: int = 50, step: int = 10, minimum: int = 5, seed=SEED) -> DataFrame:
    """C11: shrinking per-author samples (start, start-step, ... >= minimum), each
    nested in the previous one: one seeded rank, one row per (size, doc)."""
    sizes = nested_sizes(start, step, minimum)
    r = hash_rank(corpus, ["author"], seed, ["doc_id"], out="__rk", count_col=None)
    steps = F.array(*[F.lit(s) for s in sizes])
    return (
        r.withColumn("sample_size", F.explode(F.filter(steps, lambda s: F.col("__rk") <= s)))
        .drop("__rk")
    )


def experiment_grid(
    datasets: DataFrame,
    seeds: Sequence[int],
    n_authors: Sequence[int],
    docs_by_author: Sequence[int],
    methods: Sequence[str],
) -> DataFrame:
    """The run grid seeds x datasets x authors x docs x methods, built by
    exploding literal arrays on the (small) dataset table."""
    g = datasets.select("dataset")
    for name, vals in (("seed", seeds), ("n_authors", n_authors), ("docs_by_author", docs_by_author), ("method", methods)):
        g = g.withColumn(name, F.explode(F.array(*[F.lit(v) for v in vals])))
    return g
