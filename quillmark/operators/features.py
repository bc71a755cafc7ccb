"""Feature weighting, selection, standardisation and projection.

Long (COO) layout: ``features(doc_id, block, feat, val)``.  Vocabularies,
document frequencies and statistics are fitted on the training documents
only and applied to every split by joins, never built on the driver.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hkey, uniform_of_hex
from ..session import keep
from .grouping import global_index
from .terms import Fitted, Terms, columns, fit, weights


def _one_row_per_block(df: DataFrame, block: str, **aggs) -> DataFrame:
    return df.agg(*[v.alias(k) for k, v in aggs.items()]).withColumn("block", F.lit(block))


def tfidf_fit(train_counts: DataFrame, train_docs: DataFrame, block: str, min_df: int = 1) -> DataFrame:
    """F1/F3 fit: vocabulary (block, feat, df, idf) from training docs.

    idf = ln((1 + N) / (1 + df)) + 1 (smoothed), N = number of training docs
    (docs without any term count too).  Terms in fewer than ``min_df`` docs are dropped.
    """
    vocab = (
        train_counts.where(F.col("block") == block)
        .groupBy("block", "feat")
        .agg(F.count(F.lit(1)).alias("df"))
        .where(F.col("df") >= min_df)
    )
    n = _one_row_per_block(train_docs, block, n_docs=F.count(F.lit(1)))
    # one row per block: a broadcast of proven size
    vocab = vocab.join(F.broadcast(n), "block")
    idf = F.log((F.lit(1.0) + F.col("n_docs")) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    return vocab.select("block", "feat", "df", idf.alias("idf"))


def tfidf_transform(counts: DataFrame, vocab: DataFrame, use_idf: bool = True, norm: str = "l2") -> DataFrame:
    """F1/F2 transform: tf (* idf) of vocabulary terms, normalised per (doc, block)."""
    d = counts.join(vocab.select("block", "feat", "idf"), ["block", "feat"])
    val = F.col("tf") * F.col("idf") if use_idf else F.col("tf").cast("double")
    d = d.select("doc_id", "block", "feat", val.alias("val"))
    w = Window.partitionBy("doc_id", "block")
    if norm == "l2":
        den = F.sqrt(F.sum(F.col("val") * F.col("val")).over(w))
    elif norm == "l1":
        den = F.sum(F.abs("val")).over(w)
    else:
        return d
    return d.withColumn("val", F.col("val") / den)


def tfidf(counts: DataFrame | Terms, split_docs: DataFrame, block: str, min_df: int = 1,
          use_idf: bool = True, norm: str = "l2") -> DataFrame:
    """Fit on ``split='train'`` docs, transform all docs of ``split_docs``.

    ``Terms`` are counted in blocks of documents (``terms``).  A table of counts feeds
    both the fit and the transform; it is persisted (memory and disk)."""
    if isinstance(counts, Terms):
        return weights(fit(counts, split_docs, min_df), use_idf, norm)
    counts = keep(counts)
    train = split_docs.where(F.col("split") == "train").select("doc_id")
    tc = counts.join(train, "doc_id", "left_semi")
    vocab = tfidf_fit(tc, train, block, min_df)
    return tfidf_transform(counts.join(split_docs.select("doc_id"), "doc_id", "left_semi"), vocab, use_idf, norm)


def rawfreq(counts: DataFrame | Terms, split_docs: DataFrame, block: str, min_df: int = 1) -> DataFrame:
    """raw frequencies (no idf), L1-normalised per document."""
    return tfidf(counts, split_docs, block, min_df, use_idf=False, norm="l1")


def chi2_scores(features: DataFrame, labels: DataFrame) -> DataFrame:
    """F4 scores: chi2 of each feature against the class labels (training docs).

    With O_c = sum of values in class c, T = sum over classes, p_c = class share of
    documents, chi2 = sum_c (O_c - p_c T)^2 / (p_c T) = (sum_c O_c^2 / p_c) / T - T.
    Only non-zero (class, feat) cells are needed, so no feature x class grid is built.
    """
    o = features.join(labels.select("doc_id", "author"), "doc_id").groupBy("feat", "author").agg(
        F.sum("val").alias("o")
    )
    return chi2_of_sums(o, labels)


def chi2_of_sums(o: DataFrame, labels: DataFrame) -> DataFrame:
    """F4 scores of the classes' sums ``o`` (feat, author, o)."""
    n_cls = labels.groupBy("author").agg(F.count(F.lit(1)).alias("n_c"))
    n_all = labels.agg(F.count(F.lit(1)).alias("n_all")).withColumn("__k", F.lit(1))
    # one row per class: broadcast-sized class table (classes = authors of the training set)
    p = n_cls.withColumn("__k", F.lit(1)).join(F.broadcast(n_all), "__k").select(
        "author", (F.col("n_c") / F.col("n_all")).alias("p_c")
    )
    o = o.join(p, "author")
    s = o.groupBy("feat").agg(
        F.sum(F.col("o") * F.col("o") / F.col("p_c")).alias("q"), F.sum("o").alias("t")
    )
    return s.where(F.col("t") > 0).select("feat", (F.col("q") / F.col("t") - F.col("t")).alias("chi2"))


def chi2_topk(features: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """the k features with the highest chi2 (feat name breaks ties): a top-k."""
    return chi2_scores(features, labels).orderBy(F.desc("chi2"), "feat").limit(k)


def standardize_fit(train_dense: DataFrame) -> DataFrame:
    """P17 fit: per feature mean and population std; zero variance -> scale 1."""
    return train_dense.groupBy("feat").agg(
        F.avg("val").alias("mean"),
        F.when(F.stddev_pop("val") == 0, F.lit(1.0)).otherwise(F.stddev_pop("val")).alias("scale"),
    )


def standardize_apply(dense: DataFrame, stats: DataFrame) -> DataFrame:
    """P17 transform: (x - mean) / scale."""
    return dense.join(stats, "feat").select(
        "doc_id", "feat", ((F.col("val") - F.col("mean")) / F.col("scale")).alias("val")
    )


def zscores(dense: DataFrame) -> DataFrame:
    """(x - mean) / max(std_sample, 1e-5) per feature, over all rows."""
    stats = dense.groupBy("feat").agg(
        F.avg("val").alias("mean"),
        F.greatest(F.coalesce(F.stddev_samp("val"), F.lit(float("nan"))), F.lit(1e-5)).alias("sd"),
    )
    return dense.join(stats, "feat").select(
        "doc_id", "feat", ((F.col("val") - F.col("mean")) / F.col("sd")).alias("val")
    )


BLOCK_ORDER = ["post", "punct", "word", "char", "fw", "wl", "sl"]


def feature_index(features: DataFrame) -> DataFrame:
    """global column index over (block order, feat): sparse blocks first, then dense.

    Distributed dense index over the vocabulary (``global_index``).
    """
    order = F.create_map(*sum([[F.lit(b), F.lit(i)] for i, b in enumerate(BLOCK_ORDER)], []))
    vocab = features.select("block", "feat").distinct().withColumn("__bo", F.coalesce(order[F.col("block")], F.lit(99)))
    return global_index(vocab, ["__bo", "block", "feat"], "idx").withColumn("idx", F.col("idx").cast("int")).drop("__bo")


def indexed_matrix(fits: Sequence[Fitted], dense: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, idx, val) of the fitted blocks' TF-IDF and of ``dense`` (doc_id, block, feat,
    val), whose columns are ``names`` (block, feat).  Columns are numbered by the vocabularies and
    their numbers go where the documents are, so cells are neither listed for the index nor
    joined to it."""
    every = names
    for f in fits:
        every = every.unionByName(columns(f))
    idx = keep(feature_index(every))
    own = idx.join(names, ["block", "feat"], "left_semi")
    out = dense.join(F.broadcast(own), ["block", "feat"]).select("doc_id", "idx", F.col("val").cast("double").alias("val"))  # as few as the dense columns
    for f in fits:
        out = out.unionByName(weights(f, index=idx.where(F.col("block") == f.terms.block)))
    return out


def random_index_dictionary(index: DataFrame, dims: int, non_zeros: int = 2, seed: int = 0) -> DataFrame:
    """F6 dictionary ``ri(feat, dim, weight)``: the first dimension of feature t is
    t mod dims (round robin), the other non_zeros-1 are distinct seeded draws;
    signs are seeded; a drawn dimension equal to the first overwrites it."""
    val = 1.0 / math.sqrt(non_zeros)
    h = hkey(seed, "feat")
    d = index.select("block", "feat", "idx", h.alias("__h"))
    entries = [F.struct(F.lit(0).alias("j"), (F.col("idx") % dims).cast("int").alias("dim"))]
    for j in range(1, non_zeros):
        hj = F.md5(F.concat_ws("|", F.col("__h"), F.lit(j)))
        entries.append(F.struct(F.lit(j).alias("j"), F.floor(uniform_of_hex(hj) * dims - 1e-12).cast("int").alias("dim")))
    d = d.select("block", "feat", "__h", F.explode(F.array(*entries)).alias("e"))
    sign_h = F.md5(F.concat_ws("|", F.col("__h"), F.lit("s"), F.col("e.j")))
    d = d.select("block", "feat", F.col("e.j").alias("j"), F.col("e.dim").alias("dim"),
                 F.when(uniform_of_hex(sign_h) <= 0.5, F.lit(-val)).otherwise(F.lit(val)).alias("weight"))
    # last write wins on a repeated dimension
    w = Window.partitionBy("block", "feat", "dim").orderBy(F.desc("j"))
    return d.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "j")


def random_indexing(features: DataFrame | Fitted, ri: DataFrame) -> DataFrame:
    """F6 projection: X . R as (doc_id, dim, val); a fitted block's TF-IDF is projected
    where its documents are."""
    if isinstance(features, Fitted):
        return weights(features, ri=ri.where(F.col("block") == features.terms.block).select("feat", "dim", "weight"))
    return (
        features.join(ri, ["block", "feat"])
        .groupBy("doc_id", "dim")
        .agg(F.sum(F.col("val") * F.col("weight")).alias("val"))
    )


def dense_vectors(long_df: DataFrame, dims: int, key: str = "dim", docs: DataFrame | None = None) -> DataFrame:
    """(doc_id, dim, val) -> (doc_id, vec array<double>) of fixed width ``dims``; with
    ``docs`` a row for each of its documents, all zero where nothing is known of it.

    Gathers one document's ``dims`` values (a bound set by the caller)."""
    g = long_df.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct(key, "val"))).alias("m"))
    if docs is not None:
        g = docs.select("doc_id").join(g, "doc_id", "left")
    return g.select("doc_id", F.transform(F.sequence(F.lit(0), F.lit(dims - 1)),
                                          lambda i: F.coalesce(F.col("m")[i], F.lit(0.0))).alias("vec"))


def indexed_documents(features: DataFrame, index: DataFrame, ri: DataFrame, docs: DataFrame, non_zeros: int = 2) -> DataFrame:
    """A row per document of ``docs``: idx (its columns, ascending), val, and per column
    ``non_zeros`` dims and weights of its random index; empty arrays without features."""
    entries = ri.groupBy("block", "feat").agg(F.array_sort(F.collect_list(F.struct("dim", "weight"))).alias("r"))
    none = F.struct(F.lit(0).alias("dim"), F.lit(0.0).alias("weight"))
    padded = F.transform(F.sequence(F.lit(0), F.lit(non_zeros - 1)), lambda i: F.coalesce(F.get("r", i), none))
    columns = index.join(entries, ["block", "feat"]).select("block", "feat", "idx", padded.alias("r"))
    cells = features.join(columns, ["block", "feat"]).groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("idx", "val", "r"))).alias("c"))
    flat = docs.select("doc_id").join(cells, "doc_id", "left")
    return flat.select("doc_id", *[F.coalesce(v, F.array().cast(t)).alias(n) for n, v, t in (
        ("idx", F.col("c.idx"), "array<int>"), ("val", F.col("c.val"), "array<double>"),
        ("dims", F.flatten(F.transform("c.r", lambda r: r["dim"])), "array<int>"),
        ("weights", F.flatten(F.transform("c.r", lambda r: r["weight"])), "array<double>"))])


def indexed_differences(pairs: DataFrame, documents: DataFrame, dims: int, non_zeros: int = 2) -> DataFrame:
    """M2's input: ``pairs`` (a, b, ...) plus idx, val: the random index of |x_a - x_b|,
    sparse, by the rows of ``indexed_documents``."""
    import numpy as np

    others = [c for c in pairs.columns if c not in ("a", "b")]
    left = documents.select(F.col("doc_id").alias("a"), *[F.col(c).alias(f"{c}_a") for c in ("idx", "val", "dims", "weights")])
    right = documents.select(F.col("doc_id").alias("b"), *[F.col(c).alias(f"{c}_b") for c in ("idx", "val", "dims", "weights")])
    both = pairs.join(left, "a").join(right, "b")

    def run(frames):
        for frame in frames:
            idx, val = [], []
            for r in frame.itertuples(index=False):
                _, first, at = np.unique(np.concatenate([r.idx_a, r.idx_b]), return_index=True, return_inverse=True)
                gap = np.abs(np.bincount(at, np.concatenate([r.val_a, -np.asarray(r.val_b, dtype=float)]), len(first)))
                to = np.concatenate([r.dims_a, r.dims_b]).astype(np.int64).reshape(-1, non_zeros)[first]
                by = np.concatenate([r.weights_a, r.weights_b]).reshape(-1, non_zeros)[first]
                out = np.bincount(to.ravel(), (gap[:, None] * by).ravel(), dims)
                idx.append(np.flatnonzero(out).astype(np.int32))
                val.append(out[idx[-1]])
            yield frame[["a", "b", *others]].assign(idx=idx, val=val)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.select("a", "b", *others).schema.fields)
    return both.mapInPandas(run, fields + ", idx array<int>, val array<double>")


def assemble_blocks(blocks: Sequence[DataFrame]) -> DataFrame:
    """union of block tables (doc_id, block, feat, val)."""
    out = None
    for b in blocks:
        b = b.select("doc_id", "block", "feat", F.col("val").cast("double").alias("val"))
        out = b if out is None else out.unionByName(b)
    return out
