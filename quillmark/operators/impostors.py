"""The Impostors method as joins and aggregates.

Vectors are dense ``array<double>`` rows ``(doc_id, vec)``.  A feature subset
is a boolean mask; similarity on a subset = similarity of the masked vectors
(zeros outside the subset add nothing to min/max sums, dot products or norms).

Plan: subsets (k rows) -> impostor table (top-m references per document, from
the blocked projection with an in-task top-m) -> a row per document with its and
its impostors' vectors, joined to both sides of the pairs -> per (pair, direction,
iteration) max similarity of the impostors drawn -> averages.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hkey, uniform
from ..session import keep
from .grouping import global_index
from .ordered import running_totals
from .pairs import verification_coordinates
from .similarity import TopCells, _matrix, pairwise_projection

SEED = 42


def impostor_params(train: DataFrame, m: int = 50, n: int = 10) -> DataFrame:
    """I8: m, n clamped when m > nD/2: m = nD div 2, n = min(10, m div 2)."""
    c = train.agg(F.count(F.lit(1)).alias("n_docs"))
    half = F.floor(F.col("n_docs") / 2)
    mm = F.when(F.lit(m) > half, half).otherwise(F.lit(m)).cast("long")
    nn = F.when(F.lit(m) > half, F.least(F.lit(10), F.floor(half / 2))).otherwise(F.lit(n)).cast("long")
    return c.select("n_docs", mm.alias("m"), nn.alias("n"))


def feature_subsets(n_features: int, k: int = 100, seed=SEED, spark=None) -> DataFrame:
    """K subsets of n_features div 2 features (iter, feat), drawn without
    replacement by seeded rank; shared by all pairs."""
    it = spark.range(k).withColumnRenamed("id", "iter")
    f = it.withColumn("feat", F.explode(F.sequence(F.lit(0), F.lit(n_features - 1))))
    w = Window.partitionBy("iter").orderBy(uniform(seed, "iter", "feat"), "feat")  # k x n_features rows
    return f.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n_features // 2).drop("__r")


def top_impostors(docs: DataFrame, reference: DataFrame, m: int, metric: str = "cosine",
                  block_rows: int = 1024) -> DataFrame:
    """(doc_id, imp_rank, imp_id): the m references most similar to each doc.

    Each task keeps only its top m per doc, so no full score matrix is shuffled; the
    final cut is a window group limit."""
    s = pairwise_projection(docs, reference.select("doc_id", "vec"), metric, block_rows, reduce=TopCells(m, by_author=False))
    w = Window.partitionBy("x_id").orderBy(F.desc("key"), "ref_id")
    r = s.withColumn("imp_rank", F.row_number().over(w)).where(F.col("imp_rank") <= m)
    return r.select(F.col("x_id").alias("doc_id"), "imp_rank", F.col("ref_id").alias("imp_id"), F.col("p").alias("sim"))


def drawn_rank(seed, m: int, *cols) -> Column:
    """The impostor rank in 1..m drawn for a pair, direction, iteration and j."""
    return (F.floor(uniform(seed, *cols) * m) + 1).cast("long")


def impostor_draws(pairs: DataFrame, m: int, n: int, k: int, seed=SEED) -> DataFrame:
    """For every pair, direction and iteration, n draws with replacement of an
    impostor rank in 1..m.  dir 0: x = a, v = b (impostors of b); dir 1: swapped."""
    d = pairs.select("a", "b").withColumn("dir", F.explode(F.array(F.lit(0), F.lit(1))))
    d = d.withColumn("iter", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    d = d.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return d.withColumn("imp_rank", drawn_rank(seed, m, "a", "b", "dir", "iter", "j"))


def impostor_decision(scores: DataFrame, sigma: float) -> DataFrame:
    """SAME iff the two-way score is strictly above sigma."""
    return scores.withColumn("pred", (F.col("score") > F.lit(sigma)).cast("int"))


def threshold_search_f1(scored: DataFrame, compat: bool = False) -> DataFrame:
    """Best threshold by F1 over the sorted validation scores.

    In the order of (score, a, b), cut i (0-based, 1..n-2, score != 0) predicts SAME
    for positions >= i; the first best cut wins and sigma = its score.  Default
    (intended) mode cuts only at the start of a tie group, so equal scores are counted
    together first; ``compat`` cuts at every position.  Positions and positives before
    a cut are running totals over ranges of the order: no task sees all scores.
    """
    if compat:
        g, order = scored.select("score", "a", "b", F.lit(1).alias("n"), F.col("same").alias("p")), ["score", "a", "b"]
    else:
        g, order = scored.groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.sum("same").alias("p")), ["score"]
    d = running_totals(g, order, ["n", "p"]).withColumn("pos", F.col("n_before")).withColumn("tp", F.col("p_all") - F.col("p_before"))
    fp = (F.col("n_all") - F.col("pos")) - F.col("tp")
    fn = F.col("p_all") - F.col("tp")
    d = d.withColumn("f1", F.when(2 * F.col("tp") + fp + fn == 0, F.lit(0.0)).otherwise(2 * F.col("tp") / (2 * F.col("tp") + fp + fn)))
    cuts = d.where((F.col("pos") >= 1) & (F.col("pos") <= F.col("n_all") - 2) & (F.col("score") != 0))
    return cuts.orderBy(F.round("f1", 9).desc(), "pos").limit(1).select(F.col("score").alias("sigma"), "f1", "pos")


def masks_matrix(subsets: DataFrame, n_features: int, k: int) -> np.ndarray:
    """k x n_features 0/1 matrix of the subsets (k * n_features numbers, a bound
    set by the parameters), shared by every scoring task."""
    m = np.zeros((k, n_features))
    for r in subsets.select("iter", "feat").collect():
        m[int(r["iter"]), int(r["feat"])] = 1.0
    return m


def _np_subset_sims(x: np.ndarray, Y: np.ndarray, M: np.ndarray, similarity: str) -> np.ndarray:
    """sim(x restricted to subset t, y restricted to subset t) for every row y of Y (x: one
    row, or one for each of Y) and subset t: returns (len(Y), k)."""
    if similarity == "cosine":
        num = (Y * x) @ M.T
        nx = np.sqrt((x * x) @ M.T)
        ny = np.sqrt((Y * Y) @ M.T)
        den = ny * nx
    elif similarity == "minmax":
        num = np.minimum(Y, x) @ M.T
        den = np.maximum(Y, x) @ M.T
    else:
        raise ValueError(similarity)
    return np.divide(num, den, out=np.zeros_like(num), where=den != 0)


def _np_pair_hits(x: np.ndarray, v: np.ndarray, imps: np.ndarray, ranks: np.ndarray, sizes: np.ndarray,
                  draws: np.ndarray, M: np.ndarray, similarity: str) -> np.ndarray:
    """One direction of some pairs: the share of subsets in which x is no less similar to v than
    to the best of the impostors drawn.  ``imps`` and ``ranks``: the impostors of all pairs,
    ``sizes`` of a pair, by rank; ``draws``: (pairs, k, n) ranks."""
    of = np.repeat(np.arange(len(x)), sizes)
    sims = _np_subset_sims(x[np.concatenate([np.arange(len(x)), of])], np.concatenate([v, imps]), M, similarity)
    own, others = sims[:len(x)], sims[len(x):]
    width = int(max(ranks.max(initial=0), draws.max(initial=0))) + 1
    keys, wanted = of * width + ranks, np.arange(len(x))[:, None, None] * width + draws
    at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    if not len(keys) or (keys[at] != wanted).any():
        raise ValueError(f"a rank was drawn that a document has no impostor of (it has {sizes.min(initial=0)} at least)")
    best = others[at, np.arange(len(M))[None, :, None]].max(axis=2)
    return (own >= best).sum(axis=1) / float(len(M))


#: Pairs that are scored at once.
PAIRS = 64


def impostor_scores_by_pair(pairs: DataFrame, vectors: DataFrame, impostors: DataFrame, subsets: DataFrame,
                            m: int, n: int, k: int, n_features: int, similarity: str = "cosine",
                            seed=SEED) -> DataFrame:
    """I4 + I5: every document's vector and its impostors' vectors are one row, joined to the
    pairs by either side; the seeded draws (``impostor_draws``, in its order) are made beside
    the pair, so no draw is shuffled, and NumPy computes the k subset similarities of some
    pairs at once with matrix products.  Rows that share an id are one document."""
    M = masks_matrix(subsets, n_features, k)
    vec = vectors.groupBy("doc_id").agg(F.max("vec").alias("vec"))
    imp = impostors.select("doc_id", F.col("imp_rank").cast("long").alias("rk"), "imp_id")
    imp = imp.join(vec.withColumnRenamed("doc_id", "imp_id"), "imp_id").groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("rk", "vec"))).alias("i"))
    docs = vec.join(imp, "doc_id", "full").select("doc_id", "vec", F.col("i.rk").alias("rk"), F.col("i.vec").alias("iv"))
    rows = pairs.select("a", "b").distinct()
    for side in ("a", "b"):
        rows = rows.join(docs.select(F.col("doc_id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("vec", "rk", "iv")]), side, "left")
    rows = rows.where(" or ".join(f"{c}_{s} is not null" for c in ("vec", "rk") for s in ("a", "b")))
    draws = F.transform(F.sequence(F.lit(0), F.lit(2 * k * n - 1)), lambda t: drawn_rank(
        seed, m, "a", "b", F.floor(t / (k * n)), F.floor(t / n) % k, t % n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, PAIRS):
                some = batch.slice(start, PAIRS)
                for c in ("vec_a", "vec_b", "rk_a", "rk_b"):
                    if some.column(c).null_count:
                        at = int(pc.index(pc.is_null(some.column(c)), True).as_py())
                        raise ValueError(f"pair ({some.column('a')[at]}, {some.column('b')[at]}): {c} is missing")
                own = {s: _matrix(some.column(f"vec_{s}")) for s in ("a", "b")}
                draws = some.column("draws").flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, 2, k, n)
                out = []
                for d, (x, v) in enumerate((("a", "b"), ("b", "a"))):
                    sizes = pc.list_value_length(some.column(f"rk_{v}")).to_numpy(zero_copy_only=False).astype(np.int64)
                    ranks = some.column(f"rk_{v}").flatten().to_numpy(zero_copy_only=False)
                    imps = _matrix(some.column(f"iv_{v}").flatten()) if len(ranks) else np.zeros((0, n_features))
                    out.append(_np_pair_hits(own[x], own[v], imps, ranks, sizes, draws[:, d], M, similarity))
                yield pa.RecordBatch.from_arrays([some.column("a"), some.column("b"), *map(pa.array, (*out, (out[0] + out[1]) / 2))],
                                                 ["a", "b", "score_ab", "score_ba", "score"])

    return rows.withColumn("draws", draws).mapInArrow(run, "a long, b long, score_ab double, score_ba double, score double")


def author_halves(train: DataFrame) -> DataFrame:
    """``train`` with half: 0 for the first half of the sorted authors (the smaller
    one, if their number is odd), 1 for the others."""
    authors = global_index(train.select("author").distinct(), ["author"], "__i")
    n = authors.agg(F.count(F.lit(1)).alias("__n")).withColumn("__k", F.lit(1))  # one row
    half = F.when(F.col("__i") < F.floor(F.col("__n") / 2), 0).otherwise(1)
    halves = authors.withColumn("__k", F.lit(1)).join(F.broadcast(n), "__k").select("author", half.alias("half"))
    return train.join(halves, "author")


def fitted_sigma(train: DataFrame, vectors: DataFrame, n_features: int, m: int, n: int, k: int, similarity: str,
                 subsample: int = 500, seed=SEED, block_rows: int = 1024) -> DataFrame:
    """One row (sigma, f1, pos), or none if there is no cut: balanced pairs of the
    second half of the authors of ``train`` (doc_id, author), ``subsample`` of them at most,
    scored with impostors from the first half."""
    h = keep(author_halves(train))
    known, val = (h.where(F.col("half") == x).select("doc_id", "author") for x in (0, 1))
    p = impostor_params(known, m, n).first()
    pairs = keep(verification_coordinates(val, True, subsample, seed).select("a", "b", "same"))
    asked = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()  # no other document's impostors are read
    own, ref = vectors.join(val.select("doc_id"), "doc_id").join(asked, "doc_id", "left_semi"), vectors.join(known.select("doc_id"), "doc_id")
    imps = top_impostors(own.select("doc_id", "vec"), ref, p["m"], similarity, block_rows)
    subsets = feature_subsets(n_features, k, seed, train.sparkSession)
    scores = impostor_scores_by_pair(pairs.select("a", "b"), vectors, imps, subsets, p["m"], p["n"], k, n_features, similarity, seed)
    return threshold_search_f1(scores.join(pairs, ["a", "b"]).select("a", "b", "same", "score"))


def decide_by_sigma(scores: DataFrame, sigma: DataFrame, fallback: float = 0.5) -> DataFrame:
    """``scores`` with sigma (``fallback``, if ``sigma`` has no row) and pred = score > sigma."""
    found = sigma.agg(F.coalesce(F.max("sigma"), F.lit(fallback)).alias("sigma")).withColumn("__k", F.lit(1))
    d = scores.withColumn("__k", F.lit(1)).join(F.broadcast(found), "__k").drop("__k")  # one row
    return d.withColumn("pred", (F.col("score") > F.col("sigma")).cast("int"))
