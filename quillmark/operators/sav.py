"""Same-author verification with fitted methods.

Every method is fitted on the training documents alone and decides the same
evaluation pairs, of a closed set (authors seen in training) and of an open one:

* ``Dist-l1``, ``Dist-l2``, ``Dist-cos`` (M6): a logistic threshold on one distance,
  fitted on training pairs;
* ``DV-Bin`` (M5): a logistic regression on difference vectors of training pairs;
* ``DV-2xAA`` (M15 + M17): that classifier attributes both documents by the best
  references of an author; SAME if both go to one author;
* ``LR-2xAA`` (M16 + M17): a verifier per author, all in the same passes, attributes both;
* ``Impostors`` (I1-I7): sigma from the halves of the training authors; SAME lies strictly
  above sigma, so where the best cut is at a score of 1 no pair is SAME.

Decisions are long rows (mode, method, a, b, same, pred); all metrics come from
one aggregate over them.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import keep
from . import impostors as I
from . import linear as LN
from . import models as M
from . import pairs as J
from . import rules as R
from . import similarity as S
from .grouping import global_index

DISTANCES = {"Dist-l1": "l1", "Dist-l2": "l2", "Dist-cos": "cosine_distance"}
METHODS = (*DISTANCES, "DV-Bin", "DV-2xAA", "LR-2xAA", "Impostors")
#: Training pairs of a class at most (a documented parameter; the learners' bound).
MAX_PAIRS = 50_000


def attribute_by_verifiers(train: DataFrame, docs: DataFrame, dims: int, folds: int = 5) -> DataFrame:
    """(doc_id, pred) of ``docs`` (doc_id, vec): the author of the largest margin among
    the verifiers of ``train`` (doc_id, author, vec)."""
    tr = keep(M.with_folds(train, "author", folds))
    codes = global_index(tr.select("author").distinct(), ["author"], "label")
    names = [r["author"] for r in codes.orderBy("label").collect()]  # a row per author with a verifier
    rows = LN.dense_rows(tr.join(codes, "author").withColumn("cls", F.col("label").cast("int")), "vec")
    w, _ = LN.fit_verifiers(rows, dims, len(names), folds)
    m = LN.margins(LN.dense_rows(docs.select("doc_id", "vec"), "vec"), w, ["doc_id"])
    best = (F.array_position("margins", F.array_max("margins")) - 1).cast("int")
    return m.select("doc_id", F.get(F.array(*[F.lit(x) for x in names]), best).alias("pred"))


def fitted_decisions(train: DataFrame, evaluation: DataFrame, vectors: DataFrame, dims: int, methods: Sequence[str] = METHODS,
                     seed=J.SEED, impostors: tuple[int, int, int] = (20, 5, 30), max_pairs: int = MAX_PAIRS,
                     block_rows: int = 1024) -> DataFrame:
    """(mode, method, a, b, same, pred) of the pairs ``evaluation`` (mode, a, b, same) by each of
    ``methods``, fitted on ``train`` (doc_id, author); ``vectors`` (doc_id, author, vec of
    ``dims`` numbers) hold the documents of both.  An unknown method raises."""
    unknown = set(methods) - set(METHODS)
    if unknown or not methods:
        raise ValueError(f"methods {sorted(unknown)} are not known, or none is given")
    ev = keep(evaluation.select("mode", "a", "b", "same"))
    pair = ev.select("a", "b", "same").distinct()
    known = keep(vectors.select("doc_id", "vec").join(train, "doc_id").select("doc_id", "author", "vec"))
    docs = ev.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct().join(vectors, "doc_id").select("doc_id", "vec")
    decided: dict[str, DataFrame] = {}
    classifier = None
    if set(methods) & {*DISTANCES, "DV-Bin", "DV-2xAA"}:
        fit_pairs = keep(J.generate_pairs(train, -1, -1, max_pairs, "round_robin", seed))
        for name in (x for x in methods if x in DISTANCES):
            model, _ = M.distance_classifier(fit_pairs, vectors, DISTANCES[name])
            decided[name] = M.distance_scores(model, pair, vectors, DISTANCES[name]).select("a", "b", "pred")
        if set(methods) & {"DV-Bin", "DV-2xAA"}:
            classifier = M.pair_classifier(fit_pairs, vectors, 1.0 / max(1, fit_pairs.count()))
    if "DV-Bin" in methods:
        decided["DV-Bin"] = M.pair_scores(classifier, pair, vectors).select("a", "b", "pred")
    if "DV-2xAA" in methods:
        coef, intercept = [float(c) for c in classifier.coefficients], float(classifier.intercept)
        scores = S.pairwise_projection(docs, known, "diff_logit", block_rows, reduce=R.knn_block_reduce(5),
                                       reduce_schema=R.SCORE_SCHEMA, coef=coef, intercept=intercept)
        decided["DV-2xAA"] = R.sav_via_attribution(pair, R.knn_attribution(scores, 5).select("doc_id", "pred")).select("a", "b", "pred")
    if "LR-2xAA" in methods:
        decided["LR-2xAA"] = R.sav_via_attribution(pair, attribute_by_verifiers(known, docs, dims)).select("a", "b", "pred")
    if "Impostors" in methods:
        m, n, k = impostors
        p = I.impostor_params(known, m, n).first()
        sigma = I.fitted_sigma(train, vectors, dims, m, n, k, "cosine", 500, seed, block_rows)
        top = I.top_impostors(docs, known, p["m"], "cosine", block_rows)
        subsets = I.feature_subsets(dims, k, seed, train.sparkSession)
        scores = I.impostor_scores_by_pair(pair, vectors, top, subsets, p["m"], p["n"], k, dims, "cosine", seed)
        decided["Impostors"] = I.decide_by_sigma(scores, sigma).select("a", "b", "pred")
    out = None
    for name, d in decided.items():
        rows = ev.join(d, ["a", "b"]).select("mode", F.lit(name).alias("method"), "a", "b", "same", "pred")
        out = rows if out is None else out.unionByName(rows)
    return out


def metrics_by(decisions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """G6 for every group of ``keys`` in one aggregate: acc in percent, p, r, f1 of SAME (0/0 -> 0)."""
    def n(condition):
        return F.sum(F.when(condition, 1).otherwise(0))

    t, p = F.col("same") == 1, F.col("pred") == 1
    c = decisions.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), n(t & p).alias("tp"), n(~t & p).alias("fp"),
                                     n(t & ~p).alias("fn"), n(~t & ~p).alias("tn"))

    def ratio(a, b):
        return F.when(b == 0, F.lit(0.0)).otherwise(a / b)

    return c.select(*keys, (F.lit(100.0) * (F.col("tp") + F.col("tn")) / F.col("n")).alias("acc"),
                    ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("p"),
                    ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("r"),
                    ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))
