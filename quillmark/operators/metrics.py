"""Evaluation metrics as aggregates.

Inputs: ``predictions(truth, pred)`` for attribution, ``pair_scores(same, pred
[, score])`` for verification.  Every metric is one distributed aggregate; no
label matrix is ever expanded.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import exact_quantiles, running_totals


def _ratio(num, den):
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)


def _class_counts(pred: DataFrame) -> DataFrame:
    """(cls, tp, fp, fn) for every class seen as truth or prediction."""
    hit = F.col("truth") == F.col("pred")
    rows = F.array(
        F.struct(F.col("truth").alias("cls"), F.when(hit, 1).otherwise(0).alias("tp"), F.lit(0).alias("fp"),
                 F.when(hit, 0).otherwise(1).alias("fn"), F.lit(1).alias("t")),
        F.struct(F.col("pred").alias("cls"), F.lit(0).alias("tp"), F.when(hit, 0).otherwise(1).alias("fp"),
                 F.lit(0).alias("fn"), F.lit(0).alias("t")),
    )
    return pred.select(F.explode(rows).alias("r")).groupBy(F.col("r.cls").alias("cls")).agg(
        F.sum("r.tp").alias("tp"), F.sum("r.fp").alias("fp"), F.sum("r.fn").alias("fn"),
        F.max("r.t").alias("in_truth"),
    )


def accuracy(pred: DataFrame) -> DataFrame:
    """G1."""
    return pred.agg(F.avg((F.col("truth") == F.col("pred")).cast("double")).alias("acc"))


def f1_macro(pred: DataFrame) -> DataFrame:
    """Mean per-class F1 over truth and predicted classes (0/0 -> 0)."""
    c = _class_counts(pred)
    f1 = _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return c.agg(F.avg(f1).alias("f1_macro"))


def f1_micro(pred: DataFrame) -> DataFrame:
    """2tp / (2tp + fp + fn) over all classes."""
    c = _class_counts(pred).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    return c.select(_ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1_micro"))


def attribution_metrics(pred: DataFrame) -> DataFrame:
    """G1-G3 in one row."""
    c = _class_counts(pred)
    f1 = _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    s = c.agg(F.avg(f1).alias("f1_macro"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    return s.select(
        _ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("acc"),
        "f1_macro",
        _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1_micro"),
    )


def verification_metrics(pred: DataFrame) -> DataFrame:
    """Metrics of the binarised (one column per truth class) problem.

    A predicted class outside the truth classes marks no column.  Cells:
    N * C; mismatches per row: 0 if right, 2 if the wrong class is a truth
    class, else 1.
    """
    c = _class_counts(pred)
    truth_cls = c.where(F.col("in_truth") == 1)
    f1 = _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    s = truth_cls.agg(
        F.count(F.lit(1)).alias("C"), F.avg(f1).alias("f1_macro"),
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"),
    )
    n = pred.agg(F.count(F.lit(1)).alias("N"))
    s = s.withColumn("__k", F.lit(1)).join(F.broadcast(n.withColumn("__k", F.lit(1))), "__k")  # one-row tables
    return s.select(
        (F.lit(1.0) - (F.col("fp") + F.col("fn")) / (F.col("N") * F.col("C"))).alias("acc"),
        "f1_macro",
        _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1_micro"),
    )


def verifier_metrics(decisions: DataFrame) -> DataFrame:
    """G4 for independent verifiers: (doc_id, truth, author, pred 0/1), a cell per
    document and author; a document may have several authors or none."""
    t, p = F.col("truth") == F.col("author"), F.col("pred") == 1

    def n(c):
        return F.sum(F.when(c, 1).otherwise(0))

    c = decisions.groupBy("author").agg(n(t & p).alias("tp"), n(~t & p).alias("fp"), n(t & ~p).alias("fn"), F.count(F.lit(1)).alias("n"))
    f1 = _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    s = c.agg(F.avg(f1).alias("f1_macro"), *[F.sum(x).alias(x) for x in ("tp", "fp", "fn", "n")])
    return s.select((F.lit(1.0) - (F.col("fp") + F.col("fn")) / F.col("n")).alias("acc"), "f1_macro",
                    _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1_micro"))


def binary_counts(df: DataFrame, truth: str = "same", pred: str = "pred") -> DataFrame:
    t, p = F.col(truth) == 1, F.col(pred) == 1
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(t & p, 1).otherwise(0)).alias("tp"),
        F.sum(F.when(~t & p, 1).otherwise(0)).alias("fp"),
        F.sum(F.when(t & ~p, 1).otherwise(0)).alias("fn"),
        F.sum(F.when(~t & ~p, 1).otherwise(0)).alias("tn"),
    )


def sav_metrics(df: DataFrame, truth: str = "same", pred: str = "pred") -> DataFrame:
    """Accuracy in percent, binary precision / recall / F1 of SAME (0/0 -> 0)."""
    c = binary_counts(df, truth, pred)
    return c.select(
        (F.lit(100.0) * (F.col("tp") + F.col("tn")) / F.col("n")).alias("acc"),
        _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("p"),
        _ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("r"),
        _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
    )


def auc(df: DataFrame, truth: str = "same", score: str = "score") -> DataFrame:
    """G5 AUC (Mann-Whitney, ties count one half): scores are grouped first, and the
    negatives below each are running totals over ranges of the scores."""
    g = df.groupBy(score).agg(
        F.sum(F.when(F.col(truth) == 1, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col(truth) == 1, 0).otherwise(1)).alias("neg"),
    )
    s = running_totals(g, [score], ["neg"]).agg(
        F.sum(F.col("pos") * (F.col("neg_before") + 0.5 * F.col("neg"))).alias("u"),
        F.sum("pos").alias("np"), F.sum("neg").alias("nn"),
    )
    return s.select((F.col("u") / (F.col("np") * F.col("nn"))).alias("auc"))


def pan_metrics(df: DataFrame, truth: str = "same", pred: str = "pred", score: str = "score") -> DataFrame:
    """Acc, F1, AUC and acc * AUC."""
    c = binary_counts(df, truth, pred).select(
        ((F.col("tp") + F.col("tn")) / F.col("n")).alias("acc"),
        _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
    ).withColumn("__k", F.lit(1))
    a = auc(df, truth, score).withColumn("__k", F.lit(1))
    return c.join(F.broadcast(a), "__k").select("acc", "f1", "auc", (F.col("acc") * F.col("auc")).alias("acc_auc"))


def author_counts(corpus: DataFrame) -> DataFrame:
    """Documents per author, most common first (author breaks ties)."""
    return corpus.groupBy("author").agg(F.count(F.lit(1)).alias("n_docs")).orderBy(F.desc("n_docs"), "author")


def calibration_curve(df: DataFrame, truth: str = "y", prob: str = "p", n_bins: int = 5,
                      strategy: str = "uniform", normalize: bool = False) -> DataFrame:
    """(bin, prob_true, prob_pred, n) for non-empty bins.

    bin = number of inner edges strictly below p; uniform edges k(1+1e-8)/n,
    quantile edges = exact percentiles of the probabilities.
    """
    d = df.select(F.col(truth).cast("double").alias("y"), F.col(prob).cast("double").alias("p"))
    if normalize:
        mm = d.agg(F.min("p").alias("lo"), F.max("p").alias("hi")).withColumn("__k", F.lit(1))
        d = d.withColumn("__k", F.lit(1)).join(F.broadcast(mm), "__k")
        d = d.withColumn("p", (F.col("p") - F.col("lo")) / (F.col("hi") - F.col("lo"))).select("y", "p")
    d = d.withColumn("p", F.when((F.col("p") < 0) | (F.col("p") > 1), F.raise_error(F.lit("y_prob has values outside [0, 1]")))
                     .otherwise(F.col("p")))
    if strategy == "uniform":
        bid = F.size(F.filter(F.sequence(F.lit(1), F.lit(max(n_bins - 1, 1))),
                              lambda k: (k * F.lit(1.0 + 1e-8) / F.lit(n_bins) < F.col("p")) & (k < n_bins)))
        d = d.withColumn("bin", bid)
    else:
        qs = [i / n_bins for i in range(n_bins + 1)]
        edges = exact_quantiles(d, "p", qs, "e").withColumn("__k", F.lit(1))
        d = d.withColumn("__k", F.lit(1)).join(F.broadcast(edges), "__k")
        inner = F.slice(F.col("e"), 2, n_bins - 1)
        d = d.withColumn("bin", F.size(F.filter(inner, lambda e: e < F.col("p"))))
    return d.groupBy("bin").agg(
        F.avg("y").alias("prob_true"), F.avg("p").alias("prob_pred"), F.count(F.lit(1)).alias("n"),
    )
