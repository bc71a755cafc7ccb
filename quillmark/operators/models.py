"""Learners, pair classifiers and calibration on pyspark.ml.

Data stays in DataFrames: pair difference vectors (absolute values) are built by joins and
higher-order functions, models are pyspark.ml estimators fitted by Spark, and
scoring is ``model.transform`` on a pair DataFrame.  Fold columns are seeded
and stratified (md5 rank inside each class), so folds are reproducible.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes, ProbabilisticClassificationModel
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, keep
from . import linear as LN
from .grouping import hash_rank
from .similarity import PAIR_FUNCS, RowScores, diff_vector, pair_vectors

SEED = 42
CS = [10.0 ** e for e in range(-3, 4)]  # fixed values: C grid 1e-3 .. 1e3


def with_folds(df: DataFrame, label: str = "label", k: int = 5, seed=SEED, key: str = "doc_id") -> DataFrame:
    """Stratified seeded fold column 0..k-1 (round robin over each class's shuffle)."""
    r = hash_rank(df, [label], seed, [key], out="__rk", count_col=None)
    return r.withColumn("fold", ((F.col("__rk") - 1) % k).cast("int")).drop("__rk")


def diff_pairs(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """P12 for learning: (a, b, same, features = |v_a - v_b| as an ml vector)."""
    pv = pair_vectors(pairs, vectors)
    return pv.select("a", "b", *(["same"] if "same" in pairs.columns else []),
                     array_to_vector(diff_vector("va", "vb")).alias("features"))


def train_lr_cv(train: DataFrame, label: str = "label", features: str = "features", k: int = 5) -> DataFrame:
    """M1: L2 logistic regression, C from 7 log-spaced values, k-fold CV on
    accuracy (regParam = 1 / (C n), no standardisation).  Returns the fitted
    CrossValidatorModel; ``train`` needs a ``fold`` column (see with_folds)."""
    n = train.count()
    lr = LogisticRegression(featuresCol=features, labelCol=label, standardization=False, elasticNetParam=0.0,
                            maxIter=100, tol=1e-4)
    grid = ParamGridBuilder().addGrid(lr.regParam, [1.0 / (c * n) for c in CS]).build()
    ev = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")
    cv = CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=ev, foldCol="fold", numFolds=k, parallelism=8)
    return cv.fit(train)


def platt_targets(df: DataFrame, label: str = "label") -> DataFrame:
    """M7 targets: T+ = (n+ + 1) / (n+ + 2) and T- = 1 / (n- + 2)."""
    c = df.agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("n_pos"),
               F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("n_neg"))
    return c.select("n_pos", "n_neg", ((F.col("n_pos") + 1.0) / (F.col("n_pos") + 2.0)).alias("t_pos"),
                    (F.lit(1.0) / (F.col("n_neg") + 2.0)).alias("t_neg"))


def platt_fit(scores: DataFrame, score: str = "score", label: str = "label"):
    """M7: sigmoid calibration 1 / (1 + exp(a f + b)) with smoothed targets.

    Each row becomes two weighted rows (label 1 with weight T, label 0 with
    1 - T); an unregularised weighted logistic regression on the single score
    feature then solves the same likelihood.  Returns (a, b)."""
    t = platt_targets(scores, label).withColumn("__k", F.lit(1))
    d = scores.withColumn("__k", F.lit(1)).join(F.broadcast(t), "__k")  # one-row table
    tgt = F.when(F.col(label) == 1, F.col("t_pos")).otherwise(F.col("t_neg"))
    rows = d.select(F.col(score).alias("f"), tgt.alias("T"))
    dup = rows.select("f", F.explode(F.array(
        F.struct(F.lit(1.0).alias("y"), F.col("T").alias("w")),
        F.struct(F.lit(0.0).alias("y"), (1 - F.col("T")).alias("w")))).alias("r"))
    dup = cut(dup.select(array_to_vector(F.array("f")).alias("features"), F.col("r.y").alias("y"), F.col("r.w").alias("w")))
    m = LogisticRegression(labelCol="y", weightCol="w", regParam=0.0, standardization=False, maxIter=200).fit(dup)
    return -float(m.coefficients[0]), -float(m.intercept)


def platt_apply(df: DataFrame, a: float, b: float, score: str = "score", out: str = "prob") -> DataFrame:
    return df.withColumn(out, F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(a) * F.col(score) + F.lit(b))))


def isotonic_fit(scores: DataFrame, score: str = "score", label: str = "label"):
    """M8: monotone (PAVA) fit of the label on the score; out of range clips."""
    d = scores.select(F.col(score).alias("features"), F.col(label).cast("double").alias("label"))
    return IsotonicRegression(featuresCol="features", labelCol="label", isotonic=True).fit(d)


def margin(df: DataFrame, raw: str = "rawPrediction") -> DataFrame:
    """Positive-class margin of a binary model output."""
    return df.withColumn("score", vector_to_array(F.col(raw))[1])


def _calibrator(scores: DataFrame, method: str, label: str):
    return platt_fit(scores, "score", label) if method == "sigmoid" else isotonic_fit(scores, "score", label)


def calibrated_cv(train: DataFrame, make_estimator, k: int = 3, method: str = "sigmoid",
                  label: str = "label", ensemble: bool = False) -> list[tuple]:
    """M9: calibrated members (model, calibrator) for ``calibrated_prob``.

    ``ensemble``: per fold a model fitted on the other folds and calibrated on
    that fold.  Otherwise one member: out-of-fold margins from k fits -> one
    calibrator -> base model refitted on all rows.  A calibrator is (a, b) for
    sigmoid or an IsotonicRegressionModel.  A class with fewer than k rows raises."""
    per_class = train.groupBy(label).count().agg(F.min("count").alias("m")).first()["m"]
    if per_class is None or per_class < k:
        raise ValueError(f"requesting {k}-fold calibration but a class has {per_class} rows")
    members, oof = [], None
    for f in range(k):
        m = make_estimator().fit(train.where(F.col("fold") != f))
        s = margin(m.transform(train.where(F.col("fold") == f))).select(label, "score")
        if ensemble:
            members.append((m, _calibrator(s, method, label)))
        oof = s if oof is None else oof.unionByName(s)
    return members if ensemble else [(make_estimator().fit(train), _calibrator(oof, method, label))]


def calibrated_prefit(model, held_out: DataFrame, method: str = "sigmoid", label: str = "label") -> list[tuple]:
    """M9 ('prefit'): calibrator of an already fitted model on rows it has not seen."""
    return [(model, _calibrator(margin(model.transform(held_out)), method, label))]


def calibrate_if_needed(model, train: DataFrame, make_estimator, k: int = 5, label: str = "label") -> list[tuple]:
    """A fitted model that gives probabilities is kept (calibrator None), a grid
    search is unwrapped first; any other is calibrated by M9 (``fold`` column, k folds)."""
    model = model.bestModel if isinstance(model, CrossValidatorModel) else model
    if isinstance(model, ProbabilisticClassificationModel):
        return [(model, None)]
    return calibrated_cv(train, make_estimator, k, label=label, ensemble=False)


def calibrated_prob(members: list[tuple], df: DataFrame) -> DataFrame:
    """``df`` with score (mean margin) and prob (mean calibrated probability of the members)."""
    out, n = df, len(members)
    for i, (model, cal) in enumerate(members):
        s = margin(model.transform(out))
        if cal is None:
            s = s.withColumn("prob", vector_to_array("probability")[1])
        elif isinstance(cal, tuple):
            s = platt_apply(s, cal[0], cal[1])
        else:
            s = cal.setFeaturesCol("score").setPredictionCol("prob").transform(s)
        out = s.select(*out.columns, F.col("score").alias(f"__score{i}"), F.col("prob").alias(f"__prob{i}"))
    mean = [(sum((F.col(f"__{c}{i}") for i in range(n)), F.lit(0.0)) / n).alias(c) for c in ("score", "prob")]
    return out.select(*df.columns, *mean)


def linear_probability(member: tuple) -> tuple[list[float], float]:
    """(coef, intercept) whose logistic function is a linear member's P(SAME)."""
    model, cal = member
    a, b = (-1.0, 0.0) if cal is None else cal
    return [-a * float(c) for c in model.coefficients], -a * float(model.intercept) - b


def normalize_probs(df: DataFrame, probs: str = "probs") -> DataFrame:
    """Binary -> [1 - p, p]; multi-class -> divided by the row sum, NaN -> 1/n,
    values in (1, 1 + 1e-5] clipped to 1; plus the argmax class index."""
    p = F.col(probs)
    n = F.size(p)
    tot = F.aggregate(p, F.lit(0.0), lambda acc, x: acc + x)
    norm = F.when(n == 1, F.array(F.lit(1.0) - p[0], p[0])).otherwise(
        F.transform(p, lambda x: F.when(tot == 0, F.lit(float("nan"))).otherwise(x / tot)))
    fixed = F.transform(norm, lambda x: F.when(F.isnan(x), F.lit(1.0) / F.greatest(n, F.lit(2)))
                        .when((x > 1.0) & (x <= 1.0 + 1e-5), F.lit(1.0)).otherwise(x))
    best = F.array_position(fixed, F.array_max(fixed)) - 1
    return df.withColumn("proba", fixed).withColumn("argmax", best.cast("int"))


def pair_classifier(train_pairs: DataFrame, vectors: DataFrame, reg_param: float = 0.0):
    """M5 (DV-Bin): logistic regression on the absolute differences of SAME/DIFFERENT pairs."""
    d = diff_pairs(train_pairs, vectors).withColumn("label", F.col("same").cast("double"))
    return LogisticRegression(standardization=False, regParam=reg_param, maxIter=100, tol=1e-4).fit(d)


def pair_scores(model, pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """M5 h_prob / same_author: P(SAME) per pair and the decision prob > 0.5."""
    d = diff_pairs(pairs, vectors)
    out = model.transform(d)
    return out.select("a", "b", *(["same"] if "same" in pairs.columns else []),
                      vector_to_array("probability")[1].alias("score"),
                      vector_to_array("rawPrediction")[1].alias("margin"),
                      (vector_to_array("probability")[1] > 0.5).cast("int").alias("pred"))


def distance_classifier(train_pairs: DataFrame, vectors: DataFrame, metric: str = "l1"):
    """M6: one-feature logistic regression (C = 1 -> regParam = 1 / n) on a paired
    distance.  Returns (model, (min, max) of the training distances)."""
    d = pair_vectors(train_pairs, vectors).select("same", PAIR_FUNCS[metric]("va", "vb").alias("dist"))
    d = d.select(F.col("same").cast("double").alias("label"), "dist", array_to_vector(F.array("dist")).alias("features"))
    n = d.count()
    rng = d.agg(F.min("dist"), F.max("dist")).first()
    m = LogisticRegression(regParam=1.0 / n, standardization=False, maxIter=100, tol=1e-4).fit(d)
    return m, (float(rng[0]), float(rng[1]))


def distance_scores(model, pairs: DataFrame, vectors: DataFrame, metric: str = "l1") -> DataFrame:
    d = pair_vectors(pairs, vectors).select("a", "b", "same", PAIR_FUNCS[metric]("va", "vb").alias("dist"))
    out = model.transform(d.withColumn("features", array_to_vector(F.array("dist"))))
    return out.select("a", "b", "same", "dist", vector_to_array("probability")[1].alias("score"),
                      F.col("prediction").cast("int").alias("pred"))


def naive_bayes(train: DataFrame, label: str = "label", features: str = "features", smoothing: float = 0.0):
    """M4: multinomial naive Bayes (alpha as given; non-negative features only)."""
    return NaiveBayes(modelType="multinomial", smoothing=smoothing, labelCol=label, featuresCol=features).fit(train)


def linear_svc(n: int, label: str = "label", features: str = "features", c: float = 1.0) -> LinearSVC:
    """M2 base: linear SVM (hinge loss) for n rows; regParam = 1 / (C n)."""
    return LinearSVC(regParam=1.0 / (c * n), labelCol=label, featuresCol=features, maxIter=100, tol=1e-4, standardization=False)


def svm_lri(rows: DataFrame, dims: int, k: int = 3, c: float = 1.0) -> list[tuple]:
    """M2: squared-hinge linear SVM on random-indexed rows (cls 0/1, fold, idx, val) with
    sigmoid calibration: a machine per left-out fold, all fitted in the same passes,
    each calibrated on its fold.  Returns members (weights, (a, b))."""
    packed = LN.blocks(rows, dims)
    w = LN.fit(packed, dims, LN.Problems.of([(1, f, c) for f in range(k)]), "squared_hinge")
    scores = keep(LN.margins(rows, w, ["cls", "fold"]))
    return [(w[f], platt_fit(scores.where(F.col("fold") == f).select(F.col("margins")[f].alias("score"), F.col("cls").alias("label"))))
            for f in range(k)]


def svm_probability(members: list[tuple], rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` plus score (mean margin) and prob (mean calibrated probability)."""
    m = LN.margins(rows, np.stack([w for w, _ in members]), keys)
    each = [F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(a) * F.col("margins")[i] + F.lit(b))) for i, (_, (a, b)) in enumerate(members)]
    mean = sum((F.col("margins")[i] for i in range(len(members))), F.lit(0.0)) / len(members)
    return m.select(*keys, mean.alias("score"), (sum(each, F.lit(0.0)) / len(members)).alias("prob"))


def stacked_attribution(train_stacked: DataFrame | RowScores, test_stacked: DataFrame | RowScores, label: str = "label"):
    """M14 learner: a logistic regression on the stacked score features (doc_id, vec[, label]), or on
    ``RowScores``, which are scored again instead of stored."""
    if isinstance(train_stacked, RowScores):
        return stacked_scores_attribution(train_stacked, test_stacked)
    tr = train_stacked.withColumn("features", array_to_vector("vec"))
    te = test_stacked.withColumn("features", array_to_vector("vec"))
    m = LogisticRegression(standardization=False, maxIter=100, regParam=0.01, labelCol=label).fit(tr)
    return m.transform(te)


def minimise(value, w: np.ndarray, max_iter: int = 100, tol: float = 1e-6, memory: int = 10) -> np.ndarray:
    """L-BFGS with halved steps; ``value(w)`` gives (f, gradient).  It ends when a step gains
    less than ``tol`` of f, or after ``max_iter`` steps."""
    f, g = value(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(max_iter):
        d, a = -g, []
        for s, y in reversed(past):
            a.append((s * d).sum() / (s * y).sum())
            d = d - a[-1] * y
        if past:
            s, y = past[-1]
            d = d * ((s * y).sum() / (y * y).sum())
        for (s, y), c in zip(past, reversed(a)):
            d = d + (c - (y * d).sum() / (s * y).sum()) * s
        slope = (g * d).sum()
        if slope >= 0:
            break
        t = 1.0 if past else min(1.0, 1.0 / max(np.sqrt((g * g).sum()), 1e-300))
        while t > 1e-12:
            f_new, g_new = value(w + t * d)
            if f_new <= f + 1e-4 * t * slope:
                break
            t *= 0.5
        else:
            break
        s, y = t * d, g_new - g
        if (s * y).sum() > 1e-12 * (y * y).sum():
            past = [*past[-memory + 1:], (s, y)]
        gain, w, f, g = f - f_new, w + s, f_new, g_new
        if gain <= tol * max(abs(f), 1e-12):
            break
    return w


def stacked_scores_attribution(rows: RowScores, test: RowScores, reg_param: float = 0.01, max_iter: int = 100,
                               tol: float = 1e-6) -> DataFrame:
    """``stacked_attribution`` on score rows against the same references, ``rows`` with whole
    numbers as authors: (doc_id, prediction).  Neither features nor their copies are stored: every
    pass of the fit scores the rows again in its tasks, which send sums of references x classes
    numbers.  The same objective: mean multinomial loss (two classes: binomial) and reg_param
    |w|^2 / 2, intercepts free."""
    test = test.against(rows)
    classes = int(rows.x.agg(F.max(F.array_max(F.transform("authors", lambda a: a.cast("double")))).alias("m")).first()["m"]) + 1
    out = classes if classes > 2 else 1  # columns of weights

    def summed(each, sizes: list[int]) -> list[np.ndarray]:
        """Sums over all rows of the arrays that ``each(label, S)`` gives."""
        def run(refs, _, authors, S):
            label = np.array([float(a) for a in authors.to_pylist()]).astype(np.int64)
            for i, v in enumerate(each(label, S)):
                refs.own[i] = refs.own[i] + v if i in refs.own else v

        def last(refs):
            return pa.RecordBatch.from_arrays([pa.array([np.concatenate([np.ravel(refs.own[i]) for i in range(len(sizes))]).tobytes()], pa.binary())], ["sums"])

        total = sum(np.frombuffer(r["sums"]) for r in rows.run(run, "sums binary", last).collect())
        return np.split(total, np.cumsum(sizes)[:-1])

    mean = summed(lambda _, S: [S.sum(axis=0)], [rows.nr])[0] / rows.nx  # columns are centred, which moves the intercepts only

    def logits(S: np.ndarray, w: np.ndarray) -> np.ndarray:
        z = S @ w[:-1] + (w[-1] - mean @ w[:-1])
        return z if out > 1 else np.hstack([np.zeros_like(z), z])

    def value(flat: np.ndarray) -> tuple[float, np.ndarray]:
        w = flat.reshape(rows.nr + 1, out)

        def each(label, S):
            z = logits(S, w)
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            total = p.sum(axis=1, keepdims=True)
            at = np.arange(len(S)), label
            loss = (np.log(total[:, 0]) - z[at]).sum()
            p /= total
            p[at] -= 1.0
            p = p if out > 1 else p[:, 1:]
            return [np.array([loss]), S.T @ p, p.sum(axis=0)]

        loss, g, g0 = summed(each, [1, rows.nr * out, out])
        g = g.reshape(rows.nr, out) - np.outer(mean, g0)
        return (loss[0] / rows.nx + 0.5 * reg_param * (w[:-1] ** 2).sum(),
                np.concatenate([g / rows.nx + reg_param * w[:-1], g0[None, :] / rows.nx]).ravel())

    w = minimise(value, np.zeros((rows.nr + 1) * out), max_iter, tol).reshape(rows.nr + 1, out)

    def predicted(_, ids, __, S):
        return pa.RecordBatch.from_arrays([ids, pa.array(logits(S, w).argmax(axis=1).astype(np.float64))], ["doc_id", "prediction"])

    return test.run(predicted, "doc_id long, prediction double")
