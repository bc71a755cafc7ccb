"""Calibration of learners (M2, M9, M11) and the pair classifier in AA."""
import math
import random

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from quillmark.operators import models as M


@pytest.fixture(scope="module")
def train(spark):
    rng = random.Random(5)
    rows = []
    for i in range(240):
        y = i % 2
        rows.append((i, float(y), [rng.gauss(y, 1.0), rng.gauss(-y, 1.0)]))
    d = spark.createDataFrame(rows, "doc_id long, label double, vec array<double>")
    return M.with_folds(d.withColumn("features", array_to_vector("vec")), "label", 5).coalesce(1).cache()


def make():
    return M.linear_svc(240).setMaxIter(3)


def test_ensemble_averages_its_folds(train):
    two = train.withColumn("fold", (F.floor(F.col("doc_id") / 2) % 2).cast("int"))
    members = M.calibrated_cv(two, make, 2, ensemble=True)
    assert len(members) == 2
    each = [{r["doc_id"]: r["prob"] for r in M.calibrated_prob([m], train).collect()} for m in members]
    for r in M.calibrated_prob(members, train).collect():
        assert r["prob"] == pytest.approx(sum(e[r["doc_id"]] for e in each) / 2)


def test_prefit_keeps_the_model(train):
    svm = make().fit(train.where("fold <> 0"))
    (model, cal), = M.calibrated_prefit(svm, train.where("fold = 0"))
    assert model is svm and cal[0] < 0


def test_calibrated_only_if_needed(train):
    lr = LogisticRegression(maxIter=3).fit(train)
    assert M.calibrate_if_needed(lr, train, make) == [(lr, None)]
    two = train.withColumn("fold", (F.floor(F.col("doc_id") / 2) % 2).cast("int"))
    member, = M.calibrate_if_needed(make().fit(train), two, make, 2)
    assert member[1] is not None
    coef, icpt = M.linear_probability(member)
    for r in M.calibrated_prob([member], train).where("doc_id < 20").collect():
        z = sum(c * x for c, x in zip(coef, r["vec"])) + icpt
        assert r["prob"] == pytest.approx(1 / (1 + math.exp(-z)))


def test_aa_experiment_uses_the_pair_classifier(spark, monkeypatch):
    from quillmark.plans import experiments as E

    used, project = [], E.S.pairwise_projection
    monkeypatch.setattr(E.S, "pairwise_projection", lambda *a, **k: used.append(a[2]) or project(*a, **k))
    monkeypatch.setattr(E, "_aa_metrics_row", lambda p, name, n: p.select(F.lit(name).alias("method"), "doc_id"))
    out = E.aa_experiment(spark, "/root/testdata/sf0.01")
    assert used == ["diff_logit"] * 3 and out.where("method = 'PairLRlinear'").count() > 0
