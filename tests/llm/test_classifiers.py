"""Toxicity and quality classifiers: held-out accuracy, counterfactuals, shrinkage."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.llm import quality as Q
from quillmark.llm import toxicity as T
from quillmark.llm.samples import Rows, held_out

SF = "/root/testdata/sf0.01"


def planted(n=900, seed=5):
    """Toxic sentences often name a group; neutral mentions of it occur too."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(["apple", "river", "stone", "cloud", "paper", "green"]) for _ in range(12)]
        toxic = int(rng.random() < 0.4)
        if toxic:
            words[3] = rng.choice(["scumword", "trashword", "vileword"])
        if rng.random() < (0.8 if toxic else 0.05):
            words[6] = "muslim"
        elif rng.random() < 0.2:
            words[6] = rng.choice(["christian", "hindu"])
        rows.append((i, " ".join(words) + ".", toxic))
    return rows


def test_counterfactual_penalty_frees_neutral_mentions(spark):
    rows = planted()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    plain, _ = T.train(docs, labels, fairness=0.0, l2=1e-3)
    fair, b = T.train(docs, labels, fairness=10.0, l2=1e-3)

    def term(w):
        return sum(v for f, v in w.items() if "muslim".startswith(f.rstrip("*")))

    assert term(plain) > 0.5 and abs(term(fair)) < 0.2 * term(plain)
    scores = {r["doc_id"]: r["score"] for r in T.score(docs, fair, b).collect()}
    assert np.mean([(scores[i] >= T.THRESHOLD) == y for i, _, y in rows]) > 0.98


def test_swap_terms():
    assert T.swap_terms("Women sang. The Muslim man left") == "men sang. The christian woman left"


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, 9), (None, "", 9), (2, "x " * 50_000, 9), (2, "x", 9)], "doc_id long, text string, y int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    w, b = T.train(docs, none)
    assert w == {} and [r["score"] < 1e-6 for r in T.score(docs, w, b).collect()] == [True] * 4
    one = spark.createDataFrame([(2, 1), (None, 0), (5, None)], "doc_id long, toxic int")
    assert T.train(docs, one)[0] == {}
    assert T.score(docs.limit(0), {"x": 1.0}, 0.0).count() == 0


def test_fit_learns_only_from_open_rows(spark):
    from quillmark.llm.samples import labelled
    ids = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic"))
    rows = labelled(ids, "toxic")
    assert rows.where(held_out()).count() == 0 and rows.count() == ids.where(~held_out()).count()


def test_sparse_rows():
    r = Rows([[0, 2], [], [1]], 3)
    assert r.times(np.array([1.0, 2, 4])).tolist() == [5, 0, 2] and r.back(np.array([1.0, 5, 7])).tolist() == [1, 7, 1]


def test_quality_held_out_accuracy(spark):
    out = Q.op6_quality(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    m = out.join(labels, "doc_id").where(held_out()).select((F.col("kept") == (F.col("quality") == 1)).alias("ok"))
    assert m.where("ok").count() >= 0.98 * m.count()


def test_posteriors_shrink_and_leave_own_out(spark):
    rows = [("big", "a", 0.9)] * 400 + [("bad", "a", 0.1)] * 400 + [("tiny", "a", 0.1)] + [(None, None, 0.5)] * 3
    d = spark.createDataFrame([(i, s, p, v) for i, (s, p, v) in enumerate(rows)], "doc_id long, source string, lang string, doc_score double")
    got = {(r["source"]): r for r in Q.posteriors(d, "source", "lang").collect()}
    assert len(got) == 4
    whole = sum(v for _, _, v in rows) / len(rows)
    assert got["big"]["site_rate"] > 0.85 and got["bad"]["site_rate"] < 0.15
    assert got["tiny"]["site_rate"] == pytest.approx(whole)  # its only document does not speak for the site
    assert got["tiny"]["score"] < 0.3 and got["bad"]["score"] < got["tiny"]["score"]


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, "s", "en", 1.0), (None, "", None, None, 1.0), (2, "x " * 30_000, "s", None, 1.0)],
                                 "doc_id long, text string, source string, lang string, score double")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = Q.quality(docs, labels).collect()
    assert len(got) == 3 and all(0 <= r["score"] <= 1 for r in got)
    assert Q.quality(docs.limit(0), labels).count() == 0
    assert Q.shape(None) == Q.shape(" \n") == [0.0] * Q.SHAPES
