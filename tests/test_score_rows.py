"""Whole score rows: references read once a task, hits and sums taken there, stacked fits without stored scores."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.operators import models as M
from quillmark.operators import rules as R
from quillmark.operators import similarity as S

COEF, ICPT = [0.5, -1.0, 2.0, 0.25], -0.5


def _rows(n, seed=0, first=0, authors=3):
    rng = np.random.default_rng(seed)
    return [(first + i, str(i % authors), (rng.normal(size=4) + (i % authors)).tolist()) for i in range(n)]


def _frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, author string, vec array<double>")


@pytest.fixture(autouse=True)
def small(monkeypatch):
    monkeypatch.setattr(S, "PACK_ROWS", 16)
    monkeypatch.setattr(S, "ROW_CELLS", 700)


def test_a_task_reads_its_rows_once(spark):
    x, r = _frame(spark, _rows(60)), _frame(spark, _rows(100, 1, 1000))
    s = S.RowScores(x, r, "l1")
    parts = s.both.where("x_ids is not null").agg(F.sum(F.size("x_ids")).alias("n")).first()["n"]
    assert parts == 60  # a copy beside every packed row of the references before
    assert s.both.select("r_blk").count() <= 7 * 8  # packed rows of the references times tasks


@pytest.mark.parametrize("held", [1 << 20, 0])
def test_hits_leave_a_task_once(spark, monkeypatch, held):
    monkeypatch.setattr(S, "HELD_BYTES", held)  # 0: the references lie in a file
    sent, real = [], S.RowScores.run

    def run(self, each, schema, last=None):
        out = real(self, each, schema, last)
        sent.append((out.count(), self.both.where("x_ids is not null").count()))
        return out

    monkeypatch.setattr(S.RowScores, "run", run)
    rows = _rows(60)
    got = {r["k"]: r["acc"] for r in R.knn_tune_k(_frame(spark, rows)).collect()}
    assert sent and sent[0][0] == 20 * sent[0][1]  # a row per k for every few rows of x before
    V = np.array([v for *_, v in rows])
    V = V / np.linalg.norm(V, axis=1, keepdims=True)
    P, a = V @ V.T, np.arange(60) % 3
    np.fill_diagonal(P, 0)
    for k in (1, 7, 20):
        mean = np.stack([np.sort(P[:, a == g], axis=1)[:, ::-1][:, :k].mean(1) for g in range(3)], axis=1).round(9)
        assert got[k] == pytest.approx((mean.argmax(1) == a).mean())


def test_repeated_ids_are_one_document(spark):
    rows = _rows(30)
    k = R.knn_tune_k(_frame(spark, rows + rows[:9]))
    assert k.agg(F.max("k")).first()[0] == 10
    got = {r["doc_id"]: r for r in R.stacked_rows(_frame(spark, rows + rows[:9]), _frame(spark, rows), "l1", summed=True).collect()}
    assert len(got) == 30 and [got[0]["width"], got[20]["width"]] == [60, 30]


def test_summed_rows_are_those_of_the_whole_rows(spark):
    x, r = _frame(spark, _rows(30)), _frame(spark, _rows(50, 1, 1000))
    rows = R.stacked_rows(x, r, "diff_logit", COEF, ICPT).collect()
    sums = {d["doc_id"]: d for d in R.stacked_rows(x, r, "diff_logit", COEF, ICPT, summed=True).collect()}
    for d in rows:
        s = sums[d["doc_id"]]
        assert (s["width"], s["total"], s["first"]) == (50, pytest.approx(sum(d["vec"])), d["vec"][0])


def test_coordinates_keep_the_dot_products_of_score_rows(spark):
    tr, te = _frame(spark, _rows(40)), _frame(spark, _rows(20, 1, 1000))
    V = {d["doc_id"]: d["vec"] for x in (tr, te) for d in R.stacked_rows(x, tr, "cosine").collect()}
    Z = {d["doc_id"]: d["vec"] for x in (tr, te) for d in R.stacked_rows(x, tr, turned=True).collect()}
    ids = sorted(V)
    V, Z = (np.array([d[i] for i in ids]) for d in (V, Z))
    assert V.shape == (60, 40) and Z.shape == (60, 4)  # as wide as the references before
    assert V @ V.T == pytest.approx(Z @ Z.T)


@pytest.mark.parametrize("authors", [2, 3])
def test_stacked_fit_equals_the_one_on_stored_rows(spark, authors):
    tr, te = _frame(spark, _rows(60, authors=authors)), _frame(spark, _rows(50, 1, 1000, authors))
    got = M.stacked_scores_attribution(*(S.pairwise_projection(x, tr, "diff_logit", coef=COEF, intercept=ICPT, whole_rows=True) for x in (tr, te)), tol=1e-9)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    ftr, fte = (R.stacked_rows(x, tr, "diff_logit", COEF, ICPT) for x in (tr, te))
    ftr = ftr.join(tr.select("doc_id", F.col("author").cast("double").alias("label")), "doc_id")
    want = {r["doc_id"]: r["prediction"] for r in M.stacked_attribution(ftr, fte).collect()}
    assert {r["doc_id"]: r["prediction"] for r in got.collect()} == want
    turned = M.stacked_attribution(R.stacked_rows(tr, tr, turned=True).withColumn("label", F.col("author").cast("double")), R.stacked_rows(te, tr, turned=True))
    ftr, fte = (R.stacked_rows(x, tr) for x in (tr, te))
    ftr = ftr.join(tr.select("doc_id", F.col("author").cast("double").alias("label")), "doc_id")
    want = {r["doc_id"]: r["prediction"] for r in M.stacked_attribution(ftr, fte).collect()}
    assert {r["doc_id"]: r["prediction"] for r in turned.collect()} == want
