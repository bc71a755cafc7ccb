"""Running totals, quantiles, AUC and the F1 cut against direct computation."""
import numpy as np
import pytest

from quillmark.operators import corpus as C
from quillmark.operators import impostors as I
from quillmark.operators import metrics as G
from quillmark.operators import ordered as O
from quillmark.operators import text_features as P


def scored(spark, n=400, seed=1, levels=23):
    r = np.random.default_rng(seed)
    rows = [(i, i + 1, int(r.random() < 0.4), float(r.integers(0, levels)) / levels) for i in range(n)]
    return rows, spark.createDataFrame(rows, "a long, b long, same int, score double").repartition(7)


def test_running_totals(spark):
    rows, df = scored(spark)
    got = O.running_totals(df, ["score", "a"], ["same", "b"]).collect()
    want = sorted(rows, key=lambda x: (x[3], x[0]))
    before = {x[0]: (sum(y[2] for y in want[:k]), sum(y[1] for y in want[:k])) for k, x in enumerate(want)}
    assert len(got) == len(rows)
    assert all((r["same_before"], r["b_before"]) == before[r["a"]] for r in got)
    assert {(r["same_all"], r["b_all"]) for r in got} == {(sum(x[2] for x in rows), sum(x[1] for x in rows))}
    assert O.running_totals(df.limit(0), ["score"], ["same"]).collect() == []


@pytest.mark.parametrize("n", [1, 2, 7, 400])
def test_exact_quantiles(spark, n):
    rows, df = scored(spark, n, n)
    shares = [0.0, 0.13, 0.5, 0.9, 1.0]
    got = O.exact_quantiles(df, "score", shares).first()[0]
    assert got == pytest.approx(list(np.quantile([r[3] for r in rows], shares)))
    assert O.exact_quantiles(df.limit(0), "score", shares).collect() == []


def test_auc_counts_ties_half(spark):
    rows, df = scored(spark)
    pos, neg = ([r[3] for r in rows if r[2] == y] for y in (1, 0))
    want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert G.auc(df).first()["auc"] == pytest.approx(want)


@pytest.mark.parametrize("compat", [False, True])
def test_threshold_search(spark, compat):
    rows, df = scored(spark)
    order = sorted(rows, key=lambda r: (r[3], r[0], r[1]))
    best = None
    for i in range(1, len(order) - 1):
        if order[i][3] == 0 or (not compat and order[i - 1][3] == order[i][3]):
            continue
        tp = sum(r[2] for r in order[i:])
        f1 = 2 * tp / (len(order) - i + sum(r[2] for r in order))
        if best is None or round(f1, 9) > round(best[1], 9):
            best = (order[i][3], f1, i)
    got = I.threshold_search_f1(df, compat).first()
    assert (got["sigma"], got["pos"]) == (best[0], best[2]) and got["f1"] == pytest.approx(best[1])


def test_split_ranks_ids_only_and_plans_start_no_job(spark):
    rows = [(i, f"a{i % 3}", f"text {i}", "en") for i in range(60)] + [(0, "a0", "again", "en")]
    c = spark.createDataFrame(rows, "doc_id long, author string, text string, lang string")
    spark.sparkContext.setJobGroup("plan-only", "")
    s = C.stratified_split(c)
    P.char_ngram_counts(s)
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("plan-only")) == []
    got = s.collect()
    assert s.columns == ["doc_id", "author", "text", "lang", "split"] and len(got) == 61
    assert len({r["split"] for r in got if r["doc_id"] == 0}) == 1
