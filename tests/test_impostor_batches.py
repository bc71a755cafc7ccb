"""Impostor scores in batches of pairs."""
import numpy as np
import pytest

from quillmark.operators import impostors as I
from quillmark.operators import similarity as S


def _vectors(spark, n, d=6):
    base = np.abs(np.random.default_rng(n).normal(size=(n // 2 + 1, d))).round(2)
    rows = [(i, str(i % 3), base[i // 2].tolist()) for i in range(n)]  # every vector comes twice
    return rows, spark.createDataFrame(rows, "doc_id long, author string, vec array<double>")


@pytest.mark.parametrize("similarity", ["minmax", "cosine"])
def test_scores_follow_the_draws(spark, similarity):
    rows, v = _vectors(spark, 24)
    m, n, k, d = 4, 3, 5, 6
    pairs = spark.createDataFrame([(0, 1), (2, 9), (3, 4), (2, 9)], "a long, b long")
    imps = I.top_impostors(v.where("doc_id < 12").select("doc_id", "vec"), v.where("doc_id >= 12"), m, similarity)
    subsets = I.feature_subsets(d, k, 1, spark)
    s = I.impostor_scores_by_pair(pairs, v.unionByName(v), imps, subsets, m, n, k, d, similarity, 1)
    assert "CoGroups" not in s._jdf.queryExecution().executedPlan().toString()  # a Python call per pair before
    M, vec = I.masks_matrix(subsets, d, k), {i: np.array(x) for i, _, x in rows}
    at = {(r["doc_id"], r["imp_rank"]): r["imp_id"] for r in imps.collect()}

    def sim(x, y, t):
        x, y = x * M[t], y * M[t]
        return np.minimum(x, y).sum() / np.maximum(x, y).sum() if similarity == "minmax" else x @ y / np.sqrt((x @ x) * (y @ y))

    want = {}
    drawn = I.impostor_draws(pairs.distinct(), m, n, k, 1).collect()
    for a, b in {(0, 1), (2, 9), (3, 4)}:
        for way, (x, y) in enumerate(((a, b), (b, a))):
            hits = 0
            for t in range(k):
                most = max(sim(vec[x], vec[at[y, r["imp_rank"]]], t) for r in drawn if (r["a"], r["b"], r["dir"], r["iter"]) == (a, b, way, t))
                hits += sim(vec[x], vec[y], t) >= most - 1e-12
            want[a, b, way] = hits / k
    got = s.collect()
    assert len(got) == 3
    for r in got:
        assert (r["score_ab"], r["score_ba"]) == (want[r["a"], r["b"], 0], want[r["a"], r["b"], 1])


def test_a_missing_impostor_raises(spark):
    _, v = _vectors(spark, 12)
    pairs = spark.createDataFrame([(0, 5)], "a long, b long")
    imps = I.top_impostors(v.where("doc_id = 0").select("doc_id", "vec"), v, 3, "minmax")
    s = I.impostor_scores_by_pair(pairs, v, imps, I.feature_subsets(6, 2, 1, spark), 3, 2, 2, 6, "minmax", 1)
    with pytest.raises(Exception, match="rk_b is missing"):
        s.collect()


def test_only_documents_of_pairs_get_impostors(spark, monkeypatch):
    _, v = _vectors(spark, 120)
    asked = []
    real = I.top_impostors
    monkeypatch.setattr(I, "top_impostors", lambda docs, *a, **k: asked.append(docs.count()) or real(docs, *a, **k))
    I.fitted_sigma(v.select("doc_id", "author"), v, 6, 4, 2, 3, "minmax", 6, 1).collect()
    assert asked[0] <= 12  # 80 before: all documents of the second half
