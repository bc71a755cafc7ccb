"""Best cells of the blocked projection found by sums in 16 bits."""
import numpy as np
import pytest

from quillmark.operators import similarity as S


@pytest.mark.parametrize("metric", ["minmax", "diff_logit", "cosine"])
@pytest.mark.parametrize("by_author", [False, True])
def test_screened_cells_are_the_best(metric, by_author, monkeypatch):
    rng = np.random.default_rng(3)
    coef = rng.normal(size=8)
    x, reduce, scored = rng.normal(size=(40, 8)), S.TopCells(3, by_author), []
    refs = [rng.normal(size=(120, 8)) for _ in range(9)]
    refs[4][:30] = x[:30]  # equal rows: equal scores
    refs[5][:30] = x[:30]
    if metric == "minmax":
        x, refs = np.abs(x), [np.abs(r) for r in refs]
    real = S.np_scores
    monkeypatch.setattr(S, "np_scores", lambda metric, X, R, *a: scored.append(len(X) * len(R)) or real(metric, X, R, *a))
    bests, kept = S._Bests(reduce, 40), []
    for at, r in enumerate(refs):
        screen = S._Screen(metric, x, r, coef, 0.3)
        groups = [(0, slice(0, 50)), (1, slice(50, 120))] if by_author else [(0, slice(0, 120))]
        for s in range(0, 40, 16):
            for g, i, j, p in screen.best(reduce, bests, groups, slice(s, min(s + 16, 40))):
                kept.append([i, np.full(len(i), g), j + 120 * at, p])
    assert sum(scored) < 40 * 120 * 9 / 2  # every cell was scored in full before
    i, g, j, p = reduce.cut([np.concatenate(c) for c in zip(*kept)])
    P = np.concatenate([real(metric, x, r, coef, 0.3) for r in refs], axis=1)
    of = np.tile((np.arange(120) >= 50).astype(int) if by_author else np.zeros(120, dtype=int), 9)
    for row in range(40):
        for a in np.unique(of):
            cols = np.flatnonzero(of == a)
            order = cols[np.lexsort((cols, -P[row, cols].round(9)))][:3]
            own = (i == row) & (g == a)
            assert sorted(j[own]) == sorted(order)
            assert sorted(p[own]) == pytest.approx(sorted(P[row, order]), abs=1e-15)


def test_parts_of_the_references_follow_the_tasks_that_are_wanted(spark, monkeypatch):
    monkeypatch.setattr(S, "PACK_ROWS", 16)
    x, r = (spark.createDataFrame([(i, np.abs(np.random.default_rng(i).normal(size=4)).tolist()) for i in range(a, b)],
                                  "doc_id long, vec array<double>") for a, b in ((0, 60), (1000, 1480)))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        s = S.pairwise_projection(x, r, "minmax", 16, reduce=S.TopCells(2, False))
        assert s.count() <= 60 * 2 * 2  # 4 parts of x times 2; 8 times the best cells of a row before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
