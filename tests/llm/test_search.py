"""Vector searches against brute force."""
import math

import numpy as np
import pytest

from quillmark.llm import ann, metric_search, vectors

SCHEMA = "vec_id long, embedding array<double>, score string"


def table(spark, rows):
    return spark.createDataFrame([(i, e, "clash") for i, e in rows], SCHEMA)


def odd_rows():
    return [(7, None), (14, [1.0, None]), (None, [1.0, 2.0]), (21, [math.nan, 1.0]), (28, [math.inf, 1.0])]


def random_rows(n, dims, seed=0, copies=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dims)) * rng.uniform(0.2, 2, (n, 1))
    x[n - copies:] = x[0]
    return [(i, v.tolist()) for i, v in enumerate(x)]


@pytest.mark.parametrize("block_rows,copies", [(8192, 0), (90, 0), (90, 150)])
def test_metric_search_is_exact(spark, block_rows, copies):
    rows = random_rows(400, 6, copies=copies)
    t = table(spark, rows + [(400, [0.0] * 6), (5, rows[5][1])] + [(i, None if e is None else (e * 3)) for i, e in odd_rows()])
    got = metric_search.top_k(t, t.where("vec_id % 50 = 0"), 5, block_rows, 5).collect()
    x = np.floor(256 * np.array([e for _, e in rows] + [[0.0] * 6])).astype(np.int64)
    for q in range(0, 401, 50):
        s = x @ x[q]
        want = sorted((-int(v), i) for i, v in enumerate(s) if i != q)[:5]
        mine = sorted((r["rank"], -r["score"], r["vec_id"]) for r in got if r["query_id"] == q)
        assert mine == [(k, v, i) for k, (v, i) in enumerate(want, 1)]


def test_metric_search_large_components(spark):
    t = table(spark, [(0, [1e7, 1.0]), (1, [2e7, -1.0]), (2, [-1e300, 0.0]), (3, [0.5, 0.5]), (4, [1e3, 7.0])])
    got = {(r["rank"], r["vec_id"], r["score"]) for r in metric_search.top_k(t, t.where("vec_id = 0"), 4).collect()}
    assert got == {(1, 1, (1 << 63) - 1), (2, 4, 2560000000 * 256000 + 256 * 1792), (3, 3, 2560000000 * 128 + 256 * 128),
                   (4, 2, -(1 << 63))}


def test_ann_recall_and_scores(spark):
    rows = random_rows(3000, 32, seed=3)
    t = table(spark, rows + odd_rows() + [(9000, [0.0] * 32)])
    got = ann.nearest(t, t.where("vec_id % 20 = 0"), 20, block_rows=1024).collect()
    x = np.array([e for _, e in rows])
    hits = 0
    for q in range(0, 3000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21))
        assert all(r["score"] == pytest.approx(s[r["vec_id"]], rel=1e-12) for r in mine)
        hits += len(set(np.argsort(-s)[:20].tolist()) & {r["vec_id"] for r in mine})
    assert hits / (150 * 20) >= 0.9


@pytest.mark.parametrize("search", [lambda t, q: ann.nearest(t, q, 20), lambda t, q: metric_search.top_k(t, q, 20)])
def test_few_rows_ties_and_none(spark, search):
    same = table(spark, [(i, [1.0, 0.0]) for i in (20, 3, 40, 1)] + odd_rows())
    got = sorted((r["rank"], r["vec_id"]) for r in search(same, same.where("vec_id = 20")).collect())
    assert got == [(1, 1), (2, 3), (3, 40)]
    empty = table(spark, [])
    assert search(empty, empty).count() == 0 and search(same, empty).count() == 0


def test_usable_rows(spark):
    t = table(spark, odd_rows() + [(1, []), (2, [0.0]), (3, [1.0])])
    assert sorted(r["vec_id"] for r in vectors.usable(t, True).collect()) == [3]
    assert sorted(r["vec_id"] for r in vectors.usable(t, False).collect()) == [2, 3]


SEARCHES = [lambda t, q: ann.nearest(t, q, 20, 4, 3), lambda t, q: metric_search.top_k(t, q, 20, 4, 3)]


@pytest.mark.parametrize("search", SEARCHES)
def test_unequal_lengths_meet_only_their_own(spark, search):
    rows = [(i, [1.0 + i / 8, 2.0][: 1 + i % 2] + [0.5] * (i % 3 == 0)) for i in range(30)]
    t = table(spark, rows + odd_rows())
    got = search(t, t.where("vec_id % 7 = 0")).collect()
    length = {i: len(e) for i, e in rows}
    for q in (0, 7, 14, 21, 28):
        mine = sorted(r["vec_id"] for r in got if r["query_id"] == q)
        assert mine == [i for i in length if length[i] == length[q] and i != q]


@pytest.mark.parametrize("search", SEARCHES)
def test_repeated_ids_are_rows(spark, search):
    t = table(spark, [(1, [1.0, 0.0]), (1, [3.0, 0.0]), (1, [3.0, 0.0]), (2, [2.0, 0.0]), (2, [5.0, 0.0]), (3, [1.0, 0.0])])
    got = {q: [r["vec_id"] for r in sorted(search(t, t.where("vec_id < 3")).where(f"query_id = {q}").collect(), key=lambda r: r["rank"])]
           for q in (1, 2)}
    # every query row meets every row of another id
    assert sorted(got[1]) == [2] * 6 + [3] * 3 and sorted(got[2]) == [1] * 6 + [3] * 2
