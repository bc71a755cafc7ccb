"""Near-duplicate groups against all pairs."""
import random

import numpy as np
import pytest

from quillmark.llm import near_dup as N


def brute(rows, width, percent):
    def shingles(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())

    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, s) in enumerate(sets):
        for b, u in sets[:k]:
            if s and u and 100 * len(s & u) >= percent * len(s | u):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def family(seed, n, words, edits):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10 ** 6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("width,percent,bands,rows", [(3, 85, 36, 7), (5, 80, 42, 6)])
def test_groups_equal_all_pairs(spark, width, percent, bands, rows):
    texts = family(1, 60, 120, 8) + family(2, 40, 60, 6) + family(3, 30, 12, 2) + family(4, 25, 4, 1)
    texts += ["", None, "  \n ", "one", "ONE", "one two", "One  Two", "é É", "É é"] + ["same text as others here"] * 20
    table = [(3 * i + 1, t) for i, t in enumerate(texts)] + [(None, "same text as others here"), (None, None)]
    docs = spark.createDataFrame([(i, t, 0, "z") for i, t in table], "doc_id long, text string, n int, keys string")
    got = N.near_duplicates(docs, width, percent, bands, rows).collect()
    assert len(got) == len(table)
    want = brute(table, width, percent)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
            assert r["kept"] == (r["component_id"] == r["doc_id"])


@pytest.mark.parametrize("percent", [80, 85])
def test_sketches_keep_every_linked_pair(spark, percent):
    rng = np.random.default_rng(percent)
    rows = []
    for n, m, shared in [(4, 5, 4), (8, 10, 8), (9, 9, 8), (12, 15, 12), (6, 7, 6), (17, 20, 17), (40, 50, 40),
                         (170, 200, 170), (1700, 2000, 1700), (9000, 9000, 8300)]:
        if 100 * shared < percent * (n + m - shared):
            continue
        for _ in range(400 if n < 1000 else 5):
            x = rng.integers(0, 2 ** 63, n + m - shared, dtype=np.uint64) * np.uint64(2)
            a, b = np.sort(x[:n]), np.sort(x[n - shared:])
            assert len(np.intersect1d(a, b)) == shared and len(b) == m
            sa, sb = N.sketches([a, b]).tolist()
            rows.append((n, m, sa, sb))
    t = spark.createDataFrame(rows, "n long, m long, a array<long>, b array<long>")
    assert len(rows) > 1000 and t.where(~N.may_agree("a", "b", "n", "m", percent)).count() == 0


def test_sketches_rule_out_other_sets(spark):
    rng = np.random.default_rng(3)
    rows = [(n, *N.sketches([np.sort(rng.integers(0, 2 ** 63, n, dtype=np.uint64) * np.uint64(2)) for _ in "ab"]).tolist())
            for n in (5, 50, 500, 4000) for _ in range(20)]
    t = spark.createDataFrame(rows, "n long, a array<long>, b array<long>")
    assert t.where(N.may_agree("a", "b", "n", "n", 80)).count() == 0


def test_short_variants_all_linked(spark):
    """Many texts of 4 and 5 shingles whose links the last step must confirm."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(12)]
    texts = []
    for _ in range(40):
        own = [f"{w}{rng.randrange(10 ** 6)}" for w in base]
        texts += [" ".join(own[at:at + k]) for at in range(4) for k in (6, 7, 8)]
    table = list(enumerate(texts))
    docs = spark.createDataFrame(table, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicates(docs, 3, 80, 42, 6).collect()}
    assert got == brute(table, 3, 80)


def test_repeated_ids_and_empty_table(spark):
    schema = "doc_id long, text string"
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (9, "A b c d e f"), (2, "other words are here now")]
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in N.near_duplicates(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(5, 5, True), (9, 5, False), (2, 2, True)}
    assert N.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 102)], "a long, b long")
    got = {r["node"]: r["comp"] for r in N.components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 102: 100}
