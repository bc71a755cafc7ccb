"""Mixing: water filling, flow and selection."""
import itertools

import pytest
from pyspark.sql import functions as F

from quillmark.llm import mixing as M


def test_water_fill_reshares_the_excess():
    t = M.water_fill([10, 100, 1000], [5, 2, 1], 1.5 * 1110, 2)
    assert t[0] == 20 and t[1] == 200 and t[2] == pytest.approx(1665 - 220)
    assert M.water_fill([0, 0], [5, 2], 0, 2) == [0, 0] and M.water_fill([], [], 0, 2) == []


def test_flow_is_cheapest():
    patterns = [(5, (0,)), (4, (0, 1)), (3, (1,))]
    for quotas in itertools.product(range(0, 18, 3), repeat=2):
        flow = M.min_cost_flow(list(quotas), patterns, [1, 3])
        assert all(sum(f for (p, _), f in flow.items() if p == i) <= 2 * w for i, (w, _) in enumerate(patterns))
        got = sum(flow.values())
        cost = sum(x + 2 * max(0, x - w) for i, (w, _) in enumerate(patterns)
                   for x in [sum(f for (p, _), f in flow.items() if p == i)])
        best = None
        for a in range(0, 11):  # words of source 0 from pattern 0, the rest from 1; likewise source 1
            for b in range(0, 9):
                for c in range(0, 9 - b):
                    for d in range(0, 7):
                        if a + b <= quotas[0] and c + d <= quotas[1]:
                            x = [a, b + c, d]
                            value = (-(a + b + c + d), sum(v + 2 * max(0, v - w) for v, (w, _) in zip(x, patterns)))
                            best = value if best is None else min(best, value)
        assert (-got, cost) == best


def test_overlapping_sources_are_mixed_to_targets(spark):
    rows = [(i, ["a"] if i % 3 == 0 else ["b", "a"] if i % 3 == 1 else [None], 10 + i % 7, "kept") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, sources array<string>, size long, extra string")
    out, sizes, targets = M.mix(docs, lambda s: {"a": 900.0, "b": 1700.0, None: 100.0})
    got = out.collect()
    assert len(got) == 300 and all(0 <= r["taken"] <= 2 * r["size"] for r in got) and got[0]["extra"] == "kept"
    assert sum(r["taken"] for r in got if r["sources"] == [None]) == 100
    assert sum(r["taken"] for r in got) == 2700
    again = M.mix(docs.repartition(7), lambda s: targets)[0]
    assert {(r["doc_id"], r["taken"]) for r in got} == {(r["doc_id"], r["taken"]) for r in again.collect()}


def test_running_total_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(M, "BUCKET_ROWS", 16)
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.array(F.lit("s")).alias("sources"), F.lit(3).cast("long").alias("size"))
    got = M.mix(docs, lambda s: {"s": 700.0})[0].collect()
    assert sum(r["taken"] for r in got) == 700 and sorted({r["taken"] for r in got}) == [0, 1, 3]


def test_words_nulls_and_empty(spark):
    d = spark.createDataFrame([(1, "a\tb\x0bc d e"), (2, None), (3, " \n")], "doc_id long, text string")
    assert [r["n"] for r in d.select(M.word_count("text").alias("n")).collect()] == [4, 0, 0]
    empty = spark.createDataFrame([], "doc_id long, sources array<string>, size long")
    assert M.mix(empty, M.by_weight)[0].count() == 0
