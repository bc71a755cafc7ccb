"""Pair draws: nothing as long as the corpus is broadcast, nothing as long as the pairs is shuffled."""
import pytest
from pyspark.sql import functions as F

from quillmark.operators import pairs as J


def _corpus(spark):
    return spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 40, F.concat(F.lit("g"), F.col("id") % 9))
                                   .otherwise(F.lit("big")).alias("author"))


def _joins(df, column):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Join" in line and column in line]


@pytest.mark.parametrize("pack", [7, 1024])
def test_every_pair_as_drawn_without_shuffling_pairs(spark, monkeypatch, pack):
    monkeypatch.setattr(J, "PACK", pack)
    c = _corpus(spark)
    idx, req = J.indexed_docs(c), J.pair_request(J.pair_capacity(c), -1, 0)
    every = J.positive_pairs_round_robin(idx, req, every=True)
    assert not _joins(every, "__pi")
    assert sorted(every.collect()) == sorted(J.positive_pairs_round_robin(idx, req).collect())


def test_every_pair_is_not_a_smaller_request(spark):
    c = _corpus(spark)
    with pytest.raises(Exception, match="the request is smaller"):
        J.positive_pairs_round_robin(J.indexed_docs(c), J.pair_request(J.pair_capacity(c), 100, 0), every=True).collect()


def test_documents_are_not_broadcast(spark):
    c = _corpus(spark)
    idx, req = J.indexed_docs(c), J.pair_request(J.pair_capacity(c), 100, 100)
    for d, at in ((J.positive_pairs_round_robin(idx, req), "__pi"), (J.negative_pairs(idx, req), "__px")):
        joins = _joins(d, at)
        assert joins and all("SortMergeJoin" in j for j in joins)
