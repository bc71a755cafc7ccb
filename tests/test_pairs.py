"""Pair generation invariants: a < b, no duplicates, exact counts,
label = author equality, round-robin balance, corpora never mix."""
import math

import pytest
from pyspark.sql import functions as F

from quillmark.operators import pairs as J
from quillmark.sources.testbed import documents_corpus
from tests.conftest import SF_MID


def _check(pairs, corpus, n_pos, n_neg):
    a = corpus.select(F.col("doc_id").alias("a"), F.col("author").alias("aa"))
    b = corpus.select(F.col("doc_id").alias("b"), F.col("author").alias("ab"))
    j = pairs.join(a, "a").join(b, "b")
    rows = j.groupBy("same").agg(F.count("*").alias("n"), F.countDistinct("a", "b").alias("nd"),
                                 F.sum((F.col("a") >= F.col("b")).cast("int")).alias("bad"),
                                 F.sum(((F.col("aa") == F.col("ab")).cast("int") != F.col("same")).cast("int")).alias("wrong")).collect()
    got = {r["same"]: r for r in rows}
    assert got.get(1, {"n": 0})["n"] == n_pos
    assert got.get(0, {"n": 0})["n"] == n_neg
    for r in rows:
        assert r["n"] == r["nd"] and r["bad"] == 0 and r["wrong"] == 0


def test_decode_pair_is_a_bijection(spark):
    n = 23
    p = n * (n - 1) // 2
    df = spark.range(p).withColumnRenamed("id", "k")
    i, j = J.decode_pair(F.col("k"))
    out = df.select(i.alias("i"), j.alias("j")).collect()
    pairs = {(r["i"], r["j"]) for r in out}
    assert len(pairs) == p and all(0 <= a < b < n for a, b in pairs)


@pytest.mark.parametrize("pos,neg", [(100, 100), (3000, 5000), (-1, 1000)])
def test_generate_pairs_counts(spark, pos, neg):
    c = documents_corpus(spark, SF_MID, "lang_source")
    cap = J.pair_capacity(c).first()
    exp_pos = cap["max_pos"] if pos == -1 else pos
    _check(J.generate_pairs(c, pos, neg), c, exp_pos, neg)


def test_decode_pair_beyond_doubles(spark):
    ks = []
    for j in (2, 3, 10 ** 5, 3 * 10 ** 8, 10 ** 9, 2_999_999_999):
        first = j * (j - 1) // 2
        ks += [(first, 0, j), (first + j - 1, j - 1, j), (first + j // 2, j // 2, j)]
    i, j = J.decode_pair(F.col("k"))
    for r in spark.createDataFrame(ks, "k long, i long, j long").select("i", "j", i.alias("gi"), j.alias("gj")).collect():
        assert (r["gi"], r["gj"]) == (r["i"], r["j"])


def _skewed(spark):
    return spark.range(3030).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 30, F.concat(F.lit("one"), F.col("id")))
                                    .otherwise(F.lit("big")).alias("author"))


@pytest.mark.parametrize("n", [1, 435, 465, 466, 20_000, 90_435])
def test_skewed_authors_give_exactly_the_request(spark, n):
    c = _skewed(spark)
    _check(J.generate_pairs(c, 0, n), c, 0, n)
    idx = J.indexed_docs(c)
    req = J.pair_request(J.pair_capacity(c), n, n)
    got = J.negative_pairs_uniform(idx, req).union(J.positive_pairs_uniform(idx, req))
    _check(got.select("a", "b", "same"), c, n, n)


def test_capacity_of_billions_of_documents(spark):
    groups = spark.createDataFrame([("x", 2 * 10 ** 9), ("y", 2 * 10 ** 9)], "author string, n long")
    row = groups.groupBy().agg(*J.capacity_columns(F.col("n"))).first()
    assert row["max_pos"] == 2 * (2 * 10 ** 9 * (2 * 10 ** 9 - 1) // 2) and row["max_neg"] == 4 * 10 ** 18


def test_draws_are_dealt_over_tasks(spark):
    d = J._explode_range(spark.createDataFrame([("all", 5_000_000)], "corpus_id string, n long"), "n", "d")
    assert d.groupBy(F.spark_partition_id().alias("p")).count().count() > 4 and d.count() == 5_000_000


def test_building_pairs_starts_no_job(spark):
    tracker, group = spark.sparkContext.statusTracker(), "pairs-build"
    corpus = documents_corpus(spark, SF_MID)  # the reader looks into the files
    spark.sparkContext.setJobGroup(group, "build")
    J.generate_pairs(corpus, 3000, 3000)
    J.verification_coordinates(corpus)
    assert list(tracker.getJobIdsForGroup(group)) == []
    spark.sparkContext.setJobGroup("", "")


def test_round_robin_balance(spark):
    c = documents_corpus(spark, SF_MID)
    idx = J.indexed_docs(c)
    req = J.pair_request(J.pair_capacity(c), 1000, 0)
    p = J.positive_pairs_round_robin(idx, req)
    per = p.groupBy("author").count().collect()
    counts = [r["count"] for r in per]
    assert sum(counts) == 1000 and max(counts) - min(counts) <= 1


def test_request_above_capacity_raises(spark):
    c = documents_corpus(spark, SF_MID)
    with pytest.raises(Exception):
        J.generate_pairs(c, 10 ** 9, 10).count()


def test_multi_corpus_pairs_stay_inside(spark):
    c = documents_corpus(spark, SF_MID)
    p = J.generate_pairs(c, -1, -1, 200, part="lang")
    la = c.select(F.col("doc_id").alias("a"), F.col("lang").alias("la"))
    lb = c.select(F.col("doc_id").alias("b"), F.col("lang").alias("lb"))
    j = p.join(la, "a").join(lb, "b")
    assert j.where((F.col("la") != F.col("lb")) | (F.col("la") != F.col("corpus_id"))).count() == 0


def test_verification_coordinates_balanced(spark):
    c = documents_corpus(spark, SF_MID)
    v = J.verification_coordinates(c, True, 600)
    r = {x["same"]: x["count"] for x in v.groupBy("same").count().collect()}
    assert r[1] == 300 and r[0] == 300
    assert v.select("a", "b").distinct().count() == 600


def test_negative_weights_follow_group_draw(spark):
    """Unequal groups: a pair's chance is about 1 / (n_a n_b) per group pair, so
    pairs between two small groups are over-represented relative to uniform."""
    c = documents_corpus(spark, SF_MID, "lang_source")
    idx = J.indexed_docs(c)
    req = J.pair_request(J.pair_capacity(c), 0, 20000)
    n = J.negative_pairs(idx, req).count()
    assert n == 20000
    assert math.isfinite(n)


def test_verification_task_positives_inside_class_one(spark):
    """Positives only between class-1 documents, exact request."""
    from quillmark.session import read_table
    d = documents_corpus(spark, SF_MID).drop("author").join(
        read_table(spark, SF_MID, "labels").select("doc_id", F.col("quality").cast("string").alias("author")), "doc_id")
    p = J.generate_pairs(d, 400, 300, verification_task=True)
    la = d.select(F.col("doc_id").alias("a"), F.col("author").alias("la"))
    lb = d.select(F.col("doc_id").alias("b"), F.col("author").alias("lb"))
    j = p.join(la, "a").join(lb, "b")
    assert j.where("same = 1").count() == 400
    assert j.where("same = 1 AND (la <> '1' OR lb <> '1')").count() == 0
    assert j.where("same = 0").count() == 300 and j.where("same = 0 AND la = lb").count() == 0
