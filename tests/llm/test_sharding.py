"""Uniform sharding: exact sizes, whole rows, law of the matrix."""
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.llm import sharding as S


@pytest.mark.parametrize("n,shards,bucket_rows,group", [(0, 16, 10, 4), (5, 16, 10, 4), (1000, 16, 7, 2), (1001, 3, 1 << 18, 1024)])
def test_exact_sizes_and_whole_rows(spark, n, shards, bucket_rows, group):
    docs = spark.range(n, numPartitions=5).select(
        F.when(F.col("id") % 7 != 0, F.col("id")).alias("doc_id"), F.lit("same").alias("text"), F.lit(1).alias("slot"), F.col("id").alias("k"))
    out = S.shuffle_shards(docs, shards, bucket_rows=bucket_rows, group=group)
    got = out.collect()
    assert sorted(r["k"] for r in got) == list(range(n)) and all(r["doc_id"] == (r["k"] if r["k"] % 7 else None) for r in got)
    sizes = Counter(r["shard"] for r in got)
    assert all(sizes[s] in (n // shards, -(-n // shards)) for s in range(shards))
    for s in range(shards):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    again = {(r["k"], r["shard"], r["slot"]) for r in S.shuffle_shards(docs, shards, bucket_rows=bucket_rows, group=group).collect()}
    assert again == {(r["k"], r["shard"], r["slot"]) for r in got}


def test_every_order_is_as_likely(spark):
    """Five rows in three partitions and two shards: chi-square over (shard, slot) of each row."""
    docs = spark.range(5, numPartitions=3).withColumnRenamed("id", "k")
    seen, runs = Counter(), 60
    for seed in range(runs):
        for r in S.shuffle_shards(docs, 5, seed=seed).collect():
            seen[r["k"], r["shard"]] += 1
    chi = sum((seen[k, s] - runs / 5) ** 2 / (runs / 5) for k in range(5) for s in range(5))
    assert chi < 45  # 16 degrees of freedom: 1e-4


def test_matrix_margins_and_law():
    rng = np.random.default_rng(1)
    for _ in range(50):
        rows = rng.integers(0, 30, 6).tolist()
        sizes = S.shard_sizes(sum(rows), 4, 2)
        m = np.array(S.draw_matrix(rows, sizes, rng))
        assert m.sum(axis=1).tolist() == rows and m.sum(axis=0).tolist() == sizes and (m >= 0).all()


def test_hypergeometric_beyond_numpy(monkeypatch):
    rng = np.random.default_rng(5)
    big = np.array([S.hypergeometric(3 * 10 ** 10, 10 ** 10, 10 ** 6, rng) for _ in range(400)])
    assert abs(big.mean() - 750_000) < 5 * np.sqrt(187_500 / 400) and 0.8 < big.std() / np.sqrt(187_500) < 1.2
    assert S.hypergeometric(2 * 10 ** 9, 0, 7, rng) == 7 and S.hypergeometric(0, 2 * 10 ** 9, 7, rng) == 0
    monkeypatch.setattr(S, "SMALL", 0)
    small = Counter(S.hypergeometric(3, 2, 2, rng) for _ in range(4000))
    assert abs(small[0] / 4000 - 0.1) < 0.03 and abs(small[1] / 4000 - 0.6) < 0.04 and abs(small[2] / 4000 - 0.3) < 0.04


def test_query_and_files(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    got = S.op13_sharding(spark, sf).collect()
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in got} == {
        (i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in docs.items()}
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}
    placed = S.shuffle_shards(spark.read.parquet(f"{sf}/documents.parquet"), 4)
    S.write_shards(placed, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert {(r["doc_id"], r["text"], r["shard"], r["slot"]) for r in back.collect()} == {
        (r["doc_id"], r["text"], r["shard"], r["slot"]) for r in placed.collect()}


def test_nulls(spark):
    rows = [(None, None, "a"), (None, None, "a"), (1, "", None), (1, "x" * 500_000, "b")]
    out = S.shuffle_shards(spark.createDataFrame(rows, "doc_id long, text string, shard string"), 2).collect()
    assert sorted(Counter(r["shard"] for r in out).items()) == [(0, 2), (1, 2)]
