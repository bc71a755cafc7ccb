"""Blocked projection: complete (every x meets every reference row) and equal to
the row-wise pair functions, with many blocks and many shuffle partitions."""
import numpy as np
from pyspark.sql import functions as F

from quillmark.operators import similarity as S
from quillmark.sources.testbed import embedding_vectors
from tests.conftest import SF_MID


def test_projection_complete_and_exact(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        v = embedding_vectors(spark, SF_MID)
        x = v.where(F.col("doc_id") < 120).select("doc_id", "vec")
        r = v.where(F.col("doc_id") >= 120)
        s = S.pairwise_projection(x, r, "cosine", block_rows=16)
        assert s.count() == x.count() * r.count()
        pairs = s.select(F.col("x_id").alias("a"), F.col("ref_id").alias("b"), "p")
        chk = S.paired_score(pairs, v, "cosine").where(F.abs(F.col("score") - F.col("p")) > 1e-9)
        assert chk.count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_symmetric_projection(spark):
    v = embedding_vectors(spark, SF_MID).where(F.col("doc_id") < 90)
    s = S.pairwise_projection(v, v, "l1", block_rows=16, symmetric=True).toPandas()
    assert len(s) == 90 * 90
    m = s.pivot(index="x_id", columns="ref_id", values="p").to_numpy()
    assert np.allclose(m, m.T) and np.allclose(np.diag(m), 0)
