"""The pipeline's stages, each on its own input."""
import os
import tempfile

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size string, kept string"


def odd_docs(spark):
    text = "a b c d e f g h i j"
    rows = [(1, text, "en", "s"), (1, text, "en", "s"), (2, text + " k", "en", None), (None, text, None, "t"),
            (None, None, "en", "t"), (3, "", "en", "s"), (4, "word " * 60_000, "en", "s"), (5, "other words entirely here", "de", "u")]
    return spark.createDataFrame([(*r, 1, 0.5, "x", "y") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def folder(spark):
    d = tempfile.mkdtemp(prefix="pipe-")
    spark.read.parquet(f"{SF}/documents.parquet").write.parquet(f"{d}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{d}/labels.parquet")
    return d


@pytest.mark.parametrize("name,stage", P.STAGES)
def test_stage_on_odd_rows_and_empty(spark, folder, name, stage):
    docs = odd_docs(spark)
    for d in (docs, docs.limit(0)):
        out = stage(spark, d, folder)
        n = out.count()
        assert name == "packing" or out.columns == d.columns
        assert n <= 2 * d.count() or name == "packing"
        assert d is docs or n == 0


def test_run_and_decisions(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    kept = {}
    for name, stage in P.STAGES[:4]:
        before, docs = docs, P.save(stage(spark, docs, folder), name)
        kept[name] = docs
        if name != "mixing":
            assert docs.count() < before.count() and docs.select("doc_id").distinct().count() == docs.count()
    good = labels.where("toxic = 0 and quality = 1")
    assert kept["quality"].join(good, "doc_id").count() >= 0.99 * good.count()
    bad = labels.where("quality = 0")
    assert kept["quality"].join(bad, "doc_id").count() <= 0.05 * bad.count()
    copies = kept["mixing"].groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert copies == 2
    assert kept["mixing"].join(kept["near_duplicates"], "doc_id", "left_anti").count() == 0
    pieces = P.run(spark, folder)
    want = kept["mixing"].groupBy("doc_id").count()
    starts = pieces.where("start = 0").groupBy("doc_id").count()
    assert want.exceptAll(starts).count() == 0 and starts.exceptAll(want).count() == 0
    assert os.path.isdir(folder)
