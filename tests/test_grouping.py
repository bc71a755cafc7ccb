"""The salted rank equals a plain row_number, also when groups span many buckets."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmark.functions.hashing import uniform
from quillmark.operators.grouping import hash_rank, int_rank


def test_hash_rank_matches_row_number_with_hot_group(spark):
    # one hot group holding most rows, dealt into as many buckets as a shuffle has tasks
    df = spark.range(0, 3000).select(F.col("id").alias("doc_id"),
                                     F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("author"))
    got = hash_rank(df, ["author"], 42, ["doc_id"], out="rk", count_col="n")
    w = Window.partitionBy("author").orderBy(uniform(42, "doc_id"), "doc_id")
    exp = df.withColumn("rk2", F.row_number().over(w)).withColumn("n2", F.count(F.lit(1)).over(Window.partitionBy("author")))
    j = got.join(exp, ["doc_id", "author"])
    assert j.count() == 3000
    assert j.where((F.col("rk") != F.col("rk2")) | (F.col("n") != F.col("n2"))).count() == 0


def test_int_rank_dense(spark, monkeypatch):
    from quillmark.operators import grouping
    monkeypatch.setattr(grouping, "ROWS_PER_BUCKET", 50)
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("d"), F.lit("c").alias("corpus_id"))
    r = int_rank(df, ["corpus_id"], "d", "rk")
    assert r.where(F.col("rk") != F.col("d") + 1).count() == 0


def test_global_index_range_buckets(spark):
    from quillmark.operators.grouping import global_index
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).cast("string").alias("k"))
    got = global_index(df, ["k"], "idx", rows_per_bucket=300)
    exp = df.withColumn("idx2", F.row_number().over(Window.orderBy("k")) - 1)
    j = got.join(exp, "k")
    assert j.count() == 5000 and j.where("idx != idx2").count() == 0
