"""Hand-made fixtures for rules that once were wrong, and errors that must be raised."""
import os
import subprocess
import sys
import tempfile

import pytest
from pyspark.sql import functions as F

from quillmark.functions import text as X
from quillmark.operators import corpus as C
from quillmark.operators import pairs as J
from quillmark.operators import reports as RP
from quillmark.operators import text_features as P
from quillmark.sources import corpora as K

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_renames_chain_all_rules(spark):
    d = spark.createDataFrame([("Dist-cos-close",), ("Impostors-open",), ("LR-close",), ("Dist-l1-close",)], "method string")
    assert [r["method"] for r in RP.rename_methods(d).collect()] == ["STD-CosDist", "Impostors", "STD-2xAA", "Dist-l1"]
    own = RP.rename_methods(d, renames=[("Dist", "D"), ("D-l1", "X")])
    assert [r["method"] for r in own.collect()][3] == "X-close"


def test_excluded_log_is_not_read(spark):
    base = tempfile.mkdtemp(prefix="logs-")
    schema = RP.SAV_LOG_SCHEMA
    for name in ("a_log", "a_log_timings"):
        row = ("d", 0, "CLOSE", 1, 1, 1, 1, name, 1.0, 1.0, 1.0, 1.0, "")
        RP.append_log(spark.createDataFrame([row], schema), f"{base}/{name}")
    paths = [f"{base}/a_log", f"{base}/a_log_timings"]
    assert {r["method"] for r in RP.read_logs(spark, paths, exclude_suffix="_timings").collect()} == {"a_log"}
    assert RP.read_logs(spark, paths[1:], exclude_suffix="_timings").count() == 0


def test_plain_author_folders(spark):
    base = tempfile.mkdtemp(prefix="unknown-")  # the base's own name does not matter
    for author, name, text in (("Jane Doe", "1.txt", "one"), ("J+ü%", "2.txt", "two\nlines"), ("unknown author", "3.txt", "x"),
                               ("Jane Doe", "truth.txt", "x"), ("Jane Doe", "essay.txt", "three")):
        os.makedirs(f"{base}/{author}", exist_ok=True)
        with open(f"{base}/{author}/{name}", "w") as f:
            f.write(text + "\n")
    got = {(r["author"], r["doc_id"], r["text"]) for r in K.read_dir_corpus(spark, base).collect()}
    assert got == {("Jane Doe", 1, "one"), ("J+ü%", 2, "two\nlines"), ("Jane Doe", None, "three")}
    assert K.read_dir_corpus(spark, "file://" + base).count() == 3


def corpus(spark):
    rows = [(i, f"a{i % 3}", "train" if i % 4 else "test") for i in range(30)]
    return spark.createDataFrame(rows, "doc_id long, author string, split string")


def test_errors_are_raised(spark):
    c = corpus(spark)
    with pytest.raises(Exception, match="no author has 100"):
        C.min_docs_filter(c, 100).collect()
    assert C.min_docs_filter(c, 7).select("author").distinct().count() == 3
    with pytest.raises(Exception, match="fewer than 4 authors"):
        C.sample_authors(c, 3, 1).collect()
    assert C.sample_authors(c, 2, 1).count() == 30
    with pytest.raises(Exception, match="must be 0 or 1"):
        J.generate_pairs(c, 1, 1, verification_task=True).collect()


def test_labels_keep_every_document(spark):
    c = corpus(spark)
    labels = c.where("doc_id < 20").select("doc_id", F.lit(1).alias("y"))
    with pytest.raises(Exception, match="no label for document"):
        C.attach_labels(c, labels).collect()
    assert C.attach_labels(c, labels, required=False).where("y is null").count() == 10
    assert C.attach_labels(c.where("doc_id < 20"), labels).count() == 20


def test_every_language_keeps_its_documents(spark):
    d = spark.createDataFrame([(1, "the casa and", "it"), (2, "the", None), (3, "der Hund", "de")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["n"] for r in P.function_word_freq(d).groupBy("doc_id").count().withColumnRenamed("count", "n").collect()}
    assert got == {1: len(X.ENGLISH_FUNCTION_WORDS), 2: len(X.ENGLISH_FUNCTION_WORDS), 3: len(X.GERMAN_FUNCTION_WORDS)}


def test_report_pivot_is_a_pivot(spark):
    log = spark.createDataFrame([("m", "d1", 50.0), ("m", "d1", 100.0), ("n", "d2", 20.0)], "method string, dataset string, acc double")
    got = {r["method"]: r for r in RP.report_pivot(log, names=["d1", "d2"], percent_to_fraction=True).collect()}
    assert got["m"]["d1_mean"] == 0.75 and got["m"]["d1_n"] == 2 and got["m"]["d2_mean"] is None and got["n"]["d2_mean"] == 0.2


PROBE = """
import glob, sys
glob.glob = lambda *a, **k: []
sys.path.insert(0, {repo!r})
import __spark_entry__ as e
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
assert len(e.queries()) > 100 and len(e.oracle_sql()) > 100
print("rows", e.queries()["knn_attribution"](spark, "/root/testdata/sf0.001").count())
"""


def test_loads_and_runs_from_another_folder():
    folder = tempfile.mkdtemp(prefix="elsewhere-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", PROBE.format(repo=REPO)], cwd=folder, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 150" in out.stdout, out.stderr[-2000:]
