"""Terms counted and weighted in blocks of documents."""
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillmark.operators import features as FE
from quillmark.operators import terms as TE
from quillmark.operators import text_features as P

ROWS = [(i, f"Tee  {'ab' * (i % 4)} <b{i % 7}> é{chr(20000 + i)}, tea\ttea.", "en", f"a{i % 3}", "test" if i % 4 == 0 else "train") for i in range(40)]
ROWS += [(3, "a second row", "en", "a2", "train"), (None, "no id at all", "en", "a0", "train"), (60, "", "en", "a0", "test"), (61, "x", "en", None, "train")]
KINDS = [(TE.char_ngrams, P.char_ngram_counts, "char", 1), (TE.words, P.word_unigram_counts, "word", 3),
         (TE.tag_ngrams, P.tag_ngram_counts, "post", 1), (TE.punctuation, P.punctuation_counts, "punct", 1)]


def corpus(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, author string, split string")


@pytest.mark.parametrize("limit", [TE.LIMIT, 1 << 20], ids=["numbered", "written out"])
@pytest.mark.parametrize("terms, counts, block, min_df", KINDS, ids=[k[2] for k in KINDS])
def test_blocks_give_what_a_table_of_counts_gives(spark, monkeypatch, terms, counts, block, min_df, limit):
    monkeypatch.setattr(TE, "LIMIT", limit)
    monkeypatch.setattr(TE, "BLOCK_CHARS", 150)
    monkeypatch.setattr(TE, "CHUNK", 60)
    c = corpus(spark)
    summary = counts(c).groupBy("feat").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))
    assert sorted(map(tuple, TE.counted(terms(c)).collect())) == sorted(map(tuple, summary.collect()))
    for use_idf, norm in ((True, "l2"), (False, "l1")):
        want = {(r[0], r["feat"]): r["val"] for r in FE.tfidf(counts(c), c, block, min_df, use_idf, norm).collect()}
        rows = FE.tfidf(terms(c), c, block, min_df, use_idf, norm).collect()
        assert {(r["doc_id"], r["feat"]): r["val"] for r in rows} == pytest.approx(want) and len(rows) == len(want)


def test_no_row_per_document_and_term_is_kept_or_shuffled(spark):
    c = corpus(spark)
    plan = FE.tfidf(TE.char_ngrams(c), c, "char")._jdf.queryExecution().toString()
    assert "InMemoryRelation" not in plan and "Exchange hashpartitioning(feat" not in plan


def test_class_sums_and_projection(spark, monkeypatch):
    monkeypatch.setattr(TE, "BLOCK_CHARS", 150)
    monkeypatch.setattr(TE, "CHUNK", 60)
    c = corpus(spark)
    f = TE.fit(TE.words(c), c, 1)
    rows = TE.weights(f).collect()
    labels = [(r[0], r[3]) for r in ROWS if r[4] == "train" and r[0] is not None and r[3]]
    want = Counter()
    for d, a in labels:
        for r in rows:
            if r["doc_id"] == d:
                want[a, r["feat"]] += r["val"]
    got = TE.weights(f, classes=True).groupBy("author", "feat").agg(F.sum("val").alias("v")).collect()
    assert {(r["author"], r["feat"]): r["v"] for r in got} == pytest.approx(dict(want))
    ri = FE.random_index_dictionary(FE.feature_index(TE.columns(f)), 16, 2, 0)
    one, other = ({(r["doc_id"], r["dim"]): r["val"] for r in FE.random_indexing(x, ri).collect()} for x in (f, TE.weights(f)))
    assert one.keys() == other.keys() and all(math.isclose(one[k], other[k], abs_tol=1e-12) for k in one)
