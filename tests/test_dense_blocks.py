"""Dense blocks and the feature matrix: texts are cut once, columns numbered by the vocabularies."""
import re

import pytest
from pyspark.sql import functions as F

from quillmark.operators import extractor as E
from quillmark.operators import features as FE
from quillmark.operators import terms as TE
from quillmark.operators import text_features as P

TEXTS = ["The cat sat. The cat, the dog and a bird!", "", "One; two: three-four? Extraordinarily-long antidisestablishmentarianism.",
         "the the the", "word " * 80 + ". " + "and " * 3, "12 34 !!!"]


@pytest.fixture
def corpus(spark):
    rows = [(i, t, "en" if i else None, str(i % 2), "train" if i < 4 else "test") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, author string, split string")


def _tokens(text):
    return [t for t in re.findall(r"[^\W_]+(?:'[^\W_]*)*", text.lower()) if any(c.isalpha() for c in t)]


def test_shares_by_brute_force(corpus):
    lens = {i: [len(t) for t in _tokens(text)] for i, text in enumerate(TEXTS)}
    got = {(r["doc_id"], r["i"]): r["val"] for r in P.word_length_profile(corpus).collect()}
    assert got == {(d, i): sum(x >= i for x in v) / max(1, len(v)) for d, v in lens.items() for i in range(1, 23)}
    lens = {i: [len(_tokens(s)) for s in re.split(r"[.!?]+(?:\s+|$)", text) if s.strip()] for i, text in enumerate(TEXTS)}
    got = {(r["doc_id"], r["i"]): r["val"] for r in P.sentence_length_profile(corpus).collect()}
    assert got == {(d, i): sum(x >= i for x in v) / max(1, len(v)) for d, v in lens.items() for i in range(3, 70)}


def test_function_words_by_brute_force(corpus):
    for r in P.function_word_freq(corpus).collect():
        own = _tokens(TEXTS[r["doc_id"]])
        assert r["val"] == own.count(r["feat"].split(":")[2]) / max(1, len(own))


def test_dense_texts_are_cut_once(corpus):
    features, columns = E.extract(corpus, E.Toggles(tag_ngrams=False, punctuation=False, word_ngrams=False, char_ngrams=False))
    plan = features._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan  # statistics, names and values each cut the texts into tokens before
    assert columns.count() == features.where("doc_id = 0").count()


def test_matrix_equals_the_join_by_names(corpus):
    fits = [TE.fit(TE.punctuation(corpus), corpus), TE.fit(TE.words(corpus), corpus, 2)]
    wl = P.word_length_profile(corpus).select("doc_id", F.lit("wl").alias("block"), F.lpad(F.col("i").cast("string"), 2, "0").alias("feat"), "val")
    got = FE.indexed_matrix(fits, wl, wl.select("block", "feat").distinct())
    blocks = FE.assemble_blocks([*(TE.weights(f) for f in fits), wl])
    want = blocks.join(FE.feature_index(blocks), ["block", "feat"]).select("doc_id", "idx", "val")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.count() > 6 * 22
    # a term went with every cell before
    assert "feat" not in {c for f in fits for c in TE.weights(f, index=FE.feature_index(TE.columns(f))).columns}
