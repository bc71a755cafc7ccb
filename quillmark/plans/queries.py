"""Registered queries: one callable (spark, sf_dir) -> DataFrame per inventory row.

Every query reads the driver tables (documents, embeddings, labels,
conversations, benchmark) in full.  Doubles are rounded to 6 digits so the
plain-SQL twins in ``oracle.py`` can be compared value by value.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus as C
from ..operators import features as FE
from ..operators import metrics as G
from ..operators import pairs as J
from ..operators import rules as R
from ..operators import similarity as S
from ..operators import terms as TE
from ..operators import text_features as P
from ..session import read_table
from ..sources.testbed import documents_corpus, embedding_vectors

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

D6 = 6


def q(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


def r6(c: str):
    return F.round(F.col(c), D6).alias(c)


def round_doubles(df: DataFrame) -> DataFrame:
    return df.select(*[r6(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields])


def _docs(spark, sf, author="source"):
    return documents_corpus(spark, sf, author)


def _split(spark, sf, author="source"):
    return C.stratified_split(_docs(spark, sf, author))


# ------------------------------------------------------------------ scans / joins

@q("label_attach_join")
def label_attach_join(spark, sf):
    d = _docs(spark, sf)
    lab = read_table(spark, sf, "labels")
    return C.attach_labels(d, lab, required=False).select("doc_id", "author", "quality", "toxic")


# ------------------------------------------------------------------ text

@q("token_count_filter")
def token_count_filter(spark, sf):
    d = P.token_count_filter(_docs(spark, sf), 15)
    from ..functions.text import token_count
    return d.select("doc_id", token_count("text").cast("long").alias("n_tokens"))


@q("clean_citations")
def clean_citations(spark, sf):
    return P.clean_citations(_docs(spark, sf)).select("doc_id", F.col("text").alias("clean_text"))


@q("style_tokens")
def style_tokens(spark, sf):
    return P.style_tokens(_docs(spark, sf)).withColumn("pos", F.col("pos").cast("long"))


@q("sentence_split")
def sentence_split(spark, sf):
    return P.sentence_split(_docs(spark, sf)).withColumn("pos", F.col("pos").cast("long"))


@q("function_word_freq")
def function_word_freq(spark, sf):
    return round_doubles(P.function_word_freq(_docs(spark, sf)))


@q("word_length_profile")
def word_length_profile(spark, sf):
    return round_doubles(P.word_length_profile(_docs(spark, sf)).withColumn("i", F.col("i").cast("long")))


@q("sentence_length_profile")
def sentence_length_profile(spark, sf):
    return round_doubles(P.sentence_length_profile(_docs(spark, sf)).withColumn("i", F.col("i").cast("long")))


@q("char_ngrams")
def char_ngrams(spark, sf):
    return TE.counted(TE.char_ngrams(_docs(spark, sf)))


@q("word_unigrams")
def word_unigrams(spark, sf):
    return P.word_unigram_counts(_docs(spark, sf)).select("doc_id", "feat", "tf")


@q("tag_ngrams")
def tag_ngrams(spark, sf):
    return TE.counted(TE.tag_ngrams(_docs(spark, sf)))


@q("punctuation_counts")
def punctuation_counts(spark, sf):
    return P.punctuation_counts(_docs(spark, sf)).select("doc_id", "feat", "tf")


# ------------------------------------------------------------------ corpus shaping

@q("stratified_split")
def stratified_split(spark, sf):
    return _split(spark, sf).select("doc_id", "author", "split")


@q("min_docs_filter")
def min_docs_filter(spark, sf):
    return C.min_docs_filter(_split(spark, sf, "lang_source"), 10).select("doc_id", "author", "split")


@q("author_min_count")
def author_min_count(spark, sf):
    return C.author_min_count(_docs(spark, sf, "lang_source"), 20).select("doc_id", "author")


@q("sample_docs_per_author")
def sample_docs_per_author(spark, sf):
    return C.sample_docs_per_author(_split(spark, sf, "lang_source"), 20).select("doc_id", "author", "split")


@q("sample_authors")
def sample_authors(spark, sf):
    return C.sample_authors(_docs(spark, sf, "lang_source"), 8, 2).select("doc_id", "author")


@q("open_set_split")
def open_set_split(spark, sf):
    return C.open_set_split(_split(spark, sf), 5).select("doc_id", "author", "split")


@q("label_reindex")
def label_reindex(spark, sf):
    return C.label_reindex(C.open_set_split(_split(spark, sf), 5)).select("doc_id", "author", "split", "label")


@q("label_drop")
def label_drop(spark, sf):
    return C.label_drop(_docs(spark, sf), ["src3", "src7", "src11"]).select("doc_id", "author")


@q("group_docs")
def group_docs(spark, sf):
    return C.group_docs(_docs(spark, sf, "lang_source"))


@q("sample_per_class")
def sample_per_class(spark, sf):
    return C.sample_per_class(_docs(spark, sf, "lang_source"), 7).select("doc_id", "author")


@q("nested_samples")
def nested_samples(spark, sf):
    return C.nested_samples(_docs(spark, sf), 30, 10, 5).select("sample_size", "doc_id", "author")


@q("experiment_grid")
def experiment_grid(spark, sf):
    ds = _docs(spark, sf).select(F.col("lang").alias("dataset")).distinct()
    return C.experiment_grid(ds, list(range(10)), [5, 10], [10, 20, 30], ["LR", "LRbin", "PairLRknn", "PairLRlinear"])


@q("author_counts")
def author_counts(spark, sf):
    return G.author_counts(_docs(spark, sf, "lang_source"))


# ------------------------------------------------------------------ features

def _train_split(spark, sf):
    return _split(spark, sf).select("doc_id", "author", "split", "text", "lang")


@q("tfidf_words")
def tfidf_words(spark, sf):
    sp = _train_split(spark, sf)
    return round_doubles(FE.tfidf(TE.words(sp), sp, "word", min_df=3)).select("doc_id", "feat", "val")


@q("tfidf_char")
def tfidf_char(spark, sf):
    sp = _train_split(spark, sf)
    t = FE.tfidf(TE.char_ngrams(sp), sp, "char")
    # one row per document: number of terms, their squared norm and weight sum
    return round_doubles(t.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_terms"), F.sum(F.col("val") * F.col("val")).alias("sq"), F.sum("val").alias("total")))


@q("tfidf_punct")
def tfidf_punct(spark, sf):
    sp = _train_split(spark, sf)
    return round_doubles(FE.tfidf(TE.punctuation(sp), sp, "punct")).select("doc_id", "feat", "val")


@q("tfidf_tags")
def tfidf_tags(spark, sf):
    sp = _train_split(spark, sf)
    return round_doubles(FE.tfidf(TE.tag_ngrams(sp), sp, "post")).select("doc_id", "feat", "val")


@q("rawfreq_words")
def rawfreq_words(spark, sf):
    sp = _train_split(spark, sf)
    return round_doubles(FE.rawfreq(TE.words(sp), sp, "word", min_df=3)).select("doc_id", "feat", "val")


@q("vocab_min_df")
def vocab_min_df(spark, sf):
    sp = _train_split(spark, sf)
    tr = sp.where("split = 'train'")
    return round_doubles(FE.tfidf_fit(P.word_unigram_counts(tr), tr.select("doc_id"), "word", 3)).select("feat", "df", "idf")


@q("chi2_topk")
def chi2_topk(spark, sf):
    sp = _train_split(spark, sf)
    tr = sp.where("split = 'train'")
    feats = FE.tfidf(TE.words(sp), sp, "word", min_df=3).join(tr.select("doc_id"), "doc_id", "left_semi")
    return round_doubles(FE.chi2_topk(feats, tr.select("doc_id", "author"), 500))


@q("standardize_train_apply")
def standardize_train_apply(spark, sf):
    sp = _train_split(spark, sf)
    dense = P.word_length_profile(sp).select("doc_id", F.col("i").cast("string").alias("feat"), "val")
    tr = dense.join(sp.where("split = 'train'").select("doc_id"), "doc_id", "left_semi")
    return round_doubles(FE.standardize_apply(dense, FE.standardize_fit(tr)))


@q("zscores")
def zscores(spark, sf):
    sp = _docs(spark, sf)
    dense = P.word_length_profile(sp).select("doc_id", F.col("i").cast("string").alias("feat"), "val")
    return round_doubles(FE.zscores(dense))


@q("feature_matrix")
def feature_matrix(spark, sf):
    sp = _train_split(spark, sf)
    punct, words = TE.fit(TE.punctuation(sp), sp), TE.fit(TE.words(sp), sp, min_df=3)
    wl = P.word_length_profile(sp).select("doc_id", F.lit("wl").alias("block"), F.lpad(F.col("i").cast("string"), 2, "0").alias("feat"), "val")
    return round_doubles(FE.indexed_matrix([punct, words], wl, wl.select("block", "feat").distinct()))


@q("feature_extractor")
def feature_extractor(spark, sf):
    """F4 + F5: seven blocks, one chi2 selection of 50,000 columns over all sparse ones;
    per (document, block) the number of cells, sums of values, squares and column numbers."""
    from ..operators.extractor import extract
    features, _ = extract(_train_split(spark, sf))
    return round_doubles(features.groupBy("doc_id", "block").agg(
        F.count(F.lit(1)).alias("n"), F.sum("val").alias("total"), F.sum(F.col("val") * F.col("val")).alias("squares"),
        F.sum("idx").cast("long").alias("columns")))


@q("random_indexing")
def random_indexing(spark, sf):
    sp = _train_split(spark, sf)
    words = TE.fit(TE.words(sp), sp, min_df=3)
    idx = FE.feature_index(TE.columns(words))
    ri = FE.random_index_dictionary(idx, 64, 2, 0)
    return round_doubles(FE.random_indexing(words, ri))


# ------------------------------------------------------------------ vector math (P12-P15) on embeddings

def chain_pairs(df: DataFrame) -> DataFrame:
    """A pair list over a whole table: every row with the next row of its author
    in the seeded order (same-author pairs, an equi-join on (author, pos + 1))
    and with the row whose id is one higher (mostly different authors)."""
    idx = C.group_docs(df.select("doc_id", "author")).select("author", "doc_id", "pos")
    nxt = idx.select("author", F.col("doc_id").alias("b"), (F.col("pos") - 1).alias("pos"))
    same = idx.join(nxt, ["author", "pos"]).select(F.col("doc_id").alias("a"), "b")
    ids = df.select("doc_id")
    by_id = ids.join(ids.select((F.col("doc_id") - 1).alias("doc_id"), F.col("doc_id").alias("b")), "doc_id") \
        .select(F.col("doc_id").alias("a"), "b")
    u = same.unionByName(by_id)
    return u.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _chain_pairs(spark, sf) -> DataFrame:
    return chain_pairs(embedding_vectors(spark, sf))


def _pair_metric(spark, sf, metric: str, absval: bool = False) -> DataFrame:
    v = embedding_vectors(spark, sf)
    if absval:
        v = v.withColumn("vec", F.transform("vec", F.abs))
    s = S.paired_score(_chain_pairs(spark, sf), v, metric)
    return round_doubles(s.select("a", "b", "score"))


@q("paired_distance_l1")
def paired_distance_l1(spark, sf):
    return _pair_metric(spark, sf, "l1")


@q("paired_distance_l2")
def paired_distance_l2(spark, sf):
    return _pair_metric(spark, sf, "l2")


@q("paired_distance_cosine")
def paired_distance_cosine(spark, sf):
    return _pair_metric(spark, sf, "cosine_distance")


@q("cosine_similarity")
def cosine_similarity(spark, sf):
    return _pair_metric(spark, sf, "cosine")


@q("minmax_similarity")
def minmax_similarity(spark, sf):
    return _pair_metric(spark, sf, "minmax", absval=True)


@q("diff_vectors")
def diff_vectors(spark, sf):
    v = embedding_vectors(spark, sf)
    pv = S.pair_vectors(_chain_pairs(spark, sf), v)
    d = pv.select("a", "b", F.posexplode(S.diff_vector("va", "vb")).alias("dim", "val"))
    return round_doubles(d.withColumn("dim", F.col("dim").cast("long")))


@q("diff_vectors_sparse")
def diff_vectors_sparse(spark, sf):
    sp = _train_split(spark, sf)
    feats = FE.tfidf(TE.punctuation(sp), sp, "punct")
    pairs = chain_pairs(sp.where("split = 'test'"))
    return round_doubles(S.sparse_diff(pairs, feats))
