"""Registered queries, second part: pairs, scoring, rules, metrics, impostors."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import corpus as C
from ..operators import impostors as I
from ..operators import metrics as G
from ..operators import pairs as J
from ..operators import rules as R
from ..operators import similarity as S
from ..sources.testbed import documents_corpus, embedding_vectors
from .queries import chain_pairs, q, round_doubles

SEED = 42


def _ls(spark, sf):
    return documents_corpus(spark, sf, "lang_source")


# ------------------------------------------------------------------ pairs

@q("pair_capacity")
def pair_capacity(spark, sf):
    return J.pair_capacity(_ls(spark, sf))


@q("pair_request")
def pair_request(spark, sf):
    return J.pair_request(J.pair_capacity(_ls(spark, sf)), 5000, -1, 3000)


@q("positive_pairs_round_robin")
def positive_pairs_round_robin(spark, sf):
    c = _ls(spark, sf)
    idx = J.indexed_docs(c, SEED)
    req = J.pair_request_per_doc(J.pair_capacity(c), "n_docs * 3 div 2", "0")
    return J.positive_pairs_round_robin(idx, req, SEED)


@q("positive_pairs_random")
def positive_pairs_random(spark, sf):
    c = _ls(spark, sf)
    idx = J.indexed_docs(c, SEED)
    req = J.pair_request_per_doc(J.pair_capacity(c), "n_docs * 3 div 2", "0")
    return J.positive_pairs_uniform(idx, req, SEED).select("corpus_id", "a", "b", "same", "rk")


@q("negative_pairs")
def negative_pairs(spark, sf):
    c = _ls(spark, sf)
    idx = J.indexed_docs(c, SEED)
    req = J.pair_request(J.pair_capacity(c), 0, 2000)
    return J.negative_pairs(idx, req, SEED).select("corpus_id", "a", "b", "same", "rk")


@q("verification_coordinates")
def verification_coordinates(spark, sf):
    sp = C.stratified_split(documents_corpus(spark, sf))
    return J.verification_coordinates(sp.where("split = 'test'"), True, 1000, SEED)


@q("multi_corpus_pairs")
def multi_corpus_pairs(spark, sf):
    """Pairs per language corpus, never across (author = source)."""
    return J.generate_pairs(documents_corpus(spark, sf), -1, -1, 300, "round_robin", SEED, part="lang")


@q("verification_pairs")
def verification_pairs(spark, sf):
    """Binary target quality (labels): positives inside class 1 only."""
    from ..session import read_table
    d = documents_corpus(spark, sf).drop("author").join(
        read_table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("author")), "doc_id")
    return J.generate_pairs(d, 500, 500, -1, "round_robin", SEED, verification_task=True)


# ------------------------------------------------------------------ blocked projection (J11) + kNN rules

def _emb_split(spark, sf):
    v = embedding_vectors(spark, sf)
    sp = C.stratified_split(v.select("doc_id", "author"))
    return v.join(sp.select("doc_id", "split"), "doc_id")


@q("pairwise_projection")
def pairwise_projection(spark, sf):
    e = _emb_split(spark, sf)
    te, tr = e.where("split = 'test'"), e.where("split = 'train'")
    return round_doubles(S.pairwise_projection(te.select("doc_id", "vec"), tr.select("doc_id", "vec", "author"),
                                               "cosine", block_rows=128))


@q("pairwise_symmetric")
def pairwise_symmetric(spark, sf):
    e = _emb_split(spark, sf).where("split = 'train'").select("doc_id", "vec", "author")
    return round_doubles(S.pairwise_projection(e, e, "l1", block_rows=128, symmetric=True))


def _knn_scores(spark, sf):
    e = _emb_split(spark, sf)
    te, tr = e.where("split = 'test'"), e.where("split = 'train'")
    return S.pairwise_projection(te.select("doc_id", "vec"), tr.select("doc_id", "vec", "author"), "cosine", block_rows=128,
                                 reduce=R.knn_block_reduce(5), reduce_schema=R.SCORE_SCHEMA), te


@q("knn_attribution")
def knn_attribution(spark, sf):
    s, _ = _knn_scores(spark, sf)
    return round_doubles(R.knn_attribution(s, 5))


@q("knn_tune_k")
def knn_tune_k(spark, sf):
    e = _emb_split(spark, sf).where("split = 'train'")
    return round_doubles(R.knn_tune_k(e.select("doc_id", "vec", "author"), "cosine"))


def _knn_predictions(spark, sf):
    s, te = _knn_scores(spark, sf)
    p = R.knn_attribution(s, 5)
    return p.join(te.select("doc_id", F.col("author").alias("truth")), "doc_id")


@q("metric_attribution")
def metric_attribution(spark, sf):
    return round_doubles(G.attribution_metrics(_knn_predictions(spark, sf)))


@q("metric_verification")
def metric_verification(spark, sf):
    return round_doubles(G.verification_metrics(_knn_predictions(spark, sf)))


def _emb_eval_pairs(spark, sf):
    """Evaluation pairs over the embedding test split: the chain pair list."""
    e = _emb_split(spark, sf).where("split = 'test'")
    pairs = chain_pairs(e.select("doc_id", "author"))
    a = e.select(F.col("doc_id").alias("a"), F.col("author").alias("aa"))
    b = e.select(F.col("doc_id").alias("b"), F.col("author").alias("ab"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", (F.col("aa") == F.col("ab")).cast("int").alias("same"))


@q("sav_via_attribution")
def sav_via_attribution(spark, sf):
    ev = _emb_eval_pairs(spark, sf)
    p = R.sav_via_attribution(ev, _knn_predictions(spark, sf).select("doc_id", "pred"))
    return round_doubles(G.sav_metrics(p))


@q("trivial_rejector")
def trivial_rejector(spark, sf):
    return round_doubles(R.trivial_rejector(_emb_eval_pairs(spark, sf)))


def _scored_eval(spark, sf):
    ev = _emb_eval_pairs(spark, sf)
    v = embedding_vectors(spark, sf)
    s = S.paired_score(ev, v, "cosine")
    return s.select("a", "b", "same", "score", (F.col("score") > 0.5).cast("int").alias("pred"))


@q("metric_sav")
def metric_sav(spark, sf):
    return round_doubles(G.sav_metrics(_scored_eval(spark, sf)))


@q("metric_pan_auc")
def metric_pan_auc(spark, sf):
    return round_doubles(G.pan_metrics(_scored_eval(spark, sf)))


@q("scores_by_truth")
def scores_by_truth(spark, sf):
    return round_doubles(_scored_eval(spark, sf).select("a", "b", "same", "score"))


@q("calibration_curve_uniform")
def calibration_curve_uniform(spark, sf):
    s = _scored_eval(spark, sf).select(F.col("same").alias("y"), ((F.col("score") + 1) / 2).alias("p"))
    return round_doubles(G.calibration_curve(s, n_bins=10, strategy="uniform").withColumn("bin", F.col("bin").cast("long")))


@q("calibration_curve_quantile")
def calibration_curve_quantile(spark, sf):
    s = _scored_eval(spark, sf).select(F.col("same").alias("y"), ((F.col("score") + 1) / 2).alias("p"))
    return round_doubles(G.calibration_curve(s, n_bins=5, strategy="quantile").withColumn("bin", F.col("bin").cast("long")))


# ------------------------------------------------------------------ impostors

def _abs_vectors(spark, sf):
    v = embedding_vectors(spark, sf)
    return v.withColumn("vec", F.transform("vec", F.abs))


@q("impostor_params")
def impostor_params(spark, sf):
    e = _emb_split(spark, sf).where("split = 'train'")
    return I.impostor_params(e, 50, 10)


@q("impostor_feature_subsets")
def impostor_feature_subsets(spark, sf):
    """I1 over the training vocabulary (word TF-IDF, min_df 3): k = 100 subsets of nF div 2 features."""
    from ..operators import features as FE
    from ..operators import text_features as P
    sp = C.stratified_split(documents_corpus(spark, sf))
    tr = sp.where("split = 'train'")
    n_feat = FE.tfidf_fit(P.word_unigram_counts(tr), tr.select("doc_id"), "word", 3).count()
    return I.feature_subsets(n_feat, 100, SEED, spark).withColumn("feat", F.col("feat").cast("long"))


@q("top_impostors")
def top_impostors(spark, sf):
    e = _emb_split(spark, sf)
    v = _abs_vectors(spark, sf)
    te = v.join(e.where("split = 'test'").select("doc_id"), "doc_id")
    tr = v.join(e.where("split = 'train'").select("doc_id"), "doc_id")
    return round_doubles(I.top_impostors(te.select("doc_id", "vec"), tr, 20, "minmax", block_rows=128)
                         .withColumn("imp_rank", F.col("imp_rank").cast("long")))


def _impostor_scores(spark, sf, sim="minmax"):
    e = _emb_split(spark, sf)
    v = _abs_vectors(spark, sf)
    te = v.join(e.where("split = 'test'").select("doc_id"), "doc_id")
    tr = v.join(e.where("split = 'train'").select("doc_id"), "doc_id")
    m, n, k = 20, 5, 30
    imps = I.top_impostors(te.select("doc_id", "vec"), tr, m, sim, block_rows=128)
    dim = 64
    subsets = I.feature_subsets(dim, k, SEED, spark)
    ev = _emb_eval_pairs(spark, sf)
    sc = I.impostor_scores_by_pair(ev.select("a", "b"), v, imps, subsets, m, n, k, dim, sim, SEED)
    return sc.join(ev, ["a", "b"])


@q("impostor_draws")
def impostor_draws(spark, sf):
    ev = _emb_eval_pairs(spark, sf)
    return I.impostor_draws(ev, 20, 5, 30, SEED).withColumn("iter", F.col("iter").cast("long")).withColumn("j", F.col("j").cast("long"))


@q("impostor_scores")
def impostor_scores(spark, sf):
    return round_doubles(_impostor_scores(spark, sf).select("a", "b", "same", "score_ab", "score_ba", "score"))


@q("threshold_search_f1")
def threshold_search_f1(spark, sf):
    s = _impostor_scores(spark, sf).select("a", "b", "same", "score")
    return round_doubles(I.threshold_search_f1(s).withColumn("pos", F.col("pos").cast("long")))


@q("impostors_fitted")
def impostors_fitted(spark, sf):
    """I6 + I7: sigma from the pairs of one half of the training authors, scored against the
    other half; it decides the test pairs (0.5 where no cut exists)."""
    tr = _emb_split(spark, sf).where("split = 'train'").select("doc_id", "author")
    sigma = I.fitted_sigma(tr, _abs_vectors(spark, sf), 64, 20, 5, 30, "minmax", 500, SEED, block_rows=128)
    return round_doubles(I.decide_by_sigma(_impostor_scores(spark, sf), sigma).select("a", "b", "same", "score", "sigma", "pred"))


@q("impostors_eval")
def impostors_eval(spark, sf):
    s = _impostor_scores(spark, sf)
    return round_doubles(G.sav_metrics(I.impostor_decision(s, 0.5)))


# ------------------------------------------------------------------ named entries of SURVEY §2

@q("positive_pairs")
def positive_pairs(spark, sf):
    """Every same-author pair (pos_request = -1), listed in round-robin order."""
    c = _ls(spark, sf)
    idx = J.indexed_docs(c, SEED)
    return J.positive_pairs_round_robin(idx, J.pair_request(J.pair_capacity(c), -1, 0), SEED, every=True)


@q("negative_pairs_large")
def negative_pairs_large(spark, sf):
    """A large request of negatives on the whole corpus (author = source)."""
    c = documents_corpus(spark, sf)
    idx = J.indexed_docs(c, SEED)
    req = J.pair_request_per_doc(J.pair_capacity(c), "0", "n_docs * 20")
    return J.negative_pairs(idx, req, SEED).select("corpus_id", "a", "b", "same", "rk")


@q("metric_accuracy")
def metric_accuracy(spark, sf):
    return round_doubles(G.accuracy(_knn_predictions(spark, sf)))


@q("metric_f1_macro")
def metric_f1_macro(spark, sf):
    return round_doubles(G.f1_macro(_knn_predictions(spark, sf)))


@q("metric_f1_micro")
def metric_f1_micro(spark, sf):
    return round_doubles(G.f1_micro(_knn_predictions(spark, sf)))


@q("impostor_decision")
def impostor_decision(spark, sf):
    """SAME iff the two-way impostor score is above sigma (0.5)."""
    s = _impostor_scores(spark, sf)
    return round_doubles(I.impostor_decision(s, 0.5).select("a", "b", "same", "score", "pred"))


@q("stacked_features")
def stacked_features(spark, sf):
    """M14 features: per training document its score vector against the training set
    (summarised as width, sum and first score, in reference-id order)."""
    e = _emb_split(spark, sf).where("split = 'train'").select("doc_id", "vec", "author")
    return round_doubles(R.stacked_rows(e, e, "cosine", summed=True))
