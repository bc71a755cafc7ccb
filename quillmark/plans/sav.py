"""SAV experiment with fitted methods over shrinking training samples.

Not a registered query: all methods and both sizes take more than 300 s at sf0.01 on
eight cores, most of it in the many short passes of the logistic fits.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import corpus as C
from ..operators import features as FE
from ..operators import pairs as J
from ..operators import reports as RP
from ..operators import sav
from ..operators import terms as TE
from ..operators import text_features as P
from ..session import keep
from ..sources.testbed import documents_corpus

SEED = 42
#: Dimensions of the random index, authors kept out of training, training documents per author.
DIMS = 128
OPEN_AUTHORS = 4
SIZES = (20, 10)
#: Evaluation pairs of a set at most (the report's own sample).
EVAL_PAIRS = 1000


def sav_fitted_log(spark, sf: str, log: DataFrame | None = None) -> DataFrame:
    """Log rows of every training size, mode and method that ``log`` does not hold yet
    (none, if it is complete).  Documents are random-indexed word TF-IDF vectors; the
    impostors method decides open pairs with the largest sample only."""
    sp = keep(C.open_set_split(C.stratified_split(documents_corpus(spark, sf)), OPEN_AUTHORS, SEED))
    n_authors, n_open = (sp.where(F.col("split") == s).agg(F.countDistinct("author")).first()[0] for s in ("train", "test_out"))
    grid = [("all", SEED, n_authors, size, f"{m}-{mode}") for size in SIZES for m in sav.METHODS for mode in ("close", "open")
            if m != "Impostors" or (mode == "open" and size == max(SIZES))]
    grid = spark.createDataFrame(grid, "dataset string, seed int, n_authors int, docs_by_author int, method string")
    if log is not None:
        grid = RP.pending_experiments(grid, log)
    wanted: dict[int, set[tuple[str, str]]] = {}
    for r in grid.collect():  # at most a row per size, method and mode
        name, mode = r["method"].rsplit("-", 1)
        wanted.setdefault(r["docs_by_author"], set()).add((name, mode))
    words = FE.tfidf(TE.words(sp), sp, "word", min_df=3)
    ri = FE.random_index_dictionary(FE.feature_index(words), DIMS, 2, 0)
    vectors = FE.dense_vectors(FE.random_indexing(words, ri), DIMS, docs=sp)
    vectors = keep(vectors.join(sp.select("doc_id", "author"), "doc_id").select("doc_id", "author", "vec"))
    samples = keep(C.nested_samples(sp.where("split = 'train'").select("doc_id", "author"), max(SIZES), SIZES[0] - SIZES[1], min(SIZES), SEED))
    pairs = {mode: J.verification_coordinates(sp.where(F.col("split") == s).select("doc_id", "author"), True, EVAL_PAIRS, SEED)
             .select(F.lit(mode).alias("mode"), "a", "b", "same") for mode, s in (("close", "test"), ("open", "test_out"))}
    pairs = keep(pairs["close"].unionByName(pairs["open"]))
    rows = spark.createDataFrame([], RP.SAV_LOG_SCHEMA)
    for size in sorted(wanted, reverse=True):
        train = samples.where(F.col("sample_size") == size).select("doc_id", "author")
        cells = spark.createDataFrame(sorted(wanted[size]), "method string, mode string")  # of this size, some ten rows
        d = sav.fitted_decisions(train, pairs, vectors, DIMS, [m for m in sav.METHODS if m in {x for x, _ in wanted[size]}])
        found = sav.metrics_by(d.join(F.broadcast(cells), ["method", "mode"]), ["method", "mode"])
        rows = rows.unionByName(found.select(
            F.lit("all").alias("dataset"), F.lit(SEED).alias("seed"), F.upper("mode").alias("mode"),
            F.lit(n_authors).cast("int").alias("n_authors"), F.lit(size).alias("docs_by_author"),
            F.when(F.col("mode") == "close", n_authors).otherwise(n_open).cast("int").alias("n_authors_te"),
            F.lit(-1).alias("docs_by_author_te"), F.concat_ws("-", "method", "mode").alias("method"),
            "acc", "p", "r", "f1", F.lit("").alias("notes")))
    return rows
