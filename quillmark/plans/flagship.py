"""The flagship plan, also ``entry(spark)``."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus as C
from ..operators import features as FE
from ..operators import metrics as G
from ..operators import pairs as J
from ..operators import similarity as S
from ..operators import terms as TE
from ..sources.testbed import documents_corpus
from .queries import q, round_doubles

THRESHOLD = 0.5


def cosine_sav(spark: SparkSession, sf_dir: str, subsample: int = 1000, threshold: float = THRESHOLD):
    """Scored evaluation pairs (a, b, same, score, pred)."""
    sp = C.stratified_split(documents_corpus(spark, sf_dir))
    feats = FE.tfidf(TE.words(sp), sp, "word", min_df=3)
    test = sp.where(F.col("split") == "test")
    pairs = J.verification_coordinates(test, balanced=True, subsample=subsample)
    scored = pairs.join(S.sparse_cosine(pairs.select("a", "b"), feats), ["a", "b"])
    return scored.select("a", "b", "same", F.col("cosine").alias("score"),
                         (F.col("cosine") > threshold).cast("int").alias("pred"))


@q("sav_cosine_flagship")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(G.sav_metrics(cosine_sav(spark, sf_dir)))
