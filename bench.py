"""Benchmark: headline workloads at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line {"metric", "value", "unit", "queries", "sf"}.  Each
query is executed in full through the ``noop`` sink (no driver collect).
"""
from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from quillmark.operators import corpus as C  # noqa: E402
from quillmark.operators import features as FE  # noqa: E402
from quillmark.operators import impostors as I  # noqa: E402
from quillmark.operators import pairs as J  # noqa: E402
from quillmark.operators import rules as R  # noqa: E402
from quillmark.operators import similarity as S  # noqa: E402
from quillmark.operators import terms as TE  # noqa: E402
from quillmark.plans.flagship import flagship  # noqa: E402
from quillmark.session import get_spark, release  # noqa: E402
from quillmark.sources.testbed import documents_corpus  # noqa: E402


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def lri_vectors(spark, sf, dims=1000):
    sp = C.stratified_split(documents_corpus(spark, sf))
    words = FE.tfidf(TE.words(sp), sp, "word", min_df=3)
    ri = FE.random_index_dictionary(FE.feature_index(words), dims, 2, 0)
    vec = FE.dense_vectors(FE.random_indexing(words, ri), dims)
    return vec.join(sp.select("doc_id", "author", "split"), "doc_id")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(master=f"local[{cpus}]", partitions=int(cpus) * 2)
    corpus = documents_corpus(spark, sf)
    times: dict[str, float] = {}

    def timed(name, fn):
        t0 = time.time()
        fn()
        times[name] = round(time.time() - t0, 3)
        release()  # workloads are independent
        print(f"{name}: {times[name]}s", file=sys.stderr, flush=True)

    sp = C.stratified_split(corpus)
    timed("tfidf_char", lambda: run(FE.tfidf(TE.char_ngrams(sp), sp, "char")))
    timed("positive_pairs_all", lambda: run(J.generate_pairs(corpus, -1, 0)))
    timed("pairs_capped_50k", lambda: run(J.generate_pairs(corpus, 50_000, 50_000)))

    def lri_knn():
        v = lri_vectors(spark, sf).persist()
        te = v.where("split = 'test'").select("doc_id", "vec")
        tr = v.where("split = 'train'").select("doc_id", "vec", "author")
        sc = S.pairwise_projection(te, tr, "cosine", block_rows=1024, reduce=R.knn_block_reduce(5), reduce_schema=R.SCORE_SCHEMA)
        run(R.knn_attribution(sc, 5))
        v.unpersist()

    timed("block_scoring_lri_knn", lri_knn)

    def impostors():
        v = lri_vectors(spark, sf, 256).persist()
        te = v.where("split = 'test'")
        tr = v.where("split = 'train'").select("doc_id", "vec", "author")
        pairs = J.verification_coordinates(te.select("doc_id", "author"), True, 1000)
        imps = I.top_impostors(te.select("doc_id", "vec"), tr, 50, "cosine", block_rows=1024)
        subsets = I.feature_subsets(256, 100, 42, spark)
        run(I.impostor_scores_by_pair(pairs.select("a", "b"), v.select("doc_id", "vec"), imps, subsets,
                                      50, 10, 100, 256, "cosine"))
        v.unpersist()

    timed("impostors_1000_pairs", impostors)
    timed("flagship_sav_cosine", lambda: run(flagship(spark, sf)))
    m = re.search(r"sf([0-9.]+)", sf)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf}))


if __name__ == "__main__":
    main()
