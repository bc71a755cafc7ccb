"""Registered queries against their SQL twins on the smallest scale."""
import hashlib

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

QUICK = ["stratified_split", "group_docs", "tfidf_words", "function_word_freq", "positive_pairs_round_robin",
         "negative_pairs", "verification_coordinates", "knn_attribution", "impostor_scores", "feature_matrix",
         "scan_tsv_corpus", "scan_tagged_records", "scan_dir_corpus", "message_body_corpus", "merge_dedup_requests",
         "sav_experiment", "report_ttest", "sav_cosine_flagship"]


def _digest(df):
    df = df[sorted(df.columns)]
    rows = sorted(repr(tuple(round(v, 6) if isinstance(v, float) else (int(v) if hasattr(v, "item") and not isinstance(v, float) else v)
                             for v in r)) for r in df.itertuples(index=False, name=None))
    return hashlib.md5("\n".join(rows).encode()).hexdigest()


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ["documents", "embeddings", "labels", "conversations", "benchmark"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    s = E.queries()[name](spark, SF_SMALL).toPandas()
    o = con.execute(E.oracle_sql()[name]).df()
    assert sorted(s.columns) == sorted(o.columns)
    assert len(s) == len(o)
    assert _digest(s) == _digest(o)


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and set(df.columns) == {"acc", "p", "r", "f1"}
