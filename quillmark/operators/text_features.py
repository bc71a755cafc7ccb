"""Stylometric and n-gram feature extraction.

Every function reads a corpus ``(doc_id, text, ...)`` and returns a long
table.  Work is per document (bounded by one text); aggregations are keyed by
``(doc_id, feat)`` so Spark combines map-side before any shuffle.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def token_count_filter(corpus: DataFrame, min_tokens: int, max_tokens: int | None = None) -> DataFrame:
    """Keep docs with ``min_tokens <= #tokens`` (and ``< max_tokens`` if given)."""
    n = T.token_count("text")
    cond = n >= min_tokens
    if max_tokens is not None:
        cond = cond & (n < max_tokens)
    return corpus.where(cond)


def clean_citations(corpus: DataFrame, strict: bool = False) -> DataFrame:
    """Citation removal applied to the text column."""
    return corpus.withColumn("text", T.clean_citations("text", strict))


def _posexplode(df: DataFrame, arr, name: str) -> DataFrame:
    return df.select("doc_id", F.posexplode(arr).alias("pos", name)).withColumn("pos", F.col("pos") + 1)


def style_tokens(corpus: DataFrame) -> DataFrame:
    """(doc_id, pos, token)."""
    return _posexplode(corpus, T.style_tokens("text"), "token")


def sentence_split(corpus: DataFrame) -> DataFrame:
    """(doc_id, pos, sentence)."""
    return _posexplode(corpus, T.sentences("text"), "sentence")


def function_word_freq(corpus: DataFrame, lang: str | None = None) -> DataFrame:
    """P5: dense block (doc_id, feat, val): count(word) / max(1, #tokens) for every
    word of the function-word list, in list order.

    ``lang`` fixes one list for the whole corpus (as one extractor does); when
    None, each document's ``lang`` column picks its language's list (the English
    one where the language is null or has none, so no document is lost).
    """
    toks = T.style_tokens("text")
    if lang is not None:
        words = F.array(*[F.lit(w) for w in T.function_words(lang)])
    else:
        pairs = []
        for lg, ws in T.FUNCTION_WORDS.items():
            pairs += [F.lit(lg), F.array(*[F.lit(w) for w in ws])]
        default = F.array(*[F.lit(w) for w in T.ENGLISH_FUNCTION_WORDS])
        words = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("lang")), default)
    d = corpus.select("doc_id", toks.alias("toks"), words.alias("words"))
    d = d.select(
        "doc_id",
        F.greatest(F.lit(1), F.size("toks")).alias("n"),
        F.filter("toks", lambda t: F.array_contains(F.col("words"), t)).alias("fw"),
        "words",
    )
    d = d.select("doc_id", "n", "fw", F.posexplode("words").alias("idx", "word"))
    cnt = F.size("fw") - F.size(F.array_remove("fw", F.col("word")))
    feat = F.concat(F.lit("fw:"), F.lpad((F.col("idx") + 1).cast("string"), 3, "0"), F.lit(":"), F.col("word"))
    return d.select("doc_id", feat.alias("feat"), (cnt / F.col("n")).alias("val"))


def _reaching(lens, upto: int):
    """How many of ``lens`` reach 0, 1, ..., ``upto`` - 1: values are taken out from below."""
    def step(acc, i):
        return F.struct(F.array_remove(acc["left"], i).alias("left"), F.concat(acc["n"], F.array(F.size(acc["left"]))).alias("n"))

    start = F.struct(lens.alias("left"), F.array().cast("array<int>").alias("n"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(upto - 1)), start, step, lambda acc: acc["n"])


def _shares(corpus: DataFrame, lens, downto: int, upto: int) -> DataFrame:
    """(doc_id, i, val): for i = downto..upto-1 the share of ``lens`` that reach i."""
    d = corpus.select("doc_id", lens.alias("lens"))
    d = d.select("doc_id", F.greatest(F.lit(1), F.size("lens")).alias("n"), _reaching(F.col("lens"), upto).alias("at"))
    d = d.select("doc_id", "n", "at", F.explode(F.sequence(F.lit(downto), F.lit(upto - 1))).alias("i"))
    return d.select("doc_id", "i", (F.get("at", F.col("i")) / F.col("n")).alias("val"))


def word_length_profile(corpus: DataFrame, upto: int = 23) -> DataFrame:
    """For i = 1..upto-1, share of tokens with length >= i."""
    return _shares(corpus, F.transform(T.style_tokens("text"), F.length), 1, upto)


def sentence_length_profile(corpus: DataFrame, downto: int = 3, upto: int = 70) -> DataFrame:
    """For i = downto..upto-1, share of sentences with >= i style tokens."""
    return _shares(corpus, F.transform(T.sentences("text"), lambda s: F.size(T.style_tokens(s))), downto, upto)


def spread(df: DataFrame) -> DataFrame:
    """Deals documents by doc_id into a shuffle's tasks before their terms are counted:
    texts cross the network once, and the counts by (doc_id, term), many times their
    size, are then grouped where they are made."""
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(tasks, "doc_id")


def _term_counts(corpus: DataFrame, terms, block: str) -> DataFrame:
    return (
        corpus.select("doc_id", F.explode(terms).alias("feat"))
        .groupBy("doc_id", "feat")
        .agg(F.count(F.lit(1)).alias("tf"))
        .withColumn("block", F.lit(block))
    )


def char_ngram_counts(corpus: DataFrame, n_min: int = 2, n_max: int = 5) -> DataFrame:
    """(doc_id, feat, tf, block='char')."""
    d = spread(corpus).select("doc_id", T.char_preprocess("text").alias("__t"))
    return _term_counts(d, T.char_ngrams("__t", n_min, n_max), "char")


def word_unigram_counts(corpus: DataFrame) -> DataFrame:
    """(doc_id, feat, tf, block='word')."""
    return _term_counts(spread(corpus), T.word_unigrams("text"), "word")


def tag_ngram_counts(corpus: DataFrame, tags_col: str | None = None, n_min: int = 3, n_max: int = 4) -> DataFrame:
    """P10: word n-grams over a tag sequence column (default: shape tags of the text)."""
    tags = F.col(tags_col) if tags_col else T.shape_tags("text")
    d = spread(corpus).select("doc_id", T.tag_tokens(tags).alias("__tg"))
    return _term_counts(d, T.word_ngrams("__tg", n_min, n_max), "post")


def punctuation_counts(corpus: DataFrame) -> DataFrame:
    """Counts of the 32 ASCII punctuation characters."""
    return _term_counts(spread(corpus), T.punctuation_chars("text"), "punct")
