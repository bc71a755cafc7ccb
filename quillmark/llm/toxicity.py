"""Counterfactual-regularised toxicity classifier.

A logistic model over the presence of words and word beginnings in the whole
text.  For the labelled documents of the fit that mention identity terms, each
sentence's terms are swapped for others of their group; the fit penalises the
squared change of the logit, so that a bare mention of a group carries no
weight of its own.

The fit sees a bounded sample (``per_class`` labelled documents of each class,
documented limit); its vocabulary is chosen by a grouped count over that sample
(log-likelihood ratio, at most ``vocabulary`` features).  Scoring is one narrow
pass over every whole text.  Labels, language, source and ids are never inputs.

Defined cases: null or empty texts get the score of a text without features;
null ids are scored and not held out; without labels of both classes the score
is the observed rate (0 if there are none); an empty table gives no rows; extra
columns are ignored.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import save, tidy
from .samples import Rows, fit_sample, held_out, sigmoid

#: Swappable terms, a group per line (fixed values).
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("immigrants", "locals", "refugees", "foreigners"),
    ("disabled", "elderly", "young", "poor"),
)
THRESHOLD = 0.7
PREFIXES = (4, 5, 6, 7)
WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def features(text: str | None) -> set[str]:
    """Distinct lower-cased words, and their first letters marked with a star."""
    words = set(WORD.findall((text or "").lower()))
    return words | {w[:n] + "*" for n in PREFIXES for w in words if len(w) > n}


def swap_terms(text: str, groups=IDENTITY_TERMS) -> str:
    """The text with every identity term of a sentence replaced by the next of its group."""
    following = {t: g[(i + 1) % len(g)] for g in groups for i, t in enumerate(g)}

    def other(m: re.Match) -> str:
        return following.get(m[0].lower(), m[0])

    return " ".join(WORD.sub(other, s) for s in SENTENCE.split(text))


def choose_vocabulary(sample: DataFrame, size: int, least_docs: int = 3, least_g2: float = 20.0) -> list[str]:
    """Features whose document counts differ most between the classes."""
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, list[int]] = {}
        for frame in frames:
            for text, y in zip(frame["text"], frame["y"]):
                for f in features(text):
                    seen.setdefault(f, [0, 0])[y] += 1
        names = list(seen)
        for at in range(0, len(names), 50_000):
            part = names[at:at + 50_000]
            yield pd.DataFrame({"feature": pd.Series(part, dtype=object), "n0": [seen[f][0] for f in part],
                                "n1": [seen[f][1] for f in part]})

    counts = (sample.mapInPandas(tidy(count), "feature string, n0 long, n1 long").groupBy("feature")
              .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    total = sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()
    docs = {r["y"]: r["n"] for r in total}

    def part(n, of):  # observed * log(observed / expected)
        return F.when(n > 0, n * F.log(n / ((F.col("n0") + F.col("n1")) * of / sum(docs.values())))).otherwise(0.0)

    g2 = 2 * (part(F.col("n0"), docs[0]) + part(F.col("n1"), docs[1]))
    best = (counts.where(F.col("n0") + F.col("n1") >= least_docs).select("feature", g2.alias("g2"))
            .where(F.col("g2") >= least_g2).orderBy(F.desc("g2"), "feature").limit(size))
    return [r["feature"] for r in best.collect()]


def fit_logistic(x: Rows, y: np.ndarray, weight: np.ndarray, swapped: Rows, of: np.ndarray, l2: float, fairness: float,
                 steps: int = 1500, rate: float = 0.1) -> np.ndarray:
    """Weights and, last, the intercept (Adam on the full sample).

    ``swapped`` row i is the counterfactual of row ``of[i]`` of x."""
    w = np.zeros(x.width + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    total = weight.sum()
    for t in range(1, steps + 1):
        z = x.times(w[:-1])
        err = weight * (sigmoid(z + w[-1]) - y) / total
        g = np.append(x.back(err) + l2 * w[:-1], err.sum())
        if swapped.n:
            gap = 2 * fairness * (z[of] - swapped.times(w[:-1])) / swapped.n
            at = np.bincount(of, gap, x.n)
            g[:-1] += x.back(at) - swapped.back(gap)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-9)
    return w


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 8000, vocabulary: int = 3000,
          l2: float = 1e-6, fairness: float = 1.0, seed: int = 7, groups=IDENTITY_TERMS) -> tuple[dict[str, float], float]:
    """(feature weights, intercept)."""
    chosen, each = fit_sample(docs, labels, label, per_class, seed)
    sample = save(chosen, "toxicity-sample")
    have = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(have) < 2:
        return {}, 40.0 if have.get(1) else -40.0
    names = choose_vocabulary(sample, vocabulary)
    index = {f: i for i, f in enumerate(names)}
    terms = {t for g in groups for t in g}

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            own, other = [], []
            for text in frame["text"]:
                found = features(text)
                own.append(sorted(index[f] for f in found if f in index))
                swap = features(swap_terms(text, groups)) if terms & found else None
                other.append(None if swap is None else sorted(index[f] for f in swap if f in index))
            yield pd.DataFrame({"doc_id": frame["doc_id"], "y": frame["y"], "own": own, "other": other})

    # at most 2 * per_class short rows
    rows = sample.mapInPandas(tidy(encode), "doc_id long, y int, own array<int>, other array<int>").orderBy("doc_id").collect()
    y = np.array([r["y"] for r in rows], dtype=float)
    of = np.array([i for i, r in enumerate(rows) if r["other"] is not None], dtype=np.int64)
    w = fit_logistic(Rows([r["own"] for r in rows], len(names)), y, np.array([each[r["y"]] for r in rows]),
                     Rows([rows[i]["other"] for i in of], len(names)), of, l2, fairness)
    return dict(zip(names, w[:-1].tolist())), float(w[-1])


def score(docs: DataFrame, weights: dict[str, float], intercept: float) -> DataFrame:
    """``docs`` with a column score (0 to 1)."""
    known = frozenset(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            z = [intercept + sum(weights[f] for f in sorted(features(t) & known)) for t in batch.column(at).to_pylist()]
            yield batch.append_column("score", pa.array(sigmoid(np.array(z, dtype=float))))

    return docs.mapInArrow(tidy(run), StructType([*docs.schema.fields, StructField("score", DoubleType())]))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every whole document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    weights, intercept = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, weights, intercept)
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
