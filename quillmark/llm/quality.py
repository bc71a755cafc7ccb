"""Hierarchical empirical Bayes over a document quality classifier.

A logistic model over the shape of the whole text (letter case, symbols,
repetition, word and line lengths) gives each document's evidence.  Grouped
sums of that evidence by path (a site's section) and by site give rates of good
documents; each rate is shrunk towards its parent, path to site and site to the
whole corpus, by a strength that the method of moments takes from the spread of
the rates themselves, so a sparse site stays near the corpus.  A document's own
evidence is left out of its path's and site's rate.  Its posterior is its
classifier's log-odds moved by what its path's rate differs from the corpus.

The classifier is fitted on at most ``per_class`` labelled documents of each
class (documented limit); rates and strengths use every document.

Defined cases: null or empty texts have a shape of zeros; a null site or path
part is a group of its own; null ids are scored; without labels of both classes
the evidence is the observed rate; an empty table gives no rows; extra columns
stay untouched (the added ones replace any of the same name).
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .common import save, tidy
from .samples import fit_sample, sigmoid

SHAPES = 14
KEEP_AT = 0.5


def shape(text: str | None) -> list[float]:
    """What the classifier sees of a text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw.strip():
        return [0.0] * SHAPES
    n = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    words, lines = raw.split(), raw.count(b"\n") + 1
    lower, upper, digits, high = n[97:123].sum(), n[65:91].sum(), n[48:58].sum(), n[128:].sum()
    marks = n[33:48].sum() + n[58:65].sum() + n[91:97].sum() + n[123:127].sum()
    plain = n[44] + n[46] + n[39] + n[45]  # , . ' -
    count = len(words)
    again = sum(a == b for a, b in zip(words, words[1:])) / count
    distinct = len(set(words))
    return [
        float(upper / (1 + upper + lower)), float((marks - plain) / count), float(n[33] / count), float(n[124] / count),
        float((n[35] + n[36] + n[37] + n[38] + n[42]) / count), float(digits / len(raw)), float(high / len(raw)),
        again, distinct / count, float(np.log1p(count)), float(np.log1p(distinct) / np.log1p(count)),
        min(len(raw) / count, 40.0) / 10, min(count / lines, 100.0) / 50, float(plain / count),
    ]


def with_shape(docs: DataFrame) -> DataFrame:
    """``docs`` with a column shape (array of double)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.append_column("shape", pa.array([shape(t) for t in texts], pa.list_(pa.float64())))

    docs = docs.drop("shape")
    return docs.mapInArrow(tidy(run), StructType([*docs.schema.fields, StructField("shape", ArrayType(DoubleType()))]))


def expand(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised shape values, clipped, their squares and an intercept."""
    z = np.clip((x - centre) / scale, -8, 8)
    return np.hstack([z, z * z, np.ones((len(z), 1))])


def fit_shape(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> dict:
    """Ridge logistic regression by damped Newton steps."""
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = expand(x, centre, scale)
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(40):
        p = sigmoid(z @ w)
        g = z.T @ (weight * (p - y)) + penalty * w
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return {"centre": centre, "scale": scale, "w": w}


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 8000, seed: int = 11) -> dict:
    sample, each = fit_sample(docs, labels, label, per_class, seed)
    rows = with_shape(sample.select("doc_id", "text", "y")).select("doc_id", "y", "shape").orderBy("doc_id").collect()  # bounded
    y = np.array([r["y"] for r in rows], dtype=float)
    if len(set(y.tolist())) < 2:
        rate = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        w = np.zeros(2 * SHAPES + 1)
        w[-1] = np.log(rate / (1 - rate))
        return {"centre": np.zeros(SHAPES), "scale": np.ones(SHAPES), "w": w}
    return fit_shape(np.array([r["shape"] for r in rows]), y, np.array([each[r["y"]] for r in rows]))


def evidence(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with the classifier's probability, doc_score."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            x = np.array([shape(t) for t in texts], dtype=float).reshape(-1, SHAPES)
            p = sigmoid(expand(x, model["centre"], model["scale"]) @ model["w"])
            yield batch.append_column("doc_score", pa.array(np.clip(p, 1e-6, 1 - 1e-6)))

    docs = docs.drop("doc_score")
    return docs.mapInArrow(tidy(run), StructType([*docs.schema.fields, StructField("doc_score", DoubleType())]))


def strength(groups: DataFrame, parent: str) -> DataFrame:
    """One row, m: how many documents the parent's rate counts for.

    Method of moments for beta-distributed group rates: with the observed spread
    v of the rates around their parents (weighted by size) and the spread s that
    sampling alone gives, m = mean p(1-p) / (v - s) - 1, at least 1."""
    spread = F.sum(F.col("n") * (F.col("k") / F.col("n") - F.col(parent)) ** 2) / F.sum("n")
    noise = F.sum(F.col(parent) * (1 - F.col(parent))) / F.sum("n")
    level = F.sum(F.col("n") * F.col(parent) * (1 - F.col(parent))) / F.sum("n")
    m = F.greatest(F.lit(1.0), F.least(F.lit(1e6), level / F.greatest(spread - noise, F.lit(1e-9)) - 1))
    return groups.agg(F.coalesce(m, F.lit(1.0)).alias("m"))


def posteriors(scored: DataFrame, site: str, section: str) -> DataFrame:
    """``scored`` (with doc_score) plus site_rate, path_rate and score.

    ``scored`` is read twice, once for the grouped sums, which are written, and
    once for the result; nothing else of its size is kept."""
    keys = [F.col(site).alias("g_site"), F.col(section).alias("g_path")]
    path = save(scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("doc_score").alias("k")), "path-sums")
    sites = path.groupBy("g_site").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    whole = sites.agg(F.coalesce(F.sum("k") / F.sum("n"), F.lit(0.5)).alias("mu")).collect()[0]["mu"]
    m_site = strength(sites.withColumn("mu", F.lit(whole)), "mu").collect()[0]["m"]
    site_rate = sites.select(F.col("g_site").alias("s_site"), F.col("n").alias("site_n"), F.col("k").alias("site_k"),
                             ((F.col("k") + m_site * whole) / (F.col("n") + m_site)).alias("rate"))
    path = path.join(site_rate, F.col("g_site").eqNullSafe(F.col("s_site")))
    m_path = strength(path, "rate").collect()[0]["m"]
    path = path.select(F.col("g_site"), F.col("g_path"), F.col("n").alias("path_n"), F.col("k").alias("path_k"),
                       "site_n", "site_k")
    both = scored.join(path, F.col(site).eqNullSafe(F.col("g_site")) & F.col(section).eqNullSafe(F.col("g_path")))
    own = F.col("doc_score")
    site_own = (F.col("site_k") - own + m_site * whole) / (F.col("site_n") - 1 + m_site)
    path_own = (F.col("path_k") - own + m_path * F.col("site_rate")) / (F.col("path_n") - 1 + m_path)

    def logit(c):
        return F.log(c / (1 - c))

    def safe(c):
        return F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6))

    moved = logit(own) + logit(F.col("path_rate")) - F.lit(float(np.log(whole / (1 - whole))) if 0 < whole < 1 else 0.0)
    return (both.withColumn("site_rate", safe(site_own)).withColumn("path_rate", safe(path_own))
            .withColumn("score", 1 / (1 + F.exp(-moved)))
            .drop("g_site", "g_path", "path_n", "path_k", "site_n", "site_k"))


def quality(docs: DataFrame, labels: DataFrame, site: str = "source", section: str = "lang", keep_at: float = KEEP_AT,
            per_class: int = 8000) -> DataFrame:
    """``docs`` plus doc_score, site_rate, path_rate, score and kept."""
    docs = docs.drop("doc_score", "site_rate", "path_rate", "score", "kept")
    return posteriors(evidence(docs, train(docs, labels, per_class=per_class)), site, section).withColumn(
        "kept", F.col("score") >= keep_at)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality posterior of every document; host: source, path: language section."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.col("text").cast("string").alias("text"))
    out = quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "source", "lang", "doc_score", "site_rate", "path_rate", "score", "kept")
