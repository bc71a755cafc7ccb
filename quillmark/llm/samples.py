"""Bounded, seeded samples of labelled documents, and a small logistic fit."""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out() -> Column:
    """Rows that no fit may learn from: crc32 of the id's text leaves 1 by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, y) of the rows open to learning; of repeated ids the larger label counts."""
    return (labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).where(~held_out())
            .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y")))


def fit_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, seed: int) -> tuple[DataFrame, dict[int, float]]:
    """(doc_id, text, y) of at most ``per_class`` labelled documents of a class,
    the first in seeded hash order, and per class how many rows one stands for."""
    rows = labelled(labels, label)
    order = [F.xxhash64("doc_id", F.lit(seed)), F.col("doc_id")]
    chosen = rows.where("y = 0").orderBy(*order).limit(per_class).union(rows.where("y = 1").orderBy(*order).limit(per_class))
    totals = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    weights = {y: max(1.0, n / per_class) for y, n in totals.items()}
    # at most 2 * per_class ids: proven small
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), weights


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


class Rows:
    """Sparse 0/1 rows: ``row`` and ``col`` of the ones."""

    def __init__(self, lists: list, width: int):
        self.n, self.width = len(lists), width
        self.row = np.repeat(np.arange(self.n), [len(x) for x in lists])
        self.col = np.concatenate([np.asarray(x, dtype=np.int64) for x in lists]) if self.n else np.empty(0, np.int64)
        self.row = self.row[:len(self.col)]

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, r[self.row], self.width)
