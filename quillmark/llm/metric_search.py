"""Exact top-k by integer inner product in M-trees, best first.

A component x counts as floor(256 * x).  With one more component that brings
every vector of a block to the block's largest norm, a larger inner product is a
smaller Euclidean distance, so metric bounds apply.  A block of rows is one
M-tree, loaded in bulk into pages: an inner page holds routing vectors with the
radius that covers their subtree and their distance to the page's own routing
vector; a leaf page holds rows with that distance.  A query visits pages in the
order of their least possible distance and stops when none can beat its k-th
best.  Inside a page the stored distances and the triangle inequality rule out
entries before their distance is computed.

Exact: bounds carry a slack above rounding, and scores are integers.

Defined cases: see ``vectors.usable`` (zero vectors take part here); vectors of
another length than a query have no score with it; rows that share a vec_id are
rows like others, none of them an answer to that id; fewer candidates than k: all of
them; no queries or an empty table: no rows; equal scores: smaller vec_id;
components too large for exact doubles are handled without bounds, and scores
beyond a long are held at its ends; extra columns are ignored.
"""
from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .vectors import BLOCK_ROWS, QUERY_ROWS, best, from_bytes, pack, packed_rows, search_blocks, to_bytes, usable

PAGE = 128
FANOUT = 32
SCALE = 256
EXACT = 2.0 ** 21
FOUND = "query_id long, vec_id long, score long"


def lengths(x: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)


class Loader:
    """Bulk load: pages as ranges of one entry list, rows in leaf order."""

    def __init__(self, x: np.ndarray):
        self.x, self.sq = x, lengths(x)
        self.top = float(self.sq.max())
        self.lift = np.sqrt(np.maximum(0.0, self.top - self.sq))
        self.random = np.random.default_rng(1)
        self.pages: list[tuple[bool, list, list, list, list]] = []  # leaf, rows, radii, to parent, children

    def distance(self, rows: np.ndarray, pivot: int) -> np.ndarray:
        gap = self.sq[rows] + self.sq[pivot] - 2 * (self.x[rows] @ self.x[pivot]) + (self.lift[rows] - self.lift[pivot]) ** 2
        return np.sqrt(np.maximum(0.0, gap))

    def load(self, rows: np.ndarray, parent: int | None) -> int:
        """Page number of the tree over ``rows`` below routing row ``parent``."""
        number = len(self.pages)
        self.pages.append((False, [], [], [], []))
        to_parent = (lambda r: self.distance(r, parent)) if parent is not None else (lambda r: np.zeros(len(r)))
        if len(rows) <= PAGE:
            self.pages[number] = (True, rows.tolist(), [0.0] * len(rows), to_parent(rows).tolist(), [-1] * len(rows))
            return number
        pivots = self.random.choice(rows, min(FANOUT, -(-len(rows) // PAGE)), replace=False)
        nearest = np.argmin(np.stack([self.distance(rows, p) for p in pivots]), axis=0)
        groups = [(p, rows[nearest == i]) for i, p in enumerate(pivots) if (nearest == i).any()]
        if max(len(g) for _, g in groups) > 0.9 * len(rows):  # nothing to tell the rows apart
            groups = [(p, g) for p, g in zip(pivots, np.array_split(rows, len(pivots)))]
        entries = [(int(p), float(self.distance(g, p).max()), self.load(g, int(p))) for p, g in groups]
        heads = np.array([p for p, _, _ in entries])
        self.pages[number] = (False, heads.tolist(), [r for _, r, _ in entries], to_parent(heads).tolist(),
                              [c for _, _, c in entries])
        return number


def build_tree(ids: np.ndarray, x: np.ndarray) -> bytes:
    """A block's M-tree: pages as ranges of entry arrays."""
    x = np.floor(SCALE * x)
    exact = bool(np.abs(x).max() < EXACT)
    loader = Loader(x if exact else np.zeros_like(x))
    loader.load(np.arange(len(ids)), None)
    sizes = [len(p[1]) for p in loader.pages]
    rows, radii, near, child = ([v for p in loader.pages for v in p[i]] for i in (1, 2, 3, 4))
    rows = np.array(rows, dtype=np.int64)
    return to_bytes(ids=ids[rows], x=x[rows], at=np.concatenate(([0], np.cumsum(sizes))), radius=np.array(radii),
                    near=np.array(near), child=np.array(child), leaf=np.array([p[0] for p in loader.pages]),
                    top=np.array(loader.top), exact=np.array(exact))


def clamp(v) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, int(v)))


def search_tree(t: dict, query: int, q: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The best k (score, -id) of the tree's rows other than the query's own."""
    at, ids, x, radius, near, child, leaf = (t[n] for n in ("at", "ids", "x", "radius", "near", "child", "leaf"))
    base = float(q @ q) + float(t["top"])
    slack = 1e-6 * (1.0 + np.sqrt(base))
    kept: list[tuple[int, int]] = []
    limit = np.inf
    queue: list[tuple[float, int, float]] = [(0.0, 0, -1.0)]
    while queue:
        least, page, to_parent = heapq.heappop(queue)
        if least > limit:
            break
        a, b = at[page], at[page + 1]
        rows = slice(a, b)
        if to_parent >= 0 and limit < np.inf:
            may = np.flatnonzero(np.abs(near[a:b] - to_parent) - radius[a:b] <= limit)
            if len(may) < b - a:
                rows = may + a
        score = x[rows] @ q
        if leaf[page]:
            own = ids[rows]
            good = np.flatnonzero(score >= kept[0][0]) if len(kept) == k else np.arange(len(score))
            for i in good[own[good] != query].tolist():
                item = (int(score[i]), -int(own[i]))
                if len(kept) < k:
                    heapq.heappush(kept, item)
                elif item > kept[0]:
                    heapq.heapreplace(kept, item)
            if len(kept) == k:
                limit = np.sqrt(max(0.0, base - 2.0 * kept[0][0])) + slack
        else:
            gap = np.sqrt(np.maximum(0.0, base - 2.0 * score))
            floor = np.maximum(0.0, gap - radius[rows])
            for f, c, g in zip(floor.tolist(), child[rows].tolist(), gap.tolist()):
                if f <= limit:
                    heapq.heappush(queue, (f, c, g))
    return kept


def search_large(t: dict, query: int, q: np.ndarray, k: int) -> list[tuple[int, int]]:
    """Without bounds, in whole numbers of any size."""
    rows = np.flatnonzero(np.repeat(t["leaf"], np.diff(t["at"])) & (t["ids"] != query))
    whole = [int(v) for v in q.tolist()]
    return heapq.nlargest(k, ((clamp(sum(a * int(b) for a, b in zip(whole, t["x"][r].tolist()))), -int(t["ids"][r]))
                              for r in rows))


def search_trees(data: bytes, wanted: bytes, k: int) -> pd.DataFrame:
    t, queries = from_bytes(data), from_bytes(wanted)
    out: list[tuple[int, int, int]] = []
    x = np.floor(SCALE * queries["x"])
    if x.shape[1:] == t["x"].shape[1:]:
        exact = bool(t["exact"]) and np.abs(x).max() < EXACT
        for query, q in zip(queries["ids"].tolist(), x):
            found = (search_tree if exact else search_large)(t, query, q, k)
            out += [(query, -i, s) for s, i in found]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int, block_rows: int = BLOCK_ROWS,
          query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of ``vectors`` of largest integer
    inner product with each row of ``queries``, other than itself (vec_id, embedding)."""
    index = pack(usable(vectors, False), block_rows, "metric-trees", build_tree)
    wanted = pack(usable(queries, False), query_rows, "metric-queries", packed_rows)
    return best(search_blocks(index, wanted, lambda a, b: search_trees(a, b, k), FOUND), k)


def op9_metric_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 vectors of largest integer inner product with every 50th vector."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, x -> CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
           FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, x -> x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id,
        CAST(list_sum(list_transform(range(1, len(q.e) + 1), i -> q.e[i] * c.e[i])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5
"""
