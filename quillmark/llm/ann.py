"""Approximate nearest neighbours by collision counting (query-aware hashing).

Largest inner product becomes smallest distance: a block's vectors are scaled
by its largest norm and get one more component that brings them to length 1; a
query is scaled to length 1.  A block keeps one sorted array per random
projection.  A query opens a window
around its own projection in every array; a vector that falls into the windows
of at least ``threshold`` of the projections is a candidate.  The windows' first
width is read off every ``SAMPLE``-th row of the block (the width at which
``spare`` times k of the block's rows should collide often enough) and widened
(virtual rehashing) until the candidates are enough for the answer.  All
candidates are verified by their exact inner product; their number follows k
and the number of blocks, not the rows of a block.

A vector's place in each sorted array is kept, so collisions of a block are
counted by comparing places with the windows' bounds, all rows at once.

Every row is indexed; no fit, no sample.  Parameters trade time for recall; with
the defaults it is measured above 0.9 (tests, README).

Defined cases: see ``vectors.usable`` for the rows that take part; vectors are
compared only among equal lengths; rows that share a vec_id are rows like others,
none of them an answer to that id; fewer candidates than k: all of them; no queries or an empty table: no rows;
equal scores: smaller vec_id; extra columns are ignored.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .vectors import BLOCK_ROWS, QUERY_ROWS, best, from_bytes, pack, packed_rows, search_blocks, to_bytes, usable

PROJECTIONS = 160
THRESHOLD = 0.6
#: Candidates of a block in multiples of k.
SPARE = 32
#: Every which row of a block gives the first width; by how much windows widen.
SAMPLE = 32
WIDEN = 1.15
#: Projections counted at a time (their places stay in the processor's cache).
STEP = 16
QUERY_STEP = 256
FOUND = "query_id long, vec_id long, score double"


def directions(projections: int, dims: int, seed: int = 3) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((projections, dims + 1))


def build_arrays(ids: np.ndarray, x: np.ndarray, projections: int = PROJECTIONS) -> bytes:
    """A block's vectors and, per projection, the sorted values and every row's place."""
    norms = np.linalg.norm(x, axis=1)
    top = norms.max()
    lift = np.sqrt(np.maximum(0.0, 1.0 - (norms / top) ** 2))
    values = (np.hstack([x / top, lift[:, None]]) @ directions(projections, x.shape[1]).T).T
    order = np.argsort(values, axis=1, kind="stable")
    place = np.empty(order.shape, dtype=np.uint16 if len(ids) < 1 << 16 else np.uint32)
    np.put_along_axis(place, order, np.arange(len(ids), dtype=place.dtype)[None, :], axis=1)
    return to_bytes(ids=ids, x=x, place=place, values=np.take_along_axis(values, order, axis=1))


def first_widths(sample: np.ndarray, at: np.ndarray, need: int, share: float) -> np.ndarray:
    """Per query the half width at which a share of the sampled rows (a row per
    sampled vector) falls into at least ``need`` windows."""
    keep = min(len(sample) - 1, int(share * len(sample)))
    out = np.empty(len(at))
    for i, q in enumerate(at.astype(np.float32)):
        reach = np.partition(np.abs(sample - q), need - 1, axis=1)[:, need - 1]
        out[i] = np.partition(reach, keep)[keep]
    return out


def windows(values: np.ndarray, at: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of every query's window in every sorted array."""
    low, high = (np.empty(at.shape, dtype=np.int64) for _ in range(2))
    for j, v in enumerate(values):
        low[:, j] = np.searchsorted(v, at[:, j] - widths, "left")
        high[:, j] = np.searchsorted(v, at[:, j] + widths, "right")
    return low, high


def collisions(place: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Per row of the block in how many windows [low, high) of the sorted arrays it lies."""
    low, size = low.astype(place.dtype)[:, None], (high - low).astype(place.dtype)[:, None]
    total = np.zeros(place.shape[1], dtype=np.uint8 if len(place) < 256 else np.uint32)
    for j in range(0, len(place), STEP):
        inside = (place[j:j + STEP] - low[j:j + STEP]) < size[j:j + STEP]
        total += np.add.reduce(inside.view(np.uint8), axis=0, dtype=np.uint8)
    return total


def search_arrays(data: bytes, wanted: bytes, k: int, threshold: float = THRESHOLD, spare: int = SPARE) -> pd.DataFrame:
    """The best k verified candidates of a block for each query of a query block."""
    index, queries = from_bytes(data), from_bytes(wanted)
    ids, x, place, values = index["ids"], index["x"], index["place"], index["values"]
    q = queries["x"] / np.linalg.norm(queries["x"], axis=1)[:, None]
    at = q @ directions(len(values), x.shape[1])[:, :-1].T
    need = int(np.ceil(threshold * len(values)))
    enough = min(len(ids), k + 1)
    sampled = place[:, ::SAMPLE].astype(np.int64)
    sample = np.ascontiguousarray(np.take_along_axis(values, sampled, axis=1).T.astype(np.float32))
    rows: list[tuple] = []
    for first in range(0, len(at), QUERY_STEP):
        some = at[first:first + QUERY_STEP]
        widths = first_widths(sample, some, need, min(1.0, spare * k / len(ids)))
        low, high = windows(values, some, widths)
        for i in range(len(some)):
            of = np.flatnonzero(collisions(place, low[i], high[i]) >= need)
            while len(of) < enough:
                widths[i] = max(widths[i] * WIDEN, 1e-9)
                a, b = windows(values, some[i:i + 1], widths[i:i + 1])
                of = np.flatnonzero(collisions(place, a[0], b[0]) >= need)
            rows.append(top(queries["ids"][first + i], queries["x"][first + i], of, ids, x, k))
    if not rows:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    q_ids, v_ids, scores = zip(*rows)
    return pd.DataFrame({"query_id": np.concatenate(q_ids), "vec_id": np.concatenate(v_ids), "score": np.concatenate(scores)})


def top(query: int, vector: np.ndarray, of: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple:
    """Exact inner products of the rows ``of``; the best k other than the query."""
    of = of[ids[of] != query]
    score = x[of] @ vector
    if len(of) > k:
        cut = np.partition(score, len(of) - k)[len(of) - k]
        keep = score >= cut
        of, score = of[keep], score[keep]
    by = np.lexsort((ids[of], -score))[:k]
    return np.full(len(by), query, dtype=np.int64), ids[of[by]], score[by]


def nearest(vectors: DataFrame, queries: DataFrame, k: int, block_rows: int = BLOCK_ROWS,
            query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` its k rows of
    ``vectors`` of largest inner product, other than itself (vec_id, embedding)."""
    index = pack(usable(vectors, True), block_rows, "collision-index", build_arrays)
    wanted = pack(usable(queries, True), query_rows, "collision-queries", packed_rows)
    return best(search_blocks(index, wanted, lambda a, b: search_arrays(a, b, k), FOUND), k)


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every 20th vector."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)
