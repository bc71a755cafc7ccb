"""Vector math on document pairs and blocked pairwise
projection (J11).

Dense vectors are ``array<double>`` and their pair functions are
higher-order SQL functions (codegen, no Python).  Sparse features stay in
the long ``(doc_id, feat, val)`` layout and pair functions become joins on
``feat`` plus per-pair aggregates.

J11 ``P[i, j] = h(x_i, r_j)`` is scored in blocks: each side is packed once into
rows of ``PACK_ROWS`` vectors, cut by a checkpoint, and a Cartesian product pairs the
packed rows by reading the checkpoint, so no vector is copied through a shuffle.
NumPy scores a pair of blocks in bounded chunks.  Callers that only need a per-row
summary (top-k, best author) pass a ``reduce``: a task keeps the best cells of an x
block over all reference blocks it reads.  ``RowScores`` hands whole score rows to a
function where one row needs every reference.
"""
from __future__ import annotations

import copy
import math
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .grouping import task_count

#: Vectors of a packed row; packed rows of a reference partition at most.
PACK_ROWS, PACKS = 2048, 32
#: Where a task needs whole score rows: scores that it holds at once, rows of x at most,
#: bytes of references in memory (more are held in a file).
ROW_CELLS, TASK_ROWS, HELD_BYTES = 1 << 24, 1 << 14, 1 << 27
#: Tasks of a pass of a fit over score rows (more beyond ``TASK_ROWS`` rows each): every one
#: sends a gradient of references x classes numbers.
FIT_TASKS = 16


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


# ---------------------------------------------------------------- dense columns

def diff_vector(a, b) -> Column:
    """Element-wise |a - b|."""
    return F.zip_with(_c(a), _c(b), lambda x, y: F.abs(x - y))


def l1_distance(a, b) -> Column:
    return _sum(diff_vector(a, b))


def l2_distance(a, b) -> Column:
    return F.sqrt(_sum(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y))))


def norm2(a) -> Column:
    return F.sqrt(_sum(F.transform(_c(a), lambda x: x * x)))


def dot(a, b) -> Column:
    return _sum(F.zip_with(_c(a), _c(b), lambda x, y: x * y))


def cosine_similarity(a, b) -> Column:
    """Cosine; a zero vector gives 0."""
    den = norm2(a) * norm2(b)
    return F.when(den == 0, F.lit(0.0)).otherwise(dot(a, b) / den)


def cosine_distance(a, b) -> Column:
    """P13 paired cosine distance: 0.5 * ||a/|a| - b/|b|||^2 (zero vectors stay zero)."""
    na, nb = norm2(a), norm2(b)
    ua = F.transform(_c(a), lambda x: F.when(na == 0, F.lit(0.0)).otherwise(x / na))
    ub = F.transform(_c(b), lambda x: F.when(nb == 0, F.lit(0.0)).otherwise(x / nb))
    return 0.5 * _sum(F.zip_with(ua, ub, lambda x, y: (x - y) * (x - y)))


def minmax_similarity(a, b) -> Column:
    """sum(min) / sum(max); 0 when the denominator is 0."""
    num = _sum(F.zip_with(_c(a), _c(b), lambda x, y: F.least(x, y)))
    den = _sum(F.zip_with(_c(a), _c(b), lambda x, y: F.greatest(x, y)))
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)


PAIR_FUNCS: dict[str, Callable[[Column, Column], Column]] = {
    "l1": l1_distance,
    "l2": l2_distance,
    "cosine_distance": cosine_distance,
    "cosine": cosine_similarity,
    "minmax": minmax_similarity,
}


def pair_vectors(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Attach ``va``/``vb`` (and authors) to a pair table (a, b)."""
    va = vectors.select(F.col("doc_id").alias("a"), F.col("vec").alias("va"), F.col("author").alias("author_a"))
    vb = vectors.select(F.col("doc_id").alias("b"), F.col("vec").alias("vb"), F.col("author").alias("author_b"))
    return pairs.join(va, "a").join(vb, "b")


def paired_score(pairs: DataFrame, vectors: DataFrame, metric: str, out: str = "score") -> DataFrame:
    return pair_vectors(pairs, vectors).withColumn(out, PAIR_FUNCS[metric]("va", "vb"))


# ---------------------------------------------------------------- sparse (long) form

def sparse_diff(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """P12 on the long layout: (a, b, feat, val=|x_a - x_b|) over the union of both supports."""
    fa = pairs.select("a", "b").join(features.select(F.col("doc_id").alias("a"), "feat", "val"), "a")
    fb = pairs.select("a", "b").join(features.select(F.col("doc_id").alias("b"), "feat", F.col("val").alias("v")), "b")
    u = fa.unionByName(fb.select("a", "b", "feat", (-F.col("v")).alias("val")))
    d = u.groupBy("a", "b", "feat").agg(F.abs(F.sum("val")).alias("val"))
    return d.where(F.col("val") != 0)


def sparse_cosine(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """P15 on the long layout: (a, b, cosine)."""
    norms = features.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("val") * F.col("val"))).alias("nrm"))
    fa = pairs.select("a", "b").join(features.select(F.col("doc_id").alias("a"), "feat", F.col("val").alias("x")), "a")
    fb = features.select(F.col("doc_id").alias("b"), "feat", F.col("val").alias("y"))
    dots = fa.join(fb, ["b", "feat"]).groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    d = pairs.select("a", "b").join(dots, ["a", "b"], "left")
    d = d.join(norms.select(F.col("doc_id").alias("a"), F.col("nrm").alias("na")), "a", "left")
    d = d.join(norms.select(F.col("doc_id").alias("b"), F.col("nrm").alias("nb")), "b", "left")
    den = F.col("na") * F.col("nb")
    return d.select("a", "b", F.when(den.isNull() | (den == 0), F.lit(0.0))
                    .otherwise(F.coalesce(F.col("dot"), F.lit(0.0)) / den).alias("cosine"))


# ---------------------------------------------------------------- J11 blocked projection

def unit_rows(X: np.ndarray) -> np.ndarray:
    """Rows of length 1; a zero row stays zero."""
    norm = np.linalg.norm(X, axis=1, keepdims=True)
    return np.divide(X, norm, out=np.zeros_like(X), where=norm > 0)


def np_scores(metric: str, X: np.ndarray, R: np.ndarray, coef: np.ndarray | None = None,
              intercept: float = 0.0) -> np.ndarray:
    """Score matrix h(X[i], R[j]) in row chunks of bounded memory."""
    if metric == "cosine":
        return unit_rows(X) @ unit_rows(R).T
    if metric not in ("minmax", "l1", "l2", "diff_logit"):
        raise ValueError(metric)
    out = np.zeros((X.shape[0], R.shape[0]))
    T = np.ascontiguousarray(R.T)
    step = max(1, (1 << 18) // max(1, R.shape[0]))  # a chunk stays in the processor's cache
    for s in range(0, X.shape[0], step):
        x, acc = X[s:s + step], out[s:s + step]
        cell = np.empty_like(acc)
        for d in range(T.shape[0]):
            if metric == "minmax":
                np.minimum(x[:, d, None], T[d], out=cell)
            else:
                np.subtract(x[:, d, None], T[d], out=cell)
                if metric == "l2":
                    np.multiply(cell, cell, out=cell)
                else:
                    np.abs(cell, out=cell)
                if metric == "diff_logit":
                    np.multiply(cell, coef[d], out=cell)
            acc += cell
        if metric == "minmax":
            den = x.sum(1)[:, None] + T.sum(0) - acc  # least and largest add up to both
            acc[:] = np.divide(acc, den, out=np.zeros_like(acc), where=den != 0)
        elif metric == "l2":
            np.sqrt(acc, out=acc)
        elif metric == "diff_logit":
            with np.errstate(over="ignore"):
                acc[:] = 1.0 / (1.0 + np.exp(-(acc + intercept)))
    return out


class TopCells:
    """The ``k`` best references of an x row (``by_author``: of each x row and author)
    by score rounded to 9 digits, then the smaller id; NaN scores come last."""

    DIGITS = 9

    def __init__(self, k: int, by_author: bool):
        self.k, self.by_author = k, by_author
        self.schema = f"x_id long, ref_id long, {'ref_author string, ' if by_author else ''}p double, key double"

    def cells(self, S: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, columns) of S, a group's, among which its best are that reach ``low``."""
        if np.isnan(S).any() or S.shape[1] <= self.k:
            return tuple(v.ravel() for v in np.indices(S.shape))
        if np.isneginf(low).any():
            low = np.maximum(low, np.partition(S, S.shape[1] - self.k, axis=1)[:, S.shape[1] - self.k] - 2.0 * 10.0 ** -self.DIGITS)
        return np.nonzero(S >= low[:, None])

    def cut(self, cells: list[np.ndarray]) -> list[np.ndarray]:
        """The best of ``cells`` (x, author code, ref_id, p)."""
        x, author, ref, p = cells
        order = np.lexsort((ref, -np.round(p, self.DIGITS), author, x))
        x, author = x[order], author[order]
        first = np.ones(len(x), dtype=bool)
        first[1:] = (x[1:] != x[:-1]) | (author[1:] != author[:-1])
        return [c[order[_ranks(first) < self.k]] for c in cells]


def _ranks(first: np.ndarray) -> np.ndarray:
    """Positions from 0 in runs that begin where ``first``."""
    start = np.flatnonzero(first)
    return np.arange(len(first)) - np.repeat(start, np.diff(np.append(start, len(first))))


class _Bests:
    """The k best scores so far of every row of an x block and author: what a cell must reach."""

    def __init__(self, reduce: TopCells, rows: int):
        self.reduce, self.rows, self.top = reduce, rows, {}

    def low(self, author: int, rows: slice) -> np.ndarray:
        if author not in self.top:
            self.top[author] = np.full((self.rows, self.reduce.k), -np.inf)
        return self.top[author][rows].min(axis=1) - 2.0 * 10.0 ** -self.reduce.DIGITS

    def add(self, author: int, rows: slice, i: np.ndarray, p: np.ndarray) -> None:
        if not len(i):
            return
        p = np.where(np.isnan(p), -np.inf, p)
        order = np.lexsort((-p, i))
        i, p = i[order], p[order]
        rank = _ranks(np.concatenate(([True], i[1:] != i[:-1])))
        own, k = self.top[author][rows], self.reduce.k
        new = np.full(own.shape, -np.inf)
        new[i[rank < k], rank[rank < k]] = p[rank < k]
        some = np.unique(i)
        own[some] = -np.partition(-np.hstack([own[some], new[some]]), k - 1, axis=1)[:, :k]


class _Screen:
    """Scores of a few rows of x against r (columns in groups of an author each) where only those
    that reach a row's bound are asked for.  Cosines are a matrix product.  For the measures that
    take a pass per dimension coordinates are first held in 16 bits: sums of whole numbers give a
    score up to a known error, and only the cells that may reach the bound are scored, as
    ``np_scores`` does it."""

    def __init__(self, metric: str, X: np.ndarray, R: np.ndarray, coef: np.ndarray | None, intercept: float):
        self.metric, self.X, self.R, self.coef, self.intercept = metric, X, R, coef, intercept
        self.q, d = None, R.shape[1]
        if metric == "cosine":
            self.X, self.R = unit_rows(X), unit_rows(R)
            return
        if metric not in ("minmax", "diff_logit") or not len(X) or not 0 < d <= 1 << 10:
            return
        low, high = np.minimum(X.min(0), R.min(0)), np.maximum(X.max(0), R.max(0))
        if not (np.isfinite(low).all() and np.isfinite(high).all()) or metric == "minmax" and low.min() < 0:
            return
        units, shift = 65535 // d - 1, low if metric == "diff_logit" else np.zeros(d)
        by = np.ones(d) if metric == "minmax" else np.abs(coef)
        most = float(((high - shift) * by).max())
        if not 0 < most < math.inf:
            return
        self.scale = units / most
        # whole numbers of d columns add up to 16 bits at most
        self.q = [np.rint((v - shift) * (by * self.scale)).astype(np.uint16) for v in (X, R)]
        if metric == "minmax":
            self.minus = np.zeros(d, dtype=bool)
            self.sums = [X.sum(1), np.ascontiguousarray(R.T).sum(0)]
        else:
            self.minus = coef < 0
            self.sums = [(v.astype(np.int64) * np.where(self.minus, -1, 1)).sum(1) for v in self.q]
        self.offset = int(self.minus.sum()) * units  # what is taken away at most
        self.qT = np.ascontiguousarray(self.q[1].T)

    def least(self, rows: slice) -> np.ndarray:
        """``offset`` and the sums over the dimensions of the smaller coordinate, signed."""
        x = self.q[0][rows]
        acc = np.full((len(x), self.qT.shape[1]), self.offset, dtype=np.uint16)
        cell = np.empty_like(acc)
        for d in range(len(self.qT)):
            np.minimum(x[:, d, None], self.qT[d], out=cell)
            (np.subtract if self.minus[d] else np.add)(acc, cell, out=acc)
        return acc

    def reached(self, acc: np.ndarray, rows: slice, cols: slice, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells that may score ``low``, by ``acc`` of these rows and all columns."""
        a, b, d = self.sums[0][rows], self.sums[1][cols], len(self.qT)
        if self.metric == "minmax":  # least / (a + b - least) >= low; half a unit of error a dimension
            c = np.where(low > -0.5, low / (1.0 + np.maximum(low, -0.5)), -np.inf) * self.scale
            bound = np.multiply.outer(c.astype(np.float32), b.astype(np.float32))
            bound += (c * a - 0.5 * d - 2.0).astype(np.float32)[:, None]
            return np.nonzero(acc[:, cols] >= bound)
        with np.errstate(divide="ignore", invalid="ignore"):  # a unit of error a dimension
            z = np.where(low > 0, np.log(low / (1.0 - low)) - self.intercept, -np.inf) * self.scale
        bound = np.add.outer((self.offset + 0.5 * (a - z + d) + 2.0).astype(np.float32), (0.5 * b).astype(np.float32))
        return np.nonzero(acc[:, cols] <= bound)

    def at(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The scores of single cells, the dimensions added up in the order of ``np_scores``."""
        x, r = self.X[i], self.R[j]
        if self.metric == "minmax":
            acc = np.cumsum(np.minimum(x, r), axis=1)[:, -1]
            total = self.sums[0][i] + self.sums[1][j] - acc
            return np.divide(acc, total, out=np.zeros_like(acc), where=total != 0)
        acc = np.cumsum(np.abs(x - r) * self.coef, axis=1)[:, -1]
        with np.errstate(over="ignore"):
            return 1.0 / (1.0 + np.exp(-(acc + self.intercept)))

    def scores(self, rows: slice) -> np.ndarray:
        if self.metric == "cosine":
            return self.X[rows] @ self.R.T
        return np_scores(self.metric, self.X[rows], self.R, self.coef, self.intercept)

    def best(self, reduce: TopCells, bests: _Bests, groups: list[tuple[int, slice]], rows: slice) -> Iterator[tuple]:
        """(author, rows, columns, scores) of the cells of ``rows`` that may be among the best."""
        lows = [bests.low(g, rows) for g, _ in groups]
        found = None
        if self.q is not None and not any(np.isneginf(low).any() for low in lows):
            acc = self.least(rows)
            found = [self.reached(acc, rows, cols, low) for (_, cols), low in zip(groups, lows)]
            if sum(len(i) for i, _ in found) > acc.size // 16:  # many equal rows: all cells are cheaper
                found = None
        if found is None:
            S, P = self.scores(rows), None
            found = [reduce.cells(S[:, cols], low) for (_, cols), low in zip(groups, lows)]
        else:
            P = self.at(*(np.concatenate(c) for c in zip(*((i + rows.start, j + cols.start) for (i, j), (_, cols) in zip(found, groups)))))
        start = 0
        for (g, cols), low, (i, j) in zip(groups, lows, found):
            j = j + cols.start
            if P is None:
                p = S[i, j]
            else:
                p = P[start:start + len(i)]
                start += len(i)
                some = p >= low[i]
                i, j, p = i[some], j[some], p[some]
            bests.add(g, rows, i, p)
            yield g, i + rows.start, j, p


def _pack(df: DataFrame, n: int, rows: int, parts: int) -> DataFrame:
    """(blk, ids, authors, vecs): ``rows`` vectors a row or so, by the hash of doc_id, cut
    by a checkpoint into ``parts`` partitions."""
    ensure_checkpoint_dir(df.sparkSession)
    blk = F.pmod(F.xxhash64("doc_id"), F.lit(_block_count(n, rows))).cast("int")
    author = F.col("author") if "author" in df.columns else F.lit(None).cast("string")
    d = df.select(blk.alias("blk"), F.struct(F.col("doc_id").alias("i"), author.alias("a"), F.col("vec").alias("v")).alias("c"))
    g = d.groupBy("blk").agg(F.collect_list("c").alias("c"))
    g = g.select("blk", F.col("c.i").alias("ids"), F.col("c.a").alias("authors"), F.col("c.v").alias("vecs"))
    return g.repartitionById(parts, F.col("blk") % parts).checkpoint()


def _paired(left: DataFrame, lp: str, right: DataFrame, rp: str, cond: Column | None = None) -> DataFrame:
    """Every packed row of ``left`` with every one of ``right``, read from their
    checkpoints: a task takes one partition of each."""
    def named(d, p):
        return d.select(*[F.col(c).alias(f"{p}_{c}") for c in d.columns])
    r = named(right, rp).hint("shuffle_replicate_nl")
    return named(left, lp).join(r, cond) if cond is not None else named(left, lp).crossJoin(r)


def _matrix(vecs: pa.ListArray) -> np.ndarray:
    if vecs.null_count or len(pc.unique(pc.list_value_length(vecs))) > 1:
        raise ValueError("all vectors must have the same length")
    return vecs.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vecs), -1)


class _Block:
    """A packed row in a task."""

    def __init__(self, batch: pa.RecordBatch, i: int, p: str):
        self.blk = batch.column(f"{p}_blk")[i].as_py()
        self.ids, self.authors, vecs = (batch.column(f"{p}_{c}").slice(i, 1).flatten() for c in ("ids", "authors", "vecs"))
        self.vecs = _matrix(vecs)


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Block, _Block]]:
    x, r = None, None
    for batch in batches:
        for i in range(batch.num_rows):
            if x is None or x.blk != batch.column("x_blk")[i].as_py():
                x = _Block(batch, i, "x")
            if r is None or r.blk != batch.column("r_blk")[i].as_py():
                r = _Block(batch, i, "r")
            yield x, r


def _block_count(n: int, block_rows: int) -> int:
    return max(1, math.ceil(n / block_rows))


def pairwise_projection(
    x: DataFrame,
    ref: DataFrame,
    metric: str = "cosine",
    block_rows: int = 1024,
    symmetric: bool = False,
    reduce: TopCells | None = None,
    reduce_schema: str | None = None,
    coef: list[float] | None = None,
    intercept: float = 0.0,
    whole_rows: bool = False,
) -> DataFrame | RowScores:
    """Scores (x_id, ref_id, ref_author, p) for every x row against every ref row.

    ``x``/``ref``: (doc_id, vec[, author]).  Two count actions (scalars) give the numbers
    of packed rows; ``block_rows`` rows of x are scored at once.  With ``symmetric`` (x is
    ref, no ``reduce``) only one order of two blocks is scored and mirrored.  With
    ``reduce`` a task emits its best cells only (schema ``reduce_schema``).  ``whole_rows``:
    the ``RowScores``, which a learner has its tasks score whenever it reads them.
    """
    if whole_rows:
        return RowScores(x, ref, metric, coef, intercept, tasks=FIT_TASKS)
    nx = x.count()
    nr = nx if symmetric else ref.count()
    bx, br = _block_count(nx, PACK_ROWS), _block_count(nr, PACK_ROWS)
    mirrored = symmetric and reduce is None
    xb = _pack(x, nx, PACK_ROWS, bx)
    # as many parts of the references as tasks are wanted besides those of x: each part gives its own best cells
    wanted = min(br, _block_count(task_count(ref), bx) if reduce is not None else task_count(ref))
    rb = xb if symmetric else _pack(ref, nr, PACK_ROWS, max(wanted, _block_count(br, PACKS)))
    both = _paired(xb, "x", rb, "r", F.col("x_blk") <= F.col("r_blk") if mirrored else None)
    cf = np.asarray(coef, dtype=float) if coef is not None else None

    def pack(columns: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    def chunks(b: _Block, r: _Block) -> Iterator[tuple[int, np.ndarray]]:
        for s in range(0, len(b.vecs), block_rows):
            yield s, np_scores(metric, b.vecs[s:s + block_rows], r.vecs, cf, intercept)

    def all_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, r in _block_pairs(batches):
            for s, S in chunks(b, r):
                i = np.repeat(np.arange(s, s + S.shape[0]), S.shape[1])
                j = np.tile(np.arange(S.shape[1]), S.shape[0])
                xi, rj, p = b.ids.take(pa.array(i)), r.ids.take(pa.array(j)), pa.array(S.ravel())
                yield pack({"x_id": xi, "ref_id": rj, "ref_author": r.authors.take(pa.array(j)), "p": p})
                if mirrored and b.blk != r.blk:
                    yield pack({"x_id": rj, "ref_id": xi, "ref_author": b.authors.take(pa.array(i)), "p": p})

    def best_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, codes, now, kept, held, bound, bests = [], {}, None, [], 0, 0, None

        def merged() -> list[np.ndarray]:
            return reduce.cut([np.concatenate(c) for c in zip(*kept)])

        def done() -> pa.RecordBatch:
            xi, author, ref, p = merged()
            columns = {"x_id": now.ids.take(pa.array(xi)), "ref_id": pa.array(ref)}
            if reduce.by_author:
                columns["ref_author"] = pa.array(names, pa.string()).take(pa.array(author))
            return pack(columns | {"p": pa.array(p), "key": pa.array(np.round(p, reduce.DIGITS))})

        for b, r in _block_pairs(batches):
            if now is not b:
                if kept:
                    yield done()
                now, kept, held, bound, bests = b, [], 0, 1 << 19, _Bests(reduce, len(b.ids))
            of = np.zeros(len(r.ids), dtype=np.int64)
            if reduce.by_author:
                for at, a in enumerate(r.authors.to_pylist()):
                    if a is not None and a not in codes:
                        codes[a] = len(names)
                        names.append(a)
                    of[at] = -1 if a is None else codes[a]  # a reference without author votes for none
            order = np.argsort(of, kind="stable")
            order = order[of[order] >= 0]
            if not len(order):
                continue
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(of[order])) + 1, [len(order)]))
            groups = [(int(of[order[s]]), slice(int(s), int(e))) for s, e in zip(cuts, cuts[1:])]
            refs, screen = r.ids.to_numpy(zero_copy_only=False)[order], _Screen(metric, b.vecs, r.vecs[order], cf, intercept)
            for s in range(0, len(b.vecs), block_rows):
                for g, i, j, p in screen.best(reduce, bests, groups, slice(s, min(s + block_rows, len(b.vecs)))):
                    kept.append([i, np.full(len(i), g), refs[j], p])
                    held += len(i)
                if held > bound:
                    kept = [merged()]
                    held = len(kept[0][0])
                    bound = max(1 << 19, 2 * held)
        if kept:
            yield done()

    if reduce is not None:
        return both.mapInArrow(best_cells, reduce_schema or reduce.schema)
    return both.mapInArrow(all_cells, "x_id long, ref_id long, ref_author string, p double")


def _held(rows: int, dims: int) -> np.ndarray:
    """Room for vectors: beyond ``HELD_BYTES`` a file of the task's own, without a name."""
    if rows * dims * 8 <= HELD_BYTES:
        return np.empty((rows, dims))
    return np.memmap(tempfile.TemporaryFile(), dtype=np.float64, mode="w+", shape=(rows, dims))


@dataclass
class References:
    """What a task knows of all references, in the order of the columns of a score row."""
    ids: np.ndarray
    authors: pa.Array
    vecs: np.ndarray
    own: dict  # the caller's, kept between the calls of a task


class RowScores:
    """Whole score rows of J11 where one row needs every reference.  x is packed into as many
    rows as tasks are wanted; a task reads all references once and then scores its part of x,
    a few rows at a time (``ROW_CELLS`` scores or a row), so nothing quadratic is stored and
    the references are read once a task."""

    def __init__(self, x: DataFrame, ref: DataFrame, metric: str, coef: list[float] | None = None, intercept: float = 0.0,
                 by_author: bool = False, tasks: int | None = None):
        self.metric, self.intercept, self.by_author = metric, intercept, by_author
        self.coef = np.asarray(coef, dtype=float) if coef is not None else None
        self.nx, self.nr = x.count(), ref.count()
        parts = max(_block_count(self.nx, TASK_ROWS), min(tasks or task_count(x), _block_count(self.nx, PACK_ROWS // 8)))
        self.x = _pack(x, self.nx, _block_count(self.nx, parts), parts)
        self.refs = _pack(ref, self.nr, PACK_ROWS, min(_block_count(self.nr, PACK_ROWS), task_count(ref))).coalesce(1)
        self.first = self.refs.agg(F.min("blk")).first()[0]

    def against(self, other: RowScores) -> RowScores:
        """The same rows against the references of ``other``, in their order there."""
        out = copy.copy(self)
        out.nr, out.refs, out.first = other.nr, other.refs, other.first
        return out

    @property
    def both(self) -> DataFrame:
        """Every packed row of the references with every part of x, which goes to its task beside one of them only."""
        first = F.col("r_blk") == F.lit(self.first)
        return _paired(self.refs, "r", self.x, "x").select(*[f"r_{c}" for c in self.refs.columns],
                                                           *[F.when(first, F.col(f"x_{c}")).alias(f"x_{c}") for c in self.x.columns])

    def run(self, each: Callable, schema: str, last: Callable | None = None) -> DataFrame:
        """``each(references, ids, authors, S)`` gets a few ids of x (Arrow) with their authors
        and the matrix of their scores, columns by ascending id (``by_author``: by author, then
        id; rows that share an id of x come together), and returns a record batch of ``schema``
        or None; ``last(references)`` may give one more per task."""
        nr, metric, coef, intercept, by_author = self.nr, self.metric, self.coef, self.intercept, self.by_author

        def read(batches: Iterator[pa.RecordBatch]) -> tuple[_Block | None, References | None]:
            x, held, ids, authors, at = None, None, [], [], 0
            for batch in batches:
                for i in range(batch.num_rows):
                    r = _Block(batch, i, "r")
                    held = _held(nr, r.vecs.shape[1]) if held is None else held
                    held[at:at + len(r.vecs)] = unit_rows(r.vecs) if metric == "cosine" else r.vecs
                    at += len(r.vecs)
                    ids.append(r.ids)
                    authors.append(r.authors)
                    if batch.column("x_blk")[i].is_valid:
                        x = _Block(batch, i, "x")
            if x is None:
                return None, None
            ids, authors = pa.concat_arrays(ids), pa.concat_arrays(authors)
            keys = [(("a", "ascending"))] if by_author else []
            order = pc.sort_indices(pa.table({"a": authors, "i": ids}), sort_keys=[*keys, ("i", "ascending")])
            to, vecs = order.to_numpy(), _held(nr, held.shape[1])
            for s in range(0, nr, PACK_ROWS):
                vecs[s:s + PACK_ROWS] = held[to[s:s + PACK_ROWS]]
            return x, References(ids.take(order).to_numpy(zero_copy_only=False), authors.take(order), vecs, {})

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x, refs = read(batches)
            if x is None:
                return
            own = x.ids.to_numpy(zero_copy_only=False)
            order = np.argsort(own, kind="stable")
            own, X = own[order], (unit_rows(x.vecs) if metric == "cosine" else x.vecs)[order]
            ends = np.append(np.flatnonzero(own[1:] != own[:-1]) + 1, len(own))  # where the next id begins
            step, s = max(1, ROW_CELLS // max(1, nr)), 0
            while s < len(own):
                e = int(ends[np.searchsorted(ends, min(s + step, len(own)))])
                S = np.empty((e - s, nr))
                for c in range(0, nr, PACK_ROWS):
                    cols = slice(c, c + PACK_ROWS)
                    if metric == "cosine":
                        np.matmul(X[s:e], refs.vecs[cols].T, out=S[:, cols])
                    else:
                        S[:, cols] = np_scores(metric, X[s:e], refs.vecs[cols], coef, intercept)
                some = pa.array(order[s:e])
                out = each(refs, x.ids.take(some), x.authors.take(some), S)
                if out is not None:
                    yield out
                s = e
            if last is not None:
                yield last(refs)

        return self.both.mapInArrow(scored, schema)


def projected_rows(x: DataFrame, ref: DataFrame, metric: str, each: Callable, schema: str,
                   coef: list[float] | None = None, intercept: float = 0.0) -> DataFrame:
    """``each`` applied to whole score rows of J11, see ``RowScores``."""
    return RowScores(x, ref, metric, coef, intercept).run(each, schema)


def principal_rows(x: DataFrame, ref: DataFrame) -> DataFrame:
    """The score rows S of the cosine (x against ``ref``: (doc_id, vec, ...)) in as many
    coordinates as vectors have: S is the unit rows of x times those of ``ref``, U V', so its
    rows lie in the columns of V; in an orthonormal base of them they are U (V'V)^(1/2), with the
    dot products and distances of S.  A learner that turning the axes leaves alone (any linear
    one with an L2 penalty) fits the same function on them.  ``vec`` of x is replaced."""
    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                v = unit_rows(_matrix(batch.column("vec")))
                total = v.T @ v + (0.0 if total is None else total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    # dims x dims numbers a task
    sums = [np.frombuffer(r["sums"]) for r in ref.select("vec").mapInArrow(squares, "sums binary").collect()]
    if not sums:
        return x
    dims = math.isqrt(len(sums[0]))
    size, axes = np.linalg.eigh(np.sum(sums, axis=0).reshape(dims, dims))
    root = (axes * np.sqrt(np.maximum(size, 0.0))) @ axes.T
    at = x.columns.index("vec")

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                z = unit_rows(_matrix(batch.column(at))) @ root
                ends = pa.array(np.arange(0, z.size + 1, dims, dtype=np.int32))
                yield batch.set_column(at, batch.schema.names[at], pa.ListArray.from_arrays(ends, pa.array(z.ravel())))

    return x.mapInArrow(turned, x.schema)
