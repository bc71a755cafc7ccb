"""Vectors in blocks: a searched table as blocks of bounded size, and a query set
as blocks of bounded size, every pair of which is one task's work.

Rows fall into blocks by a hash of their id, so sizes are even whatever the data.
Each block pair meets once; a block keeps the best ``k`` rows of each query and a
window joins the blocks' answers.  Nothing passes the driver but row counts.
"""
from __future__ import annotations

import io
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save

BLOCK_ROWS = 8192
QUERY_ROWS = 4096


def usable(vectors: DataFrame, nonzero: bool) -> DataFrame:
    """(vec_id, embedding as doubles) of the rows that take part: an id, a vector
    without null or non-finite components, and (``nonzero``) not all zero."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                       F.col("embedding").cast("array<double>").alias("embedding"))
    inf = float("inf")

    def odd(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == inf)

    v = v.where("vec_id is not null and embedding is not null").where(F.size("embedding") > 0)
    v = v.where(~F.exists("embedding", odd))
    return v.where(F.exists("embedding", lambda x: x != 0)) if nonzero else v


def pack(rows: DataFrame, block_rows: int, name: str,
         build: Callable[[np.ndarray, np.ndarray], bytes]) -> tuple[DataFrame, int]:
    """(block, dims, data): ``build(ids, matrix)`` of each block's rows of one length by
    ascending id, written to the shared folder, and the number of blocks.  Rows are
    dealt by id and position, so neither a repeated id nor a repeated vector fills a block."""
    count = max(1, -(-rows.count() // block_rows))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        x, ids = np.stack(frame["embedding"].to_numpy()).astype(np.float64), frame["vec_id"].to_numpy()
        order = np.lexsort((x[:, 0], ids))
        return pd.DataFrame({"block": frame["block"].iloc[:1].to_numpy(), "dims": [x.shape[1]],
                             "data": [build(ids[order], x[order])]})

    spot = F.xxhash64("vec_id", F.monotonically_increasing_id())
    placed = rows.withColumn("block", F.pmod(spot, F.lit(count)).cast("int")).withColumn("dims", F.size("embedding"))
    return save(placed.groupBy("block", "dims").applyInPandas(run, "block int, dims int, data binary"), name), count


def search_blocks(index: tuple[DataFrame, int], queries: tuple[DataFrame, int],
                  search: Callable[[bytes, bytes], pd.DataFrame], schema: str) -> DataFrame:
    """``search(index data, query data)`` for every pair of an index and a query block,
    among vectors of equal length."""
    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        wanted = dict(zip(right["dims"], right["data"]))
        found = [search(data, wanted[dims]) for dims, data in zip(left["dims"], left["data"]) if dims in wanted]
        return pd.concat(found) if found else pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})

    left = index[0].select("block", "dims", every(queries[1]).alias("part"), "data")
    right = queries[0].select(every(index[1]).alias("block"), "dims", F.col("block").alias("part"), "data")
    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(run, schema)


def best(found: DataFrame, k: int) -> DataFrame:
    """Rows (query_id, vec_id, score) ranked per query: highest score, then smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def to_bytes(**arrays: np.ndarray) -> bytes:
    buffer = io.BytesIO()
    np.savez(buffer, **arrays)
    return buffer.getvalue()


def from_bytes(data: bytes) -> dict[str, np.ndarray]:
    return dict(np.load(io.BytesIO(data)))


def packed_rows(ids: np.ndarray, matrix: np.ndarray) -> bytes:
    return to_bytes(ids=ids, x=matrix)
