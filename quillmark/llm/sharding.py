"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows are frozen in a written table with the partition and position they were
written at.  Row p of the matrix says how many rows of partition p go to each
shard.  Its law is that of a uniformly random permutation of all rows cut into
shards of the wanted sizes: multivariate hypergeometric with both margins fixed.
It is drawn in two levels: the driver draws the totals of groups of ``GROUP``
partitions (a row per group), then every group draws its own partitions in a
task, conditional on its total.

A partition permutes its positions with a seeded generator and cuts the
permutation by its matrix row (local permutation), rows are exchanged by shard,
and permuted again inside the shard: a row carries a random key, a shard is
dealt into key ranges of some ``BUCKET_ROWS`` rows, ranked there and offset by
the ranges before it.  So no task holds a shard or a hot source.

Everything is a function of (seed, partition, position) of the written table, so
a task that runs again after a lost executor gives the same rows, whatever
splits it reads.

Defined cases: null ids and texts, ties and repeated rows are rows like others;
empty tables and fewer rows than shards leave shards empty; a row's size does
not matter (law ``rows``); extra columns stay, added ones (shard, slot) replace
those of the same name.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grouping import bucketed_rank
from .common import save

SHARDS = 16
SEED = 29
#: Partitions whose matrix rows one task draws.
GROUP = 1024
BUCKET_ROWS = 1 << 18
#: NumPy's own sampler is exact below this population.
SMALL = 10 ** 9


def hypergeometric(good: int, bad: int, take: int, rng: np.random.Generator) -> int:
    """How many of ``take`` draws without replacement are good, at any population:
    beyond NumPy's, by inversion over ratios of neighbouring probabilities
    around the mode, as far as 14 standard deviations."""
    if good + bad < SMALL:
        return int(rng.hypergeometric(good, bad, take))
    low, high, total = max(0, take - bad), min(good, take), good + bad
    mode = (take + 1) * (good + 1) // (total + 2)
    width = 50 + int(14 * math.sqrt(take * (good / total) * (bad / total) * max(1, total - take) / max(1, total - 1)))
    a, b = max(low, mode - width), min(high, mode + width)
    k = np.arange(a, b, dtype=np.float64)
    ratio = np.log(good - k) + np.log(take - k) - np.log(k + 1) - np.log(bad - take + k + 1)
    weight = np.concatenate(([0.0], np.cumsum(ratio)))
    weight = np.exp(weight - weight.max())
    return a + int(np.searchsorted(np.cumsum(weight) / weight.sum(), rng.random(), "right"))


def draw_row(room: list[int], take: int, rng: np.random.Generator) -> list[int]:
    """Multivariate hypergeometric: ``take`` rows dealt to columns with ``room`` left."""
    row, rest = [], sum(room)
    for space in room:
        n = hypergeometric(space, rest - space, take, rng) if take else 0
        row.append(n)
        rest -= space
        take -= n
    return row


def draw_matrix(rows: list[int], columns: list[int], rng: np.random.Generator) -> list[list[int]]:
    """A matrix with these row and column sums, row by row from what is left."""
    room, out = list(columns), []
    for take in rows:
        out.append(draw_row(room, take, rng))
        room = [a - b for a, b in zip(room, out[-1])]
    return out


def shard_sizes(n: int, shards: int, seed: int) -> list[int]:
    """Sizes at most one apart; seeded choice of the larger ones."""
    extra = set(np.random.default_rng([seed, 1]).permutation(shards)[:n % shards].tolist())
    return [n // shards + (s in extra) for s in range(shards)]


def matrix(counts: DataFrame, sizes: list[int], seed: int, group: int = GROUP) -> DataFrame:
    """(part, row): the communication matrix for ``counts`` (part, n)."""
    grouped = counts.withColumn("g", F.floor(F.col("part") / group).cast("long"))
    totals = grouped.groupBy("g").agg(F.sum("n").alias("n")).orderBy("g").collect()  # a row per ``group`` partitions
    drawn = draw_matrix([r["n"] for r in totals], sizes, np.random.default_rng([seed, 2]))
    plan = counts.sparkSession.createDataFrame([(r["g"], row) for r, row in zip(totals, drawn)], "g long, sums array<long>")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("part")
        rng = np.random.default_rng([seed, 3, int(frame["g"].iat[0])])
        rows = draw_matrix([int(n) for n in frame["n"]], [int(x) for x in frame["sums"].iat[0]], rng)
        return pd.DataFrame({"part": frame["part"].to_numpy(), "row": rows})

    return save(grouped.join(plan, "g").groupBy("g").applyInPandas(run, "part long, row array<long>"), "matrix")


def place(frozen: DataFrame, rows: DataFrame, seed: int) -> DataFrame:
    """Adds ``shard`` and ``__key`` to ``frozen`` by its ``__part`` and ``__at``: the
    partition's seeded permutation cut by its matrix row, and a random key."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, shard_of, keys = None, None, None
        for frame in frames:
            shard = np.empty(len(frame), dtype=np.int32)
            key = np.empty(len(frame), dtype=np.float64)
            parts, at = frame["__part"].to_numpy(), frame["__at"].to_numpy()
            cuts = np.flatnonzero(np.r_[True, parts[1:] != parts[:-1]]).tolist() + [len(parts)]
            for a, b in zip(cuts, cuts[1:]):
                if parts[a] != part:
                    part, row = parts[a], frame["row"].iat[a]
                    rng = np.random.default_rng([seed, 4, int(part)])
                    shard_of = np.repeat(np.arange(len(row)), row)[rng.permutation(int(sum(row)))]
                    keys = rng.random(len(shard_of))
                shard[a:b], key[a:b] = shard_of[at[a:b]], keys[at[a:b]]
            yield pd.DataFrame({"__part": parts, "__at": at, "shard": shard, "__key": key})

    placed = frozen.select("__part", "__at").join(rows.withColumnRenamed("part", "__part"), "__part")
    return placed.mapInPandas(run, "__part long, __at long, shard int, __key double")


def shuffle_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS,
                   group: int = GROUP) -> DataFrame:
    """``docs`` with shard (0 to shards - 1) and slot (gapless from 0 in its shard):
    a uniformly random order of all rows in shards whose counts are at most one apart."""
    docs = docs.drop("shard", "slot")
    spot = F.monotonically_increasing_id()  # partition in the upper 31 bits, position in the lower 33
    frozen = save(docs.withColumn("__spot", spot), "frozen")
    frozen = (frozen.withColumn("__part", F.shiftright("__spot", 33))
              .withColumn("__at", F.col("__spot").bitwiseAND(F.lit((1 << 33) - 1))).drop("__spot"))
    counts = save(frozen.groupBy(F.col("__part").alias("part")).agg(F.count(F.lit(1)).alias("n")), "partitions")
    n = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = matrix(counts, shard_sizes(n, shards, seed), seed, group)
    buckets = max(1, -(-n // (shards * bucket_rows)))
    where = place(frozen, rows, seed)
    ranked = bucketed_rank(where, ["shard"], ["__key", "__part", "__at"], F.floor(F.col("__key") * buckets), "slot")
    ranked = ranked.select("__part", "__at", "shard", (F.col("slot") - 1).alias("slot"))
    return frozen.join(ranked, ["__part", "__at"]).drop("__part", "__at")


def write_shards(placed: DataFrame, path: str) -> None:
    """Shard folders of ``shuffle_shards`` rows, each shard's files in slot order."""
    step = F.floor(F.col("slot") / BUCKET_ROWS)
    (placed.withColumn("__step", step).repartition("shard", "__step").sortWithinPartitions("shard", "slot").drop("__step")
     .write.partitionBy("shard").parquet(path))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents shuffled into 16 shards."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    data = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.length(data) + 1).cast("long").alias("size"),
                       F.crc32(data).alias("text_crc32"))
    return shuffle_shards(slim).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                                       F.lit(None).cast("int").alias("grown_shard"))
