"""Hierarchical multi-length packing of documents into training sequences.

Every document is tokenised whole and ends with an end id.  Its full windows of
the longest context become sequences at once; the rest is routed to the
shortest context tier that holds it.  Each tier is packed from the longest
down: a window opens with a piece of its own tier and its gap is filled with
the longest pieces of the same or shorter tiers that fit; what still stays open
is closed by cutting one more piece.  Windows of a tier are exactly as long as
the tier (a power of two), so only the last window of a task is padded.  The
finished windows are dealt into step groups of one tier with equal token counts
and balanced attention cost (sum of squared piece lengths).

One pass over the input splits, no shuffle: a task packs its own rows in
blocks of ``block_tokens`` ids, so memory does not grow with the partition, and
a lost task is simply run again with the same result.

Defined cases: a null or empty text is the end id alone; a null ``doc_id`` and
repeated rows are packed like any other row; an empty table gives no rows;
extra columns are ignored.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import KEPT_WORDS, worker_encoder

TIERS = (256, 512, 1024, 2048)
END_ID = 1
BLOCK_TOKENS = 1 << 20
STEP_WINDOWS = 8

PIECE_SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
                "offset long, sequence_length long, tier int, step_group long, ids binary")


class Piece:
    """Ids ``data`` (uint32 bytes) of one document from its position ``start``."""
    __slots__ = ("doc", "start", "data", "total")

    def __init__(self, doc, start: int, data: bytes, total: int):
        self.doc, self.start, self.data, self.total = doc, start, data, total

    def __len__(self) -> int:
        return len(self.data) // 4

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return (Piece(self.doc, self.start, self.data[:4 * n], self.total),
                Piece(self.doc, self.start + n, self.data[4 * n:], self.total))


class Pool:
    """Open pieces by length; ``mask`` has bit n set where a piece of n ids waits."""

    def __init__(self):
        self.by_length: dict[int, list[Piece]] = {}
        self.mask = 0
        self.tokens = 0

    def add(self, piece: Piece) -> None:
        n = len(piece)
        self.by_length.setdefault(n, []).append(piece)
        self.mask |= 1 << n
        self.tokens += n

    def longest(self, limit: int) -> int:
        """The greatest waiting length up to ``limit`` (0: none)."""
        return max(0, (self.mask & ((1 << (limit + 1)) - 1)).bit_length() - 1)

    def take(self, n: int) -> Piece:
        stack = self.by_length[n]
        piece = stack.pop()
        if not stack:
            self.mask &= ~(1 << n)
        self.tokens -= n
        return piece


def fill(pool: Pool, window: list[Piece], gap: int) -> int:
    """Close a window's gap from the pool; returns what stays open."""
    while gap and pool.tokens:
        n = pool.longest(gap)
        if n:
            window.append(pool.take(n))
            gap -= n
        else:  # only longer pieces wait: cut the shortest of them
            head, rest = pool.take((pool.mask & -pool.mask).bit_length() - 1).cut(gap)
            window.append(head)
            pool.add(rest)
            gap = 0
    return gap


def pack_tiers(pool: Pool, tiers: tuple[int, ...], last: bool) -> Iterator[tuple[int, list[Piece]]]:
    """(tier, window) from the longest tier down.  Unless ``last``, a window that
    the pool cannot close goes back to it for the next block."""
    for i in range(len(tiers) - 1, -1, -1):
        tier, floor = tiers[i], tiers[i - 1] if i else 0
        while (n := pool.longest(tier)) > floor:
            window = [pool.take(n)]
            gap = fill(pool, window, tier - n)
            if gap and not last:
                for piece in window:
                    pool.add(piece)
                return
            yield tier, window


def step_groups(windows: list[list[Piece]], size: int) -> list[int]:
    """Group number per window: groups of ``size`` windows, the costliest window
    always to the cheapest group with room (ties: lowest group)."""
    import heapq

    count = -(-len(windows) // size)
    heap = [(0, g, 0) for g in range(count)]
    of = [0] * len(windows)
    cost = [sum(len(p) ** 2 for p in w) for w in windows]
    for i in sorted(range(len(windows)), key=lambda i: -cost[i]):
        total, g, held = heapq.heappop(heap)
        of[i] = g
        if held + 1 < size:
            heapq.heappush(heap, (total + cost[i], g, held + 1))
    return of


class TaskPacker:
    """Packs the documents of one task, block by block."""

    def __init__(self, first_id: int, tiers: tuple[int, ...], block_tokens: int, step_windows: int, with_ids: bool):
        self.tiers, self.block, self.step, self.with_ids = tiers, block_tokens, step_windows, with_ids
        self.pool, self.full = Pool(), []
        self.held = 0
        self.next_id = self.next_group = first_id

    def add(self, doc, ids: bytes) -> Iterator[pd.DataFrame]:
        total, longest = len(ids) // 4, self.tiers[-1]
        for start in range(0, total, longest):
            piece = Piece(doc, start, ids[4 * start:4 * (start + longest)], total)
            if len(piece) == longest:
                self.full.append([piece])
            else:
                self.pool.add(piece)
            self.held += len(piece)
            if self.held >= self.block:
                yield self.flush(False)

    def flush(self, last: bool) -> pd.DataFrame:
        by_tier: dict[int, list[list[Piece]]] = {t: [] for t in self.tiers}
        by_tier[self.tiers[-1]], self.full = self.full, []
        for tier, window in pack_tiers(self.pool, self.tiers, last):
            by_tier[tier].append(window)
        self.held = self.pool.tokens
        rows = []
        for tier in self.tiers:
            windows = by_tier[tier]
            groups = step_groups(windows, self.step)
            for window, group in zip(windows, groups):
                length, offset = sum(map(len, window)), 0
                padded = length if length & (length - 1) == 0 else self.tiers[-1]
                for p in window:
                    rows.append((p.doc, p.start, len(p), zlib.crc32(p.data), p.total, self.next_id, offset, padded,
                                 tier, self.next_group + group, p.data if self.with_ids else None))
                    offset += len(p)
                self.next_id += 1
            self.next_group += max(groups, default=-1) + 1
        columns = [c.split()[0] for c in PIECE_SCHEMA.split(", ")]
        return pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"})


def pack(docs: DataFrame, tokenizer_file: str | None = None, tiers: tuple[int, ...] = TIERS, end_id: int = END_ID,
         block_tokens: int = BLOCK_TOKENS, step_windows: int = STEP_WINDOWS, with_ids: bool = True,
         kept_words: int = KEPT_WORDS) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text): where its ids lie in its
    document and in its sequence, the sequence's padded length and step group,
    and, unless ``with_ids`` is false, the ids (little-endian uint32).  A Python
    worker keeps the ids of ``kept_words`` words.

    Sequence and group ids are the task's number times 2^36 plus a count."""
    tiers = tuple(sorted(tiers))
    if any(t & (t - 1) for t in tiers):
        raise ValueError("context tiers must be powers of two")
    tail = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = TaskPacker(TaskContext.get().partitionId() << 36, tiers, block_tokens, step_windows, with_ids)
        encoder = worker_encoder(tokenizer_file, kept_words)
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch["text"]]
            docs_of = [None if pd.isna(d) else int(d) for d in batch["doc_id"]]
            for doc, ids in zip(docs_of, encoder.encode(texts)):
                yield from packer.add(doc, ids + tail)
        yield packer.flush(True)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, PIECE_SCHEMA)


def op1_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens, one row per piece."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False).drop("ids")
