"""Spelling variant groups by a bit-sliced position index.

1. Every distinct run of letters of a document is counted, partial counts per
   task, then summed by word.  Words with enough code points and occurrences are
   the vocabulary.
2. Two words at one edit agree on a half: with m the length of the shorter and
   h = m // 2, an edit at position h or later leaves the first h characters, an
   earlier one leaves the last m - h.  For each m, words of m and m + 1
   characters are dealt into groups by the hash of that half, so all near words
   of a word are among its four groups.  A group beyond ``GROUP_WORDS`` words (a
   very common beginning) is split into blocks, and each block's words are
   looked up in each block.
3. A group keeps, per position and letter, the bitset of its words with that
   letter there.  All its words are looked up at once, 64 words per machine
   word: exact matches Z, and matches with one replaced (S), one inserted (I) or
   one deleted (D) letter, advance letter by letter; S reads the position
   itself, I the next and D the one before.  Z after h letters tells the two
   halves' groups apart, so a pair is found exactly once.
4. A group returns per word the count of its near words and the best of them.
   Forms are followed to their roots by pointer doubling: each step multiplies
   the count by ``RATIO``, so a chain of 64-bit counts ends within 32 links.

Defined cases: null and empty texts have no words; a null doc_id is written as
the text ``null`` in the hash; rows that share a doc_id count one by one; ties
go to the smaller word in code-point order; an empty table or vocabulary gives
no rows; very long words are words like others; extra columns are ignored.
"""
from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save

RUN = "[A-Za-zÀ-ÿ]+"
DIVISOR = 199
MIN_LENGTH = 6
MIN_COUNT = 5
RATIO = 5
GROUP_WORDS = 4096
#: Distinct words of a task whose partial counts are held before they are sent on.
HELD_WORDS = 400_000
LINKS_LOG2 = 5


def noted_words(doc, text: str, find, min_length: int) -> Iterator[tuple[str, int]]:
    """(word, occurrences) of one text, one letter deleted where the hash says so."""
    data = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # bytes: A-Z only
    head = zlib.crc32(f"{'null' if doc is None else doc}:".encode())
    crc = zlib.crc32
    for run, n in Counter(find(data)).items():
        h = crc(run.encode(), head)
        if h % DIVISOR == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        if len(run) >= min_length:
            yield run, n


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of all words of ``docs`` (doc_id, text) that are long and common enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, total = re.compile(RUN).findall, Counter()

        def send() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": pa.array(list(total), pa.string()),
                                               "n": pa.array(list(total.values()), pa.int64())})

        for batch in batches:
            texts = batch.column("text")
            for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                for word, n in noted_words(doc, texts[i].as_py() or "", find, min_length):
                    total[word] += n
                if len(total) >= HELD_WORDS:
                    yield send()
                    total.clear()
        if total:
            yield send()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return save(counts.where(F.col("n") >= min_count), "vocabulary")


def positions(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points per (word, position), numbered from 1 (0: past the end), and lengths."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    _, codes = np.unique(points, return_inverse=True)
    out = np.zeros((len(words), width), dtype=np.int32)
    out[np.arange(width) < lengths[:, None]] = codes + 1
    return out, lengths


def bits(flags: np.ndarray) -> np.ndarray:
    """Bitsets (64-bit words) of the last axis, whose length is a multiple of 64."""
    return np.packbits(flags, axis=-1, bitorder="little").view(np.uint64)


def near_in_group(words: list[str], is_query: np.ndarray, is_target: np.ndarray, m: int, prefix: bool) -> Iterator[tuple[int, np.ndarray]]:
    """(query, near targets) as indexes of ``words`` (m or m + 1 characters): the pairs
    one edit apart whose first m // 2 characters agree (``prefix``) or do not."""
    if len(words) < 2:
        return
    codes, lengths = positions(words, m + 2)
    targets, queries = np.flatnonzero(is_target), np.flatnonzero(is_query)
    padded = -(-len(targets) // 64) * 64
    of_target = np.full((padded, m + 2), -1, dtype=np.int32)
    of_target[:len(targets)] = codes[targets]
    letters = int(codes.max()) + 1
    every = bits(np.arange(padded) < len(targets))
    has_length = {n: bits(of_target[:, n - 1] > 0) & ~bits(of_target[:, n] > 0) & every for n in (m, m + 1)}

    def index(position: int) -> np.ndarray:
        """Per letter the bitset of targets with that letter at this position."""
        flags = np.zeros((letters, padded), dtype=bool)
        if 0 <= position < m + 2:
            held = of_target[:, position] >= 0
            flags[of_target[held, position], np.flatnonzero(held)] = True
        return bits(flags)

    q, q_length = codes[queries], lengths[queries]
    z = np.broadcast_to(every, (len(q), len(every))).copy()
    s, i, d = np.zeros_like(z), z.copy(), np.zeros_like(z)
    half = z
    before, here, after = index(-1), index(0), index(1)
    hits = np.zeros_like(z)
    for at in range(m + 1):
        if at == m:  # queries of m characters end here
            short = (q_length == m)[:, None]
            hits |= np.where(short, (s & has_length[m]) | (i & has_length[m + 1]), 0).astype(np.uint64)
        letter = q[:, at]
        same = here[letter]
        z_next = z & same
        s = (s & same) | (z & ~same)
        i = (i & after[letter]) | z_next
        d = (d & before[letter]) | z
        z = z_next
        before, here, after = here, after, index(at + 2)
        if at + 1 == m // 2:
            half = z
    hits |= np.where((q_length == m + 1)[:, None], d & has_length[m], 0).astype(np.uint64)
    hits &= half if prefix else ~half
    for row in np.flatnonzero(hits.any(axis=1)):
        yield int(queries[row]), targets[np.flatnonzero(np.unpackbits(hits[row].view(np.uint8), bitorder="little"))]


def memberships(words: DataFrame, groups: int) -> DataFrame:
    """(word, n, m, prefix, bucket) of the four groups of every word."""
    size = F.char_length("word")
    kinds = F.array(*[F.struct((size - less).alias("m"), F.lit(p).alias("prefix")) for less in (0, 1) for p in (True, False)])
    rows = words.withColumn("__k", F.explode(kinds)).select("word", "n", "__k.m", "__k.prefix")
    h = F.floor(F.col("m") / 2).cast("int")
    half = F.when(F.col("prefix"), F.expr("substring(word, 1, cast(floor(m / 2) as int))")).otherwise(
        F.expr("right(word, m - cast(floor(m / 2) as int))"))
    return rows.where(h > 0).withColumn("bucket", F.pmod(F.xxhash64(half), F.lit(groups)).cast("long"))


def near_words(words: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """(word, n_near, best): per word of ``words`` (word, n) with near words their
    number and the best one (struct of minus n and the word)."""
    n = words.count()
    rows = memberships(words, max(1, -(-n // group_words)))
    keys = ["m", "prefix", "bucket"]
    blocks = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / group_words).cast("int").alias("blocks"))
    rows = rows.join(blocks, keys).withColumn("own", F.pmod(F.xxhash64("word", F.lit(7)), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    asked = rows.withColumn("j", other).select("word", "n", *keys, F.col("own").alias("q"), F.col("j").alias("t"),
                                               F.lit(True).alias("ask"), (F.col("own") == F.col("j")).alias("held"))
    stored = rows.withColumn("j", other).where("j <> own").select("word", "n", *keys, F.col("j").alias("q"), F.col("own").alias("t"),
                                                                  F.lit(False).alias("ask"), F.lit(True).alias("held"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        texts, counts = frame["word"].tolist(), frame["n"].to_numpy()
        out = []
        for q, near in near_in_group(texts, frame["ask"].to_numpy(), frame["held"].to_numpy(), int(frame["m"].iat[0]),
                                     bool(frame["prefix"].iat[0])):
            best = min((-int(counts[t]), texts[t]) for t in near)
            out.append((texts[q], len(near), *best))
        return pd.DataFrame(out, columns=["word", "found", "minus_n", "near"])

    found = asked.union(stored).groupBy(*keys, "q", "t").applyInPandas(run, "word string, found long, minus_n long, near string")
    return found.groupBy("word").agg(F.sum("found").alias("n_near"), F.min(F.struct("minus_n", "near")).alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root): every link (word, form) followed to its end by pointer doubling."""
    at = save(links.select("word", F.col("form").alias("root")), "links")
    for _ in range(LINKS_LOG2):
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = save(at.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "links")
    return at


def spelling_variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO,
                      group_words: int = GROUP_WORDS) -> DataFrame:
    """A row per vocabulary word of ``docs`` (doc_id, text): word, n, form (the near word
    of largest count, if ``ratio`` times as frequent), root, n_near, form_n."""
    words = vocabulary(docs, min_length, min_count)
    near = near_words(words, group_words)
    better = -F.col("best.minus_n") >= ratio * F.col("n")
    table = save(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(better, F.col("best.near")).alias("form"), F.when(better, -F.col("best.minus_n")).cast("long").alias("form_n")), "near-words")
    ends = roots(table.where("form is not null"))
    return table.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among all words of all documents."""
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
