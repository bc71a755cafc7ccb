"""Interaction audit of document filters over a sparse document-term matrix.

1. A task splits its documents into words and closes a block whenever it holds
   ``block_chars`` characters (whole documents only).  A block is a CSR matrix
   (row pointers, sorted columns, counts) over a dictionary that up to
   ``DICTIONARY_BLOCKS`` blocks of the task share while it stays small.
2. The dictionaries are unified: all (dictionary, word) entries are dealt by
   the word's hash and ranked, which numbers every distinct word of the corpus
   from 0 without a gap.  Only dictionary entries are shuffled, never tokens.
3. The numbers go back to their dictionary's blocks, whose columns become global:
   CSR shards.
4. Row sums and non-zero counts of the shards give filters A (too few words) and
   B (too few distinct words).  The flags C (capitals), D (odd signs) and E
   (same text as a smaller doc_id) are attached, and documents are counted by
   (part, set of failed filters, quality, toxicity): at most 128 rows a part.
5. From these counts follow all orders and steps.  A filter's figures depend
   only on the set of filters before it, so 80 (filter, set before) rows a part
   are summed and the 600 (order, step) rows look theirs up.

Defined cases: a null text is empty (fails A; equal to other empty texts); a
null source is the part ''; a null doc_id is neither smaller nor larger than
another (E never fails) and has no labels; rows that share a doc_id count one
by one and are not duplicates of each other, a label counts if any of its rows
sets it; an empty table gives no rows; a very long text is a block of its own;
extra columns are ignored.  Texts are compared by their SHA-256.
"""
from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.grouping import task_count
from .common import bound_batches, save, tidy

MIN_WORDS = 50
DISTINCT_PERCENT = 65
CAPITAL_PERCENT = 5
ODD_SIGNS = "#$%&*|"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FILTERS = "ABCDE"
BLOCK_CHARS = 1 << 22
#: A dictionary is closed with the block that brings it to so many words or blocks.
DICTIONARY_WORDS = 300_000
DICTIONARY_BLOCKS = 32
A, B, C, D, E = (1 << i for i in range(5))

CSR = "block long, dictionary long, doc_ids binary, no_id binary, parts array<string>, flags binary, digests binary, indptr binary, cols binary, counts binary"
BLOCK_SCHEMA = CSR + ", words array<binary>"


def pack_ints(values: np.ndarray) -> bytes:
    """Unsigned 32-bit integers, byte planes apart, compressed."""
    import zstandard

    planes = np.ascontiguousarray(values.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_ints(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


class Block:
    """Documents of one CSR block while it is built."""

    def __init__(self, local: dict[bytes, int]):
        self.local = local
        self.doc_ids, self.parts, self.flags, self.digests, self.rows = [], [], bytearray(), [], []
        self.chars = 0

    def add(self, doc, text: str, part: str) -> None:
        data = text.encode("utf-8", "surrogatepass")
        words = data.split()  # bytes: splits at ASCII white space only
        self.rows.append(np.fromiter(map(self.local.__getitem__, words), dtype=np.int32, count=len(words)))
        capitals = len(data) - len(data.translate(None, CAPITALS))
        self.flags.append(C * (100 * capitals > CAPITAL_PERCENT * len(text)) | D * any(c in text for c in ODD_SIGNS))
        self.digests.append(hashlib.sha256(data).digest())
        self.doc_ids.append(doc)
        self.parts.append(part)
        self.chars += len(text)

    def close(self, number: int, dictionary: int, last: bool) -> dict[str, list]:
        n, width = len(self.rows), max(1, len(self.local))
        doc = np.repeat(np.arange(n, dtype=np.int64), np.array([len(r) for r in self.rows], dtype=np.int64))
        doc *= width
        doc += np.concatenate([np.empty(0, np.int32), *self.rows])
        self.rows = []
        keys, counts = np.unique(doc, return_counts=True)
        row, col = np.divmod(keys, width)
        indptr = np.searchsorted(row, np.arange(n + 1))
        step = np.diff(col, prepend=0)  # sorted columns are kept as steps from the one before
        step[indptr[:-1][indptr[:-1] < len(col)]] = col[indptr[:-1][indptr[:-1] < len(col)]]
        no_id = np.array([d is None for d in self.doc_ids])
        ids = np.array([0 if d is None else d for d in self.doc_ids], dtype="<i8")
        return {
            "block": [number], "dictionary": [dictionary], "doc_ids": [ids.tobytes()], "no_id": [no_id.tobytes()], "parts": [self.parts],
            "flags": [bytes(self.flags)], "digests": [b"".join(self.digests)], "indptr": [pack_ints(indptr)],
            "cols": [pack_ints(step)], "counts": [pack_ints(counts)], "words": [list(self.local) if last else []]}


def new_dictionary() -> dict[bytes, int]:
    """Numbers words in the order in which they are first looked up."""
    local: dict[bytes, int] = defaultdict()
    local.default_factory = local.__len__
    return local


def csr_blocks(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """CSR blocks over block dictionaries of ``docs`` (doc_id, text, source), written."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(BLOCK_SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = dictionary = TaskContext.get().partitionId() << 32
        block = Block(new_dictionary())

        def close(last: bool) -> pa.RecordBatch:
            nonlocal number, dictionary, block
            last = last or len(block.local) >= DICTIONARY_WORDS or number - dictionary + 1 >= DICTIONARY_BLOCKS
            columns = block.close(number, dictionary, last)
            number, block = number + 1, Block(new_dictionary() if last else block.local)
            dictionary = number if last else dictionary
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)

        for batch in batches:
            texts = batch.column("text")
            for i, (doc, part) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("part").to_pylist())):
                block.add(doc, texts[i].as_py() or "", part)
                if block.chars >= block_chars:
                    yield close(False)
        if block.rows or number > dictionary:
            yield close(True)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"))
    bound_batches(docs.sparkSession)
    return save(rows.mapInArrow(tidy(run), BLOCK_SCHEMA), "csr-blocks")


def word_codes(blocks: DataFrame) -> DataFrame:
    """(dictionary, pos, id): the global number of every entry of every dictionary, written.

    Equal words share a hash bucket; the number is the word's rank in its bucket
    plus the words of the buckets before it."""
    buckets = 4 * task_count(blocks)
    entries = blocks.select("dictionary", F.posexplode("words").alias("pos", "word"))
    entries = entries.withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(buckets)).cast("int"))
    rank = F.dense_rank().over(Window.partitionBy("bucket").orderBy("word"))
    ranked = save(entries.select("dictionary", "pos", "bucket", (rank - 1).alias("rank")), "word-ranks")
    sizes = ranked.groupBy("bucket").agg((F.max("rank") + 1).cast("long").alias("n"))
    start = sizes.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("start"))
    # a row per bucket: four times the shuffle's tasks at most
    return ranked.join(F.broadcast(start), "bucket").select("dictionary", "pos", (F.col("start") + F.col("rank")).alias("id"))


def csr_shards(blocks: DataFrame, codes: DataFrame) -> DataFrame:
    """The blocks with global columns (unsigned 64-bit ids, row by row)."""
    columns = [c.strip().split()[0] for c in CSR.split(", ")]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ids = np.zeros(len(right), dtype="<u8")
        ids[right["pos"].to_numpy()] = right["id"].to_numpy()
        encoded = []
        for starts, steps in zip(left["indptr"], left["cols"]):
            indptr, col = unpack_ints(starts).astype(np.int64), unpack_ints(steps).astype(np.int64)
            if len(col):
                total = np.cumsum(col)
                first = np.minimum(indptr[:-1], len(col) - 1)
                col = total - np.repeat(total[first] - col[first], np.diff(indptr))
            encoded.append(ids[col].tobytes())
        kept = {c: left[c].tolist() for c in columns if c != "cols"} | {"cols": encoded}
        return pd.DataFrame({c: pd.Series(kept[c], dtype=object) for c in columns})

    return (blocks.select(*columns).groupBy("dictionary").cogroup(codes.groupBy("dictionary")).applyInPandas(run, CSR))


def document_flags(shards: DataFrame) -> DataFrame:
    """(doc_id, part, words, distinct_words, failed, digest): ``failed`` has the bits
    of A and B from row sums and non-zero counts, and of C and D."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                if not len(r.parts):  # a block that only closed its dictionary
                    continue
                indptr = unpack_ints(r.indptr).astype(np.int64)
                running = np.concatenate(([0], np.cumsum(unpack_ints(r.counts), dtype=np.int64)))
                words, distinct = running[indptr[1:]] - running[indptr[:-1]], np.diff(indptr)
                failed = (np.frombuffer(r.flags, np.uint8) | np.where(words < MIN_WORDS, A, 0)
                          | np.where(100 * distinct < DISTINCT_PERCENT * words, B, 0))
                ids = pd.Series(np.frombuffer(r.doc_ids, "<i8"), dtype="Int64").mask(np.frombuffer(r.no_id, bool))
                digests = [r.digests[i:i + 32] for i in range(0, len(r.digests), 32)]
                yield pd.DataFrame({"doc_id": ids, "part": list(r.parts), "words": words, "distinct_words": distinct,
                                    "failed": failed.astype(np.int32), "digest": digests})

    needed = shards.select("doc_ids", "no_id", "parts", "flags", "digests", "indptr", "counts", F.length("cols").alias("size"))
    return needed.mapInPandas(tidy(run), "doc_id long, part string, words long, distinct_words long, failed int, digest binary")


def attach_copies(rows: DataFrame) -> DataFrame:
    """Adds filter E to ``failed``: another row with the same digest has a smaller
    doc_id.  The smallest ids are found with partial sums and joined back by
    (digest, doc_id), so a large group of copies is never one task's."""
    first = (rows.where("doc_id is not null").groupBy(F.col("digest").alias("d")).agg(F.min("doc_id").alias("first")))
    joined = rows.join(first, (F.col("digest") == F.col("d")) & (F.col("doc_id") == F.col("first")), "left")
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return joined.withColumn("failed", F.col("failed") + F.when(copy, E).otherwise(0)).drop("d", "first", "digest")


def step_table(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Fixed tables: what a document that failed ``failed`` counts as for a filter
    after the set ``before`` (80 x 32 rows), and the 600 (order, step) rows."""
    sets = [(f, before) for f in range(5) for before in range(32) if not before >> f & 1]
    cells = []
    for f, before in sets:
        bit = 1 << f
        for failed in range(32):
            fails, gone = bool(failed & bit), bool(failed & before)
            cells.append((f, before, failed, int(not failed & (before | bit)), int(fails and not gone),
                          int(fails and gone), int(failed == bit)))
    steps, reach = [], defaultdict(int)
    for order in permutations(range(5)):
        before = 0
        for step, f in enumerate(order, 1):
            steps.append(("".join(FILTERS[i] for i in order), step, f, before))
            reach[f, before] += 1
            before |= 1 << f
    cell_table = spark.createDataFrame([(*c, reach[c[0], c[1]]) for c in cells],
                                       "f int, before int, failed int, k int, r int, red int, u int, orders long")
    return cell_table, spark.createDataFrame(steps, "filter_order string, step int, f int, before int")


def audit(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of ``rows`` (doc_id, part, failed): a row per (part, filter_order, step)."""
    marks = (labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"),
                  F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic")))
    marked = rows.select("doc_id", "part", "failed").join(marks, "doc_id", "left").na.fill(0, ["good", "toxic"])
    counts = marked.groupBy("part", "failed").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"),
                                                  F.sum("toxic").alias("toxic"))
    cells, steps = step_table(rows.sparkSession)  # fixed tables of 2,560 and 600 rows
    sums = counts.join(F.broadcast(cells), "failed").groupBy("part", "f", "before", "orders").agg(
        F.sum(F.col("n") * F.col("k")).alias("kept"), F.sum(F.col("n") * F.col("r")).alias("removed"),
        F.sum(F.col("n") * F.col("red")).alias("redundant"), F.sum(F.col("n") * F.col("u")).alias("unique_fails"),
        F.sum(F.col("good") * F.col("r")).alias("good_lost"), F.sum(F.col("toxic") * F.col("r")).alias("toxic_lost"))
    shapley = F.sum(F.col("removed") * F.col("orders")).over(Window.partitionBy("part", "f"))
    return (sums.withColumn("shapley", shapley).join(F.broadcast(steps), ["f", "before"])
            .select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost",
                    "toxic_lost", "shapley"))


def filter_audit(docs: DataFrame, labels: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Audit of the five filters on ``docs`` (doc_id, text, source) with ``labels``."""
    blocks = csr_blocks(docs, block_chars)
    flags = save(document_flags(csr_shards(blocks, word_codes(blocks))), "document-flags")
    return audit(attach_copies(flags), labels)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of the five filters over all documents, a row per part, order and step."""
    return filter_audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP11_SQL = r"""
WITH raw AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part FROM documents),
d AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
        coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS copy FROM raw),
g AS (SELECT doc_id, part,
        (CASE WHEN len(w) < 50 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN copy THEN 16 ELSE 0 END)::INT AS failed FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
c AS (SELECT part, failed, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
      FROM g LEFT JOIN l ON g.doc_id = l.doc_id GROUP BY part, failed),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(name, bit)),
o AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
      FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
s AS (SELECT filter_order, step::INT AS step, bits[step] AS bit, list_sum(bits[1:step - 1])::INT AS before FROM o, range(1, 6) r(step)),
x AS (SELECT part, filter_order, step, bit, coalesce(before, 0)::INT AS before FROM s, (SELECT DISTINCT part FROM c)),
y AS (SELECT x.part, filter_order, step, x.bit,
        sum(CASE WHEN failed & (before | x.bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
        sum(CASE WHEN failed & x.bit > 0 AND failed & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
        sum(CASE WHEN failed & x.bit > 0 AND failed & before > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
        sum(CASE WHEN failed = x.bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
        sum(CASE WHEN failed & x.bit > 0 AND failed & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
        sum(CASE WHEN failed & x.bit > 0 AND failed & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
      FROM x JOIN c ON c.part = x.part GROUP BY x.part, filter_order, step, x.bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM y
"""
