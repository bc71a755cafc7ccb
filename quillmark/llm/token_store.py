"""Token ids in shard files, each a wavelet matrix.

Documents are range-partitioned by ``doc_id``; a task tokenises its rows in
ascending order and closes a shard file whenever it holds ``shard_tokens`` ids
(whole documents only).  A shard stores its ids as succinct bit planes: plane l
holds bit l (from the highest) of every id, in the order left by stably sorting
on the planes above it.  From the one compressed file follow access(i),
rank(id, i), count(id), select(id, k), locate(id) and the whole sequence.

File (little-endian): magic ``QMWM``, version u32, task u32, shard u32, ids u64,
documents u64, planes u32, then per section (document ids, document starts,
zero counts, each plane) its compressed length u64, then the sections, each
zstd-compressed.  Rank directories (ones before every 64-bit word) are rebuilt
when a file is opened.

A file has a fixed name by task and shard and is moved into place when
complete, so a task that runs again after a lost executor, or twice, leaves the
same files.  They lie in the session's shared folder.

Defined cases: a null or empty text is the end id alone; a null doc_id comes
first; rows that share a doc_id follow each other in text order; an empty table
writes no files and gives no rows; extra columns are ignored.
"""
from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import save
from .tokens import worker_encoder

SHARD_TOKENS = 1 << 20
END_ID = 0
#: Pieces a worker keeps, some 300 MB.
KEPT_WORDS = 2_000_000
MAGIC = b"QMWM"
HEAD = "<4sIIIQQI"
NULL_DOC = -(1 << 63)

MANIFEST = "part int, shard int, file string, n_docs long, n_tokens long, n_bytes long"


class WaveletMatrix:
    """Bit planes of a sequence of ids, highest bit first."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: np.ndarray):
        self.n, self.planes, self.zeros = n, planes, zeros  # planes: packed bits, first bit lowest
        self._before: list[np.ndarray | None] = [None] * len(planes)

    @classmethod
    def build(cls, ids: np.ndarray, bits: int | None = None) -> WaveletMatrix:
        top = int(ids.max()) if len(ids) else 0
        bits = bits or max(1, top.bit_length())
        a = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, zeros = [], np.zeros(bits, dtype=np.uint64)
        for level in range(bits):
            bit = (a & a.dtype.type(1 << (bits - 1 - level))).astype(bool)
            planes.append(np.packbits(bit, bitorder="little"))
            up, ones = np.empty_like(a), int(np.count_nonzero(bit))
            zeros[level] = len(a) - ones
            np.compress(~bit, a, out=up[:len(a) - ones])
            np.compress(bit, a, out=up[len(a) - ones:])
            a = up
        return cls(len(ids), planes, zeros)

    def decode(self) -> np.ndarray:
        """All ids in order: the sorts are undone from the lowest plane up."""
        out = np.zeros(self.n, dtype=np.uint16 if len(self.planes) <= 16 else np.uint32)
        for level in range(len(self.planes) - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            up, z = np.empty_like(out), int(self.zeros[level])
            up[np.flatnonzero(~bit)] = out[:z]
            up[np.flatnonzero(bit)] = out[z:] | out.dtype.type(1 << (len(self.planes) - 1 - level))
            out = up
        return out.astype(np.uint32)

    def _ones(self, level: int, i: int) -> int:
        """Ones of a plane before position i: directory word, then the rest."""
        plane = self.planes[level]
        if self._before[level] is None:
            words = np.zeros(-(-len(plane) // 8) * 8, dtype=np.uint8)
            words[:len(plane)] = plane
            counts = np.bitwise_count(words.view(np.uint64)).astype(np.int64)
            self._before[level] = np.concatenate(([0], np.cumsum(counts)))
        word, rest = divmod(i, 64)
        part = int.from_bytes(plane[8 * word:8 * word + 8].tobytes(), "little") & ((1 << rest) - 1)
        return int(self._before[level][word]) + part.bit_count()

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3]) >> (i & 7) & 1

    def access(self, i: int) -> int:
        value = 0
        for level in range(len(self.planes)):
            bit, ones = self._bit(level, i), self._ones(level, i)
            value = value << 1 | bit
            i = int(self.zeros[level]) + ones if bit else i - ones
        return value

    def _span(self, symbol: int, i: int) -> tuple[int, int]:
        """Where, below the last plane, the occurrences of ``symbol`` before i lie."""
        lo, hi = 0, i
        if symbol >> len(self.planes):
            return 0, 0
        for level in range(len(self.planes)):
            a, b = self._ones(level, lo), self._ones(level, hi)
            if symbol >> (len(self.planes) - 1 - level) & 1:
                lo, hi = int(self.zeros[level]) + a, int(self.zeros[level]) + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def rank(self, symbol: int, i: int) -> int:
        """Occurrences of ``symbol`` before position i."""
        lo, hi = self._span(symbol, i)
        return hi - lo

    def count(self, symbol: int) -> int:
        return self.rank(symbol, self.n)

    def select(self, symbol: int, k: int) -> int:
        """Position of occurrence k (from 0)."""
        lo, hi = self._span(symbol, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for level in range(len(self.planes) - 1, -1, -1):
            z = int(self.zeros[level])
            one = symbol >> (len(self.planes) - 1 - level) & 1
            i = self._find(level, i - z if one else i, one)
        return i

    def _find(self, level: int, k: int, one: int) -> int:
        """Position of the k-th (from 0) bit of that value in a plane."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            ones = self._ones(level, mid + 1)
            if (ones if one else mid + 1 - ones) > k:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def locate(self, symbol: int) -> list[int]:
        """Positions of all occurrences, ascending."""
        return [self.select(symbol, k) for k in range(self.count(symbol))]


def dump_shard(part: int, shard: int, docs: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> bytes:
    import zstandard

    matrix = WaveletMatrix.build(ids)
    squeeze = zstandard.ZstdCompressor(level=3).compress
    sections = [squeeze(x.tobytes()) for x in (docs.astype("<i8"), starts.astype("<u8"), matrix.zeros, *matrix.planes)]
    head = struct.pack(HEAD, MAGIC, 1, part, shard, len(ids), len(docs), len(matrix.planes))
    return head + struct.pack(f"<{len(sections)}Q", *map(len, sections)) + b"".join(sections)


def load_shard(data: bytes) -> tuple[int, int, np.ndarray, np.ndarray, WaveletMatrix]:
    """(part, shard, document ids, document starts, matrix) of a file's bytes."""
    import zstandard

    magic, version, part, shard, n, n_docs, bits = struct.unpack_from(HEAD, data)
    if magic != MAGIC or version != 1:
        raise ValueError("not a token shard")
    at = struct.calcsize(HEAD) + 8 * (3 + bits)
    sections = []
    for size in struct.unpack_from(f"<{3 + bits}Q", data, struct.calcsize(HEAD)):
        sections.append(zstandard.ZstdDecompressor().decompress(data[at:at + size]))
        at += size
    docs, starts = np.frombuffer(sections[0], "<i8"), np.frombuffer(sections[1], "<u8").astype(np.int64)
    zeros = np.frombuffer(sections[2], np.uint64)
    return part, shard, docs, starts, WaveletMatrix(n, [np.frombuffer(s, np.uint8) for s in sections[3:]], zeros)


def put_file(folder: str, name: str, data: bytes) -> str:
    """Write beside the target and move into place."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    attempt = f"{path}/_{name}.{TaskContext.get().taskAttemptId()}"
    with store.open_output_stream(attempt) as out:
        out.write(data)
    store.move(attempt, f"{path}/{name}")
    return name


def write_store(docs: DataFrame, folder: str, tokenizer_file: str | None = None, end_id: int = END_ID,
                shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write ``docs`` (doc_id, text) as shard files under ``folder``; returns the
    manifest (a row per file), already written beside them."""
    tail = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard = TaskContext.get().partitionId(), 0
        encoder = worker_encoder(tokenizer_file, KEPT_WORDS)
        held: list[tuple[int, bytes]] = []
        tokens = 0
        types = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())

        def close() -> pa.RecordBatch:
            docs_of = np.array([d for d, _ in held], dtype=np.int64)
            sizes = np.array([len(b) // 4 for _, b in held], dtype=np.int64)
            ids = np.frombuffer(b"".join(b for _, b in held), dtype="<u4")
            data = dump_shard(part, shard, docs_of, np.cumsum(sizes) - sizes, ids)
            name = put_file(folder, f"shard-{part:06d}-{shard:06d}.qmwm", data)
            row = (part, shard, name, len(held), len(ids), len(data))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)],
                                              [c.split()[0] for c in MANIFEST.split(", ")])

        for batch in batches:
            keys = batch.column("doc_id").fill_null(NULL_DOC).to_pylist()
            for doc, ids in zip(keys, encoder.encode(batch.column("text"))):
                held.append((doc, ids + tail))
                tokens += len(ids) // 4 + 1
                if tokens >= shard_tokens:
                    yield close()
                    held, tokens, shard = [], 0, shard + 1
        if held:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    placed = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return save(placed.mapInArrow(run, MANIFEST), "manifest")


def read_store(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Per document of the shard files: doc_id, start (ids of all documents before
    it), n_tokens, ids_crc32, and the shard and position where it lies."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                part, shard, docs, starts, matrix = load_shard(data)
                ids = matrix.decode().astype("<u4")
                ends = np.append(starts[1:], matrix.n)
                crc = [zlib.crc32(ids[a:b].data) for a, b in zip(starts, ends)]
                doc_ids = pd.Series(docs, dtype="Int64").mask(docs == NULL_DOC)
                yield pd.DataFrame({"doc_id": doc_ids, "part": part, "shard": shard, "at": starts,
                                    "n_tokens": ends - starts, "ids_crc32": crc})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.qmwm").load(folder).select("content")
    found = files.mapInPandas(run, "doc_id long, part int, shard int, at long, n_tokens long, ids_crc32 long")
    per_part = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = per_part.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens")
    base = (manifest.select("part", "shard", inside.alias("inside")).join(before, "part")
            .select("part", "shard", (F.col("before") + F.col("inside")).alias("base")))
    return found.join(base, ["part", "shard"]).select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "part", "shard", "at")


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as wavelet-matrix shards and read back."""
    folder = scratch_path(spark, "token-store")
    manifest = write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, part int, shard int, at long")
    return read_store(spark, folder, manifest)
