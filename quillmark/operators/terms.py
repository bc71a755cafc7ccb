"""Terms of documents, counted and weighted where the documents are.

A table with a row per (document, term) is many times the size of the texts, so it is
never shuffled, sorted or stored.  Documents are dealt by doc_id to blocks of some
``BLOCK_CHARS`` characters.  A block's task counts with NumPy and gives its distinct
terms only, a row per (block, term); their document frequencies are summed over blocks,
and what a block needs of the vocabulary goes back to it, where its documents are
counted again, chunk by chunk, and weighted.

A document is symbols (the characters of a text, or tokens between single blanks); its
terms are the runs of ``n_min`` to ``n_max`` symbols.  A run is numbered in the base of
the block's symbols; where such numbers pass 62 bits the runs are written out instead.

Defined cases: rows that share a doc_id are one document, no run passes from one row to
the next, and it is a training document if one of them is; rows without a doc_id are one
document in counts and none in weights; a document without terms gives no rows.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import scratch_path

BLOCK_CHARS = 1 << 23
#: Symbols counted at once, rows of a batch.
CHUNK = 1 << 19
BATCH_ROWS = 1 << 18
LIMIT = 1 << 62


@dataclass(frozen=True)
class Rule:
    """What a task must know: the length of runs, and whether symbols are characters."""
    n_min: int = 1
    n_max: int = 1
    chars: bool = False


@dataclass(frozen=True)
class Terms:
    """The terms of ``corpus`` (doc_id, ...): runs of symbols of ``symbols``, a string."""
    corpus: DataFrame
    symbols: Column
    block: str
    rule: Rule = Rule()


def char_ngrams(corpus: DataFrame, n_min: int = 2, n_max: int = 5) -> Terms:
    """P8."""
    return Terms(corpus, T.char_preprocess("text"), "char", Rule(n_min, n_max, True))


def words(corpus: DataFrame) -> Terms:
    """P9."""
    return Terms(corpus, F.array_join(T.word_unigrams("text"), " "), "word")


def tag_ngrams(corpus: DataFrame, n_min: int = 3, n_max: int = 4) -> Terms:
    """P10 over the shape tags of the text (they hold no blank)."""
    return Terms(corpus, F.array_join(T.tag_tokens(T.shape_tags("text")), " "), "post", Rule(n_min, n_max))


def punctuation(corpus: DataFrame) -> Terms:
    """P11."""
    return Terms(corpus, F.array_join(T.punctuation_chars("text"), ""), "punct", Rule(chars=True))


# ------------------------------------------------------------------ counting in a task

def spell(texts: pa.Array, chars: bool) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(codes from 1, symbols per text, the symbols by code - 1) of ``texts``."""
    if chars:
        points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), "<u4")
        seen = np.zeros(0x110000, dtype=np.int32)
        seen[points] = 1
        alphabet = np.flatnonzero(seen)
        seen[alphabet] = np.arange(1, len(alphabet) + 1)
        return seen[points].astype(np.int64), pc.utf8_length(texts).to_numpy(False).astype(np.int64), pa.array(map(chr, alphabet.tolist()), pa.string())
    parts = pc.split_pattern(texts, " ")
    flat, sizes = parts.flatten(), pc.list_value_length(parts).to_numpy(False).astype(np.int64)
    some = pc.not_equal(flat, "").to_numpy(False)
    of = np.repeat(np.arange(len(texts)), sizes)[some]
    coded = flat.filter(pa.array(some)).dictionary_encode()
    return coded.indices.to_numpy(False).astype(np.int64) + 1, np.bincount(of, minlength=len(texts)), coded.dictionary


def written_out(texts: pa.Array, chars: bool, n_min: int, n_max: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """As ``spell``, with every run as a symbol."""
    runs, sizes = [], []
    for text in texts.to_pylist():
        own = text if chars else [t for t in text.split(" ") if t]
        found = [own[i:i + n] for n in range(n_min, n_max + 1) for i in range(len(own) - n + 1)]
        runs += found if chars else map(" ".join, found)
        sizes.append(len(found))
    coded = pa.array(runs, pa.string()).dictionary_encode()
    return coded.indices.to_numpy(False).astype(np.int64) + 1, np.array(sizes, dtype=np.int64), coded.dictionary


def runs_of(codes: np.ndarray, row: np.ndarray, n_min: int, n_max: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(number, row) of every run of codes that lies in one row; runs with a code 0 left out."""
    keys, rows = [], []
    for n in range(n_min, n_max + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        ok = row[:m] == row[n - 1:]
        key = codes[:m].copy()
        for j in range(m and 1, n):
            key *= base
            key += codes[j:j + m]
        for j in range(n):
            ok &= codes[j:j + m] > 0
        keys.append(key[ok])
        rows.append(row[:m][ok])
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *keys]), np.concatenate([none, *rows])


def cells_of(keys: np.ndarray, docs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, number, count) of distinct pairs, in order; numbers are below ``width``."""
    both = np.sort(docs * width + keys)
    first = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1]))) if len(both) else np.zeros(0, dtype=np.int64)
    doc, key = np.divmod(both[first], width)
    return doc, key, np.diff(np.append(first, len(both)))


def spelled_runs(numbers: np.ndarray, base: int, n_max: int, symbols: pa.Array, chars: bool) -> tuple[np.ndarray, pa.Array]:
    """(order, terms): the terms of ``numbers``, and which of them each is."""
    order, terms = [], []
    for n in range(1, n_max + 1):
        own = np.flatnonzero((numbers >= base ** (n - 1)) & (numbers < base ** n)) if base > 1 else np.zeros(0, dtype=np.int64)
        if len(own):
            left, columns = numbers[own], []
            for _ in range(n):
                left, code = np.divmod(left, base)
                columns.append(symbols.take(pa.array(code - 1)))
            order.append(own)
            terms.append(pc.binary_join_element_wise(*columns[::-1], "" if chars else " ") if n > 1 else columns[0])
    if not order:
        return np.zeros(0, dtype=np.int64), pa.array([], pa.string())
    return np.concatenate(order), pa.concat_arrays(terms)


def pieces(sizes: np.ndarray, doc: np.ndarray, most_docs: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at least ``CHUNK`` symbols or ``most_docs`` documents, no document cut."""
    start = held = 0
    for i in range(len(sizes)):
        if i > start and doc[i] != doc[i - 1] and (held >= CHUNK or doc[i] - doc[start] >= most_docs):
            yield start, i
            start, held = i, 0
        held += sizes[i]
    if start < len(sizes):
        yield start, len(sizes)


def block_terms(texts: pa.Array, doc: np.ndarray, train: np.ndarray, t: Rule) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Of one block: distinct terms, documents and training documents that hold each, and occurrences;
    ``doc`` numbers the rows' documents in order, ``train`` is a document's flag."""
    codes, sizes, symbols = spell(texts, t.chars)
    n_min, n_max = t.n_min, t.n_max
    if (len(symbols) + 1) ** n_max >= LIMIT:
        (codes, sizes, symbols), n_min, n_max = written_out(texts, t.chars, n_min, n_max), 1, 1
    base = len(symbols) + 1
    width, ends = base ** n_max, np.concatenate(([0], np.cumsum(sizes)))
    found = []
    for a, b in pieces(sizes, doc, (1 << 63) // width - 1):
        keys, row = runs_of(codes[ends[a]:ends[b]], np.repeat(np.arange(a, b), sizes[a:b]), n_min, n_max, base)
        of, key, count = cells_of(keys, doc[row] - doc[a], width)
        every = np.sort(key)
        numbers, n = np.unique(every, return_counts=True)
        learned, n_train = np.unique(key[train[of + doc[a]]], return_counts=True)
        fit = np.zeros(len(numbers), dtype=np.int64)
        fit[np.searchsorted(numbers, learned)] = n_train
        total = np.unique(keys, return_counts=True)[1]
        found.append((numbers, n, fit, total))
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return pa.array([], pa.string()), none, none, none
    numbers = np.concatenate([f[0] for f in found])
    order = np.argsort(numbers, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], np.diff(numbers[order]) > 0)))[:len(order)] if len(order) else order
    sums = [np.add.reduceat(np.concatenate([f[i] for f in found])[order], first) if len(order) else order for i in (1, 2, 3)]
    numbers = numbers[order][first]
    at, terms = spelled_runs(numbers, base, n_max, symbols, t.chars)
    return (terms, *[s[at] for s in sums])


class Weigher:
    """Weights of one block's documents by the vocabulary rows (term, idf, ...) of the block."""

    def __init__(self, terms: pa.Array, t: Rule):
        self.terms, self.chars, self.n_min, self.n_max, self.out = terms, t.chars, t.n_min, t.n_max, False
        codes, sizes, self.symbols = spell(terms, t.chars)
        if (len(self.symbols) + 1) ** t.n_max >= LIMIT:
            self.out, self.symbols, codes, sizes = True, terms, np.arange(1, len(terms) + 1), np.ones(len(terms), dtype=np.int64)
        self.base = len(self.symbols) + 1
        ends = np.cumsum(sizes)
        numbers = np.zeros(len(terms), dtype=np.int64)
        for j in range(int(sizes.max(initial=0))):
            own = sizes > j
            numbers[own] = numbers[own] * self.base + codes[(ends - sizes)[own] + j]
        self.order = np.argsort(numbers)
        self.numbers = numbers[self.order]

    def cells(self, texts: pa.Array, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(document, vocabulary row, count) of the documents' terms that are known, in ranges of documents."""
        if self.out:
            codes, sizes, symbols = written_out(texts, self.chars, self.n_min, self.n_max)
        else:
            codes, sizes, symbols = spell(texts, self.chars)
        known = pc.index_in(symbols, self.symbols).fill_null(-1).to_numpy(False).astype(np.int64) + 1
        codes = np.concatenate(([0], known))[codes]
        n_min, n_max = (1, 1) if self.out else (self.n_min, self.n_max)
        width, ends = self.base ** n_max, np.concatenate(([0], np.cumsum(sizes)))
        for a, b in pieces(sizes, doc, (1 << 63) // width - 1):
            keys, row = runs_of(codes[ends[a]:ends[b]], np.repeat(np.arange(a, b), sizes[a:b]), n_min, n_max, self.base)
            of, key, count = cells_of(keys, doc[row] - doc[a], width)
            at = np.minimum(np.searchsorted(self.numbers, key), max(0, len(self.numbers) - 1))
            hit = self.numbers[at] == key if len(self.numbers) else np.zeros(len(key), dtype=bool)
            yield of[hit] + doc[a], self.order[at[hit]], count[hit]


def numbered(ids: pa.Array) -> np.ndarray:
    """Numbers from 0 of the documents of sorted ``ids``."""
    keys, gone = pc.fill_null(ids, 0).to_numpy(False), pc.is_null(ids).to_numpy(False)
    new = (keys[1:] != keys[:-1]) | (gone[1:] != gone[:-1])
    return np.concatenate(([0], np.cumsum(new)))[:len(keys)]


def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table, bool]]:
    """(block, rows, last): slices of sorted ``batches`` that lie in one block; ``last`` ends it."""
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table, block = pa.Table.from_batches([batch]), batch.column("block").to_numpy(False)
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for a, b in zip(cuts, cuts[1:]):
            if before is not None:
                yield *before, before[0] != block[a]
            before = int(block[a]), table.slice(a, b - a)
    if before is not None:
        yield *before, True


def whole(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


# ------------------------------------------------------------------ Spark jobs

def saved(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` (block, ...) with every block in one task, sorted."""
    spark = rows.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(tasks, "block").sortWithinPartitions("block", *order)


def blocked(t: Terms, split_docs: DataFrame | None) -> DataFrame:
    """(block, doc_id, author, train, x), written: the documents' symbols, dealt to blocks."""
    rows = t.corpus
    flag = F.lit(False) if split_docs is None else F.coalesce(F.col("split") == "train", F.lit(False))
    if split_docs is not None and split_docs is not t.corpus:
        flags = split_docs.groupBy("doc_id").agg(F.max(flag).alias("__train"))
        rows, flag = rows.join(flags, "doc_id"), F.col("__train")
    author = F.col("author").cast("string") if "author" in rows.columns else F.lit(None).cast("string")
    docs = saved(rows.select(F.col("doc_id").cast("long").alias("doc_id"), author.alias("author"), flag.alias("train"),
                             F.coalesce(t.symbols, F.lit("")).alias("x")), "symbols")
    chars = docs.agg(F.sum(F.length("x"))).first()[0] or 0
    return docs.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-chars // BLOCK_CHARS)))).cast("int"))


def vocabulary(docs: DataFrame, t: Rule) -> DataFrame:
    """(block, feat, docs, train_docs, tf): a row per block and term of ``blocked`` documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for block, rows, last in by_block(batches):
            held.append(rows)
            if not last:
                continue
            table, held = pa.concat_tables(held), []
            doc = numbered(whole(table["doc_id"]))
            train = np.bincount(doc, table["train"].to_numpy()) > 0
            terms, *sums = block_terms(whole(table["x"]), doc, train, t)
            for i in range(0, len(terms), BATCH_ROWS):
                own = terms.slice(i, BATCH_ROWS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own), block, dtype=np.int32)), own, *[pa.array(s[i:i + BATCH_ROWS]) for s in sums]],
                    ["block", "feat", "docs", "train_docs", "tf"])

    rows = dealt(docs.select("block", "doc_id", "train", "x"), "doc_id")
    return rows.mapInArrow(run, "block int, feat string, docs long, train_docs long, tf long")


def counted(t: Terms) -> DataFrame:
    """(feat, df, tf): documents that hold a term, and its occurrences."""
    per_block = vocabulary(blocked(t, None), t.rule)
    return per_block.groupBy("feat").agg(F.sum("docs").alias("df"), F.sum("tf").alias("tf"))


@dataclass(frozen=True)
class Fitted:
    """Documents in blocks, and what each block needs of the vocabulary: (block, feat, df, idf)."""
    terms: Terms
    docs: DataFrame
    vocab: DataFrame


def fit(t: Terms, split_docs: DataFrame, min_df: int = 1) -> Fitted:
    """The vocabulary of the training documents: terms in ``min_df`` of them at least,
    idf = ln((1 + N) / (1 + df)) + 1."""
    docs = blocked(t, split_docs).where("doc_id is not null")
    n = split_docs.where(F.col("split") == "train").agg(F.count(F.lit(1)).alias("n_docs"))  # one row
    df = F.sum("train_docs").over(Window.partitionBy("feat"))
    found = vocabulary(docs, t.rule).select("block", "feat", df.alias("df")).where(F.col("df") >= max(1, min_df))
    idf = F.log((F.lit(1.0) + F.col("n_docs")) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    return Fitted(t, docs, saved(found.join(F.broadcast(n)).select("block", "feat", "df", idf.alias("idf")), "vocabulary"))


def columns(f: Fitted) -> DataFrame:
    """(block, feat): the vocabulary."""
    return f.vocab.select("feat").distinct().select(F.lit(f.terms.block).alias("block"), "feat")


def weights(f: Fitted, use_idf: bool = True, norm: str = "l2", classes: bool = False, chosen: DataFrame | None = None,
            ri: DataFrame | None = None, index: DataFrame | None = None) -> DataFrame:
    """(doc_id, block, feat, val) of every document, normalised per document.  With
    ``classes`` (author, feat, val) instead: sums over the training documents of an
    author, in parts; with ``chosen`` (feat) only its terms are given; with ``ri`` (feat,
    dim, weight) (doc_id, dim, val): the weights times that matrix; with ``index`` (feat, idx)
    of all terms (doc_id, idx, val): no row per document and term carries the term."""
    rule, block, project = f.terms.rule, f.terms.block, ri is not None
    names_out = ["doc_id", "feat" if index is None else "idx", "val"]
    none = F.array().cast("array<int>").alias("dims"), F.array().cast("array<double>").alias("by")
    vocab = f.vocab.select("*", F.lit(True).alias("given"), *none)
    if index is not None:  # the column number as the one dimension of a term
        vocab = f.vocab.join(index.select("feat", "idx"), "feat").select(
            "*", F.lit(True).alias("given"), F.array(F.col("idx").cast("int")).alias("dims"), none[1]).drop("idx")
    if chosen is not None:
        vocab = f.vocab.join(chosen.select("feat").withColumn("given", F.lit(True)), "feat", "left").na.fill(False, ["given"]).select("*", *none)
    if ri is not None:
        entries = ri.groupBy("feat").agg(F.array_sort(F.collect_list(F.struct("dim", "weight"))).alias("r"), F.lit(True).alias("given"))
        vocab = f.vocab.join(entries, "feat", "left").na.fill(False, ["given"]).select(
            "*", F.coalesce(F.col("r.dim"), none[0]).alias("dims"), F.coalesce(F.col("r.weight"), none[1]).alias("by"))
    gone = [F.lit(None).cast(k).alias(c) for c, k in (("doc_id", "long"), ("author", "string"), ("train", "boolean"))]
    rows = vocab.select("block", F.lit(0).alias("kind"), *gone, F.col("feat").alias("x"), "idf", "given", "dims", "by").unionByName(
        f.docs.select("block", F.lit(1).alias("kind"), "doc_id", "author", "train", "x",
                                                  F.lit(None).cast("double").alias("idf"), F.lit(None).cast("boolean").alias("given"), *none))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list[pa.Table] = []
        held: list[pa.Table] = []
        weigher, size = None, 0

        def weigh(table: pa.Table) -> Iterator[pa.RecordBatch]:
            ids = whole(table["doc_id"])
            doc = numbered(ids)
            first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
            for of, term, count in weigher.cells(whole(table["x"]), doc):
                if not len(of):
                    continue
                val = count * weigher.idf[term] if use_idf else count.astype(np.float64)
                if norm in ("l1", "l2"):
                    sums = np.bincount(of, val * val if norm == "l2" else np.abs(val))
                    val = val / (np.sqrt(sums) if norm == "l2" else sums)[of]
                if not weigher.all:
                    own = weigher.given[term]
                    of, term, val = of[own], term[own], val[own]
                if project:
                    yield from projected(ids.take(pa.array(first)), of, term, val)
                    continue
                if classes:
                    yield from summed(table, doc, of, term, val)
                    continue
                names = ids.take(pa.array(first))
                for i in range(0, len(of), BATCH_ROWS):
                    own = slice(i, i + BATCH_ROWS)
                    column = weigher.terms.take(pa.array(term[own])) if names_out[1] == "feat" else pa.array(weigher.dims[term[own]].astype(np.int32))
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(of[own])), column, pa.array(val[own])], names_out)

        def summed(table: pa.Table, doc: np.ndarray, of: np.ndarray, term: np.ndarray, val: np.ndarray) -> Iterator[pa.RecordBatch]:
            # a document counts once per training row
            train = table["train"].to_numpy()
            coded = whole(table["author"]).dictionary_encode()
            label = coded.indices.fill_null(-1).to_numpy(False)
            row = np.flatnonzero(train & (label >= 0))
            row = row[(doc[row] >= of[0]) & (doc[row] <= of[-1])] if len(of) else row[:0]
            for author in np.unique(label[row]).tolist():
                times = np.bincount(doc[row[label[row] == author]], minlength=int(doc[-1]) + 1)
                own = times[of] > 0
                total = np.bincount(term[own], val[own] * times[of[own]], minlength=len(weigher.terms))
                some = np.flatnonzero(np.bincount(term[own], minlength=len(weigher.terms)))
                for i in range(0, len(some), BATCH_ROWS):
                    part = some[i:i + BATCH_ROWS]
                    name = pa.array([coded.dictionary[author].as_py()] * len(part), pa.string())
                    yield pa.RecordBatch.from_arrays([name, weigher.terms.take(pa.array(part)), pa.array(total[part])], ["author", "feat", "val"])

        def projected(names: pa.Array, of: np.ndarray, term: np.ndarray, val: np.ndarray) -> Iterator[pa.RecordBatch]:
            sizes = weigher.ends[term + 1] - weigher.ends[term]
            at = np.repeat(weigher.ends[term] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            width = int(weigher.dims.max(initial=0)) + 1
            cells, where = np.unique(np.repeat(of, sizes) * width + weigher.dims[at], return_inverse=True)
            total = np.bincount(where, np.repeat(val, sizes) * weigher.by[at], len(cells))
            doc, dim = np.divmod(cells, width)
            for i in range(0, len(cells), BATCH_ROWS):
                own = slice(i, i + BATCH_ROWS)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(doc[own])), pa.array(dim[own].astype(np.int32)), pa.array(total[own])],
                                                 ["doc_id", "dim", "val"])

        for _, rows, last in by_block(batches):
            kind = rows["kind"].to_numpy()
            at = int(np.searchsorted(kind, 1))
            if at:
                known.append(rows.slice(0, at))
            if at < len(kind):
                if weigher is None:
                    table = pa.concat_tables(known) if known else rows.slice(0, 0)
                    weigher = Weigher(whole(table["x"]), rule)
                    weigher.idf, weigher.given = table["idf"].to_numpy(), whole(table["given"]).fill_null(False).to_numpy(False)
                    weigher.all, known = bool(weigher.given.all()), []
                    dims, by = whole(table["dims"]), whole(table["by"])
                    weigher.ends = np.concatenate(([0], np.cumsum(pc.list_value_length(dims).to_numpy(False).astype(np.int64))))
                    weigher.dims, weigher.by = dims.flatten().to_numpy(False).astype(np.int64), by.flatten().to_numpy(False)
                held.append(rows.slice(at))
                size += pc.sum(pc.utf8_length(held[-1]["x"])).as_py() or 0
            if held and (last or size >= CHUNK):
                table = pa.concat_tables(held)
                ids = table["doc_id"]
                # the last document may go on in the next batch
                cut = len(ids) if last else int(np.searchsorted(ids.to_numpy(), ids[-1].as_py()))
                if cut:
                    yield from weigh(table.slice(0, cut))
                    held, size = ([table.slice(cut)], 0) if cut < len(ids) else ([], 0)
                else:
                    held = [table]
            if last:
                weigher, known, held, size = None, [], [], 0

    key = "doc_id long, dim int" if project else "author string, feat string" if classes else f"doc_id long, {'feat string' if index is None else 'idx int'}"
    found = dealt(rows, "kind", "doc_id").mapInArrow(run, f"{key}, val double")
    return found if classes or project or index is not None else found.select("doc_id", F.lit(block).alias("block"), "feat", "val")
