"""Corpus readers for the reference's input formats.

Every reader returns the corpus model ``(doc_id?, author, text, ...)`` using
Spark's file sources (csv / json / text) and column expressions; folders of a file
per document are listed and read by tasks.  Nothing is parsed on the driver.  The ``write_*`` helpers build
fixtures from a corpus DataFrame with Spark writers (tests and the registered
round-trip queries use them).
"""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import token_count

_ONE_LINE = "[\\t\\r\\n]+"


def _flat(c):
    return F.regexp_replace(c, _ONE_LINE, " ")


# ------------------------------------------------------------------ S1 TSV corpus

def write_tsv_corpus(corpus: DataFrame, path: str) -> None:
    """f0 doc id, f1 author key, f2 lang, f3 n_chars, f4 title (lang), f5 body (one line)."""
    line = F.concat_ws("\t", F.col("doc_id").cast("string"), "author", "lang",
                       F.length("text").cast("string"), "lang", _flat(F.col("text")))
    corpus.orderBy("doc_id").select(line.alias("value")).write.mode("overwrite").text(path)


def read_tsv_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Tab split, no quoting; author key = field 1; text = f4 + ' ' + f5;
    label = author code by first appearance in the file."""
    raw = spark.read.option("sep", "\t").option("quote", "").option("header", False).csv(path)
    # file order: file path, split offset, then row order inside the split
    pos = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    d = raw.select(F.col("_c0").cast("long").alias("doc_id"), F.col("_c1").alias("author"),
                   F.concat_ws(" ", "_c4", "_c5").alias("text"), pos.alias("__pos"))
    first = d.groupBy("author").agg(F.min("__pos").alias("__first"))
    codes = first.withColumn("label", (F.dense_rank().over(Window.orderBy("__first")) - 1).cast("int"))  # one row per author
    return d.join(codes.select("author", "label"), "author").drop("__pos")


# ------------------------------------------------------------------ S2 CSV corpus (latin-1)

def write_csv_corpus(corpus: DataFrame, path: str) -> None:
    out = corpus.select("doc_id", "text", F.regexp_extract("author", "(\\d+)$", 1).cast("int").alias("author"))
    out.write.mode("overwrite").option("header", True).option("encoding", "ISO-8859-1") \
        .option("quote", '"').option("escape", '"').csv(path)


def read_csv_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Header, latin-1, quoted multi-line texts, integer author."""
    return (spark.read.option("header", True).option("encoding", "ISO-8859-1").option("multiLine", True)
            .option("quote", '"').option("escape", '"').schema("doc_id long, text string, author int").csv(path))


# ------------------------------------------------------------------ S3 JSON-lines pairs

def write_jsonl_pairs(pairs: DataFrame, corpus: DataFrame, path_pairs: str, path_truth: str) -> None:
    """pairs(a, b) -> {"id", "pair": [text_a, text_b]} and {"id", "authors": [a_a, a_b]}."""
    ca = corpus.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"), F.col("author").alias("aa"))
    cb = corpus.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"), F.col("author").alias("ab"))
    p = pairs.join(ca, "a").join(cb, "b").withColumn("id", F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")))
    p.select("id", F.array("ta", "tb").alias("pair")).write.mode("overwrite").option("compression", "gzip").json(path_pairs)  # every text some four times
    p.select("id", F.array("aa", "ab").alias("authors")).write.mode("overwrite").json(path_truth)


def read_jsonl_pairs(spark: SparkSession, path_pairs: str, path_truth: str,
                     min_tokens: int = 10, max_tokens: int = 10000, min_docs: int = 2) -> DataFrame:
    """S3 (+P1, C3): explode the two texts of each pair with their authors, keep
    texts with min_tokens <= tokens < max_tokens, then authors with >= min_docs docs."""
    n = token_count("text")
    at = F.col("__at")
    p = (spark.read.schema("id string, pair array<string>").json(path_pairs).select("id", F.posexplode("pair").alias("__at", "text"))
         .where((n >= min_tokens) & (n < max_tokens)))
    t = spark.read.schema("id string, authors array<string>").json(path_truth).select("id", F.posexplode("authors").alias("__at", "author"))
    # authors are counted and chosen without the texts, which cross the network once
    d = p.select("id", "__at").join(t, ["id", "__at"])
    keep = d.groupBy("author").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= min_docs).select("author")
    return p.join(t.join(keep, "author", "left_semi"), ["id", "__at"]).select(
        "id", F.when(at < 2, at).alias("pos"), "text", "author")


# ------------------------------------------------------------------ S4 tagged records

def write_tagged(corpus: DataFrame, path: str) -> None:
    rec = F.concat(F.lit('<text file="'), F.col("doc_id").cast("string"), F.lit('">\n<author id="'), F.col("author"),
                   F.lit('"/>\n<body>\n'), F.col("text"), F.lit("\n</body>\n</text>"))
    corpus.select(rec.alias("value")).write.mode("overwrite").text(path)


def read_tagged(spark: SparkSession, path: str, min_tokens: int = 0) -> DataFrame:
    """Records split at '</text>'; file id, author id and body by regex."""
    r = spark.read.option("lineSep", "</text>").text(path)
    d = r.select(
        F.regexp_extract("value", '<text file="([^"]*)">', 1).alias("text_id"),
        F.regexp_extract("value", '<author id="([^"]*)"/>', 1).alias("author"),
        F.regexp_extract("value", "(?s)<body>\\n(.*)\\n</body>", 1).alias("text"),
    ).where(F.col("text_id") != "")
    return d.where(token_count("text") >= min_tokens) if min_tokens else d


# ------------------------------------------------------------------ S6 / S7 directory and file-name labels

#: Folders that files with the author in their name are dealt to.
NAME_FOLDERS = 256
#: Characters of a batch of file contents.
READ_CHARS = 4 << 20
#: What Spark's own writer puts for a null or empty value, and the characters it escapes, in a path.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
ESCAPED = frozenset("\"#%'*/:=?\\{[]^\x7f") | {chr(i) for i in range(1, 32)}


def _tasks(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _write_files(rows: DataFrame, path: str) -> None:
    """``rows`` (in_folder, in_file: fixed prefixes; folder, file, text) as one file per
    (folder, file) below ``path``, with an end of line after every text; rows of equal names share a file.

    A task writes a file beside its target and moves it into place, so a commit by the
    driver, which renames file by file, is not needed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(path)
        attempt = f".{TaskContext.get().taskAttemptId()}"
        now, out, made, n = None, None, set(), 0

        def escaped(name: str | None) -> str:
            return "".join(f"%{ord(c):02X}" if c in ESCAPED else c for c in name) if name else NO_VALUE

        def close() -> None:
            out.close()
            store.move(f"{base}/{now[0]}/{attempt}", f"{base}/{now[0]}/{now[1]}")

        for batch in batches:
            for keys, named, folder, file, text in zip(*(c.to_pylist() for c in batch.columns)):
                key = keys + escaped(folder), named + escaped(file) + ".txt"
                if key != now:
                    if now is not None:
                        close()
                    if key[0] not in made:
                        store.create_dir(f"{base}/{key[0]}", recursive=True)
                        made.add(key[0])
                    out, now, n = store.open_output_stream(f"{base}/{key[0]}/{attempt}"), key, n + 1
                out.write(((text or "") + "\n").encode("utf-8", "surrogatepass"))
        if now is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    fs.FileSystem.from_uri(path)[0].create_dir(fs.FileSystem.from_uri(path)[1], recursive=True)
    dealt = (rows.select("in_folder", "in_file", "folder", "file", "text").repartition(_tasks(rows.sparkSession), "folder", "file")
             .sortWithinPartitions("folder", "file"))
    dealt.mapInArrow(run, "n long").agg(F.sum("n")).collect()


def _read_files(spark: SparkSession, path: str) -> DataFrame:
    """(rel, value): place below ``path`` and content of every file there, hidden ones left
    out.  Tasks list the folders and read the files; the driver holds no list of them."""
    def listed(recursive: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, base = fs.FileSystem.from_uri(path)
            base = base.rstrip("/")

            def hidden(rel: str) -> bool:
                return any(p.startswith(".") or p.startswith("_") and "=" not in p or p.endswith("._COPYING_") for p in rel.split("/"))

            for batch in batches:
                for rel, folder in zip(*(c.to_pylist() for c in batch.columns)):
                    found = [(rel, False)]
                    if folder:
                        at = store.get_file_info(fs.FileSelector(f"{base}/{rel}".rstrip("/"), recursive=recursive))
                        found = [(i.path[len(base) + 1:], i.type == fs.FileType.Directory) for i in at]
                    found = [f for f in found if not hidden(f[0]) and not (recursive and f[1])]
                    for i in range(0, len(found), 10_000):
                        rels, folders = zip(*found[i:i + 10_000])
                        yield pa.RecordBatch.from_arrays([pa.array(rels, pa.string()), pa.array(folders, pa.bool_())], ["rel", "folder"])
        return run

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(path)
        rels, values, size = [], [], 0

        def pack() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rels, pa.string()), pa.array(values, pa.string())], ["rel", "value"])

        for batch in batches:
            for rel in batch.column(0).to_pylist():
                with store.open_input_stream(f"{base.rstrip('/')}/{rel}") as f:
                    values.append(f.read().decode("utf-8", "replace"))
                rels.append(rel)
                size += len(values[-1])
                if size >= READ_CHARS or len(rels) >= 10_000:
                    yield pack()
                    rels, values, size = [], [], 0
        yield pack()

    n, entries = _tasks(spark), "rel string, folder boolean"
    top = spark.range(1).select(F.lit("").alias("rel"), F.lit(True).alias("folder")).mapInArrow(listed(False), entries)
    files = top.repartition(n, "rel").mapInArrow(listed(True), entries).select("rel")
    return files.repartition(n, "rel").mapInArrow(read, "rel string, value string")


def write_dir_corpus(corpus: DataFrame, path: str) -> None:
    """One file per document, author=<a>/doc_id=<id>.txt."""
    _write_files(corpus.select(F.lit("author=").alias("in_folder"), F.lit("doc_id=").alias("in_file"),
                               F.col("author").cast("string").alias("folder"), F.col("doc_id").cast("string").alias("file"), "text"), path)


def read_dir_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Whole files below ``path``; author = the first folder, doc_id = the number
    in a folder or file ``doc_id=...`` or else the file's stem (null if it is no number).
    Author folders with 'unknown' in their name, contents.json and truth.txt are
    left out."""
    r = _read_files(spark, path)
    folder = F.substring_index("rel", "/", 1)
    name = F.regexp_extract("rel", "([^/]+)$", 1)
    r = r.where((F.instr("rel", "/") > 0) & ~F.lower(folder).contains("unknown") & ~name.isin("contents.json", "truth.txt"))
    author = F.when(folder.startswith("author="), _decoded(F.substring(folder, 8, 1 << 20))).otherwise(folder)
    number = F.coalesce(F.nullif(F.regexp_extract("rel", "doc_id=([0-9]+)(/|[.][^./]+$)", 1), F.lit("")),
                        F.nullif(F.regexp_extract(name, "^([0-9]+)[.][^.]+$", 1), F.lit("")))
    return r.select(author.alias("author"), number.cast("long").alias("doc_id"),
                    F.regexp_replace("value", "\\n\\z", "").alias("text"))


def _decoded(c: Column) -> Column:
    """Percent escapes resolved ('+' is no blank in a path)."""
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def write_filename_corpus(corpus: DataFrame, path: str) -> None:
    """Files name=<author>_<title>.txt (title = doc id), dealt to numbered folders."""
    name = F.concat_ws("_", "author", F.col("doc_id").cast("string"))
    folder = F.pmod(F.xxhash64(name), F.lit(NAME_FOLDERS)).cast("string")
    _write_files(corpus.select(F.lit("").alias("in_folder"), F.lit("name=").alias("in_file"),
                               folder.alias("folder"), name.alias("file"), "text"), path)


def read_filename_corpus(spark: SparkSession, path: str) -> DataFrame:
    """author = file stem (or folder ``name=...``) before the first '_', title = the rest."""
    r = _read_files(spark, path)
    stem = F.coalesce(F.nullif(F.regexp_extract("rel", "name=([^/]+)/", 1), F.lit("")),
                      F.regexp_extract("rel", "(?:^|/)(?:name=)?([^/]+)\\.txt$", 1))
    return r.select(F.substring_index(stem, "_", 1).alias("author"),
                    F.regexp_extract(stem, "^[^_]*_(.*)$", 1).alias("title"),
                    F.regexp_replace("value", "\\n\\z", "").alias("text"))


# ------------------------------------------------------------------ S8 message bodies

# fixed values: reply / forward markers, cut in this order
BODY_MARKERS = ["-----Original Message-----", "----- Forward", "cc:", "To:", "to:", "From:", "from:"]


def message_body_corpus(messages: DataFrame, min_tokens: int = 10, min_docs: int = 5,
                        docs_by_author: int | None = None) -> DataFrame:
    """Cut each body before every marker in turn, keep bodies with >= min_tokens
    tokens, keep authors with >= min_docs docs (or, with docs_by_author, the first
    docs_by_author docs of authors reaching that number, by message id)."""
    body = F.col("body")
    for m in BODY_MARKERS:
        body = F.substring_index(body, m, 1)
    d = messages.withColumn("text", body).where(token_count("text") >= min_tokens)
    need = docs_by_author if docs_by_author else min_docs
    keep = d.groupBy("author").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= need).select("author")
    d = d.join(keep, "author", "left_semi")
    if docs_by_author:
        from ..operators.grouping import int_rank
        d = int_rank(d, ["author"], "msg_id", "__rk").where(F.col("__rk") <= docs_by_author).drop("__rk")
    return d


# ------------------------------------------------------------------ S9 multi-request merge

def merge_requests(requests: Sequence[DataFrame], min_docs: int = 10, compat: bool = False) -> DataFrame:
    """Concatenate requests in order; an id keeps only its first request
    (``compat``: only ids seen in an *earlier* request are dropped, repeats inside
    one request stay); 'Collaboration' authors dropped; authors with >= min_docs kept;
    text = title + newline + abstract."""
    u = None
    for i, r in enumerate(requests):
        r = r.select("id", "title", "abstract", "author").withColumn("req_no", F.lit(i))
        u = r if u is None else u.unionByName(r)
    first = u.groupBy("id").agg(F.min("req_no").alias("__first"))
    d = u.join(first, "id").where(F.col("req_no") == F.col("__first")).drop("__first")
    if not compat:
        # repeats inside one request: the first by content order stays (deterministic)
        w = Window.partitionBy("id").orderBy("title", "abstract", "author")
        d = d.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    d = d.where(~F.col("author").contains("Collaboration"))
    keep = d.groupBy("author").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= min_docs).select("author")
    return d.join(keep, "author", "left_semi").select(
        "id", "author", "req_no", F.concat_ws("\n", "title", "abstract").alias("text"))
