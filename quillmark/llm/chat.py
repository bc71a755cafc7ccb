r"""Chat formatting with prefix-target expansion.

Every assistant turn becomes an example of its own: its context is all turns
before it, and only its reply is trainable.  The turns are rendered once,

    <turn>role<text>text</turn>\n

with ``\`` and ``<`` inside role and text escaped by a backslash, so that no text
can form a mark and every text is read back exactly.  A conversation's rendered
turns are one text.  The expansion gives each reply a row with its whole context as
``prefix``: prefix and segment together are the example's text, with the loss mask on
[target_start, target_end) of it.  Reading back checks every prefix against the turns
before it.  So n replies cost n copies of their contexts, as the method has it: the
output grows with the square of a conversation's length, and no prefix is cut.

Turns are ordered and given their places by windows over a conversation; reading back
streams the sorted turns and holds one example.

Defined cases: a null role or text is empty; a null conv_id is a conversation of
its own; equal turn numbers are ordered by role and text; only the exact role
``assistant`` is trainable; a conversation without one has turns but no example;
an empty table gives no rows; extra columns are ignored.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, save

OPEN, BODY, CLOSE = "<turn>", "<text>", "</turn>\n"
TRAINED = "assistant"

#: Possessive: the match keeps no state per character, however long the turn.
CONTENT = r"([^\\<]*+(?:\\[\\<][^\\<]*+)*+)"
TURN = re.compile(f"{OPEN}{CONTENT}{BODY}{CONTENT}{CLOSE}", re.DOTALL)


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\<"))


def unescape(text: str) -> str:
    # every < follows its own backslash; without those, all that are left are doubled
    return text.replace("\\<", "<").replace("\\\\", "\\")


def expand(turns: DataFrame) -> DataFrame:
    """Rendered turns of ``turns`` (conv_id, turn, role, text), in place order:
    conv_id, pos, segment, seg_start, and for a trainable turn example (its number), prefix
    (all turns before it, rendered), target_start and target_end; positions are code
    points in the conversation's text, which are those in prefix and segment."""
    empty = F.lit("")
    t = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"),
                     F.coalesce(F.col("role").cast("string"), empty).alias("role"),
                     F.coalesce(F.col("text").cast("string"), empty).alias("text"))
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(BODY))
    t = t.select("conv_id", "turn", "role", "text", F.length(head).cast("long").alias("head"),
                 F.length(escape(F.col("text"))).cast("long").alias("body"),
                 F.concat(head, escape(F.col("text")), F.lit(CLOSE)).alias("segment"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.length("segment").cast("long")
    trained = F.col("role") == TRAINED
    t = (t.withColumn("pos", F.row_number().over(order).cast("long") - 1)
         .withColumn("seg_start", F.sum(size).over(so_far) - size)
         .withColumn("__before", F.collect_list("segment").over(order.rowsBetween(Window.unboundedPreceding, -1)))
         .withColumn("__k", F.sum(trained.cast("long")).over(so_far) - 1))
    start = F.col("seg_start") + F.col("head")
    return t.select("conv_id", "pos", "segment", "seg_start", F.when(trained, F.col("__k")).alias("example"),
                    F.when(trained, F.array_join("__before", "")).alias("prefix"),
                    F.when(trained, start).alias("target_start"),
                    F.when(trained, start + F.col("body")).alias("target_end"))


def example_texts(formatted: DataFrame) -> DataFrame:
    """Examples in full: conv_id, example, text (context and reply), target_start,
    target_end.  Its size is that of all contexts together; for chosen conversations."""
    ends = formatted.where("example is not null").select(
        F.col("conv_id").alias("c"), "example", "target_start", "target_end", F.col("pos").alias("last"))
    both = ends.join(formatted.select("conv_id", "pos", "segment"),
                     F.col("c").eqNullSafe(F.col("conv_id")) & (F.col("pos") <= F.col("last")))
    parts = F.array_sort(F.collect_list(F.struct("pos", "segment")))
    whole = F.array_join(F.transform(parts, lambda p: p["segment"]), "")
    return (both.groupBy("conv_id", "example", "target_start", "target_end").agg(whole.alias("whole"))
            .select("conv_id", "example", F.expr("substring(whole, 1, int(target_end))").alias("text"),
                    "target_start", "target_end"))


class Digest:
    """Running digest of one conversation read back from its rendered turns."""

    def __init__(self, conv):
        self.conv, self.turns, self.chars, self.loss_chars, self.examples, self.prefix = conv, 0, 0, 0, 0, 0
        self.all, self.loss, self.text = hashlib.sha256(), hashlib.sha256(), hashlib.sha256()

    def add(self, segment: str, seg_start: int, target_start: int | None, target_end: int | None, prefix: str | None = None) -> None:
        found = TURN.fullmatch(segment)
        if not found or seg_start != self.chars:
            raise ValueError(f"conversation {self.conv}: turn {self.turns} is not where or what it should be")
        if prefix is not None and hashlib.sha256(prefix.encode("utf-8", "surrogatepass")).digest() != self.text.digest():
            raise ValueError(f"conversation {self.conv}: the prefix of example {self.examples} is not the turns before it")
        self.text.update(segment.encode("utf-8", "surrogatepass"))
        role, text = unescape(found[1]), unescape(found[2])
        self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        if target_start is not None:
            reply = unescape(segment[target_start - seg_start:target_end - seg_start])
            self.loss.update(reply.encode("utf-8", "surrogatepass"))
            self.loss_chars += len(reply)
            self.examples += 1
            self.prefix += target_end
        self.turns += 1
        self.chars += len(segment)

    def row(self) -> tuple:
        return (self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars,
                self.examples, self.prefix)


DIGEST = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
          "n_examples long, example_chars long")


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation what its stored examples say (see ``DIGEST``)."""
    names = [c.split()[0] for c in DIGEST.split(", ")]
    types = [pa.string() if c.endswith("string") else pa.int64() for c in DIGEST.split(", ")]

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for batch in batches:
            for conv, *turn in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now.conv != conv:
                    if now is not None:
                        done.append(now.row())
                    now = Digest(conv)
                now.add(*turn)
            if len(done) >= 1000:
                yield pack(done)
                done = []
        if now is not None:
            done.append(now.row())
        yield pack(done)

    rows = (formatted.repartition("conv_id").sortWithinPartitions("conv_id", "pos")
            .select("conv_id", "segment", "seg_start", "target_start", "target_end", "prefix"))
    bound_batches(formatted.sparkSession)
    return rows.mapInArrow(run, DIGEST)


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    r"""All conversations, and one whose texts hold marks, formatted, stored and read back."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    marks = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", marks), (-7, 1, TRAINED, marks)],
                                  "conv_id long, turn long, role string, text string")
    return read_back(save(expand(turns.union(extra)), "chat"))
