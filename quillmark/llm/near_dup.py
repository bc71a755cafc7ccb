"""MinHash near-duplicate groups: one-permutation hashing with optimal
densification, banded buckets and star-shaped candidate edges.

1. A document's set of word shingles is hashed once; the hash's high bits give
   a bin, the least hash of a bin is its value.  An empty bin takes the value of
   the first filled bin in its own fixed random order (densification).  Bands of
   consecutive bins are the bucket keys.
2. Documents with equal sets form a class; only the class's smallest doc_id
   goes on, so thousands of copies cost one row.
3. A bucket links its members to one centre only (a star), so it makes as many
   candidate pairs as it has members.  Candidates are confirmed on full sets.
   Connected components follow from the confirmed links.
4. Another round takes other centres in the buckets that still span several
   components.  What then remains is completed: every pair of a bucket that lies
   in two components is confirmed too, unless it is ruled out by the set sizes,
   by the triangle inequality of the Jaccard distance to a common centre, or by
   its sketches: bit i is the parity of the number of shingles in bin i of 2048.
   A shingle in one set only turns one bit, so sketches never differ in more
   bits than the sets do in shingles, and two linked sets of n and m shingles
   differ in at most (100 - percent) / (100 + percent) * (n + m).  All three
   tests are bounds, not estimates: no linked pair is dropped.  No cap on partners.

Defined cases: null, empty or blank texts have an empty set and are linked with
nothing; texts shorter than a shingle are one shingle; rows without a doc_id
take no part (component null, kept); rows that share a doc_id count as one
document; an empty table gives no rows; extra columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save, tidy

BINS = 256
CENTRE_ROUNDS = 2
SKETCH_BITS = 2048
SKETCH_LONGS = SKETCH_BITS // 64
BATCH_BYTES = 4_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public domain splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles.

    Bytes are lower-cased (A-Z only) and split at ASCII white space."""
    from xxhash import xxh3_64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    if len(words) < width:
        return mix(np.array([xxh3_64_intdigest(h.tobytes(), len(words))], dtype=np.uint64))
    n = len(words) - width + 1
    s = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        s = mix(s + h[i:i + n])
    return np.unique(s)


def donor_order(bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Per bin a random start and odd step: its order of donor bins."""
    i = np.arange(bins, dtype=np.uint64)
    start = mix(i * np.uint64(2) + np.uint64(0x5851F42D)) % np.uint64(bins)
    step = (mix(i * np.uint64(2) + np.uint64(0x14057B7F)) % np.uint64(bins)) | np.uint64(1)
    return start.astype(np.int64), step.astype(np.int64)


def signatures(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """Densified one-permutation signatures, a row per (non-empty) set."""
    shift = np.uint64(64 - (bins.bit_length() - 1))
    sig = np.zeros((len(sets), bins), dtype=np.uint64)
    filled = np.zeros((len(sets), bins), dtype=bool)
    for row, s in enumerate(sets):
        b = (s >> shift).astype(np.int64)
        first = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
        sig[row, b[first]] = s[first]
        filled[row, b[first]] = True
    start, step = donor_order(bins)
    todo = np.flatnonzero(~filled.all(axis=1))
    empty = ~filled[todo]
    for t in range(bins):
        if not len(todo):
            break
        donor = (start + t * step) % bins
        take = empty & filled[todo][:, donor]
        r, c = np.nonzero(take)
        sig[todo[r], c] = sig[todo[r], donor[c]]
        empty &= ~take
        left = empty.any(axis=1)
        todo, empty = todo[left], empty[left]
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit bucket key per band (the band's number is part of it)."""
    keys = np.empty((len(sig), bands), dtype=np.uint64)
    for b in range(bands):
        k = np.full(len(sig), b + 1, dtype=np.uint64)
        for i in range(b * rows, (b + 1) * rows):
            k = mix(k + sig[:, i])
        keys[:, b] = k
    return keys.view(np.int64)


def _batches(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(doc ids, texts) in runs of bounded size."""
    for frame in frames:
        ids, texts, at, size = frame["doc_id"].to_numpy(), frame["text"].tolist(), 0, 0
        for i, t in enumerate(texts, 1):
            size += len(t) if t else 0
            if size >= BATCH_BYTES or i == len(texts):
                yield ids[at:i], texts[at:i]
                at, size = i, 0


def signature_table(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """Per document: n (set size), set_key (128-bit digest) and bucket keys."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_128_digest

        for ids, texts in _batches(frames):
            sets = [shingle_set(t, width) for t in texts]
            some = [i for i, s in enumerate(sets) if len(s)]
            keys: list = [None] * len(sets)
            for i, k in zip(some, band_keys(signatures([sets[i] for i in some]), bands, rows)):
                keys[i] = k
            yield pd.DataFrame({"doc_id": ids, "n": [len(s) for s in sets],
                                "set_key": [xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                                "keys": keys})

    return docs.mapInPandas(tidy(run), "doc_id long, n long, set_key binary, keys array<long>")


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Parity of the number of hashes in each of 2048 bins, 64 bins to a word."""
    shift = np.uint64(64 - (SKETCH_BITS.bit_length() - 1))
    out = np.empty((len(sets), SKETCH_LONGS), dtype=np.int64)
    for row, s in enumerate(sets):
        odd = np.bincount((s >> shift).astype(np.int64), minlength=SKETCH_BITS) & 1
        out[row] = np.packbits(odd.astype(np.uint8)).view(np.int64)
    return out


def set_table(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, shingles, sketch): the full non-empty sets as sorted arrays, and their sketches."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, texts in _batches(frames):
            sets = [shingle_set(t, width) for t in texts]
            some = [i for i, s in enumerate(sets) if len(s)]
            sets = [sets[i] for i in some]
            yield pd.DataFrame({"doc_id": ids[some], "shingles": [s.view(np.int64) for s in sets],
                                "sketch": list(sketches(sets))})

    return docs.mapInPandas(tidy(run), "doc_id long, shingles array<long>, sketch array<long>")


def may_agree(a: str, b: str, n_a: str, n_b: str, percent: int):
    """Whether two sketches differ in no more bits than linked sets of these sizes differ in shingles."""
    differ = " + ".join(f"bit_count({a}[{i}] ^ {b}[{i}])" for i in range(SKETCH_LONGS))
    return F.expr(f"{100 + percent} * ({differ}) <= {100 - percent} * ({n_a} + {n_b})")


def components(links: DataFrame) -> DataFrame:
    """(node, comp): smallest node reachable over ``links`` (a, b).

    Least-label propagation with pointer jumping; each round is written to the
    shared folder, so the plan stays short and lost executors cost one round."""
    edges = save(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
                 "edges")
    labels = save(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("comp")), "labels")
    while True:
        near = (edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"))
                .agg(F.min("comp").alias("near")))
        step = labels.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("jump"))
        step = step.join(jump, "comp").select("node", "was", F.least("comp", "jump").alias("comp"))
        step = save(step, "labels")
        labels = step.select("node", "comp")
        if step.where("comp <> was").isEmpty():
            return labels


def close_enough(n_a: str, n_b: str, percent: int):
    """Set sizes that can reach the similarity."""
    return F.expr(f"100 * least({n_a}, {n_b}) >= {percent} * greatest({n_a}, {n_b})")


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, inter, uni): exact intersection and union sizes of candidate pairs."""
    a = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.select("a", "b").join(a, "a").join(b, "b")
    inter = F.size(F.array_intersect("sa", "sb")).cast("long")
    return (both.select("a", "b", inter.alias("inter"), (F.size("sa") + F.size("sb")).alias("total"))
            .select("a", "b", "inter", (F.col("total") - F.col("inter")).alias("uni")))


def bucket_components(members: DataFrame, comps: DataFrame | None) -> DataFrame:
    """Bucket members with their component, where a bucket still spans several."""
    if comps is None:
        return members.withColumn("comp", F.col("doc_id"))
    named = (members.join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left")
             .withColumn("comp", F.coalesce("comp", "doc_id")))
    open_keys = (named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
                 .where("lo < hi").select("key"))
    return named.join(open_keys, "key")


def star_pairs(members: DataFrame, percent: int, salt: int) -> DataFrame:
    """(a, b, key-independent) pairs of a member and its bucket's centre, in two
    components and of fitting sizes.  Round 0 centres are the smallest ids."""
    rank = F.struct(F.lit(0).cast("long") if salt == 0 else F.xxhash64("doc_id", F.lit(salt)), F.col("doc_id"),
                    F.col("n"), F.col("comp"))
    centre = members.groupBy("key").agg(F.min(rank).alias("c"))
    return (members.join(centre, "key").where("comp <> c.comp").where(close_enough("n", "c.n", percent))
            .select(F.least("doc_id", "c.doc_id").alias("a"), F.greatest("doc_id", "c.doc_id").alias("b")).distinct())


def remaining_pairs(members: DataFrame, seen: DataFrame, sets: DataFrame, classes: DataFrame,
                    percent: int) -> DataFrame:
    """Pairs of a bucket in two components that are not yet confirmed or ruled
    out.  One side is always outside the component of the bucket's first centre,
    so a large, resolved group meets only the few members outside it."""
    first = members.groupBy("key").agg(F.min(F.struct("doc_id", "comp")).alias("c"))
    dist = (seen.select(F.col("a").alias("x"), F.col("b").alias("y"), (1 - F.col("inter") / F.col("uni")).alias("d")))
    dist = dist.union(dist.select(F.col("y"), F.col("x"), "d")).distinct()
    m = members.join(first, "key").select("key", "doc_id", "n", "comp", F.col("c.doc_id").alias("centre"),
                                          (F.col("comp") == F.col("c.comp")).alias("inner"))
    m = m.join(dist.withColumnRenamed("x", "doc_id").withColumnRenamed("y", "centre"), ["doc_id", "centre"], "left")
    m = m.withColumn("d", F.when(F.col("doc_id") == F.col("centre"), 0.0).otherwise(F.col("d")))
    m = (m.join(sets.select("doc_id", "sketch"), "doc_id")
         .join(classes.select(F.col("rep").alias("doc_id"), "keys"), "doc_id"))
    x, y = m.where(~F.col("inner")).alias("x"), m.alias("y")
    far = 1 - percent / 100 + 1e-9
    fits = ((F.col("x.key") == F.col("y.key")) & (F.col("x.comp") != F.col("y.comp"))
            & (F.col("y.inner") | (F.col("x.doc_id") < F.col("y.doc_id")))
            & close_enough("x.n", "y.n", percent)
            & (F.abs(F.coalesce(F.col("x.d") - F.col("y.d"), F.lit(0.0))) <= far)
            & may_agree("x.sketch", "y.sketch", "x.n", "y.n", percent)
            & F.expr("x.key = array_min(array_intersect(x.keys, y.keys))"))  # each pair in one bucket
    pairs = x.join(y, fits).select(F.least("x.doc_id", "y.doc_id").alias("a"),
                                   F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct()
    return pairs.join(seen.select("a", "b"), ["a", "b"], "left_anti")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 42, rows: int = 6,
                    centre_rounds: int = CENTRE_ROUNDS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_shingles, component_id (smallest
    doc_id of its group of near-duplicates), kept (it is that document).

    Two texts are linked where 100 * intersection >= percent * union of their
    sets of ``width``-word shingles.  ``bands`` x ``rows`` <= 256 bins."""
    if bands * rows > BINS or centre_rounds < 1:
        raise ValueError(f"bands x rows must be at most {BINS}, centre_rounds at least 1")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sigs = save(signature_table(docs, width, bands, rows), "signatures")
    classes = save(sigs.where("n > 0 and doc_id is not null").groupBy("set_key")
                   .agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"),
                        F.first("keys").alias("keys")), "classes")
    buckets = classes.select(F.col("rep").alias("doc_id"), "n", F.explode("keys").alias("key"))
    shared = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("key")
    members = save(buckets.join(shared, "key"), "buckets")
    sets = save(set_table(docs.join(members.select("doc_id").distinct(), "doc_id", "left_semi"), width), "sets")

    seen, comps = None, None
    for turn in range(centre_rounds + 1):
        spanning = bucket_components(members, comps)
        pairs = star_pairs(spanning, percent, turn) if turn < centre_rounds else remaining_pairs(
            spanning, seen, sets, classes, percent)
        if seen is not None and turn < centre_rounds:
            pairs = pairs.join(seen.select("a", "b"), ["a", "b"], "left_anti")
        found = save(confirm(pairs, sets), "confirmed")
        seen = found if seen is None else seen.union(found)
        comps = components(seen.where(F.expr(f"100 * inter >= {percent} * uni")))
    return label_rows(sigs, classes, comps)


def label_rows(sigs: DataFrame, classes: DataFrame, comps: DataFrame) -> DataFrame:
    groups = (classes.select("set_key", "rep", "copies").join(comps, F.col("rep") == F.col("node"), "left")
              .where("copies > 1 or comp is not null")
              .select("set_key", F.coalesce("comp", "rep").alias("comp")))
    out = sigs.select("doc_id", "n", "set_key").join(groups, "set_key", "left")
    comp = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"),
                      F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicates among all documents: 3-word shingles, 85 %."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, width=3, percent=85, bands=36, rows=7)
