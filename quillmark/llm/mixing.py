"""Mixing sources to target weights by minimum-cost flow.

Documents are aggregated by membership pattern (the set of sources that list
them).  A small network then routes words: every source has a quota, every
pattern offers its words once per allowed repetition, each repetition at a
higher price (convex), and a source may draw on any pattern it is part of.  The
flow says how many words of each pattern the mix takes; the pattern's documents
are taken in a seeded order, first all of them once, then again, until that many
words are reached.

The order's running totals come from two window passes, over buckets of the
seeded hash and inside a bucket, so a source with a third of all rows is spread
over many tasks.  Only the patterns (at most ``MAX_PATTERNS``, checked) reach
the driver, never documents.

Defined cases: a null or blank text has size 0 and nothing of it is taken; a
null source is a source of its own and comes last; null or repeated ids are rows
like others (equal rows are interchangeable); without words every target is 0;
an empty table gives no rows; extra columns stay, added ones replace those of
the same name.
"""
from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import save

WORDS = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
SEED = 17
MAX_PATTERNS = 20_000
BUCKET_ROWS = 4096


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORDS)), F.lit(0)).cast("long")


def water_fill(sizes: list[int], weights: list[float], total: float, repeats: float) -> list[float]:
    """Targets by weight that add up to ``total``, none above ``repeats`` times its
    size: the excess of those that reach it is shared by the others' weights."""
    order = sorted(range(len(sizes)), key=lambda i: (repeats * sizes[i] / weights[i], i))
    rest, open_weight = float(total), float(sum(weights))
    targets = [0.0] * len(sizes)
    for at, i in enumerate(order):
        if repeats * sizes[i] > rest * weights[i] / open_weight:
            for j in order[at:]:
                targets[j] = rest * weights[j] / open_weight
            break
        targets[i] = float(repeats * sizes[i])
        rest -= targets[i]
        open_weight -= weights[i]
    return targets


def min_cost_flow(quotas: list[int], patterns: list[tuple[int, tuple[int, ...]]], prices: list[int]) -> dict[tuple[int, int], int]:
    """Words by (pattern, source).  ``patterns`` are (words, member sources);
    repetition k of a pattern costs prices[k] a word.  Successive shortest paths."""
    n_s, n_p = len(quotas), len(patterns)
    start, end = n_s + n_p, n_s + n_p + 1
    to: list[int] = []
    room: list[int] = []
    cost: list[int] = []
    out: list[list[int]] = [[] for _ in range(end + 1)]

    def arc(a: int, b: int, capacity: int, price: int) -> int:
        for x, y, c, p in ((a, b, capacity, price), (b, a, 0, -price)):
            out[x].append(len(to))
            to.append(y)
            room.append(c)
            cost.append(p)
        return len(to) - 2

    for s, quota in enumerate(quotas):
        arc(start, s, quota, 0)
    routes = {}
    for p, (words, members) in enumerate(patterns):
        for s in members:
            routes[p, s] = arc(s, n_s + p, words * len(prices), 0)
        for price in prices:
            arc(n_s + p, end, words, price)
    while True:
        dist, via, queue, waiting = [None] * (end + 1), [-1] * (end + 1), [start], {start}
        dist[start] = 0
        for a in queue:  # label-correcting search; queue grows while it runs
            waiting.discard(a)
            for e in out[a]:
                b = to[e]
                if room[e] and (dist[b] is None or dist[a] + cost[e] < dist[b]):
                    dist[b], via[b] = dist[a] + cost[e], e
                    if b not in waiting:
                        waiting.add(b)
                        queue.append(b)
        if dist[end] is None:
            return {k: room[e ^ 1] for k, e in routes.items() if room[e ^ 1]}
        path, b = [], end
        while b != start:
            path.append(via[b])
            b = to[via[b] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push


def mix(docs: DataFrame, target_of: Callable[[dict], dict], members: str = "sources", size: str = "size",
        repeats: int = REPEATS, seed: int = SEED) -> tuple[DataFrame, dict, dict]:
    """``docs`` (doc_id, array ``members``, long ``size``) plus taken (words the mix
    takes of the document) and copies (whole repetitions, the last one rounded).

    ``target_of`` maps {source: words it lists} to {source: target}.  Also returns
    both maps."""
    docs = docs.drop("taken", "copies").withColumn("__p", F.to_json(F.struct(F.array_sort(members).alias("m"))))
    groups = docs.groupBy("__p").agg(F.first(F.array_sort(members)).alias("m"), F.sum(size).alias("w"), F.count(F.lit(1)).alias("n"))
    found = groups.orderBy("__p").limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns; coarsen the sources")
    sources = sorted({s for r in found for s in r["m"]}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(r["w"] for r in found if s in r["m"]) for s in sources}
    targets = target_of(sizes)
    flow = min_cost_flow([int(targets[s]) for s in sources],
                         [(r["w"], tuple(i for i, s in enumerate(sources) if s in r["m"])) for r in found],
                         [1 + 2 * k for k in range(repeats)])
    plan = [(r["__p"], r["w"], sum(flow.get((p, i), 0) for i in range(len(sources))), max(1, -(-r["n"] // BUCKET_ROWS)))
            for p, r in enumerate(found)]
    spark = docs.sparkSession
    # a row per pattern: bounded by the check above
    plan_table = F.broadcast(spark.createDataFrame(plan, "__p string, __words long, __flow long, __buckets long"))
    placed = running_total(docs.join(plan_table, "__p"), size, seed)
    left = [F.greatest(F.lit(0), F.least(F.col(size), F.col("__flow") - k * F.col("__words") - F.col("__before")))
            for k in range(repeats)]
    taken = sum(left[1:], left[0]).cast("long")
    out = placed.withColumn("taken", taken).withColumn(
        "copies", F.when(F.col(size) > 0, F.floor(F.col("taken") / F.col(size) + 0.5)).otherwise(0).cast("int"))
    return out.drop("__p", "__words", "__flow", "__buckets", "__before", "__h", "__b", "__base"), sizes, targets


def running_total(rows: DataFrame, size: str, seed: int) -> DataFrame:
    """Adds __before: words of the pattern's documents earlier in seeded order."""
    key = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rows = rows.withColumn("__h", key)
    first = F.conv(F.substring("__h", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("__b", F.floor(first * F.col("__buckets") / F.lit(2.0 ** 32)).cast("long"))
    totals = rows.groupBy("__p", "__b").agg(F.sum(size).alias("__t"))
    earlier = F.sum("__t").over(Window.partitionBy("__p").orderBy("__b")) - F.col("__t")
    rows = rows.join(totals.select("__p", "__b", earlier.alias("__base")), ["__p", "__b"])
    inside = Window.partitionBy("__p", "__b").orderBy("__h", "doc_id", size).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("__before", F.col("__base") + F.sum(size).over(inside) - F.col(size))


def repeating_weights(sources: Iterable, weights: tuple[int, ...] = WEIGHTS) -> list[int]:
    return [weights[i % len(weights)] for i, _ in enumerate(sources)]


def by_weight(sizes: dict) -> dict:
    """Targets of the sources in order (null last) by the repeating weights."""
    weights = repeating_weights(sizes)
    return dict(zip(sizes, water_fill(list(sizes.values()), weights, SHARE * sum(sizes.values()), REPEATS)))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix by source weights takes of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                             word_count("text").alias("size")), "sizes")
    taken, sizes, targets = mix(sized.withColumn("sources", F.array("source")), by_weight)
    table = spark.createDataFrame([(s, sizes[s], float(targets[s])) for s in sizes],
                                  "s string, source_size long, target double")
    return (taken.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("s")))
            .select("doc_id", "size", "source_size", "target", "taken"))


OP3_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(k % 3 + 1)::INT]::DOUBLE AS weight, (2 * source_size)::DOUBLE AS cap FROM s),
q AS (SELECT *, row_number() OVER o AS r,
        {SHARE} * sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
        sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
      FROM w WINDOW o AS (ORDER BY cap / weight, k)),
e AS (SELECT r, rest, open_weight FROM q WHERE cap > rest * weight / open_weight ORDER BY r LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN q.r < e.r OR e.r IS NULL THEN cap ELSE e.rest * weight / e.open_weight END AS target
      FROM q LEFT JOIN e ON true),
c AS (SELECT doc_id, size, source_size, target,
        coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5('{SEED}|' || coalesce(doc_id::VARCHAR, 'null')), doc_id, size
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(size, floor(target) - earlier)) + greatest(0, least(size, floor(target) - source_size - earlier)))::BIGINT AS taken
FROM c
"""
