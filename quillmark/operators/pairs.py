"""Pair generation: the join layer.

No generator self-joins an author group or enumerates all pairs of a group.
The pairs that a request may draw from are numbered, and the request is split
into quotas over groups (or pairs of groups) that add up to it exactly.  A quota
of t numbers out of P is drawn by cutting [0, P) into t strata and taking one
seeded number of each: distinct by construction, so a request is met without
rejected draws, at any ratio of request to capacity.  Two equi-joins to the
indexed documents turn numbers into doc ids.  Work follows the request, never a
group's size squared.

Selection rules (all reproducible from the seed):
  * positives, round robin (J2): per-group quotas by water-filling on the group
    table (one pair per group per round, groups in label order);
  * positives, random (J3) and verification coordinates (J10): quotas in
    proportion to the groups' numbers of pairs;
  * negatives (J4): every pair of groups alike; where the request exceeds their
    number, by water-filling over them, else one pair each of as many pairs of
    groups, drawn by strata;
  * uniform negatives (J10): quotas in proportion to a group's number of pairs
    with later groups.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import uniform
from ..session import keep
from .grouping import hash_rank, task_count

SEED = 42
CHUNK = 1 << 16
#: Documents of a packed row where every pair of a group is listed.
PACK = 1 << 10


# --------------------------------------------------------------------------- helpers

def _explode_range(df: DataFrame, count_col: str, out: str) -> DataFrame:
    """One row per value 0..count-1 for every input row; chunks of the range are
    dealt over the tasks before they are written out."""
    d = df.where(F.col(count_col) > 0)
    d = d.withColumn("__ch", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({count_col} - 1) div {CHUNK}"))))
    lo = F.col("__ch") * CHUNK
    hi = F.least(lo + CHUNK, F.col(count_col).cast("long")) - 1
    d = d.repartition(task_count(df), *[c for c in d.columns])
    return d.withColumn(out, F.explode(F.sequence(lo, hi))).drop("__ch")


def decode_pair(k: Column) -> tuple[Column, Column]:
    """Pair index k in [0, n(n-1)/2) -> 0-based positions (i, j), i < j (pairs
    listed (0,1), (0,2), (1,2), (0,3), ...).  The square root is a first
    guess, at most one off for any long k; a step in whole numbers corrects it."""
    def below(j: Column) -> Column:  # pairs before (0, j), in whole numbers
        return F.shiftright(j * (j - 1), 1)

    guess = F.floor((F.lit(1.0) + F.sqrt(F.lit(1.0) + F.lit(8.0) * k.cast("double"))) / 2).cast("long")
    j = F.when(below(guess) > k, guess - 1).when(below(guess + 1) <= k, guess + 1).otherwise(guess)
    return k - below(j), j


def strata(quotas: DataFrame, size: str, take: str, seed, keys: list[str]) -> DataFrame:
    """``take`` distinct numbers k of [0, ``size``) per row of ``quotas``, one from
    each of as many strata; ``d`` is the stratum (0-based)."""
    rows = _explode_range(quotas, take, "d")
    q, r = F.expr(f"{size} div {take}"), F.col(size) % F.col(take)
    width = q + (F.col("d") < r).cast("long")
    inside = F.least(F.floor(uniform(seed, *keys, "d") * width).cast("long"), width - 1)
    # made by a generator so that the hash is not repeated wherever k is used
    return rows.withColumn("k", F.explode(F.array(F.col("d") * q + F.least(F.col("d"), r) + inside)))


def proportional_quotas(groups: DataFrame, size: str, req: str) -> DataFrame:
    """t per group: its share of ``req`` by ``size``, rounded along the running
    total in label order, so that the quotas of a corpus add up exactly; ``before``
    is the sum of the quotas of earlier groups."""
    run = Window.partitionBy("corpus_id").orderBy("author")
    every = Window.partitionBy("corpus_id")
    upto = F.sum(F.col(size).cast("decimal(38,0)")).over(run)
    g = groups.withColumn("__upto", upto).withColumn("__cap", F.sum(F.col(size).cast("decimal(38,0)")).over(every))
    g = g.where(F.col("__cap") > 0)
    share = f"cast({req} as decimal(19,0)) * cast(%s as decimal(19,0)) div __cap"
    g = g.withColumn("before", F.expr(share % f"(__upto - {size})")).withColumn("t", F.expr(share % "__upto") - F.col("before"))
    return g.drop("__upto", "__cap")


def with_corpus(corpus: DataFrame, part: str | None) -> DataFrame:
    cid = F.col(part).cast("string") if part else F.lit("all")
    return corpus.withColumn("corpus_id", cid)


def indexed_docs(corpus: DataFrame, seed=SEED, part: str | None = None) -> DataFrame:
    """(corpus_id, author, doc_id, pos, n_docs): position in the seeded shuffle of
    the author group."""
    c = with_corpus(corpus.select("doc_id", "author", *([part] if part else [])), part).select("corpus_id", "author", "doc_id")
    # read by every draw join below: keep it (memory and disk; lost blocks are recomputed)
    return keep(hash_rank(c, ["corpus_id", "author"], seed, ["doc_id"], out="pos", count_col="n_docs"))


def group_table(idx: DataFrame) -> DataFrame:
    """(corpus_id, author, n, P, g, n_grp, upto): one row per group; g = label-order
    code, upto = documents of this and the earlier groups."""
    g = idx.groupBy("corpus_id", "author").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("corpus_id").orderBy("author")
    return (
        g.withColumn("P", F.expr("case when n % 2 = 0 then (n div 2) * (n - 1) else n * ((n - 1) div 2) end"))
        .withColumn("g", (F.row_number().over(w) - 1).cast("long"))
        .withColumn("n_grp", F.count(F.lit(1)).over(Window.partitionBy("corpus_id")))
        .withColumn("upto", F.sum("n").over(w))
    )


def _wide(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,0)")


def _long(doubled: Column, name: str) -> Column:
    """Half of an even count; a capacity beyond a long is held at its end."""
    return F.least(doubled / 2, F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long").alias(name)


def capacity_columns(pos_n: Column) -> list[Column]:
    """max_pos and max_neg over groups of n documents, pos_n of which may pair up."""
    return [_long(F.sum(_wide(pos_n) * _wide(pos_n - 1)), "max_pos"),
            _long(_wide(F.sum("n")) * _wide(F.sum("n")) - F.sum(_wide("n") * _wide("n")), "max_neg")]


def pair_capacity(corpus: DataFrame, part: str | None = None, positive_label: str | None = None) -> DataFrame:
    """Per corpus, max positives sum n(n-1)/2 (only the positive class in a
    verification task) and max negatives ((sum n)^2 - sum n^2) / 2."""
    c = with_corpus(corpus, part)
    g = c.groupBy("corpus_id", "author").agg(F.count(F.lit(1)).alias("n"))
    pos_n = F.when(F.col("author") == positive_label, F.col("n")).otherwise(0) if positive_label is not None else F.col("n")
    return g.groupBy("corpus_id").agg(F.sum("n").alias("n_docs"), F.count(F.lit(1)).alias("n_groups"), *capacity_columns(pos_n))


def pair_request(capacity: DataFrame, pos_request: int, neg_request: int, max_request: int = -1) -> DataFrame:
    """pos=-1 -> all positives; neg=-1 -> min(pos, max negatives); each class
    then clipped to max_request; a request above capacity raises."""
    pos = F.lit(pos_request).cast("long") if pos_request != -1 else F.col("max_pos")
    neg = F.lit(neg_request).cast("long") if neg_request != -1 else F.least(pos, F.col("max_neg"))
    if max_request != -1:
        pos, neg = F.least(pos, F.lit(max_request)), F.least(neg, F.lit(max_request))
    chk_pos = F.when(F.lit(pos_request) > F.col("max_pos"), F.raise_error(F.lit("fewer positive pairs exist than were asked for")))
    chk_neg = F.when(F.lit(neg_request) > F.col("max_neg"), F.raise_error(F.lit("fewer negative pairs exist than were asked for")))
    return capacity.select(
        "corpus_id", "max_pos", "max_neg",
        F.coalesce(chk_pos.cast("long"), pos.cast("long")).alias("pos_req"),
        F.coalesce(chk_neg.cast("long"), neg.cast("long")).alias("neg_req"),
    )


def pair_request_per_doc(capacity: DataFrame, pos: str, neg: str) -> DataFrame:
    """J7 with requests that grow with the corpus: ``pos`` and ``neg`` are whole-number
    expressions over n_docs, each clipped to its capacity."""
    return capacity.select("corpus_id", "max_pos", "max_neg",
                           F.least(F.expr(pos).cast("long"), F.col("max_pos")).alias("pos_req"),
                           F.least(F.expr(neg).cast("long"), F.col("max_neg")).alias("neg_req"))


def _order_pair(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.withColumn("a", F.least(x, y)).withColumn("b", F.greatest(x, y))


def _attach_doc(df: DataFrame, idx: DataFrame, author_col: str, pos_col: str, out: str) -> DataFrame:
    look = idx.select("corpus_id", F.col("author").alias(author_col), F.col("pos").alias(pos_col), F.col("doc_id").alias(out))
    # a row per document: sorted on both sides, never collected for a broadcast
    return df.join(look.hint("merge"), ["corpus_id", author_col, pos_col])


# ----------------------------------------------------------------- J2 round robin

def round_robin_quotas(groups: DataFrame, req: DataFrame) -> DataFrame:
    """Per-group positive quota t of a round-robin draw of ``pos_req`` pairs.

    r* = first round whose cumulative total reaches the request (found on the
    groups sorted by capacity P), every group gives min(P, r*-1) pairs and the
    first groups in label order with P >= r* give one more.
    """
    g = groups.join(req.select("corpus_id", "pos_req"), "corpus_id")
    # groups taking part (a verification task keeps only the positive class)
    g = g.withColumn("n_grp", F.count(F.lit(1)).over(Window.partitionBy("corpus_id")))
    w = Window.partitionBy("corpus_id").orderBy("P", "author")
    g = (
        g.withColumn("__i", F.row_number().over(w))
        .withColumn("__cum_prev", F.coalesce(F.sum("P").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    )
    tot_at = F.col("__cum_prev") + F.col("P") + (F.col("n_grp") - F.col("__i")) * F.col("P")
    star = (
        g.where(tot_at >= F.col("pos_req"))
        .groupBy("corpus_id")
        .agg(F.min_by(F.struct("__cum_prev", "__i"), "__i").alias("s"))
        .select("corpus_id", F.col("s.__cum_prev").alias("__cp"), F.col("s.__i").alias("__is"))
    )
    g = g.join(star, "corpus_id", "left")
    r_star = F.ceil((F.col("pos_req") - F.col("__cp")) / (F.col("n_grp") - F.col("__is") + 1))
    # no reaching round: the request covers everything
    g = g.withColumn("__r", F.when(F.col("__is").isNull(), F.col("P") + 1).otherwise(r_star).cast("long"))
    g = g.withColumn("__full", F.least(F.col("P"), F.greatest(F.col("__r") - 1, F.lit(0))))
    wc = Window.partitionBy("corpus_id")
    g = g.withColumn("__rem", F.col("pos_req") - F.sum("__full").over(wc))
    g = g.withColumn("__e", (F.col("P") >= F.col("__r")) & F.col("__is").isNotNull())
    we = Window.partitionBy("corpus_id", "__e").orderBy("author")
    g = g.withColumn("__er", F.row_number().over(we))
    extra = F.when(F.col("__e") & (F.col("__er") <= F.col("__rem")), 1).otherwise(0)
    return g.withColumn("t", (F.col("__full") + extra).cast("long")).drop(
        "__i", "__cum_prev", "__cp", "__is", "__r", "__full", "__rem", "__er", "__e"
    )


def positive_pairs_round_robin(idx: DataFrame, req: DataFrame, seed=SEED, positive_label: str | None = None,
                               every: bool = False) -> DataFrame:
    """J1 + J2: (corpus_id, author, a, b, same=1, round).  ``every``: the request is all
    pairs (pos_request = -1, no clip; any other raises), which need no draw."""
    if every:
        less = F.raise_error(F.lit("every pair was asked for, but the request is smaller")).cast("long")
        whole = req.select("corpus_id", F.when(F.col("pos_req") == F.col("max_pos"), F.col("pos_req")).otherwise(less).alias("__req"))
        own = idx if positive_label is None else idx.where(F.col("author") == positive_label)
        return _every_positive_pair(own.join(whole.where("__req > 0"), "corpus_id", "left_semi"))
    groups = group_table(idx)
    if positive_label is not None:
        groups = groups.where(F.col("author") == positive_label)
    q = round_robin_quotas(groups, req).where(F.col("t") > 0)
    s = strata(q.select("corpus_id", "author", "P", "t"), "P", "t", f"{seed}|rr", ["corpus_id", "author"])
    return _positive_docs(s, idx).select("corpus_id", "author", "a", "b", F.lit(1).alias("same"), (F.col("d") + 1).alias("round"))


def _every_positive_pair(idx: DataFrame) -> DataFrame:
    """Every pair of a group, in the order of a round-robin draw of all of them.  Ids
    are packed by position, the packed rows of a group are joined, and pairs are written
    out behind the join: what is shuffled are packed ids, not pairs."""
    at = F.expr(f"(pos - 1) div {PACK}")
    packs = idx.groupBy("corpus_id", "author", at.alias("__bj")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "doc_id"))).alias("__js"))
    last = idx.groupBy("corpus_id", "author").agg(F.max(at).alias("__last"))
    left = packs.select("corpus_id", "author", F.col("__bj").alias("__bi"), F.col("__js").alias("__is")).join(last, ["corpus_id", "author"])
    left = left.withColumn("__bj", F.explode(F.sequence("__bi", "__last")))
    both = left.join(packs.hint("merge"), ["corpus_id", "author", "__bj"])
    i = both.select("corpus_id", "author", F.explode("__is").alias("__i"), "__js")
    p = i.select("corpus_id", "author", "__i", F.explode("__js").alias("__j")).where("__i.pos < __j.pos")
    j = F.col("__j.pos") - 1
    return _order_pair(p.select("corpus_id", "author", F.col("__i.doc_id").alias("__x"), F.col("__j.doc_id").alias("__y"),
                                (F.shiftright(j * (j - 1), 1) + F.col("__i.pos")).alias("round")), "__x", "__y").select(
        "corpus_id", "author", "a", "b", F.lit(1).alias("same"), "round")


def _positive_docs(s: DataFrame, idx: DataFrame) -> DataFrame:
    i, j = decode_pair(F.col("k"))
    s = s.withColumn("__pi", i + 1).withColumn("__pj", j + 1).withColumn("__aj", F.col("author"))
    s = _attach_doc(s, idx, "author", "__pi", "__x")
    s = _attach_doc(s, idx, "__aj", "__pj", "__y")
    return _order_pair(s, "__x", "__y")


# ----------------------------------------------------------------- J3 / J10 uniform

def positive_pairs_uniform(idx: DataFrame, req: DataFrame, seed=SEED, req_col: str = "pos_req",
                           positive_label: str | None = None) -> DataFrame:
    """Sample of ``req_col`` distinct positive pairs per corpus, spread evenly over all."""
    groups = group_table(idx)
    if positive_label is not None:
        groups = groups.where(F.col("author") == positive_label)
    g = groups.join(req.select("corpus_id", F.col(req_col).alias("__req")), "corpus_id")
    q = proportional_quotas(g, "P", "__req").where(F.col("t") > 0)
    s = strata(q.select("corpus_id", "author", "P", "t", "before"), "P", "t", f"{seed}|up", ["corpus_id", "author"])
    return _positive_docs(s, idx).select("corpus_id", "a", "b", (F.col("before") + F.col("d") + 1).alias("rk"), F.lit(1).alias("same"))


def negative_pairs_uniform(idx: DataFrame, req: DataFrame, seed=SEED, req_col: str = "neg_req") -> DataFrame:
    """Sample of ``req_col`` distinct different-author pairs per corpus, spread evenly
    over all: a group's quota covers its pairs with documents of later groups."""
    groups = group_table(idx)
    total = groups.groupBy("corpus_id").agg(F.sum("n").alias("__n"))
    g = groups.join(req.select("corpus_id", F.col(req_col).alias("__req")), "corpus_id").join(total, "corpus_id")
    g = g.withColumn("__later", F.col("__n") - F.col("upto")).withColumn("M", F.col("n") * F.col("__later"))
    q = proportional_quotas(g, "M", "__req").where(F.col("t") > 0)
    s = strata(q.select("corpus_id", "author", "M", "t", "before", "__later", "upto"), "M", "t", f"{seed}|un", ["corpus_id", "author"])
    s = s.withColumn("__px", F.expr("k div __later") + 1).withColumn("__op", F.col("upto") + F.col("k") % F.col("__later") + 1)
    s = _attach_doc(s, idx, "author", "__px", "__x")
    starts = groups.select("corpus_id", "author", (F.col("upto") - F.col("n")).alias("__start"))
    placed = idx.join(starts, ["corpus_id", "author"]).select(
        "corpus_id", (F.col("__start") + F.col("pos")).alias("__op"), F.col("doc_id").alias("__y"))
    s = _order_pair(s.join(placed, ["corpus_id", "__op"]), "__x", "__y")
    return s.select("corpus_id", "a", "b", (F.col("before") + F.col("d") + 1).alias("rk"), F.lit(0).alias("same"))


# ----------------------------------------------------------------- J4 negatives

def negative_pairs(idx: DataFrame, req: DataFrame, seed=SEED, req_col: str = "neg_req") -> DataFrame:
    """(corpus_id, a, b, same=0, rk): every pair of groups counts alike, and so
    does every pair of documents of two groups; ``rk`` is the round in which a pair
    of groups gives it."""
    groups = group_table(idx)
    stats = groups.groupBy("corpus_id").agg(F.first("n_grp").alias("n_grp"))
    stats = stats.join(req.select("corpus_id", F.col(req_col).alias("__req")), "corpus_id").where("__req > 0 and n_grp > 1")
    stats = stats.withColumn("__gp", F.expr("case when n_grp % 2 = 0 then (n_grp div 2) * (n_grp - 1) else n_grp * ((n_grp - 1) div 2) end"))
    stats = stats.withColumn("__e", F.least("__gp", "__req"))
    e = strata(stats, "__gp", "__e", f"{seed}|ng", ["corpus_id"]).drop("d")
    g1, g2 = decode_pair(F.col("k"))
    e = e.select("corpus_id", "__req", g1.alias("g1"), g2.alias("g2"))
    gt = groups.select("corpus_id", "g", "author", "n")
    e = e.join(gt.select("corpus_id", F.col("g").alias("g1"), F.col("author").alias("__ax"), F.col("n").alias("__n1")), ["corpus_id", "g1"])
    e = e.join(gt.select("corpus_id", F.col("g").alias("g2"), F.col("author").alias("__ay"), F.col("n").alias("__n2")), ["corpus_id", "g2"])
    label = F.concat_ws("|", F.lpad(F.col("g1").cast("string"), 12, "0"), F.lpad(F.col("g2").cast("string"), 12, "0"))
    e = e.withColumn("P", F.col("__n1") * F.col("__n2")).withColumn("author", label)
    want = stats.select("corpus_id", F.col("__req").alias("pos_req"))
    q = round_robin_quotas(e.select("corpus_id", "author", "P", "__ax", "__ay", "__n2"), want).where(F.col("t") > 0)
    s = strata(q, "P", "t", f"{seed}|np", ["corpus_id", "author"])
    s = s.withColumn("__px", F.expr("k div __n2") + 1).withColumn("__py", F.col("k") % F.col("__n2") + 1)
    s = _attach_doc(s, idx, "__ax", "__px", "__x")
    s = _attach_doc(s, idx, "__ay", "__py", "__y")
    s = _order_pair(s, "__x", "__y")
    return s.select("corpus_id", "a", "b", (F.col("d") + 1).alias("rk"), F.lit(0).alias("same"))


# ----------------------------------------------------------------- J5 / J8 driver

def generate_pairs(corpus: DataFrame, pos_request: int = -1, neg_request: int = -1, max_request: int = -1,
                   policy: str = "round_robin", seed=SEED, part: str | None = None,
                   verification_task: bool = False) -> DataFrame:
    """PairGenerator as one plan: (corpus_id, a, b, same) per corpus (J8: corpora
    never mix).  ``verification_task``: author holds '0'/'1'; positives only
    inside class '1', negatives across the two classes (J5)."""
    positive_label = "1" if verification_task else None
    if verification_task:
        bad = F.raise_error(F.lit("a verification target must be 0 or 1"))
        corpus = corpus.withColumn("author", F.when(F.col("author").isin("0", "1"), F.col("author")).otherwise(bad.cast("string")))
    idx = indexed_docs(corpus, seed, part)
    cap = pair_capacity(corpus, part, positive_label)
    req = pair_request(cap, pos_request, neg_request, max_request)
    if policy == "round_robin":
        pos = positive_pairs_round_robin(idx, req, seed, positive_label).select("corpus_id", "a", "b", "same")
    elif policy == "random":
        pos = positive_pairs_uniform(idx, req, seed, positive_label=positive_label).select("corpus_id", "a", "b", "same")
    else:
        raise ValueError(f"unexpected pos_selection {policy}")
    neg = negative_pairs(idx, req, seed).select("corpus_id", "a", "b", "same")
    return pos.unionByName(neg)


def verification_coordinates(corpus: DataFrame, balanced: bool = True, subsample: int = 1000, seed=SEED,
                             part: str | None = None) -> DataFrame:
    """Evaluation pairs (corpus_id, a, b, same).  balanced: as many negatives as
    positives; subsample: keep int(share_pos * subsample) positives and the rest
    negatives.  Without a subsample the result is every (balanced) pair."""
    idx = indexed_docs(corpus, seed, part)
    cap = pair_capacity(corpus, part)
    npos = F.col("max_pos")
    nneg = F.least(F.col("max_pos"), F.col("max_neg")) if balanced else F.col("max_neg")
    total = npos + nneg
    if subsample != -1:
        take_pos = F.when(F.lit(subsample) < total, F.floor(npos / total * subsample)).otherwise(npos)
        take_neg = F.when(F.lit(subsample) < total, F.lit(subsample) - take_pos).otherwise(nneg)
    else:
        take_pos, take_neg = npos, nneg
    req = cap.select("corpus_id", take_pos.cast("long").alias("pos_req"), take_neg.cast("long").alias("neg_req"))
    pos = positive_pairs_uniform(idx, req, f"{seed}v")
    neg = negative_pairs_uniform(idx, req, f"{seed}v")
    return pos.unionByName(neg).select("corpus_id", "a", "b", "same")
