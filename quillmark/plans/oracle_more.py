"""DuckDB twins, second part: pairs, vector math, rules, metrics, impostors.

The pair twins replay the same seeded draws as the Spark plans (same md5
keys, same arithmetic), so the first-k-distinct selections are identical.
"""
from __future__ import annotations

from ..functions.hashing import sql_hkey, sql_uniform, sql_uniform_of_hex
from .oracle import CORPUS, CORPUS_LS, o, split_sql

VECTORS = ("SELECT vec_id AS doc_id, CAST(label AS VARCHAR) AS author, "
           "list_transform(embedding, x -> CAST(x AS DOUBLE)) AS vec FROM embeddings")
ABS_VECTORS = ("SELECT vec_id AS doc_id, CAST(label AS VARCHAR) AS author, "
               "list_transform(embedding, x -> abs(CAST(x AS DOUBLE))) AS vec FROM embeddings")
U42 = sql_uniform(42, "doc_id")
EMB_SPLIT = f"""SELECT v.doc_id, v.author, v.vec, s.split FROM ({VECTORS}) v JOIN (
  SELECT doc_id, CASE WHEN rk <= round(n * 0.3) THEN 'test' ELSE 'train' END AS split FROM (
    SELECT doc_id, row_number() OVER (PARTITION BY author ORDER BY {U42}, doc_id) AS rk,
      count(*) OVER (PARTITION BY author) AS n FROM ({VECTORS}))) s ON v.doc_id = s.doc_id"""


def L1(a, b):
    return f"list_sum(list_transform(range(1, len({a}) + 1), i -> abs({a}[i] - {b}[i])))"


def L2(a, b):
    return f"sqrt(list_sum(list_transform(range(1, len({a}) + 1), i -> ({a}[i] - {b}[i]) * ({a}[i] - {b}[i]))))"


def NRM(a):
    return f"sqrt(list_sum(list_transform({a}, x -> x * x)))"


def DOT(a, b):
    return f"list_sum(list_transform(range(1, len({a}) + 1), i -> {a}[i] * {b}[i]))"


def COS(a, b):
    return f"(CASE WHEN {NRM(a)} * {NRM(b)} = 0 THEN 0.0 ELSE {DOT(a, b)} / ({NRM(a)} * {NRM(b)}) END)"


def COSD(a, b):
    ua = f"(CASE WHEN {NRM(a)} = 0 THEN 0.0 ELSE {a}[i] / {NRM(a)} END)"
    ub = f"(CASE WHEN {NRM(b)} = 0 THEN 0.0 ELSE {b}[i] / {NRM(b)} END)"
    return f"0.5 * list_sum(list_transform(range(1, len({a}) + 1), i -> ({ua} - {ub}) * ({ua} - {ub})))"


def MINMAX(a, b):
    num = f"list_sum(list_transform(range(1, len({a}) + 1), i -> least({a}[i], {b}[i])))"
    den = f"list_sum(list_transform(range(1, len({a}) + 1), i -> greatest({a}[i], {b}[i])))"
    return f"(CASE WHEN {den} = 0 THEN 0.0 ELSE {num} / {den} END)"


def chain_pairs_sql(src: str) -> str:
    """Twin of queries.chain_pairs over a (doc_id, author) source."""
    return f"""(SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM (
  SELECT x.doc_id AS a, y.doc_id AS b FROM
    (SELECT doc_id, author, row_number() OVER (PARTITION BY author ORDER BY {U42}, doc_id) AS pos FROM ({src})) x
    JOIN (SELECT doc_id, author, row_number() OVER (PARTITION BY author ORDER BY {U42}, doc_id) AS pos FROM ({src})) y
    ON x.author = y.author AND y.pos = x.pos + 1
  UNION ALL
  SELECT x.doc_id AS a, y.doc_id AS b FROM ({src}) x JOIN ({src}) y ON y.doc_id = x.doc_id + 1))"""


EMB_CHAIN = chain_pairs_sql(VECTORS)

for name, fn, src in (("paired_distance_l1", L1, VECTORS), ("paired_distance_l2", L2, VECTORS),
                      ("paired_distance_cosine", COSD, VECTORS), ("cosine_similarity", COS, VECTORS),
                      ("minmax_similarity", MINMAX, ABS_VECTORS)):
    o(name, f"""
SELECT p.a, p.b, round({fn('x.vec', 'y.vec')}, 6) AS score FROM {EMB_CHAIN} p
JOIN ({src}) x ON x.doc_id = p.a JOIN ({src}) y ON y.doc_id = p.b
""")

o("diff_vectors", f"""
SELECT a, b, CAST(unnest(range(0, len(d))) AS BIGINT) AS dim, round(unnest(d), 6) AS val FROM (
  SELECT p.a, p.b, list_transform(range(1, len(x.vec) + 1), i -> abs(x.vec[i] - y.vec[i])) AS d FROM {EMB_CHAIN} p
  JOIN ({VECTORS}) x ON x.doc_id = p.a JOIN ({VECTORS}) y ON y.doc_id = p.b)
""")

# ------------------------------------------------------------------ pairs
IDX_LS = f"""SELECT 'all' AS corpus_id, author, doc_id,
  row_number() OVER (PARTITION BY author ORDER BY {U42}, doc_id) AS pos,
  count(*) OVER (PARTITION BY author) AS n_docs,
  row_number() OVER (ORDER BY {sql_uniform('42g', 'doc_id')}, doc_id) AS gpos,
  count(*) OVER () AS n_corpus FROM ({CORPUS_LS})"""
def groups_sql(idx: str) -> str:
    return f"""SELECT corpus_id, author, n, CAST(n * (n - 1) / 2 AS BIGINT) AS P,
  row_number() OVER (PARTITION BY corpus_id ORDER BY author) - 1 AS g,
  count(*) OVER (PARTITION BY corpus_id) AS n_grp,
  CAST(sum(n) OVER (PARTITION BY corpus_id ORDER BY author) AS BIGINT) AS upto
  FROM (SELECT corpus_id, author, count(*) AS n FROM {idx} GROUP BY corpus_id, author)"""


CAP = """SELECT corpus_id, CAST(sum(n) AS BIGINT) AS n_docs, count(*) AS n_groups, CAST(sum(n * (n - 1) / 2) AS BIGINT) AS max_pos,
  CAST((sum(n) * sum(n) - sum(n * n)) / 2 AS BIGINT) AS max_neg FROM (
  SELECT 'all' AS corpus_id, author, count(*) AS n FROM ({src}) GROUP BY author) GROUP BY corpus_id"""

o("pair_capacity", CAP.replace("{src}", CORPUS_LS))
o("pair_request", f"""
SELECT corpus_id, max_pos, max_neg, CAST(least(5000, 3000) AS BIGINT) AS pos_req,
  CAST(least(least(5000, max_neg), 3000) AS BIGINT) AS neg_req FROM ({CAP.replace("{src}", CORPUS_LS)})
""")


def decode_sql(k: str) -> tuple[str, str]:
    j0 = f"CAST(floor((1.0 + sqrt(1.0 + 8.0 * CAST({k} AS DOUBLE))) / 2) AS BIGINT)"
    j1 = f"(CASE WHEN {j0} * ({j0} - 1) / 2 > {k} THEN {j0} - 1 ELSE {j0} END)"
    j = f"(CASE WHEN ({j1} + 1) * {j1} / 2 <= {k} THEN {j1} + 1 ELSE {j1} END)"
    i = f"CAST({k} - {j} * ({j} - 1) / 2 AS BIGINT)"
    return i, j


def strata_sql(src: str, size: str, take: str, seed: str, keys: tuple[str, ...]) -> str:
    """``take`` numbers k of [0, size) per row of src, one per stratum d."""
    u = sql_uniform(seed, *keys, "d")
    return f"""SELECT *, CAST(d * q_ + least(d, r_) + least(CAST(floor({u} * w_) AS BIGINT), w_ - 1) AS BIGINT) AS k FROM (
  SELECT *, q_ + CASE WHEN d < r_ THEN 1 ELSE 0 END AS w_ FROM (
    SELECT *, CAST({size} // {take} AS BIGINT) AS q_, CAST({size} % {take} AS BIGINT) AS r_,
      unnest(range(0, CAST({take} AS BIGINT))) AS d FROM {src} WHERE {take} > 0))"""


def fill_sql(p: str, src: str) -> str:
    """CTEs: water-filling quotas t of pos_req over src (corpus_id, author, P, pos_req); result {p}q."""
    return f"""
{p}f1 AS (SELECT *, count(*) OVER (PARTITION BY corpus_id) AS ng_, row_number() OVER (PARTITION BY corpus_id ORDER BY P, author) AS i_,
  coalesce(sum(P) OVER (PARTITION BY corpus_id ORDER BY P, author ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cp FROM {src}),
{p}f2 AS (SELECT corpus_id, arg_min(cp, i_) AS cps, min(i_) AS i_s FROM {p}f1
  WHERE cp + P + (ng_ - i_) * P >= pos_req GROUP BY corpus_id),
{p}f3 AS (SELECT {p}f1.*, i_s, CAST(CASE WHEN i_s IS NULL THEN P + 1 ELSE ceil((pos_req - cps) / (ng_ - i_s + 1)) END AS BIGINT) AS lv_
  FROM {p}f1 LEFT JOIN {p}f2 USING (corpus_id)),
{p}f4 AS (SELECT *, least(P, greatest(lv_ - 1, 0)) AS full_, (P >= lv_ AND i_s IS NOT NULL) AS e_ FROM {p}f3),
{p}f5 AS (SELECT *, pos_req - sum(full_) OVER (PARTITION BY corpus_id) AS rem_ FROM {p}f4),
{p}q AS (SELECT *, CAST(full_ + CASE WHEN e_ AND row_number() OVER (PARTITION BY corpus_id, e_ ORDER BY author) <= rem_ THEN 1 ELSE 0 END AS BIGINT) AS t FROM {p}f5)"""


def docs_sql(src: str, idx: str, ax: str, px: str, ay: str, py: str, cols: str) -> str:
    return f"""SELECT {cols}, least(x.doc_id, y.doc_id) AS a, greatest(x.doc_id, y.doc_id) AS b FROM {src} s
JOIN {idx} x ON x.corpus_id = s.corpus_id AND x.author = s.{ax} AND x.pos = {px}
JOIN {idx} y ON y.corpus_id = s.corpus_id AND y.author = s.{ay} AND y.pos = {py}"""


def rr_sql(pos_req, idx: str = IDX_LS, group_filter: str = "TRUE", with_clause: bool = True) -> str:
    i, j = decode_sql("s.k")
    return f"""
{"WITH " if with_clause else ""}idx AS ({idx}), grp AS ({groups_sql('idx')}),
rr0 AS (SELECT corpus_id, author, P, least(sum(P) OVER (PARTITION BY corpus_id), {pos_req}) AS pos_req FROM grp WHERE {group_filter}),
{fill_sql('rr', 'rr0')},
rrk AS ({strata_sql('rrq', 'P', 't', '42|rr', ('corpus_id', 'author'))}),
rr_out AS (SELECT corpus_id, author, a, b, 1 AS same, round FROM (
  {docs_sql('rrk', 'idx', 'author', f'{i} + 1', 'author', f'{j} + 1', 's.corpus_id, s.author, s.d + 1 AS round')}))""" + (
        "\nSELECT * FROM rr_out" if with_clause else "")


N_DOCS = "sum(n) OVER (PARTITION BY corpus_id)"
o("positive_pairs_round_robin", rr_sql(f"CAST({N_DOCS} * 3 // 2 AS BIGINT)"))


def share_sql(src: str, size: str, req: str) -> str:
    """Proportional quotas: t by running total, before = quotas of earlier groups."""
    return f"""SELECT *, CAST(req_ * up_ // cap_ AS BIGINT) - before AS t FROM (
  SELECT *, CAST(req_ * (up_ - {size}) // cap_ AS BIGINT) AS before FROM (
    SELECT *, {req} AS req_, CAST(sum({size}) OVER (PARTITION BY corpus_id ORDER BY author) AS HUGEINT) AS up_,
      CAST(sum({size}) OVER (PARTITION BY corpus_id) AS HUGEINT) AS cap_ FROM {src}) WHERE cap_ > 0)"""


def uniform_pos_sql(seed: str, req: str, idx: str) -> str:
    """Twin of positive_pairs_uniform: (corpus_id, a, b, rk) for one request expression."""
    i, j = decode_sql("s.k")
    return f"""
idx AS ({idx}), grp AS ({groups_sql('idx')}),
up_t AS ({share_sql('grp', 'P', req)}),
up_k AS ({strata_sql('up_t', 'P', 't', f'{seed}|up', ('corpus_id', 'author'))}),
pos_out AS ({docs_sql('up_k', 'idx', 'author', f'{i} + 1', 'author', f'{j} + 1', 's.corpus_id, s.before + s.d + 1 AS rk')})"""


def negative_sql(seed: str, req: str, idx: str, p: str = "n") -> str:
    """Twin of negative_pairs; ``req`` is an expression over the groups of a corpus."""
    g1, g2 = decode_sql("k")
    return f"""
{p}idx AS ({idx}), {p}grp AS ({groups_sql(f'{p}idx')}),
{p}st AS (SELECT *, least(gp, req_) AS e FROM (SELECT corpus_id, any_value(n_grp) AS n_grp, CAST({req} AS BIGINT) AS req_,
  CAST(any_value(n_grp) * (any_value(n_grp) - 1) / 2 AS BIGINT) AS gp FROM {p}grp GROUP BY corpus_id) WHERE req_ > 0 AND n_grp > 1),
{p}e AS (SELECT corpus_id, req_, {g1} AS g1, {g2} AS g2 FROM ({strata_sql(f'{p}st', 'gp', 'e', f'{seed}|ng', ('corpus_id',))})),
{p}c AS (SELECT e.corpus_id, e.req_ AS pos_req, u.author AS ax, v.author AS ay, v.n AS n2, u.n * v.n AS P,
  concat_ws('|', lpad(CAST(e.g1 AS VARCHAR), 12, '0'), lpad(CAST(e.g2 AS VARCHAR), 12, '0')) AS author
  FROM {p}e e JOIN {p}grp u ON u.corpus_id = e.corpus_id AND u.g = e.g1 JOIN {p}grp v ON v.corpus_id = e.corpus_id AND v.g = e.g2),
{fill_sql(p, f'{p}c')},
{p}k AS ({strata_sql(f'{p}q', 'P', 't', f'{seed}|np', ('corpus_id', 'author'))}),
neg_out AS ({docs_sql(f'{p}k', f'{p}idx', 'ax', 's.k // s.n2 + 1', 'ay', 's.k % s.n2 + 1', 's.corpus_id, s.d + 1 AS rk')})"""


def uniform_neg_sql(seed: str, req: str, idx: str) -> str:
    return f"""
nidx AS ({idx}), ngrp AS ({groups_sql('nidx')}),
un_g AS (SELECT *, n * later AS M FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY corpus_id) - upto AS BIGINT) AS later FROM ngrp)),
un_t AS ({share_sql('un_g', 'M', req)}),
un_k AS ({strata_sql('un_t', 'M', 't', f'{seed}|un', ('corpus_id', 'author'))}),
un_p AS (SELECT i.corpus_id, g.upto - g.n + i.pos AS op, i.doc_id FROM nidx i JOIN ngrp g ON g.corpus_id = i.corpus_id AND g.author = i.author),
uneg_out AS (SELECT s.corpus_id, s.before + s.d + 1 AS rk, least(x.doc_id, y.doc_id) AS a, greatest(x.doc_id, y.doc_id) AS b FROM un_k s
  JOIN nidx x ON x.corpus_id = s.corpus_id AND x.author = s.author AND x.pos = s.k // s.later + 1
  JOIN un_p y ON y.corpus_id = s.corpus_id AND y.op = s.upto + s.k % s.later + 1)"""


o("positive_pairs_random", f"""
WITH {uniform_pos_sql("42", f"CAST(least(sum(P) OVER (PARTITION BY corpus_id), {N_DOCS} * 3 // 2) AS BIGINT)", IDX_LS)}
SELECT corpus_id, a, b, 1 AS same, rk FROM pos_out
""")

o("negative_pairs", f"""
WITH {negative_sql('42', '2000', IDX_LS)}
SELECT corpus_id, a, b, 0 AS same, rk FROM neg_out
""")


def idx_of(src: str, seed: str = "42") -> str:
    u = sql_uniform(seed, "doc_id")
    ug = sql_uniform(f"{seed}g", "doc_id")
    return f"""SELECT 'all' AS corpus_id, author, doc_id,
  row_number() OVER (PARTITION BY author ORDER BY {u}, doc_id) AS pos,
  count(*) OVER (PARTITION BY author) AS n_docs,
  row_number() OVER (ORDER BY {ug}, doc_id) AS gpos,
  count(*) OVER () AS n_corpus FROM ({src})"""


TEST_DOCS = f"SELECT doc_id, author FROM ({split_sql(CORPUS)}) WHERE split = 'test'"
VC_REQ_POS = ("(SELECT CAST(CASE WHEN 1000 < mp + least(mp, mn) THEN floor(mp / (mp + least(mp, mn)) * 1000) ELSE mp END AS BIGINT) "
              "FROM (SELECT sum(n * (n - 1) / 2) AS mp, (sum(n) * sum(n) - sum(n * n)) / 2 AS mn FROM grp))")
VC_REQ_NEG = ("(SELECT CAST(CASE WHEN 1000 < mp + least(mp, mn) THEN 1000 - floor(mp / (mp + least(mp, mn)) * 1000) ELSE least(mp, mn) END AS BIGINT) "
              "FROM (SELECT sum(n * (n - 1) / 2) AS mp, (sum(n) * sum(n) - sum(n * n)) / 2 AS mn FROM ngrp))")
o("verification_coordinates", f"""
WITH {uniform_pos_sql('42v', VC_REQ_POS, idx_of(TEST_DOCS, '42'))},
{uniform_neg_sql('42v', VC_REQ_NEG, idx_of(TEST_DOCS, '42'))}
SELECT corpus_id, a, b, 1 AS same FROM pos_out UNION ALL SELECT corpus_id, a, b, 0 AS same FROM uneg_out
""")

# ------------------------------------------------------------------ projection, kNN, metrics
TE = f"SELECT * FROM ({EMB_SPLIT}) WHERE split = 'test'"
TR = f"SELECT * FROM ({EMB_SPLIT}) WHERE split = 'train'"
SCORES = f"""SELECT x.doc_id AS x_id, r.doc_id AS ref_id, r.author AS ref_author, {COS('x.vec', 'r.vec')} AS p
FROM ({TE}) x, ({TR}) r"""

o("pairwise_projection", f"SELECT x_id, ref_id, ref_author, round(p, 6) AS p FROM ({SCORES})")
o("pairwise_symmetric", f"""
SELECT x.doc_id AS x_id, r.doc_id AS ref_id, r.author AS ref_author, round({L1('x.vec', 'r.vec')}, 6) AS p
FROM ({TR}) x, ({TR}) r
""")

KNN = f"""SELECT x_id AS doc_id, ref_author AS pred, score FROM (
  SELECT *, row_number() OVER (PARTITION BY x_id ORDER BY round(score, 9) DESC, ref_author) AS rn FROM (
    SELECT x_id, ref_author, avg(p) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY x_id, ref_author ORDER BY round(p, 9) DESC, ref_id) AS rn FROM ({SCORES}))
    WHERE rn <= 5 GROUP BY x_id, ref_author)) WHERE rn = 1"""
o("knn_attribution", f"SELECT doc_id, pred, round(score, 6) AS score FROM ({KNN})")

PRED = f"SELECT k.doc_id, k.pred, t.author AS truth FROM ({KNN}) k JOIN ({TE}) t ON k.doc_id = t.doc_id"
CLS = f"""SELECT cls, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, max(t) AS in_truth FROM (
  SELECT truth AS cls, CASE WHEN truth = pred THEN 1 ELSE 0 END AS tp, 0 AS fp, CASE WHEN truth = pred THEN 0 ELSE 1 END AS fn, 1 AS t FROM ({PRED})
  UNION ALL SELECT pred AS cls, 0, CASE WHEN truth = pred THEN 0 ELSE 1 END, 0, 0 FROM ({PRED})) GROUP BY cls"""
F1C = "CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END"
o("metric_attribution", f"""
SELECT round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END, 6) AS acc, round(f1_macro, 6) AS f1_macro,
  round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6) AS f1_micro
FROM (SELECT avg({F1C}) AS f1_macro, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM ({CLS}))
""")
o("metric_verification", f"""
SELECT round(1.0 - (fp + fn) / (nn * c), 6) AS acc, round(f1_macro, 6) AS f1_macro,
  round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6) AS f1_micro
FROM (SELECT count(*) AS c, avg({F1C}) AS f1_macro, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM ({CLS}) WHERE in_truth = 1),
  (SELECT count(*) AS nn FROM ({PRED}))
""")

EMB_TEST_CHAIN = chain_pairs_sql(f"SELECT doc_id, author FROM ({TE})")
EVAL = f"""SELECT p.a, p.b, CASE WHEN x.author = y.author THEN 1 ELSE 0 END AS same FROM {EMB_TEST_CHAIN} p
JOIN ({TE}) x ON x.doc_id = p.a JOIN ({TE}) y ON y.doc_id = p.b"""


def sav_metrics_sql(src: str) -> str:
    return f"""SELECT round(100.0 * (tp + tn) / n, 6) AS acc,
  round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END, 6) AS p,
  round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END, 6) AS r,
  round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6) AS f1
FROM (SELECT count(*) AS n, sum(CASE WHEN same = 1 AND pred = 1 THEN 1 ELSE 0 END) AS tp,
  sum(CASE WHEN same <> 1 AND pred = 1 THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN same = 1 AND pred <> 1 THEN 1 ELSE 0 END) AS fn,
  sum(CASE WHEN same <> 1 AND pred <> 1 THEN 1 ELSE 0 END) AS tn FROM ({src}))"""


o("sav_via_attribution", sav_metrics_sql(f"""
SELECT e.a, e.b, e.same, CASE WHEN pa.pred = pb.pred THEN 1 ELSE 0 END AS pred FROM ({EVAL}) e
JOIN ({KNN}) pa ON pa.doc_id = e.a JOIN ({KNN}) pb ON pb.doc_id = e.b"""))
o("trivial_rejector", f"""SELECT round(100.0 * avg(1 - same), 6) AS acc, CAST(1.0 AS DOUBLE) AS p, CAST(0.0 AS DOUBLE) AS r,
  CAST(0.0 AS DOUBLE) AS f1 FROM ({EVAL})""")

SCORED = f"""SELECT e.a, e.b, e.same, {COS('x.vec', 'y.vec')} AS score FROM ({EVAL}) e
JOIN ({VECTORS}) x ON x.doc_id = e.a JOIN ({VECTORS}) y ON y.doc_id = e.b"""
SCORED_P = f"SELECT *, CASE WHEN score > 0.5 THEN 1 ELSE 0 END AS pred FROM ({SCORED})"
o("metric_sav", sav_metrics_sql(SCORED_P))
o("scores_by_truth", f"SELECT a, b, same, round(score, 6) AS score FROM ({SCORED})")
o("metric_pan_auc", f"""
WITH s AS ({SCORED_P}),
g AS (SELECT score, sum(CASE WHEN same = 1 THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN same = 1 THEN 0 ELSE 1 END) AS neg FROM s GROUP BY score),
gb AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM g),
a AS (SELECT sum(pos * (nb + 0.5 * neg)) / (sum(pos) * sum(neg)) AS auc FROM gb),
c AS (SELECT count(*) AS n, sum(CASE WHEN same = 1 AND pred = 1 THEN 1 ELSE 0 END) AS tp,
  sum(CASE WHEN same <> 1 AND pred = 1 THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN same = 1 AND pred <> 1 THEN 1 ELSE 0 END) AS fn,
  sum(CASE WHEN same <> 1 AND pred <> 1 THEN 1 ELSE 0 END) AS tn FROM s)
SELECT round((tp + tn) / n, 6) AS acc, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6) AS f1,
  round(auc, 6) AS auc, round((tp + tn) / n * auc, 6) AS acc_auc FROM c, a
""")

CAL = f"SELECT CAST(same AS DOUBLE) AS y, (score + 1) / 2 AS p FROM ({SCORED})"
o("calibration_curve_uniform", f"""
SELECT CAST(bin AS BIGINT) AS bin, round(avg(y), 6) AS prob_true, round(avg(p), 6) AS prob_pred, count(*) AS n FROM (
  SELECT y, p, len(list_filter(range(1, 10), k -> k * CAST(1.00000001 AS DOUBLE) / 10 < p AND k < 10)) AS bin FROM ({CAL}))
GROUP BY bin
""")
o("calibration_curve_quantile", f"""
WITH c AS ({CAL}), e AS (SELECT quantile_cont(p, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS q FROM c)
SELECT CAST(bin AS BIGINT) AS bin, round(avg(y), 6) AS prob_true, round(avg(p), 6) AS prob_pred, count(*) AS n FROM (
  SELECT y, p, len(list_filter(list_slice(q, 2, 5), x -> x < p)) AS bin FROM c, e) GROUP BY bin
""")

# ------------------------------------------------------------------ impostors
o("impostor_params", f"""
SELECT n_docs, CAST(CASE WHEN 50 > floor(n_docs / 2) THEN floor(n_docs / 2) ELSE 50 END AS BIGINT) AS m,
  CAST(CASE WHEN 50 > floor(n_docs / 2) THEN least(10, floor(floor(n_docs / 2) / 2)) ELSE 10 END AS BIGINT) AS n
FROM (SELECT count(*) AS n_docs FROM ({TR}))
""")

from .oracle import WORD_COUNTS as _WC  # noqa: E402
WORD_COUNTS_TR = _WC.replace("{src}", f"SELECT * FROM ({split_sql()}) WHERE split = 'train'")
SUBSETS = f"""SELECT iter, feat FROM (
  SELECT iter, feat, row_number() OVER (PARTITION BY iter ORDER BY {sql_uniform(42, 'iter', 'feat')}, feat) AS r
  FROM range(0, {{k}}) i(iter), range(0, 64) f(feat)) WHERE r <= 32"""
_NFEAT = f"""(SELECT count(*) FROM (
  SELECT feat FROM ({WORD_COUNTS_TR}) GROUP BY feat HAVING count(*) >= 3))"""
o("impostor_feature_subsets", f"""
SELECT iter, feat FROM (
  SELECT iter, feat, row_number() OVER (PARTITION BY iter ORDER BY {sql_uniform(42, 'iter', 'feat')}, feat) AS r,
    (SELECT * FROM nf) AS nf FROM range(0, 100) i(iter), range(0, (SELECT * FROM nf)) f(feat))
WHERE r <= nf // 2
""".replace("SELECT iter, feat FROM (", "WITH nf AS " + _NFEAT + " SELECT iter, feat FROM (", 1))

ATE = f"SELECT v.doc_id, v.vec FROM ({ABS_VECTORS}) v JOIN ({TE}) t ON v.doc_id = t.doc_id"
ATR = f"SELECT v.doc_id, v.vec FROM ({ABS_VECTORS}) v JOIN ({TR}) t ON v.doc_id = t.doc_id"


def topimp_sql(docs: str, ref: str) -> str:
    return f"""SELECT doc_id, imp_rank, imp_id, sim FROM (
  SELECT x.doc_id, r.doc_id AS imp_id, {MINMAX('x.vec', 'r.vec')} AS sim,
    row_number() OVER (PARTITION BY x.doc_id ORDER BY round({MINMAX('x.vec', 'r.vec')}, 9) DESC, r.doc_id) AS imp_rank
  FROM ({docs}) x, ({ref}) r) WHERE imp_rank <= 20"""


TOPIMP = topimp_sql(ATE, ATR)
o("top_impostors", f"SELECT doc_id, CAST(imp_rank AS BIGINT) AS imp_rank, imp_id, round(sim, 6) AS sim FROM ({TOPIMP})")



def draws_sql(ev: str) -> str:
    return f"""SELECT a, b, dir, iter, j, CAST(floor({sql_uniform(42, 'a', 'b', 'dir', 'iter', 'j')} * 20) + 1 AS BIGINT) AS imp_rank
FROM (SELECT a, b FROM ({ev})), (VALUES (0), (1)) d(dir), range(0, 30) i(iter), range(0, 5) jj(j)"""


DRAWS = draws_sql(EVAL)
o("impostor_draws", f"SELECT a, b, CAST(dir AS INTEGER) AS dir, iter, j, imp_rank FROM ({DRAWS})")


def imp_scores_sql(ev: str, topimp: str) -> str:
    return f"""
WITH ev AS ({ev}),
av AS ({ABS_VECTORS}),
lv AS (SELECT doc_id, unnest(range(0, len(vec))) AS f, unnest(vec) AS val FROM av),
sub AS ({SUBSETS.replace("{k}", "30")}),
dr AS (SELECT d.*, CASE WHEN dir = 0 THEN a ELSE b END AS x, CASE WHEN dir = 0 THEN b ELSE a END AS v FROM ({draws_sql(ev)}) d),
di AS (SELECT dr.*, t.imp_id FROM dr JOIN ({topimp}) t ON t.doc_id = dr.v AND t.imp_rank = dr.imp_rank),
si AS (SELECT di.a, di.b, di.dir, di.iter, di.j,
  CASE WHEN sum(greatest(lx.val, li.val)) = 0 THEN 0.0 ELSE sum(least(lx.val, li.val)) / sum(greatest(lx.val, li.val)) END AS s
  FROM di JOIN sub ON sub.iter = di.iter JOIN lv lx ON lx.doc_id = di.x AND lx.f = sub.feat JOIN lv li ON li.doc_id = di.imp_id AND li.f = sub.feat
  GROUP BY di.a, di.b, di.dir, di.iter, di.j),
best AS (SELECT a, b, dir, iter, max(s) AS s_imp FROM si GROUP BY a, b, dir, iter),
xv AS (SELECT DISTINCT a, b, dir, iter, x, v FROM dr),
sx AS (SELECT xv.a, xv.b, xv.dir, xv.iter,
  CASE WHEN sum(greatest(lx.val, lw.val)) = 0 THEN 0.0 ELSE sum(least(lx.val, lw.val)) / sum(greatest(lx.val, lw.val)) END AS s_xv
  FROM xv JOIN sub ON sub.iter = xv.iter JOIN lv lx ON lx.doc_id = xv.x AND lx.f = sub.feat JOIN lv lw ON lw.doc_id = xv.v AND lw.f = sub.feat
  GROUP BY xv.a, xv.b, xv.dir, xv.iter),
ds AS (SELECT best.a, best.b, best.dir, sum(CASE WHEN sx.s_xv >= best.s_imp THEN 1.0 ELSE 0.0 END) / 30.0 AS s
  FROM best JOIN sx ON sx.a = best.a AND sx.b = best.b AND sx.dir = best.dir AND sx.iter = best.iter GROUP BY best.a, best.b, best.dir),
sc AS (SELECT a, b, max(CASE WHEN dir = 0 THEN s END) AS score_ab, max(CASE WHEN dir = 1 THEN s END) AS score_ba FROM ds GROUP BY a, b)
SELECT sc.a, sc.b, ev.same, sc.score_ab, sc.score_ba, (sc.score_ab + sc.score_ba) / 2 AS score FROM sc JOIN ev ON ev.a = sc.a AND ev.b = sc.b"""


IMP_SCORES = imp_scores_sql(EVAL, TOPIMP)
o("impostor_scores", f"SELECT a, b, same, round(score_ab, 6) AS score_ab, round(score_ba, 6) AS score_ba, round(score, 6) AS score FROM ({IMP_SCORES})")
o("impostors_eval", sav_metrics_sql(f"SELECT *, CASE WHEN score > 0.5 THEN 1 ELSE 0 END AS pred FROM ({IMP_SCORES})"))


def best_cut_sql(scores: str) -> str:
    return f"""
WITH s AS ({scores}),
d AS (SELECT *, row_number() OVER (ORDER BY score, a, b) - 1 AS pos, count(*) OVER () AS n, sum(same) OVER () AS n_pos,
  sum(same) OVER (ORDER BY score, a, b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tp,
  lag(score) OVER (ORDER BY score, a, b) AS prev FROM s),
f AS (SELECT *, CASE WHEN 2 * tp + (n - pos - tp) + (n_pos - tp) = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + (n - pos - tp) + (n_pos - tp)) END AS f1 FROM d
  WHERE pos >= 1 AND pos <= n - 2 AND score <> 0 AND (prev IS NULL OR prev <> score))
SELECT score AS sigma, f1, CAST(pos AS BIGINT) AS pos FROM f ORDER BY round(f1, 9) DESC, pos LIMIT 1"""


o("threshold_search_f1", f"SELECT round(sigma, 6) AS sigma, round(f1, 6) AS f1, pos FROM ({best_cut_sql(IMP_SCORES)})")

HALVES = f"""SELECT *, CASE WHEN dense_rank() OVER (ORDER BY author) <= (SELECT count(DISTINCT author) FROM ({TR})) // 2
  THEN 0 ELSE 1 END AS half FROM ({TR})"""
VAL_DOCS = f"SELECT doc_id, author FROM ({HALVES}) WHERE half = 1"
VAL_PAIRS = f"""WITH {uniform_pos_sql('42v', VC_REQ_POS.replace('1000', '500'), idx_of(VAL_DOCS, '42'))},
{uniform_neg_sql('42v', VC_REQ_NEG.replace('1000', '500'), idx_of(VAL_DOCS, '42'))}
SELECT a, b, 1 AS same FROM pos_out UNION ALL SELECT a, b, 0 AS same FROM uneg_out"""


def half_vectors(half: int) -> str:
    return f"SELECT v.doc_id, v.vec FROM ({ABS_VECTORS}) v JOIN ({HALVES}) h ON v.doc_id = h.doc_id AND h.half = {half}"


o("impostors_fitted", f"""
WITH val AS MATERIALIZED ({VAL_PAIRS}),
sg AS MATERIALIZED (SELECT coalesce(max(sigma), 0.5) AS sigma FROM ({best_cut_sql(imp_scores_sql("SELECT * FROM val", topimp_sql(half_vectors(1), half_vectors(0))))}))
SELECT a, b, same, round(score, 6) AS score, round(sigma, 6) AS sigma, CASE WHEN score > sigma THEN 1 ELSE 0 END AS pred
FROM ({IMP_SCORES}), sg
""")

# ------------------------------------------------------------------ self-tuned k
TR_SCORES = f"""SELECT x.doc_id AS x_id, r.doc_id AS ref_id, r.author AS ref_author,
  CASE WHEN x.doc_id = r.doc_id THEN 0.0 ELSE {COS('x.vec', 'r.vec')} END AS p FROM ({TR}) x, ({TR}) r"""
o("knn_tune_k", f"""
WITH s AS (SELECT *, row_number() OVER w AS r, avg(p) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rm
  FROM ({TR_SCORES}) WINDOW w AS (PARTITION BY x_id, ref_author ORDER BY round(p, 9) DESC, ref_id)),
na AS (SELECT ref_author, count(DISTINCT ref_id) AS n_a FROM s GROUP BY ref_author),
km AS (SELECT max(n_a) AS kmax FROM na),
s2 AS (SELECT s.*, na.n_a FROM s JOIN na USING (ref_author)),
allk AS (SELECT x_id, ref_author, r AS k, rm FROM s2 WHERE r < n_a
  UNION ALL SELECT x_id, ref_author, unnest(range(n_a, kmax + 1)) AS k, rm FROM s2, km WHERE r = n_a),
pr AS (SELECT x_id, k, ref_author AS pred FROM (
  SELECT *, row_number() OVER (PARTITION BY x_id, k ORDER BY round(rm, 9) DESC, ref_author) AS rn FROM allk) WHERE rn = 1),
acc AS (SELECT pr.k, avg(CASE WHEN pr.pred = t.author THEN 1.0 ELSE 0.0 END) AS acc FROM pr JOIN ({TR}) t ON t.doc_id = pr.x_id GROUP BY pr.k)
SELECT CAST(k AS BIGINT) AS k, round(acc, 6) AS acc,
  CAST(CASE WHEN row_number() OVER (ORDER BY round(acc, 9) DESC, k) = 1 THEN 1 ELSE 0 END AS INTEGER) AS best FROM acc
""")

# ------------------------------------------------------------------ feature matrix, random indexing, sparse diff
from .oracle import CHAR_COUNTS, FW_DENSE, PUNCT_COUNTS, SL_DENSE, TAG_COUNTS, WL_DENSE, WORD_COUNTS, tfidf_sql  # noqa: E402

BLOCK_ORDER = "CASE block WHEN 'post' THEN 0 WHEN 'punct' THEN 1 WHEN 'word' THEN 2 WHEN 'char' THEN 3 WHEN 'fw' THEN 4 WHEN 'wl' THEN 5 WHEN 'sl' THEN 6 ELSE 99 END"
BLOCKS = f"""SELECT doc_id, 'punct' AS block, feat, val FROM ({tfidf_sql(PUNCT_COUNTS)})
UNION ALL SELECT doc_id, 'word' AS block, feat, val FROM ({tfidf_sql(WORD_COUNTS, 3)})
UNION ALL SELECT doc_id, 'wl' AS block, lpad(feat, 2, '0') AS feat, val FROM ({WL_DENSE.replace("{src}", f"SELECT * FROM ({split_sql()})")})"""
o("feature_matrix", f"""
WITH b AS ({BLOCKS}),
ix AS (SELECT block, feat, CAST(row_number() OVER (ORDER BY {BLOCK_ORDER}, block, feat) - 1 AS INTEGER) AS idx
  FROM (SELECT DISTINCT block, feat FROM b))
SELECT b.doc_id, ix.idx, round(b.val, 6) AS val FROM b JOIN ix ON b.block = ix.block AND b.feat = ix.feat
""")

SP = "SELECT * FROM sp"
o("feature_extractor", f"""
WITH sp AS MATERIALIZED ({split_sql()}),
sparse AS MATERIALIZED (SELECT doc_id, 'post' AS block, feat, val FROM ({tfidf_sql(TAG_COUNTS)})
  UNION ALL SELECT doc_id, 'punct', feat, val FROM ({tfidf_sql(PUNCT_COUNTS)})
  UNION ALL SELECT doc_id, 'word', feat, val FROM ({tfidf_sql(WORD_COUNTS, 3)})
  UNION ALL SELECT doc_id, 'char', feat, val FROM ({tfidf_sql(CHAR_COUNTS)})),
tr AS MATERIALIZED (SELECT doc_id, author FROM sp WHERE split = 'train'),
pc AS (SELECT author, count(*) / (SELECT count(*) FROM tr) AS p_c FROM tr GROUP BY author),
ob AS (SELECT s.block, s.feat, tr.author, sum(s.val) AS o FROM sparse s JOIN tr ON s.doc_id = tr.doc_id GROUP BY s.block, s.feat, tr.author),
sc AS (SELECT block, feat, sum(o * o / p_c) / sum(o) - sum(o) AS chi2 FROM ob JOIN pc ON ob.author = pc.author
  GROUP BY block, feat HAVING sum(o) > 0),
rk AS (SELECT e.block, e.feat, row_number() OVER (ORDER BY coalesce(round(sc.chi2, 9), 0) DESC, e.block, e.feat) AS r
  FROM (SELECT DISTINCT block, feat FROM sparse) e LEFT JOIN sc ON sc.block = e.block AND sc.feat = e.feat),
dense AS MATERIALIZED (SELECT doc_id, 'fw' AS block, feat, val FROM ({FW_DENSE.replace("{src}", SP)})
  UNION ALL SELECT doc_id, 'wl', lpad(feat, 2, '0'), val FROM ({WL_DENSE.replace("{src}", SP)})
  UNION ALL SELECT doc_id, 'sl', lpad(feat, 2, '0'), val FROM ({SL_DENSE.replace("{src}", SP)})),
st AS (SELECT block, feat, avg(val) AS mean, CASE WHEN stddev_pop(val) = 0 THEN 1.0 ELSE stddev_pop(val) END AS scale
  FROM dense WHERE doc_id IN (SELECT doc_id FROM tr) GROUP BY block, feat),
b AS (SELECT s.doc_id, s.block, s.feat, s.val FROM sparse s JOIN rk ON rk.block = s.block AND rk.feat = s.feat AND rk.r <= 50000
  UNION ALL SELECT d.doc_id, d.block, d.feat, (d.val - st.mean) / st.scale FROM dense d JOIN st ON st.block = d.block AND st.feat = d.feat),
ix AS (SELECT block, feat, row_number() OVER (ORDER BY {BLOCK_ORDER}, block, feat) - 1 AS idx FROM (SELECT DISTINCT block, feat FROM b))
SELECT b.doc_id, b.block, count(*) AS n, round(sum(b.val), 6) AS total, round(sum(b.val * b.val), 6) AS squares,
  CAST(sum(ix.idx) AS BIGINT) AS columns
FROM b JOIN ix ON ix.block = b.block AND ix.feat = b.feat GROUP BY b.doc_id, b.block
""")

H0 = "md5(concat_ws('|', '0', CAST(feat AS VARCHAR)))"
o("random_indexing", f"""
WITH w AS ({tfidf_sql(WORD_COUNTS, 3)}),
ix AS (SELECT feat, row_number() OVER (ORDER BY feat) - 1 AS idx FROM (SELECT DISTINCT feat FROM w)),
e AS (SELECT feat, 0 AS j, CAST(idx % 64 AS INTEGER) AS dim, {H0} AS h FROM ix
  UNION ALL SELECT feat, 1 AS j, CAST(floor({sql_uniform_of_hex("md5(concat_ws('|', " + H0 + ", '1'))")} * 64 - 1e-12) AS INTEGER) AS dim, {H0} AS h FROM ix),
ri AS (SELECT feat, dim, CASE WHEN {sql_uniform_of_hex("md5(concat_ws('|', h, 's', CAST(j AS VARCHAR)))")} <= 0.5
    THEN -1.0 / sqrt(2.0) ELSE 1.0 / sqrt(2.0) END AS weight,
  row_number() OVER (PARTITION BY feat, dim ORDER BY j DESC) AS r FROM e)
SELECT w.doc_id, ri.dim, round(sum(w.val * ri.weight), 6) AS val FROM w JOIN ri ON w.feat = ri.feat AND ri.r = 1
GROUP BY w.doc_id, ri.dim
""")

DOC_TEST_CHAIN = chain_pairs_sql(f"SELECT doc_id, author FROM ({split_sql()}) WHERE split = 'test'")
o("diff_vectors_sparse", f"""
WITH f AS ({tfidf_sql(PUNCT_COUNTS)}), p AS {DOC_TEST_CHAIN},
u AS (SELECT p.a, p.b, f.feat, f.val FROM p JOIN f ON f.doc_id = p.a
  UNION ALL SELECT p.a, p.b, f.feat, -f.val FROM p JOIN f ON f.doc_id = p.b)
SELECT a, b, feat, round(abs(sum(val)), 6) AS val FROM u GROUP BY a, b, feat HAVING abs(sum(val)) <> 0
""")

# ------------------------------------------------------------------ model inputs with exact twins
o("stratified_folds", f"""
SELECT doc_id, author, CAST((row_number() OVER (PARTITION BY author ORDER BY {U42}, doc_id) - 1) % 5 AS INTEGER) AS fold
FROM ({TR})
""")
EMB_TRAIN_CHAIN = chain_pairs_sql(f"SELECT doc_id, author FROM ({TR})")
o("distance_range", f"""
SELECT round(min(d), 6) AS dist_min, round(max(d), 6) AS dist_max FROM (
  SELECT {L1('x.vec', 'y.vec')} AS d FROM {EMB_TRAIN_CHAIN} p
  JOIN ({VECTORS}) x ON x.doc_id = p.a JOIN ({VECTORS}) y ON y.doc_id = p.b)
""")
o("platt_targets", f"""
SELECT n_pos, n_neg, round((n_pos + 1.0) / (n_pos + 2.0), 6) AS t_pos, round(1.0 / (n_neg + 2.0), 6) AS t_neg FROM (
  SELECT CAST(sum(CASE WHEN same = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_pos,
    CAST(sum(CASE WHEN same = 1 THEN 0 ELSE 1 END) AS BIGINT) AS n_neg FROM ({EVAL}))
""")

# ------------------------------------------------------------------ experiment log and reports
from .oracle import STYLE  # noqa: E402

_U_SEED = sql_uniform(42, "seed", "doc_id")
EXP_LOG = f"""
WITH d AS (SELECT doc_id, source AS author, text, lang AS dataset, seed FROM documents, (VALUES (0), (1), (2)) s(seed)
  WHERE text IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY dataset, seed, author ORDER BY {_U_SEED}, seed, doc_id) AS rk FROM d),
smp AS (SELECT * FROM r WHERE rk <= 10),
docs AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND doc_id IN (SELECT doc_id FROM smp)),
lens AS (SELECT doc_id, list_transform({STYLE}, w -> length(w)) AS lens FROM docs),
vec AS (SELECT doc_id, list_transform(range(1, 23), i -> len(list_filter(lens, x -> x >= i)) / greatest(1, len(lens))) AS vec FROM lens),
same AS (SELECT x.dataset, x.seed, x.doc_id AS a, y.doc_id AS b, 1 AS same FROM smp x JOIN smp y
  ON x.dataset = y.dataset AND x.seed = y.seed AND x.author = y.author AND y.rk = x.rk + 1),
au AS (SELECT dataset, seed, author, dense_rank() OVER (PARTITION BY dataset, seed ORDER BY author) AS ai
  FROM (SELECT DISTINCT dataset, seed, author FROM smp)),
s2 AS (SELECT smp.*, au.ai FROM smp JOIN au USING (dataset, seed, author)),
diff AS (SELECT x.dataset, x.seed, x.doc_id AS a, y.doc_id AS b, 0 AS same FROM s2 x JOIN s2 y
  ON x.dataset = y.dataset AND x.seed = y.seed AND y.ai = x.ai + 1 AND y.rk = x.rk),
pr AS (SELECT * FROM same UNION ALL SELECT * FROM diff),
pv AS (SELECT pr.*, va.vec AS va, vb.vec AS vb FROM pr JOIN vec va ON va.doc_id = pr.a JOIN vec vb ON vb.doc_id = pr.b),
m AS (SELECT dataset, seed, same, 'Dist-l1-close' AS method, round({L1('va', 'vb')}, 9) AS dist FROM pv
  UNION ALL SELECT dataset, seed, same, 'Dist-l2-close', round({L2('va', 'vb')}, 9) FROM pv
  UNION ALL SELECT dataset, seed, same, 'Dist-cos-close', round({COSD('va', 'vb')}, 9) FROM pv),
med AS (SELECT dataset, seed, method, quantile_cont(dist, 0.5) AS thr FROM m GROUP BY dataset, seed, method),
mp AS (SELECT m.*, CASE WHEN m.dist <= med.thr THEN 1 ELSE 0 END AS pred FROM m JOIN med USING (dataset, seed, method)),
c AS (SELECT dataset, seed, method, count(*) AS n,
  sum(CASE WHEN same = 1 AND pred = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN same <> 1 AND pred = 1 THEN 1 ELSE 0 END) AS fp,
  sum(CASE WHEN same = 1 AND pred <> 1 THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN same <> 1 AND pred <> 1 THEN 1 ELSE 0 END) AS tn
  FROM mp GROUP BY dataset, seed, method),
na AS (SELECT dataset, seed, count(DISTINCT author) AS n_authors FROM smp GROUP BY dataset, seed)
SELECT c.dataset, CAST(c.seed AS INTEGER) AS seed, 'CLOSE' AS mode, CAST(na.n_authors AS INTEGER) AS n_authors,
  CAST(10 AS INTEGER) AS docs_by_author, CAST(na.n_authors AS INTEGER) AS n_authors_te, CAST(-1 AS INTEGER) AS docs_by_author_te,
  c.method, 100.0 * (tp + tn) / n AS acc,
  CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS p,
  CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS r,
  CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS f1, '' AS notes
FROM c JOIN na USING (dataset, seed)"""

LOG_COLS = "dataset, seed, mode, n_authors, docs_by_author, n_authors_te, docs_by_author_te, method"
o("sav_experiment", f"""SELECT {LOG_COLS}, round(acc, 6) AS acc, round(p, 6) AS p, round(r, 6) AS r, round(f1, 6) AS f1, notes
FROM ({EXP_LOG})""")
o("log_append_roundtrip", f"""SELECT {LOG_COLS}, round(acc, 4) AS acc, round(p, 4) AS p, round(r, 4) AS r, round(f1, 4) AS f1
FROM ({EXP_LOG})""")
o("log_union_read", f"""SELECT {LOG_COLS}, round(acc, 4) AS acc, round(p, 4) AS p, round(r, 4) AS r, round(f1, 4) AS f1
FROM ({EXP_LOG}) WHERE method <> 'Dist-l2-close'""")

GRID = """SELECT d.dataset, CAST(s.seed AS INTEGER) AS seed, CAST(20 AS INTEGER) AS n_authors, CAST(10 AS INTEGER) AS docs_by_author, m.method
FROM (SELECT DISTINCT lang AS dataset FROM documents WHERE text IS NOT NULL) d, range(0, 5) s(seed),
  (VALUES ('Dist-l1-close'), ('Dist-l2-close'), ('Dist-cos-close')) m(method)"""
o("pending_experiments", f"""
SELECT g.* FROM ({GRID}) g WHERE NOT EXISTS (SELECT 1 FROM ({EXP_LOG}) l WHERE l.dataset = g.dataset AND l.seed = g.seed
  AND l.n_authors = g.n_authors AND l.docs_by_author = g.docs_by_author AND l.method = g.method)
""")
o("completed_count", f"""
SELECT g.dataset, g.seed, g.n_authors, coalesce(c.n_rows, 0) AS n_rows, CASE WHEN coalesce(c.n_rows, 0) >= 3 THEN 1 ELSE 0 END AS complete
FROM (SELECT DISTINCT dataset, seed, n_authors FROM ({GRID})) g
LEFT JOIN (SELECT dataset, seed, n_authors, count(*) AS n_rows FROM ({EXP_LOG}) GROUP BY dataset, seed, n_authors) c
  ON c.dataset = g.dataset AND c.seed = g.seed AND c.n_authors = g.n_authors
""")

_REN = """replace(replace(replace(replace(replace(method, 'LR-close', 'STD-2xAA'), 'Dist-cos', 'STD-CosDist'),
  'Impostors-open', 'Impostors'), '-close', ''), '-open', '')"""
o("rename_methods", f"SELECT dataset, seed, {_REN} AS method FROM ({EXP_LOG})")

STATS = f"SELECT dataset, method, avg(acc) AS mean, stddev_samp(acc) AS std, count(*) AS n FROM ({EXP_LOG}) GROUP BY dataset, method"
_PIVOT = ", ".join(f"""round(avg(acc / 100.0) FILTER (dataset = '{d}'), 6) AS {d}_mean,
  round(stddev_samp(acc / 100.0) FILTER (dataset = '{d}'), 6) AS {d}_std, count(*) FILTER (dataset = '{d}') AS {d}_n""" for d in ("de", "en", "es", "fr"))
o("report_pivot", f"SELECT method, {_PIVOT} FROM ({EXP_LOG}) GROUP BY method")
BEST = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY round(mean, 9) DESC, method) AS rr FROM ({STATS}))
WHERE rr = 1"""
o("report_best", f"SELECT dataset, method, round(mean, 6) AS mean, round(std, 6) AS std, n FROM ({BEST})")


def _simpson(upper: str, steps: int = 2000) -> str:
    h = f"(({upper}) / {steps})"
    return (f"(list_sum(list_transform(range(0, {steps + 1}), i -> (CASE WHEN i = 0 OR i = {steps} THEN 1.0 "
            f"WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END) * pow(cos(i * {h}), nu - 1))) * {h} / 3)")


o("report_ttest", f"""
WITH s AS ({STATS}), b AS (SELECT dataset, mean AS m2, std AS s2, n AS n2, method AS best FROM ({BEST})),
j AS (SELECT s.*, b.m2, b.s2, b.n2, b.best, CAST(s.n + b.n2 - 2 AS DOUBLE) AS nu FROM s JOIN b USING (dataset)),
k AS (SELECT *, sqrt(((n - 1) * std * std + (n2 - 1) * s2 * s2) / nu * (1.0 / n + 1.0 / n2)) AS se FROM j),
t AS (SELECT *, CASE WHEN se = 0 THEN 0.0 ELSE (round(mean, 9) - round(m2, 9)) / se END AS t FROM k),
pv AS (SELECT *, CASE WHEN method = best THEN 1.0 ELSE
  1.0 - {_simpson('atan(abs(t) / sqrt(nu))')} / {_simpson('pi() / 2')} END AS pvalue FROM t)
SELECT dataset, method, round(mean, 6) AS mean, round(std, 6) AS std, n, round(t, 6) AS t, round(pvalue, 6) AS pvalue,
  CASE WHEN round(pvalue, 9) = 1 THEN '=' WHEN round(pvalue, 9) > 0.05 THEN '**' WHEN round(pvalue, 9) > 0.005 THEN '*' ELSE '' END AS mark FROM pv
""")
o("report_series", f"""
SELECT dataset, mode, n_authors, method, docs_by_author, round(avg(acc), 6) AS y_mean, round(stddev_samp(acc), 6) AS y_std,
  round(avg(acc) - stddev_samp(acc), 6) AS y_low, round(avg(acc) + stddev_samp(acc), 6) AS y_high
FROM ({EXP_LOG}) GROUP BY dataset, mode, n_authors, method, docs_by_author
""")


def _hist(logscale: bool) -> str:
    x = "ln(score + 0.01)" if logscale else "score"
    return f"""
WITH s AS (SELECT same, {x} AS x FROM (SELECT same, (score + 1) / 2 AS score FROM ({SCORED}))),
mm AS (SELECT min(x) AS lo, max(x) AS hi FROM s),
d AS (SELECT s.same, mm.lo, (mm.hi - mm.lo) / 20 AS width,
  CAST(CASE WHEN (mm.hi - mm.lo) / 20 = 0 THEN 0 WHEN s.x >= mm.hi THEN 19 ELSE floor((s.x - mm.lo) / ((mm.hi - mm.lo) / 20)) END AS INTEGER) AS bin
  FROM s, mm),
g AS (SELECT same, bin, count(*) AS cnt, any_value(width) AS width, any_value(lo) AS lo FROM d GROUP BY same, bin),
g2 AS (SELECT *, sum(cnt) OVER (PARTITION BY same) AS n FROM g)
SELECT same, bin, round(lo + bin * width, 6) AS "left", cnt, round(CASE WHEN width = 0 THEN NULL ELSE cnt / (n * width) END, 6) AS density FROM g2"""


o("score_histogram", _hist(False))
o("score_histogram_log", _hist(True))

# ------------------------------------------------------------------ flagship, feature round trip, probability normalisation
o("feature_table_roundtrip", f"""
WITH sp AS ({split_sql()}), f AS ({tfidf_sql(PUNCT_COUNTS)})
SELECT f.doc_id, f.feat, round(f.val, 6) AS val, sp.split FROM f JOIN sp ON f.doc_id = sp.doc_id
""")

_VC_PAIRS = f"""WITH {uniform_pos_sql('42v', VC_REQ_POS, idx_of(TEST_DOCS, '42'))},
{uniform_neg_sql('42v', VC_REQ_NEG, idx_of(TEST_DOCS, '42'))},
vc AS (SELECT a, b, 1 AS same FROM pos_out UNION ALL SELECT a, b, 0 AS same FROM uneg_out),
feats AS ({tfidf_sql(WORD_COUNTS, 3)}),
nrm AS (SELECT doc_id, sqrt(sum(val * val)) AS nrm FROM feats GROUP BY doc_id),
dots AS (SELECT vc.a, vc.b, sum(fa.val * fb.val) AS dot FROM vc JOIN feats fa ON fa.doc_id = vc.a
  JOIN feats fb ON fb.doc_id = vc.b AND fb.feat = fa.feat GROUP BY vc.a, vc.b),
sc AS (SELECT vc.a, vc.b, vc.same, CASE WHEN na.nrm IS NULL OR nb.nrm IS NULL OR na.nrm * nb.nrm = 0 THEN 0.0
    ELSE coalesce(dots.dot, 0.0) / (na.nrm * nb.nrm) END AS score
  FROM vc LEFT JOIN dots ON dots.a = vc.a AND dots.b = vc.b LEFT JOIN nrm na ON na.doc_id = vc.a LEFT JOIN nrm nb ON nb.doc_id = vc.b)
SELECT a, b, same, score, CASE WHEN score > 0.5 THEN 1 ELSE 0 END AS pred FROM sc"""
o("sav_cosine_flagship", sav_metrics_sql(_VC_PAIRS.replace("WITH ", "SELECT * FROM (WITH ", 1) + ")"))

o("normalize_probs", f"""
WITH a AS (SELECT x_id AS doc_id, ref_author AS author, avg(p) AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY x_id, ref_author ORDER BY round(p, 9) DESC, ref_id) AS rn FROM ({SCORES}))
  WHERE rn <= 5 GROUP BY x_id, ref_author),
l AS (SELECT doc_id, list(greatest(score, 0.0) ORDER BY author) AS probs FROM a GROUP BY doc_id),
n AS (SELECT doc_id, CASE WHEN len(probs) = 1 THEN [1.0 - probs[1], probs[1]]
    ELSE list_transform(probs, x -> CASE WHEN list_sum(probs) = 0 THEN 'NaN'::DOUBLE ELSE x / list_sum(probs) END) END AS p0,
  len(probs) AS k FROM l),
f AS (SELECT doc_id, list_transform(p0, x -> CASE WHEN isnan(x) THEN 1.0 / greatest(k, 2)
    WHEN x > 1.0 AND x <= 1.0 + 1e-5 THEN 1.0 ELSE x END) AS pr FROM n)
SELECT doc_id, CAST(unnest(range(0, len(pr))) AS INTEGER) AS cls, round(unnest(pr), 6) AS p,
  CAST(list_position(pr, list_max(pr)) - 1 AS INTEGER) AS argmax FROM f
""")

# ------------------------------------------------------------------ sources
DOCS = "SELECT doc_id, source AS author, text, lang FROM documents WHERE text IS NOT NULL"
o("scan_tsv_corpus", f"""
WITH d AS ({DOCS}), f AS (SELECT author, min(doc_id) AS first FROM d GROUP BY author),
c AS (SELECT author, CAST(dense_rank() OVER (ORDER BY first) - 1 AS INTEGER) AS label FROM f)
SELECT d.doc_id, d.author, c.label, d.lang || ' ' || regexp_replace(d.text, '[\\t\\r\\n]+', ' ', 'g') AS text
FROM d JOIN c ON d.author = c.author
""")
o("scan_csv_corpus", f"""
SELECT doc_id, regexp_replace(text, '[^\\x{{00}}-\\x{{FF}}]', '?', 'g') AS text,
  CAST(regexp_extract(author, '(\\d+)$', 1) AS INTEGER) AS author FROM ({DOCS})
""")
_DOC_CHAIN = chain_pairs_sql(f"SELECT doc_id, author FROM ({DOCS})")
o("scan_jsonl_pairs", f"""
WITH p AS (SELECT CAST(p.a AS VARCHAR) || '-' || CAST(p.b AS VARCHAR) AS id, p.a, p.b FROM {_DOC_CHAIN} p),
x AS (SELECT p.id, 0 AS pos, d.author, d.text FROM p JOIN ({DOCS}) d ON d.doc_id = p.a
  UNION ALL SELECT p.id, 1 AS pos, d.author, d.text FROM p JOIN ({DOCS}) d ON d.doc_id = p.b),
y AS (SELECT * FROM x WHERE len(regexp_extract_all(text, '\\S+')) >= 10 AND len(regexp_extract_all(text, '\\S+')) < 10000)
SELECT id, CAST(pos AS INTEGER) AS pos, author, text FROM y
WHERE author IN (SELECT author FROM y GROUP BY author HAVING count(*) >= 2)
""")
o("scan_tagged_records", f"SELECT CAST(doc_id AS VARCHAR) AS text_id, author, text FROM ({DOCS})")
o("scan_dir_corpus", f"SELECT author, doc_id, text FROM ({DOCS})")
o("scan_filename_corpus", f"SELECT author, CAST(doc_id AS VARCHAR) AS title, text FROM ({DOCS})")

_BODY = "text"
for _m in ["-----Original Message-----", "----- Forward", "cc:", "To:", "to:", "From:", "from:"]:
    _BODY = f"split_part({_BODY}, '{_m}', 1)"
o("message_body_corpus", f"""
WITH d AS (SELECT conv_id, turn, role AS author, {_BODY} AS text FROM conversations),
k AS (SELECT * FROM d WHERE len(regexp_extract_all(text, '\\S+')) >= 10)
SELECT conv_id, turn, author, text FROM k WHERE author IN (SELECT author FROM k GROUP BY author HAVING count(*) >= 5)
""")
o("merge_dedup_requests", """
WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS id, lang AS title, text AS abstract, source AS author, lang FROM documents
  WHERE text IS NOT NULL),
u AS (SELECT id, title, abstract, author, 0 AS req_no FROM d WHERE lang IN ('en', 'fr')
  UNION ALL SELECT id, title, abstract, author, 1 FROM d WHERE lang IN ('fr', 'de')
  UNION ALL SELECT id, title, abstract, author, 2 FROM d WHERE lang IN ('de', 'es', 'en')),
f AS (SELECT * FROM (SELECT *, min(req_no) OVER (PARTITION BY id) AS first_ FROM u) WHERE req_no = first_),
g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY title, abstract, author) AS r FROM f) WHERE r = 1
  AND NOT contains(author, 'Collaboration'))
SELECT id, author, CAST(req_no AS INTEGER) AS req_no, title || chr(10) || abstract AS text FROM g
WHERE author IN (SELECT author FROM g GROUP BY author HAVING count(*) >= 10)
""")


def idx_part(src: str, part: str) -> str:
    """Indexed docs with corpus_id = a partition column."""
    return f"""SELECT CAST({part} AS VARCHAR) AS corpus_id, author, doc_id,
  row_number() OVER (PARTITION BY {part}, author ORDER BY {U42}, doc_id) AS pos,
  count(*) OVER (PARTITION BY {part}, author) AS n_docs,
  row_number() OVER (PARTITION BY {part} ORDER BY {sql_uniform('42g', 'doc_id')}, doc_id) AS gpos,
  count(*) OVER (PARTITION BY {part}) AS n_corpus FROM ({src})"""


# Per-language corpora; pos = all positives capped at 300, neg = min(all positives, all negatives) capped at 300
_NEG_REQ_ALL = "least(least(sum(P), CAST((sum(n) * sum(n) - sum(n * n)) / 2 AS BIGINT)), 300)"
o("multi_corpus_pairs", f"""
WITH {rr_sql(300, idx_part(CORPUS, 'lang'), with_clause=False)},
{negative_sql('42', _NEG_REQ_ALL, idx_part(CORPUS, 'lang'))}
SELECT corpus_id, a, b, same FROM rr_out UNION ALL SELECT corpus_id, a, b, 0 AS same FROM neg_out
""")


# Binary target (labels.quality); positives only inside class '1', negatives across the classes
_VT = """SELECT d.doc_id, CAST(l.quality AS VARCHAR) AS author FROM documents d JOIN labels l ON d.doc_id = l.doc_id
WHERE d.text IS NOT NULL"""
o("verification_pairs", f"""
WITH {rr_sql(500, idx_part(_VT, "'all'"), group_filter="author = '1'", with_clause=False)},
{negative_sql('42', '500', idx_part(_VT, "'all'"))}
SELECT corpus_id, a, b, same FROM rr_out UNION ALL SELECT corpus_id, a, b, 0 AS same FROM neg_out
""")


# ------------------------------------------------------------------ named entries
o("positive_pairs", rr_sql(10 ** 15))
o("negative_pairs_large", f"""
WITH {negative_sql('42', 'least(sum(n) * 20, (sum(n) * sum(n) - sum(n * n)) // 2)', idx_part(CORPUS, "'all'"))}
SELECT corpus_id, a, b, 0 AS same, rk FROM neg_out
""")
o("metric_accuracy", f"SELECT round(avg(CASE WHEN truth = pred THEN 1.0 ELSE 0.0 END), 6) AS acc FROM ({PRED})")
o("metric_f1_macro", f"SELECT round(avg({F1C}), 6) AS f1_macro FROM ({CLS})")
o("metric_f1_micro", f"""SELECT round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6) AS f1_micro
FROM (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM ({CLS}))""")
o("impostor_decision", f"""SELECT a, b, same, round(score, 6) AS score, CASE WHEN score > 0.5 THEN 1 ELSE 0 END AS pred
FROM ({IMP_SCORES})""")
_TRTR = f"""SELECT x.doc_id AS x_id, r.doc_id AS ref_id, {COS('x.vec', 'r.vec')} AS p FROM ({TR}) x, ({TR}) r"""
o("stacked_features", f"""
SELECT x_id AS doc_id, CAST(count(*) AS BIGINT) AS width, round(sum(p), 6) AS total, round(arg_min(p, ref_id), 6) AS "first"
FROM ({_TRTR}) GROUP BY x_id
""")
