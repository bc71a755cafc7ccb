"""DuckDB twins of the registered queries (tables pre-registered as views).

Each text is plain SQL over the driver tables that computes the same result
as the Spark query in ``queries.py``: same seeded md5 order, same regex rules,
same rounding (6 digits).
"""
from __future__ import annotations

import re

from ..functions import text as T
from ..functions.hashing import sql_uniform

ORACLE: dict[str, str] = {}


_ARROW = re.compile(r"\b([a-z_][a-z0-9_]*) -> ")


def o(name: str, sql: str) -> None:
    """Register a twin; ``x -> e`` lambdas are written as DuckDB's ``lambda x: e``."""
    ORACLE[name] = _ARROW.sub(r"lambda \1: ", sql.strip())


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


CORPUS = "SELECT doc_id, source AS author, text, lang FROM documents WHERE text IS NOT NULL"
CORPUS_LS = "SELECT doc_id, lang || '/' || source AS author, text, lang FROM documents WHERE text IS NOT NULL"
U42 = sql_uniform(42, "doc_id")

STYLE = f"list_filter(regexp_extract_all(lower(text), {lit(T.STYLE_TOKEN_RE)}), w -> regexp_matches(w, '\\p{{L}}'))"


def style_of(expr: str) -> str:
    return f"list_filter(regexp_extract_all(lower({expr}), {lit(T.STYLE_TOKEN_RE)}), w -> regexp_matches(w, '\\p{{L}}'))"


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, {lit(T.EDGE_WS_RE)}, '', 'g')"


SENTS = (f"list_filter(list_transform(string_split_regex(text, {lit(T.SENT_SPLIT_RE)}), s -> {strip('s')}), "
         f"s -> length(s) > 0)")
WORDS = f"regexp_extract_all(lower(text), {lit(T.WORD_RE)})"
CHARPRE = f"regexp_replace(lower(text), {lit(T.WS_RUN_RE)}, ' ', 'g')"


def ranked(src: str, seed_u: str = U42, part: str = "author") -> str:
    return (f"SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {seed_u}, doc_id) AS rk, "
            f"count(*) OVER (PARTITION BY {part}) AS n FROM ({src})")


def split_sql(src: str = CORPUS) -> str:
    return (f"SELECT doc_id, author, text, lang, CASE WHEN rk <= round(n * 0.3) THEN 'test' ELSE 'train' END AS split "
            f"FROM ({ranked(src)})")


def char_grams(n_min: int = 2, n_max: int = 5) -> str:
    parts = [f"list_transform(range(1, length(t) - {n} + 2), i -> substr(t, i, {n}))" for n in range(n_min, n_max + 1)]
    return "flatten([" + ", ".join(parts) + "])"


def shape_tags_sql() -> str:
    tag = ("(CASE WHEN length(w) <= 3 THEN 's' WHEN length(w) <= 6 THEN 'm' ELSE 'l' END) || "
           "(CASE WHEN regexp_matches(substr(w, 1, 1), '\\p{Lu}') THEN 'u' ELSE 'w' END) || "
           "(CASE WHEN regexp_matches(lower(right(w, 1)), '[aeiouy]') THEN 'v' ELSE 'c' END)")
    return f"list_transform(regexp_extract_all(text, {lit(T.STYLE_TOKEN_RE)}), w -> {tag})"


def word_ngrams_sql(toks: str, n_min: int, n_max: int) -> str:
    parts = [f"list_transform(range(1, len({toks}) - {n} + 2), i -> array_to_string(list_slice({toks}, i, i + {n} - 1), ' '))"
             for n in range(n_min, n_max + 1)]
    return "flatten([" + ", ".join(parts) + "])"


PUNCT_CHARS = (f"list_filter(string_split({CHARPRE}, ''), ch -> length(ch) = 1 AND "
               f"contains({lit(T.PUNCTUATION)}, ch))")


def fw_table() -> str:
    rows = []
    for lg, words in T.FUNCTION_WORDS.items():
        for i, w in enumerate(words, start=1):
            rows.append(f"({lit(lg)}, {i}, {lit(w)})")
    return "(VALUES " + ", ".join(rows) + ") AS fwl(lang, idx, word)"


# ------------------------------------------------------------------ scans / joins
o("label_attach_join", f"""
SELECT c.doc_id, c.author, l.quality, l.toxic FROM ({CORPUS}) c LEFT JOIN labels l ON c.doc_id = l.doc_id
""")

# ------------------------------------------------------------------ text
o("token_count_filter", f"""
SELECT doc_id, CAST(len(regexp_extract_all(text, {lit(T.NONSPACE_RE)})) AS BIGINT) AS n_tokens
FROM ({CORPUS}) WHERE len(regexp_extract_all(text, {lit(T.NONSPACE_RE)})) >= 15
""")

o("clean_citations", f"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
  '\\*[^*]*\\*', '', 'g'), '\\*', '', 'g'), '\\{{[^}}]*\\}}', '', 'g'), '\\{{', '', 'g') AS clean_text
FROM ({CORPUS})
""")

o("style_tokens", f"""
SELECT doc_id, CAST(unnest(range(1, len(tk) + 1)) AS BIGINT) AS pos, unnest(tk) AS token
FROM (SELECT doc_id, {STYLE} AS tk FROM ({CORPUS}))
""")

o("sentence_split", f"""
SELECT doc_id, CAST(unnest(range(1, len(ss) + 1)) AS BIGINT) AS pos, unnest(ss) AS sentence
FROM (SELECT doc_id, {SENTS} AS ss FROM ({CORPUS}))
""")

o("function_word_freq", f"""
WITH d AS (SELECT doc_id, lang, {STYLE} AS tk FROM ({CORPUS}))
SELECT d.doc_id, 'fw:' || lpad(CAST(f.idx AS VARCHAR), 3, '0') || ':' || f.word AS feat,
  round(len(list_filter(d.tk, t -> t = f.word)) / greatest(1, len(d.tk)), 6) AS val
FROM d JOIN {fw_table()} ON f.lang = CASE WHEN d.lang IN ({", ".join(lit(x) for x in T.FUNCTION_WORDS)}) THEN d.lang ELSE 'en' END
""".replace("JOIN (VALUES", "JOIN (VALUES").replace("AS fwl(lang, idx, word)", "AS f(lang, idx, word)"))

o("word_length_profile", f"""
WITH d AS (SELECT doc_id, list_transform({STYLE}, w -> length(w)) AS lens FROM ({CORPUS}))
SELECT doc_id, CAST(i AS BIGINT) AS i, round(len(list_filter(lens, x -> x >= i)) / greatest(1, len(lens)), 6) AS val
FROM d, range(1, 23) r(i)
""")

o("sentence_length_profile", f"""
WITH d AS (SELECT doc_id, list_transform({SENTS}, s -> len({style_of('s')})) AS lens FROM ({CORPUS}))
SELECT doc_id, CAST(i AS BIGINT) AS i, round(len(list_filter(lens, x -> x >= i)) / greatest(1, len(lens)), 6) AS val
FROM d, range(3, 70) r(i)
""")

CHAR_COUNTS = f"""SELECT doc_id, feat, count(*) AS tf FROM (
  SELECT doc_id, unnest({char_grams()}) AS feat FROM (SELECT doc_id, {CHARPRE} AS t FROM ({{src}}))) GROUP BY doc_id, feat"""
WORD_COUNTS = f"""SELECT doc_id, feat, count(*) AS tf FROM (
  SELECT doc_id, unnest({WORDS}) AS feat FROM ({{src}})) GROUP BY doc_id, feat"""
TAG_COUNTS = f"""SELECT doc_id, feat, count(*) AS tf FROM (
  SELECT doc_id, unnest({word_ngrams_sql('tg', 3, 4)}) AS feat FROM (
    SELECT doc_id, list_filter(list_transform({shape_tags_sql()}, x -> lower(x)), x -> length(x) >= 2) AS tg FROM ({{src}})))
  GROUP BY doc_id, feat"""
PUNCT_COUNTS = f"""SELECT doc_id, feat, count(*) AS tf FROM (
  SELECT doc_id, unnest({PUNCT_CHARS}) AS feat FROM ({{src}})) GROUP BY doc_id, feat"""

o("char_ngrams", f"SELECT feat, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM ({CHAR_COUNTS.replace("{src}", CORPUS)}) GROUP BY feat")
o("word_unigrams", WORD_COUNTS.replace("{src}", CORPUS))
o("tag_ngrams", f"SELECT feat, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM ({TAG_COUNTS.replace("{src}", CORPUS)}) GROUP BY feat")
o("punctuation_counts", PUNCT_COUNTS.replace("{src}", CORPUS))

# ------------------------------------------------------------------ corpus shaping
o("stratified_split", f"SELECT doc_id, author, split FROM ({split_sql()})")

o("min_docs_filter", f"""
WITH s AS ({split_sql(CORPUS_LS)}),
k AS (SELECT author FROM s WHERE split = 'train' GROUP BY author HAVING count(*) >= 10)
SELECT doc_id, author, split FROM s WHERE author IN (SELECT author FROM k)
""")

o("author_min_count", f"""
WITH c AS ({CORPUS_LS}) SELECT doc_id, author FROM c
WHERE author IN (SELECT author FROM c GROUP BY author HAVING count(*) >= 20)
""")

o("sample_docs_per_author", f"""
WITH s AS ({split_sql(CORPUS_LS)}),
t AS ({ranked("SELECT * FROM s WHERE split = 'train'")})
SELECT doc_id, author, split FROM t WHERE n >= 20 AND rk <= 20
UNION ALL SELECT doc_id, author, split FROM s WHERE split <> 'train'
""")

AUTH_ORDER = "md5(concat_ws('|', '42', CAST(author AS VARCHAR)))"
o("sample_authors", f"""
WITH c AS ({CORPUS_LS}),
a AS (SELECT author FROM (SELECT DISTINCT author FROM c) ORDER BY {AUTH_ORDER}, author LIMIT 10)
SELECT doc_id, author FROM c WHERE author IN (SELECT author FROM a)
""")

OPEN_SPLIT = f"""
WITH s AS ({split_sql()}),
oa AS (SELECT author FROM (SELECT DISTINCT author FROM s) ORDER BY {AUTH_ORDER}, author LIMIT 5)
SELECT doc_id, author, CASE WHEN author IN (SELECT author FROM oa) THEN 'test_out' ELSE split END AS split
FROM s WHERE NOT (author IN (SELECT author FROM oa) AND split = 'train')
"""
o("open_set_split", OPEN_SPLIT)

o("label_reindex", f"""
WITH s AS ({OPEN_SPLIT}),
tr AS (SELECT DISTINCT author FROM s WHERE split = 'train'),
ou AS (SELECT DISTINCT author FROM s WHERE split = 'test_out' AND author NOT IN (SELECT author FROM tr)),
codes AS (SELECT author, f, row_number() OVER (ORDER BY f, author) - 1 AS c FROM
  (SELECT author, 0 AS f FROM tr UNION ALL SELECT author, 1 AS f FROM ou))
SELECT s.doc_id, s.author, s.split, CAST(codes.c AS INTEGER) AS label FROM s JOIN codes ON s.author = codes.author
""")

o("label_drop", f"SELECT doc_id, author FROM ({CORPUS}) WHERE author NOT IN ('src3', 'src7', 'src11')")

o("group_docs", f"SELECT author, doc_id, rk AS pos, n AS n_docs FROM ({ranked(CORPUS_LS)})")

o("sample_per_class", f"SELECT doc_id, author FROM ({ranked(CORPUS_LS)}) WHERE rk <= 7")

o("nested_samples", f"""
SELECT s.sample_size, r.doc_id, r.author FROM ({ranked(CORPUS)}) r
JOIN (VALUES (30), (20), (10)) s(sample_size) ON r.rk <= s.sample_size
""")

o("experiment_grid", """
SELECT d.dataset, s.seed, a.n_authors, b.docs_by_author, m.method
FROM (SELECT DISTINCT lang AS dataset FROM documents WHERE text IS NOT NULL) d,
  (SELECT CAST(range AS INTEGER) AS seed FROM range(0, 10)) s,
  (VALUES (5), (10)) a(n_authors), (VALUES (10), (20), (30)) b(docs_by_author),
  (VALUES ('LR'), ('LRbin'), ('PairLRknn'), ('PairLRlinear')) m(method)
""")

o("author_counts", f"SELECT author, count(*) AS n_docs FROM ({CORPUS_LS}) GROUP BY author")

# ------------------------------------------------------------------ features
SPLIT = split_sql()


def tfidf_sql(counts: str, min_df: int = 1, use_idf: bool = True, norm: str = "l2") -> str:
    w = "c.tf * (ln((1.0 + k.n) / (1.0 + v.df)) + 1.0)" if use_idf else "CAST(c.tf AS DOUBLE)"
    den = "sqrt(sum(v0 * v0) OVER (PARTITION BY doc_id))" if norm == "l2" else "sum(abs(v0)) OVER (PARTITION BY doc_id)"
    return f"""
WITH sp AS ({SPLIT}),
cnt AS ({counts.replace("{src}", 'SELECT * FROM sp')}),
tr AS (SELECT doc_id FROM sp WHERE split = 'train'),
k AS (SELECT count(*) AS n FROM tr),
v AS (SELECT feat, count(*) AS df FROM cnt WHERE doc_id IN (SELECT doc_id FROM tr) GROUP BY feat HAVING count(*) >= {min_df}),
w AS (SELECT c.doc_id, c.feat, {w} AS v0 FROM cnt c JOIN v ON c.feat = v.feat CROSS JOIN k)
SELECT doc_id, feat, v0 / {den} AS val FROM w"""


def r6(sql: str, cols: str, key_cols: str) -> str:
    rc = ", ".join(f"round({c}, 6) AS {c}" for c in cols.split(", "))
    return f"SELECT {key_cols}, {rc} FROM ({sql})"


o("tfidf_words", r6(tfidf_sql(WORD_COUNTS, 3), "val", "doc_id, feat"))
o("tfidf_char", f"""SELECT doc_id, count(*) AS n_terms, round(sum(val * val), 6) AS sq, round(sum(val), 6) AS total
FROM ({tfidf_sql(CHAR_COUNTS)}) GROUP BY doc_id""")
o("tfidf_punct", r6(tfidf_sql(PUNCT_COUNTS), "val", "doc_id, feat"))
o("tfidf_tags", r6(tfidf_sql(TAG_COUNTS), "val", "doc_id, feat"))
o("rawfreq_words", r6(tfidf_sql(WORD_COUNTS, 3, use_idf=False, norm="l1"), "val", "doc_id, feat"))
o("vocab_min_df", f"""
WITH sp AS ({SPLIT}), tr AS (SELECT * FROM sp WHERE split = 'train'),
cnt AS ({WORD_COUNTS.replace("{src}", 'SELECT * FROM tr')}), k AS (SELECT count(*) AS n FROM tr)
SELECT feat, count(*) AS df, round(ln((1.0 + any_value(k.n)) / (1.0 + count(*))) + 1.0, 6) AS idf
FROM cnt CROSS JOIN k GROUP BY feat HAVING count(*) >= 3
""")

o("chi2_topk", f"""
WITH sp AS ({SPLIT}),
f AS ({tfidf_sql(WORD_COUNTS, 3)}),
tr AS (SELECT doc_id, author FROM sp WHERE split = 'train'),
pc AS (SELECT author, count(*) / (SELECT count(*) FROM tr) AS p_c FROM tr GROUP BY author),
ob AS (SELECT f.feat, tr.author, sum(f.val) AS o FROM f JOIN tr ON f.doc_id = tr.doc_id GROUP BY f.feat, tr.author),
s AS (SELECT feat, sum(o * o / p_c) AS q, sum(o) AS t FROM ob JOIN pc ON ob.author = pc.author GROUP BY feat)
SELECT feat, round(q / t - t, 6) AS chi2 FROM s WHERE t > 0 ORDER BY q / t - t DESC, feat LIMIT 500
""")

WL_DENSE = f"""SELECT doc_id, CAST(i AS VARCHAR) AS feat, len(list_filter(lens, x -> x >= i)) / greatest(1, len(lens)) AS val
FROM (SELECT doc_id, list_transform({STYLE}, w -> length(w)) AS lens FROM ({{src}})), range(1, 23) r(i)"""

SL_DENSE = f"""SELECT doc_id, CAST(i AS VARCHAR) AS feat, len(list_filter(lens, x -> x >= i)) / greatest(1, len(lens)) AS val
FROM (SELECT doc_id, list_transform({SENTS}, s -> len({style_of('s')})) AS lens FROM ({{src}})), range(3, 70) r(i)"""
FW_DENSE = f"""SELECT d.doc_id, 'fw:' || lpad(CAST(fwl.idx AS VARCHAR), 3, '0') || ':' || fwl.word AS feat,
  len(list_filter(d.tk, t -> t = fwl.word)) / greatest(1, len(d.tk)) AS val
FROM (SELECT doc_id, lang, {STYLE} AS tk FROM ({{src}})) d
JOIN {fw_table()} ON fwl.lang = CASE WHEN d.lang IN ({", ".join(lit(x) for x in T.FUNCTION_WORDS)}) THEN d.lang ELSE 'en' END"""

o("standardize_train_apply", f"""
WITH sp AS MATERIALIZED ({SPLIT}), d AS MATERIALIZED ({WL_DENSE.replace("{src}", 'SELECT * FROM sp')}),
st AS (SELECT feat, avg(val) AS mean, CASE WHEN stddev_pop(val) = 0 THEN 1.0 ELSE stddev_pop(val) END AS scale
  FROM d WHERE doc_id IN (SELECT doc_id FROM sp WHERE split = 'train') GROUP BY feat)
SELECT d.doc_id, d.feat, round((d.val - st.mean) / st.scale, 6) AS val FROM d JOIN st ON d.feat = st.feat
""")

o("zscores", f"""
WITH d AS ({WL_DENSE.replace("{src}", CORPUS)}),
st AS (SELECT feat, avg(val) AS mean, greatest(coalesce(stddev_samp(val), 'NaN'::DOUBLE), 1e-5) AS sd FROM d GROUP BY feat)
SELECT d.doc_id, d.feat, round((d.val - st.mean) / st.sd, 6) AS val FROM d JOIN st ON d.feat = st.feat
""")
