"""Filter audit against a direct count over all orders."""
from itertools import permutations

import pytest

from quillmark.llm import filter_audit as A

WORDS = __import__("re").compile("[^\x20\x09-\x0D]+")


def failed(i, text, rows):
    words = WORDS.findall(text)
    out = set()
    if len(words) < 50:
        out.add("A")
    if 100 * len(set(words)) < 65 * len(words):
        out.add("B")
    if 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text):
        out.add("C")
    if set(text) & set("#$%&*|"):
        out.add("D")
    if i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows):
        out.add("E")
    return out


def brute(rows, labels):
    good, toxic = {i for i, q, _ in labels if i and q == 1}, {i for i, _, x in labels if i and x == 1}
    out = {}
    for part in {s or "" for _, _, s in rows}:
        docs = [(i, failed(i, t or "", rows)) for i, t, s in rows if (s or "") == part]
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                before = set(order[:step - 1])
                gone = [(i, x) for i, x in docs if f in x and not x & before]
                out[part, "".join(order), step] = (
                    sum(not x & (before | {f}) for _, x in docs), len(gone), sum(f in x and bool(x & before) for _, x in docs),
                    sum(x == {f} for _, x in docs), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone))
    shapley = {}
    for (part, order, step), v in out.items():
        key = part, order[step - 1]
        shapley[key] = shapley.get(key, 0) + v[1]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def long_text(n, distinct, extra=""):
    return " ".join(f"w{k % distinct}" for k in range(n)) + extra


ROWS = [(1, long_text(60, 60), "s"), (2, long_text(60, 60), "s"), (2, long_text(60, 60), "s"), (3, long_text(80, 20), "s"),
        (4, "SHORT TEXT", "t"), (5, None, "t"), (6, "", None), (7, long_text(100, 65, " #"), None), (8, "a\x0bb\x1fc d", ""),
        (None, "SHORT TEXT", "t"), (None, None, "s"), (9, long_text(200_000, 7), "s"), (10, long_text(49, 49) + "\x85x", "t"),
        (11, "SHORT TEXT", None), (12, "ÄÖ é|" * 3, "s")]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (4, 1, 1), (6, None, 1), (None, 1, 1), (12, 1, 0)]


@pytest.mark.parametrize("block_chars", [1, 500, 1 << 23])
def test_against_direct_count(spark, block_chars):
    docs = spark.createDataFrame([(*r, 1, "x") for r in ROWS], "doc_id long, text string, source string, failed int, part string").repartition(3)
    labels = spark.createDataFrame([(*r, "x") for r in LABELS], "doc_id long, quality int, toxic int, part string")
    got = A.filter_audit(docs, labels, block_chars).collect()
    want = brute(ROWS, LABELS)
    assert len(got) == len(want) == 600 * 3
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[3:]) for r in got} == want


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.filter_audit(docs, labels).count() == 0


@pytest.mark.parametrize("words", [2, 500_000])
def test_shards_hold_the_document_term_matrix(spark, monkeypatch, words):
    monkeypatch.setattr(A, "DICTIONARY_WORDS", words)
    texts = {1: "b a b c", 2: "c c d", 3: "", 4: "é a"}
    docs = spark.createDataFrame([(i, t, "s") for i, t in texts.items()], "doc_id long, text string, source string").repartition(2)
    blocks = A.csr_blocks(docs, 3)
    codes = A.word_codes(blocks)
    word_of = {}
    for r in codes.join(blocks.selectExpr("dictionary", "posexplode(words) as (pos, word)"), ["dictionary", "pos"]).collect():
        assert word_of.setdefault(r["id"], r["word"]) == r["word"]
    assert sorted(word_of) == list(range(5))
    import numpy as np

    found = {}
    for r in A.csr_shards(blocks, codes).collect():
        indptr, counts = A.unpack_ints(r["indptr"]), A.unpack_ints(r["counts"])
        cols = np.frombuffer(r["cols"], "<u8")
        for k, doc in enumerate(np.frombuffer(r["doc_ids"], "<i8").tolist()):
            span = slice(int(indptr[k]), int(indptr[k + 1]))
            found[doc] = {bytes(word_of[c]).decode(): n for c, n in zip(cols[span].tolist(), counts[span].tolist())}
    assert found == {1: {"b": 2, "a": 1, "c": 1}, 2: {"c": 2, "d": 1}, 3: {}, 4: {"é": 1, "a": 1}}
