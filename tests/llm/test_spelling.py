"""Spelling variants against a direct search."""
import random
import re
import zlib
from collections import Counter

import pytest

from quillmark.llm import spelling as S


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    form, n_near = {}, {}
    for w in words:
        found = [v for v in words if near(v, w)]
        n_near[w] = len(found)
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, n_near[w], words.get(form[w])) for w, n in words.items()}


def sample(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcéÀ") for _ in range(rng.randrange(5, 12))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "ababab", "bababa"]
    rows = []
    for i in range(300):
        words = []
        for _ in range(60):
            w = rng.choice(base[:rng.randrange(1, len(base) + 1)])
            if rng.random() < 0.4:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1:], w[:at] + rng.choice("abc") + w[at:], w[:at] + rng.choice("abc") + w[at + 1:]])
            words.append(w.upper() if rng.random() < 0.2 else w)
        rows.append((None if i % 50 == 0 else i // 2, " ".join(words) + "×-" + words[0]))
    chain = [(1000 + i, " ".join(["zzzzccc"] * 12 + ["zzzzzcc"] * 2 + ["zzzzzzc"] * (i % 3 == 0))) for i in range(60)]
    return rows + chain + [(2000 + i, "zzzzzzzz zzzzzzz") for i in range(4)] + [(1, None), (2, ""), (3, "x" * 100_000), (None, None)]


@pytest.mark.parametrize("group_words", [8, 4096])
def test_against_direct_search(spark, group_words):
    rows = sample(3)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(3)
    got = {r["word"]: tuple(r[k] for k in ("form", "root", "n", "n_near", "form_n"))
           for r in S.spelling_variants(docs, group_words=group_words).collect()}
    want = brute(rows)
    assert len(want) > 100 and sum(v[0] is not None for v in want.values()) > 20
    assert want["zzzzzzc"][:2] == ("zzzzzcc", "zzzzccc")
    assert got == want


def test_long_words_and_empty(spark):
    long = "xy" * 3000
    rows = [(i, f"{long} {long}z {'q' * 5999}") for i in range(5)] + [(9, f"{long} " * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["word"]: (r["form"], r["n_near"]) for r in S.spelling_variants(docs).collect()}
    assert got[long] == (None, 1) and got[long + "z"] == (long, 1) and got["q" * 5999] == (None, 0)
    assert S.spelling_variants(docs.limit(0)).count() == 0
