"""Packing, token shards and the word-cached encoder against the plain library."""
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillmark.llm import tokens
from quillmark.llm.packing import pack
from quillmark.llm.token_store import WaveletMatrix, dump_shard, load_shard, read_store, write_store
from quillmark.llm.tokens import WordEncoder, vocabulary_path
from quillmark.session import scratch_path

ROWS = [(1, "Some words, here.\nAnd more  words.", "x"), (2, None, "x"), (3, "", "x"), (None, "no id", "y"),
        (4, "again again", None), (4, "again again", None), (5, "long text " * 9000, "z"), (6, " \n\t ", "z")]


def library():
    t = Tokenizer.from_file(vocabulary_path())
    t.encode_special_tokens = True
    return t


def table(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string, tier string")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab'sé中 \n\t  \x1c\x85\0½9<|>.,!")), max_size=30), max_size=5))
def test_word_encoder_equals_library(texts):
    got = WordEncoder().encode(texts)
    assert got == [array("I", e.ids).tobytes() for e in library().encode_batch(texts, add_special_tokens=False)]


def test_special_string_is_ordinary_text():
    assert WordEncoder().encode(["a <|endoftext|> b"]) == [
        array("I", library().encode("a <|endoftext|> b", add_special_tokens=False).ids).tobytes()]


@pytest.mark.parametrize("block_tokens", [1 << 22, 3000])
def test_pack_round_trip(spark, block_tokens):
    t = library()
    pieces = pack(table(spark).coalesce(1), block_tokens=block_tokens).toPandas()
    docs: dict = {}
    for p in pieces.sort_values("start").itertuples():
        key = None if p.doc_id != p.doc_id or str(p.doc_id) in ("<NA>", "nan") else int(p.doc_id)
        assert zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length
        docs.setdefault(key, []).append(p)
    want = sorted((str(i), len(t.encode(x or "", add_special_tokens=False).ids) + 1) for i, x, _ in ROWS)
    assert sum(p.length for p in pieces.itertuples()) == sum(n for _, n in want)
    for i, text, _ in ROWS:
        if i in (1, 2, 3, 5, 6):
            ids = b"".join(p.ids for p in docs[i])
            assert ids == array("I", t.encode(text or "", add_special_tokens=False).ids + [1]).tobytes()
    for _, seq in pieces.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert seq.offset.tolist() == (seq.length.cumsum() - seq.length).tolist() and seq.length.sum() <= 2048
        n = int(seq.length.sum())
        assert seq.sequence_length.iloc[0] == (n if n & (n - 1) == 0 else 2048)


def test_packing_wastes_little_and_balances(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").coalesce(1)
    p = pack(docs, with_ids=False).toPandas()
    seq = p.groupby("sequence_id").agg(used=("length", "sum"), size=("sequence_length", "first"), tier=("tier", "first"),
                                       group=("step_group", "first"))
    assert 1 - seq.used.sum() / seq["size"].sum() < 0.01
    cost = p.assign(c=p.length ** 2).groupby("step_group").c.sum()
    groups = seq.groupby("group").agg(n=("used", "size"), tier=("tier", "nunique"), t=("tier", "first"))
    assert groups.tier.max() == 1  # a step group has one context length
    full = groups[(groups.n == 8) & (groups.t == 2048)].index
    assert cost[full].max() < 1.5 * cost[full].min()


def test_pack_empty_table(spark):
    assert pack(table(spark, [])).count() == 0


def test_wavelet_matrix_answers():
    rng = np.random.default_rng(0)
    a = (rng.zipf(1.3, 3000) % 50257).astype(np.uint32)
    part, shard, docs, starts, w = load_shard(dump_shard(3, 4, np.array([7, 9]), np.array([0, 1000]), a))
    assert (part, shard, docs.tolist(), starts.tolist()) == (3, 4, [7, 9], [0, 1000])
    assert (w.decode() == a).all() and [w.access(i) for i in range(0, 3000, 41)] == a[::41].tolist()
    for s in (0, 1, 2, 77, 50256, 1 << 20):
        where = np.flatnonzero(a == s).tolist()
        assert w.locate(s) == where and w.count(s) == len(where) and w.rank(s, 1111) == (a[:1111] == s).sum()
    with pytest.raises(IndexError):
        w.select(1, w.count(1))


def test_token_store_round_trip(spark):
    folder = scratch_path(spark, "test-store")
    manifest = write_store(table(spark), folder, shard_tokens=5)
    assert manifest.count() > 2
    rows = sorted(read_store(spark, folder, manifest).collect(), key=lambda r: r["start"])
    t, start, got = library(), 0, []
    want = sorted(((-1 if i is None else i), x or "") for i, x, _ in ROWS)
    for (i, text), r in zip(want, rows, strict=True):
        ids = array("I", t.encode(text, add_special_tokens=False).ids + [0])
        got.append((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]))
        assert got[-1] == (None if i == -1 else i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_equal_words_of_a_group_are_looked_up_once():
    asked = []

    class Counting(tokens.Generation):
        def __getitem__(self, word):
            asked.append(word)
            return super().__getitem__(word)

    encoder = WordEncoder()
    encoder.young = Counting()
    text = "one niño, one niño. one (niño) " * 500
    assert encoder.encode([text, text]) == [array("I", library().encode(text, add_special_tokens=False).ids).tobytes()] * 2
    assert len(asked) == len(set(asked)) < 12
    assert " niño" in encoder.young and " niño," not in encoder.young


def test_groups_and_arrow_slices_equal_library(monkeypatch):
    monkeypatch.setattr(tokens, "GROUP_BYTES", 16)
    texts = [None, "", "a　 b", "é , ñ×, ÷.", "end ", " start", "x\n", "\ny", "中 文,  z", None, "it's'll, 'd", "q" * 50, ""]
    want = [array("I", e.ids).tobytes() for e in library().encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for kept in (4, 1000):
        assert WordEncoder(kept=kept).encode(pa.array(texts)[1:]) == want[1:]
        assert WordEncoder(kept=kept).encode(texts) == want
    assert WordEncoder().encode([]) == [] and WordEncoder().encode([None, ""]) == [b"", b""]
