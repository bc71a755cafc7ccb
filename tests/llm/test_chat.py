"""Chat formatting round trip."""
import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quillmark.llm import chat as C

SCHEMA = "conv_id long, turn long, role string, text string, pos string"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


def test_digest_and_examples(spark):
    rows = [(1, 0, "user", "a <b> \\"), (1, 1, "assistant", "</turn>\n"), (1, 2, None, None), (1, 3, "assistant", "é\\<text>"),
            (1, 3, "assistant", "é\\<text>"), (2, 5, "user", "only"), (None, 1, "assistant", "z"), (3, 0, "assistant", None),
            (4, 0, "user<text>\\", "x" * 5000)]
    f = C.expand(turns(spark, rows))
    got = {r["conv_id"]: r for r in C.read_back(f).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv))
        text = "".join(f"{r}\n{x}\n" for _, r, x in own)
        loss = "".join(x for _, r, x in own if r == "assistant")
        d = got[conv]
        assert d["n_turns"] == len(own) and d["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert d["loss_chars"] == len(loss) and d["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    segments = {}
    for r in sorted(f.collect(), key=lambda r: (str(r["conv_id"]), r["pos"])):
        segments.setdefault(r["conv_id"], []).append(r)
    texts = {(r["conv_id"], r["example"]): r for r in C.example_texts(f).collect()}
    for conv, own in segments.items():
        whole = "".join(r["segment"] for r in own)
        for r in own:
            if r["example"] is not None:
                e = texts[conv, r["example"]]
                assert e["text"] == whole[:r["target_end"]]
                assert C.unescape(e["text"][r["target_start"]:]) == C.unescape(C.TURN.fullmatch(r["segment"])[2])
    assert len(texts) == 5 and got[2]["n_examples"] == 0


def test_long_turn_is_read_back_in_little_memory():
    import resource

    text = ("word <mark> \\ " * 800_000) + "</turn>\n"
    segment = f"{C.OPEN}user{C.BODY}" + text.replace("\\", "\\\\").replace("<", "\\<") + C.CLOSE
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    d = C.Digest(1)
    d.add(segment, 0, len(f"{C.OPEN}user{C.BODY}"), len(segment) - len(C.CLOSE))
    assert d.all.hexdigest() == hashlib.sha256(f"user\n{text}\n".encode()).hexdigest()
    assert d.loss.hexdigest() == hashlib.sha256(text.encode()).hexdigest()
    # a few copies of 13 million characters, nothing per character
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200 * 1024


def test_empty_table(spark):
    assert C.read_back(C.expand(turns(spark, []))).count() == 0


@given(st.text(), st.text())
def test_marks_in_texts_are_read_back(role, text):
    def escape(x):
        return x.replace("\\", "\\\\").replace("<", "\\<")

    m = C.TURN.fullmatch(f"{C.OPEN}{escape(role)}{C.BODY}{escape(text)}{C.CLOSE}")
    assert (C.unescape(m[1]), C.unescape(m[2])) == (role, text)


def test_every_reply_is_expanded_with_its_whole_prefix(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn <{i}>") for i in range(6)] + [(2, 0, "assistant", "first")]
    got = C.expand(turns(spark, rows)).orderBy("conv_id", "pos").collect()
    for conv in (1, 2):
        own = [r for r in got if r["conv_id"] == conv]
        for r in own:
            before = "".join(x["segment"] for x in own[:r["pos"]])
            assert r["prefix"] == (before if r["example"] is not None else None)
            if r["example"] is not None:
                reply = (r["prefix"] + r["segment"])[r["target_start"]:r["target_end"]]
                assert C.unescape(reply) == C.unescape(C.TURN.fullmatch(r["segment"])[2])
    d = C.Digest(1)
    d.add(got[0]["segment"], 0, None, None)
    with pytest.raises(ValueError, match="prefix"):
        d.add(got[1]["segment"], got[1]["seg_start"], got[1]["target_start"], got[1]["target_end"], "another")
