"""Text functions against plain-Python renderings of the documented rules."""
import re

from pyspark.sql import functions as F

from quillmark.functions import text as T


def _py_clean(text):
    def remove(t, s, e):
        while True:
            i = t.find(s)
            if i < 0:
                return t
            j = t[i + 1:].find(e)
            t = t[:i] + t[i + 1 + j + 1:]
    return remove(remove(text, "*", "*"), "{", "}")


def test_clean_citations_rules(spark):
    cases = ["a *b* c", "x *y z", "*a* *b", "p {q} r {s", "{a{b} c}", "no marks", "**", "*a*b*c*d*e"]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    got = [r[0] for r in df.select(T.clean_citations("t")).collect()]
    assert got == [_py_clean(c) for c in cases]


def test_char_ngrams_equal_substrings(spark):
    cases = ["Hello  world\n\nagain", "ab", "a", "", "çà  é", "x\ny"]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    got = df.select(T.char_ngrams(T.char_preprocess("t")).alias("g")).collect()
    for c, r in zip(cases, got):
        p = re.sub(r"\s\s+", " ", c.lower())
        exp = [p[i:i + n] for n in range(2, 6) for i in range(len(p) - n + 1)]
        assert r["g"] == exp


def test_tokenizers(spark):
    df = spark.createDataFrame([("Don't stop: 42 cats, 1984! Ça va. New line\nhere?",)], "t string")
    r = df.select(T.style_tokens("t").alias("s"), T.word_unigrams("t").alias("w"), T.sentences("t").alias("z"),
                  T.token_count("t").alias("n")).first()
    assert r["s"] == ["don't", "stop", "cats", "ça", "va", "new", "line", "here"]
    assert r["w"] == ["don", "stop", "42", "cats", "1984", "ça", "va", "new", "line", "here"]
    assert r["z"] == ["Don't stop: 42 cats, 1984", "Ça va", "New line\nhere"]
    assert r["n"] == 10


def test_punctuation_and_function_words():
    assert len(T.PUNCTUATION) == 32
    assert len(T.LATIN_FUNCTION_WORDS) == 74
    assert "the" in T.function_words("en") and "de" in T.function_words("fr")
