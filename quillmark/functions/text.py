"""Text scalar functions as Spark Columns (JVM-side, codegen'd), with DuckDB twins.

Tokenizer rules are our own documented regexes (no Treebank / Punkt):
  * style tokens: runs of letters, digits and apostrophes, lower-cased, kept if
    they contain a letter;
  * word unigrams: runs of >= 2 letters / digits / underscores, lower-cased;
  * sentences: split at runs of . ! ? followed by whitespace or the end.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values (regex rules)
STYLE_TOKEN_RE = "[\\p{L}\\p{N}']+"
WORD_RE = "[\\p{L}\\p{N}_]{2,}"
SENT_SPLIT_RE = "[.!?]+(\\s+|$)"
WS_RUN_RE = "\\s\\s+"
EDGE_WS_RE = "^\\s+|\\s+$"
NONSPACE_RE = "\\S+"

# fixed values: Python's string.punctuation, in its natural order
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# fixed values: the built-in Latin function-word list (74 words)
LATIN_FUNCTION_WORDS = [
    "et", "in", "de", "ad", "non", "ut", "cum", "per", "a", "sed", "que", "quia", "ex", "sic",
    "si", "etiam", "idest", "nam", "unde", "ab", "uel", "sicut", "ita", "enim", "scilicet", "nec",
    "pro", "autem", "ibi", "dum", "uero", "tamen", "inter", "ideo", "propter", "contra", "sub",
    "quomodo", "ubi", "super", "iam", "tam", "hec", "post", "quasi", "ergo", "inde", "e", "tunc",
    "atque", "ac", "sine", "nisi", "nunc", "quando", "ne", "usque", "siue", "aut", "igitur", "circa",
    "quidem", "supra", "ante", "adhuc", "seu", "apud", "olim", "statim", "satis", "ob", "quoniam",
    "postea", "nunquam",
]

# fixed values: function words (closed-class words) per language, in natural order
ENGLISH_FUNCTION_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below "
    "between both but by can could did do does doing down during each few for from further had has have "
    "having he her here hers him his how i if in into is it its just me more most my no nor not now of off "
    "on once only or other our out over own same she should so some such than that the their them then "
    "there these they this those through to too under until up very was we were what when where which "
    "while who whom why will with would you your"
).split()
FRENCH_FUNCTION_WORDS = (
    "a ai au aux avec avait ce ces cette comme dans de des du elle elles en entre est et eu il ils je la "
    "le les leur leurs lui ma mais me même mes moi mon ne nos notre nous on ont ou où par pas plus pour "
    "qu que qui sa sans se ses si son sont sous sur ta te tes toi ton très tu un une vos votre vous y"
).split()
GERMAN_FUNCTION_WORDS = (
    "aber als am an auch auf aus bei bin bis da damit dann das dass dein dem den der des die doch dort du "
    "durch ein eine einem einen einer eines er es euer für gegen habe haben hat hatte hier ich ihm ihn ihr "
    "im in ist ja jede jener kein können man mein mich mir mit nach nicht noch nun nur ob oder ohne sehr "
    "sein sich sie sind so über um und uns unter vom von vor war was weil wenn wer wie wir wird wo zu zum "
    "zur zwischen"
).split()
SPANISH_FUNCTION_WORDS = (
    "a al algo como con contra cual cuando de del desde donde durante e el ella ellas ellos en entre era es "
    "esa ese eso esta este esto está fue ha hay la las le les lo los me mi mis más mucho muy nada ni no nos "
    "nosotros o os otra otro para pero poco por porque que quien se ser si sin sobre son su sus sí también "
    "tanto te tiene todo tu tus un una uno unos vosotros y ya yo"
).split()

#: Lists by language code; a document in any other language uses the English one.
FUNCTION_WORDS = {"en": ENGLISH_FUNCTION_WORDS, "fr": FRENCH_FUNCTION_WORDS, "de": GERMAN_FUNCTION_WORDS,
                  "es": SPANISH_FUNCTION_WORDS, "la": LATIN_FUNCTION_WORDS}


def function_words(lang: str) -> tuple[str, ...]:
    return tuple(FUNCTION_WORDS.get(lang, ENGLISH_FUNCTION_WORDS))


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def token_count(text) -> Column:
    """P1 helper: number of whitespace-separated tokens (``len(text.split())``)."""
    return F.size(F.regexp_extract_all(_c(text), F.lit(NONSPACE_RE), 0))


def clean_citations(text, strict: bool = False) -> Column:
    """Delete ``*...*`` then ``{...}`` left to right; an unpaired opener is
    deleted alone.  ``strict`` raises when '{' and '}' counts differ."""
    t = _c(text)
    out = F.regexp_replace(t, "\\*[^*]*\\*", "")
    out = F.regexp_replace(out, "\\*", "")
    out = F.regexp_replace(out, "\\{[^}]*\\}", "")
    out = F.regexp_replace(out, "\\{", "")
    if strict:
        n_open = F.length(t) - F.length(F.regexp_replace(t, "\\{", ""))
        n_close = F.length(t) - F.length(F.regexp_replace(t, "\\}", ""))
        out = F.when(n_open != n_close, F.raise_error(F.lit("wrong number of {} found"))).otherwise(out)
    return out


def style_tokens(text) -> Column:
    """Lower-cased word tokens that contain a letter."""
    toks = F.regexp_extract_all(F.lower(_c(text)), F.lit(STYLE_TOKEN_RE), 0)
    return F.filter(toks, lambda w: w.rlike("\\p{L}"))


def strip_ws(c: Column) -> Column:
    return F.regexp_replace(c, EDGE_WS_RE, "")


def sentences(text) -> Column:
    """Rule-based sentence split, stripped, empties dropped."""
    parts = F.transform(F.split(_c(text), SENT_SPLIT_RE), strip_ws)
    return F.filter(parts, lambda s: F.length(s) > 0)


def word_unigrams(text) -> Column:
    """Tokens of >= 2 word characters, lower-cased."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(WORD_RE), 0)


def char_preprocess(text) -> Column:
    """Lower-case and squeeze whitespace runs of length >= 2 to one space."""
    return F.regexp_replace(F.lower(_c(text)), WS_RUN_RE, " ")


def _join_at(toks: Column, n: int):
    # one-argument lambda: a second parameter would be read as the element index
    return lambda i: F.array_join(F.slice(toks, i, n), " ")


def char_ngrams(prepped, n_min: int = 2, n_max: int = 5) -> Column:
    """Every substring of length n_min..n_max of a preprocessed text column
    (see ``char_preprocess``).  One native regex scan per n with a capturing
    lookahead returns all overlapping n-grams, without a per-gram lambda."""
    t = _c(prepped)
    per_n = [F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{n}}}))"), 1) for n in range(n_min, n_max + 1)]
    return F.flatten(F.array(*per_n)) if len(per_n) > 1 else per_n[0]


def word_ngrams(tokens, n_min: int, n_max: int) -> Column:
    """Word n-grams (joined by ' ') of an array of tokens."""
    toks = _c(tokens)
    per_n = []
    for n in range(n_min, n_max + 1):
        grams = F.transform(F.sequence(F.lit(1), F.size(toks) - n + 1), _join_at(toks, n))
        per_n.append(F.when(F.size(toks) >= n, grams).otherwise(F.array().cast("array<string>")))
    return F.flatten(F.array(*per_n)) if len(per_n) > 1 else per_n[0]


def tag_tokens(tags) -> Column:
    """P10 input rule: tags lower-cased, one-letter tags dropped (default token pattern)."""
    return F.filter(F.transform(_c(tags), F.lower), lambda t: F.length(t) >= 2)


def shape_tags(text) -> Column:
    """Coarse word-shape tags, the test stand-in for POS tags:
    length class (s <= 3 < m <= 6 < l) + case of the first char (u/w) + vowel end (v/c)."""
    toks = F.regexp_extract_all(_c(text), F.lit(STYLE_TOKEN_RE), 0)

    def tag(w):
        length = F.when(F.length(w) <= 3, "s").when(F.length(w) <= 6, "m").otherwise("l")
        cap = F.when(F.substring(w, 1, 1).rlike("\\p{Lu}"), "u").otherwise("w")
        vow = F.when(F.lower(F.substring(w, -1, 1)).rlike("[aeiouy]"), "v").otherwise("c")
        return F.concat(length, cap, vow)

    return F.transform(toks, tag)


def punctuation_chars(text) -> Column:
    """The punctuation characters of the preprocessed text, one per occurrence."""
    chars = F.split(char_preprocess(text), "")
    return F.filter(chars, lambda ch: (F.length(ch) == 1) & (F.instr(F.lit(PUNCTUATION), ch) > 0))
