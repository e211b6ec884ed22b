"""Tokenizers, normalisers and token views: stateless column functions.

Unknown names raise ValueError before a plan is built. Null texts give empty arrays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The common English stop-word list of 179 entries.
STOPWORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself
she she's her hers herself it it's its itself they them their theirs themselves what which who whom this that that'll
these those am is are was were be been being have has had having do does did doing a an the and but if or because as
until while of at by for with about against between into through during before after above below to from up down in out
on off over under again further then once here there when where why how all any both each few more most other some such
no nor not only own same so than too very s t can will just don don't should should've now d ll m o re ve y ain aren
aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't
mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split()

# Keywords kept by the structural normal form, and the smaller set kept by token views.
STRUCTURE_KEYWORDS = """
auto break case char const continue default do double else enum extern float for goto if inline int long register
restrict return short signed sizeof static struct switch typedef union unsigned void volatile while NULL size_t bool
true false
""".split()
VIEW_KEYWORDS = """
auto break case char const continue default do double else enum extern float for goto if inline int long register
restrict return short signed sizeof static struct switch typedef union unsigned void volatile while
""".split()

# Suffix tables of Porter's algorithm (1980).
PORTER_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
PORTER_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
PORTER_4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()

# Token patterns.
WORDS = "[a-z0-9]+"
WORDS_CASED = "[A-Za-z0-9]+"
WORDS_UNDERSCORE = "[a-z0-9_]+"
CODE = r"(?U)[A-Za-z_]\w*|\d+|[^\s\w]"
VIEW = "(?U)[A-Za-z_]\\w*|\\d+\\.?\\d*|\"[^\"]*\"|'[^']*'|[^\\s\\w]"
OPINION = "[a-z']+|[!?]"
URDU = "[ؠ-يً-ٟ٠-٩ٰ-ۓەۥ-ۦۮ-ۿݐ-ݿ]+|[A-Za-z]+|[0-9]+"


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def words(text: Column) -> Column:
    return matches(F.lower(text), WORDS)


def words_underscore(text: Column) -> Column:
    return matches(F.lower(text), WORDS_UNDERSCORE)


def code_tokens(text: Column) -> Column:
    return matches(text, CODE)


def opinion_tokens(text: Column) -> Column:
    bare = lambda t: F.when(F.replace(t, F.lit("'"), F.lit("")) == "", t).otherwise(F.replace(t, F.lit("'"), F.lit("")))
    return F.transform(matches(F.lower(text), OPINION), bare)


def urdu_tokens(text: Column) -> Column:
    return F.transform(matches(text, URDU), F.lower)


def porter_stem(word: str) -> str:
    """Porter's 1980 stemmer; words of one or two letters stay."""
    if len(word) <= 2:
        return word

    def shape(w: str) -> str:
        out = ""
        for c in w:
            out += "v" if c in "aeiou" or (c == "y" and out[-1:] == "c") else "c"
        return out

    def measure(w: str) -> int:
        return shape(w).count("vc")

    def cvc(w: str) -> bool:
        return shape(w)[-3:] == "cvc" and w[-1] not in "wxy"

    def doubled(w: str) -> bool:
        return len(w) > 1 and w[-1] == w[-2] and shape(w)[-1] == "c"

    w = word
    for end, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + to
            break
    if w.endswith("eed"):
        if measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        end = next((e for e in ("ed", "ing") if w.endswith(e) and "v" in shape(w[: -len(e)])), None)
        if end:
            w = w[: -len(end)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif doubled(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif measure(w) == 1 and cvc(w):
                w += "e"
    if w.endswith("y") and "v" in shape(w[:-1]):
        w = w[:-1] + "i"
    for rules in (PORTER_2, PORTER_3):
        end = next((e for e in rules if w.endswith(e)), None)
        if end and measure(w[: len(w) - len(end)]) > 0:
            w = w[: len(w) - len(end)] + rules[end]
    end = next((e for e in PORTER_4 if w.endswith(e)), None)
    if end:
        if measure(w[: -len(end)]) > 1:
            w = w[: -len(end)]
    elif w.endswith("ion") and w[-4:-3] in ("s", "t") and measure(w[:-3]) > 1:
        w = w[:-3]
    if w.endswith("e") and (measure(w[:-1]) > 1 or (measure(w[:-1]) == 1 and not cvc(w[:-1]))):
        w = w[:-1]
    if w.endswith("l") and doubled(w) and measure(w) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(T.StringType())
def _porter(words):  # a pandas Series
    done = {w: porter_stem(w) for w in words.unique() if w is not None}
    return words.map(done)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _porter_all(lists):
    done: dict[str, str] = {}
    return lists.map(lambda ws: None if ws is None else [done[w] if w in done else done.setdefault(w, porter_stem(w)) for w in ws])


def stem(word: Column) -> Column:
    return _porter(word)


def tokenizer(lowercase: bool = True, remove_stopwords: bool = False, stemmed: bool = False, min_length: int = 0) -> Callable[[Column], Column]:
    """Match, drop stop words, stem, drop short tokens: in this order."""

    def run(text: Column) -> Column:
        got = words(text) if lowercase else matches(text, WORDS_CASED)
        if remove_stopwords:
            stops = F.array(*[F.lit(w) for w in STOPWORDS])
            got = F.filter(got, lambda t: ~F.array_contains(stops, F.lower(t)))
        if stemmed:
            got = _porter_all(got)
        return F.filter(got, lambda t: F.length(t) >= min_length) if min_length else got

    return run


VARIANTS = {"baseline": {}, "stopwords": {"remove_stopwords": True}, "porter": {"stemmed": True}, "min length 3": {"min_length": 3}, "cased": {"lowercase": False}, "stopwords and stem": {"remove_stopwords": True, "stemmed": True}, "full": {"remove_stopwords": True, "stemmed": True, "min_length": 3}}


def char_ngrams(text: Column, longest: int = 5) -> Column:
    """All character n-grams of the text padded with one underscore on either side, by n, then place."""
    padded = F.concat(F.lit("_"), F.coalesce(text, F.lit("")), F.lit("_"))
    size = F.length(padded)
    one = lambda n: F.when(size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(padded, i, n))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.array(*[one(F.lit(n)) for n in range(1, longest + 1)]))


def shingle_strings(tokens: Column, k: int = 5) -> Column:
    """The distinct runs of k tokens, joined by spaces; one shingle for a shorter list, none for an empty one."""
    n = F.size(tokens)
    runs = F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(tokens, i, k), " "))
    return F.when(n == 0, F.array().cast("array<string>")).when(n < k, F.array(F.array_join(tokens, " "))).otherwise(F.array_distinct(runs))


def hash31(s: Column) -> Column:
    """The first 32 bits of an MD5, modulo the prime 2**31 - 1."""
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("long") % 2147483647


def shingles(tokens: Column, k: int = 5) -> Column:
    return F.array_distinct(F.transform(shingle_strings(tokens, k), hash31))


def normalise_exact(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalise_structural(text: Column) -> Column:
    """Comments go; strings, characters, numbers and names become place holders; keywords stay."""
    got = F.regexp_replace(text, r"(?s)/\*.*?\*/", " ")
    got = F.regexp_replace(got, r"//[^\n]*", " ")
    got = F.regexp_replace(got, r'"(?:[^"\\]|\\.)*"', '"S"')
    got = F.regexp_replace(got, r"'(?:[^'\\]|\\.)*'", "'C'")
    got = F.regexp_replace(got, r"(?U)\b\d+(?:\.\d+)?\b", "N")
    names = r"(?U)\b(?!(?:" + "|".join(STRUCTURE_KEYWORDS) + r")\b)[A-Za-z_]\w*\b"
    return normalise_exact(F.regexp_replace(got, names, "V"))


def strip_disambiguator(title: Column) -> Column:
    return F.trim(F.regexp_replace(title, r"\s*\([^)]*\)\s*$", ""))


def _keyword(t: Column) -> Column:
    return t.isin(VIEW_KEYWORDS)


def _masked(text: Column) -> Column:
    return F.transform(matches(text, VIEW), lambda t: F.when(_keyword(t), t).when(t.rlike("^[\"'].+"), F.lit("STR")).when(t.rlike(r"(?U)^\d"), F.lit("NUM")).when(t.rlike("^[A-Za-z_]"), F.lit("ID")).otherwise(F.when(t.rlike("^[\"']"), F.lit("STR")).otherwise(t)))


def _structural(text: Column) -> Column:
    return F.filter(matches(text, VIEW), lambda t: _keyword(t) | ~t.rlike("(?U)^[A-Za-z_\\d\"']"))


def _layout(text: Column) -> Column:
    """Typographic features of each line: binned length and indent, then marks of what the line holds."""

    def bin_of(x: Column, edges: list[int]) -> Column:
        out = F.lit(len(edges))
        for i in range(len(edges) - 1, -1, -1):
            out = F.when(x < edges[i], i).otherwise(out)
        return out.cast("string")

    def line(x: Column) -> Column:
        bare = F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
        indent = F.length(x) - F.length(F.regexp_replace(x, r"(?U)^\s+", ""))
        full = bare != ""
        marks = [
            (F.lit(True), F.concat(F.lit("len"), bin_of(F.length(x), [20, 40, 60, 80, 120]))), (F.lit(True), F.concat(F.lit("ind"), bin_of(indent, [1, 2, 4, 8]))), (~full, F.lit("blank")),
            (full & bare.rlike(r"^(/\*|\*|//)"), F.lit("comment")), (full & bare.startswith("{"), F.lit("brace_own_line")), (full & bare.endswith("{"), F.lit("brace_trailing")),
            (full & bare.startswith("#"), F.lit("preprocessor")), (full & bare.endswith(";"), F.lit("stmt_end")), (full & x.contains("\t"), F.lit("tab")),
        ]
        return F.array_compact(F.array(*[F.when(c, v) for c, v in marks]))

    return F.flatten(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), line))


VIEWS: dict[str, Callable[[Column], Column]] = {"lexical": lambda t: matches(t, VIEW), "masked": _masked, "structural": _structural, "layout": _layout}


def view(name: str, text: Column) -> Column:
    if name not in VIEWS:
        raise ValueError(f"unknown view {name!r}; one of {sorted(VIEWS)}")
    return VIEWS[name](text)
