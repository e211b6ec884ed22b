"""Dictionary tagging, sentiment by lexicon and rules, sentence boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..plans.tables import bounded, listed

# Fixed values of the sentiment rules: negators, words that strengthen or weaken the next, contrasts.
NEGATORS = """no not none nobody nothing neither nor nowhere never cannot cant dont doesnt didnt isnt arent wasnt werent wont
wouldnt shouldnt couldnt havent hasnt hadnt aint without lack lacks lacking hardly barely scarcely rarely seldom""".split()
BOOSTERS = """very extremely absolutely completely really totally utterly incredibly especially particularly remarkably
substantially tremendously exceptionally deeply highly hugely enormously entirely purely thoroughly quite so""".split()
DAMPENERS = "slightly somewhat marginally partly fairly rather kinda sorta almost partially occasionally".split()
CONTRASTIVE = "but however although though yet nevertheless".split()
BOOST, DAMP, BEFORE, AFTER, REACH = 1.5, 0.5, 0.5, 1.5, 3
# Abbreviations after which a period ends no sentence.
ABBREVIATIONS = """mr mrs ms dr prof st jr sr vs etc inc ltd co corp dept est fig no vol pp ed eds approx univ assn bros ave
blvd rd apt ft cf ie eg al""".split()


def ngrams(docs: DataFrame, longest: int, key: str = "doc_id", column: str = "text", tokenize=text.words) -> DataFrame:
    """(key, start, n, gram): every run of 1 to ``longest`` tokens, joined by spaces."""
    t = docs.select(key, tokenize(F.col(column)).alias("t"))
    at = t.select(key, "t", F.explode(F.sequence(F.lit(1), F.greatest(F.size("t"), F.lit(1)))).alias("start")).where(F.col("start") <= F.size("t"))
    runs = at.select(key, "start", F.size("t").alias("size"), F.slice("t", F.col("start"), longest).alias("next"), F.explode(F.sequence(F.lit(1), F.lit(longest))).alias("n")).where("start + n - 1 <= size")
    return runs.select(key, (F.col("start") - 1).alias("start"), "n", F.array_join(F.slice("next", 1, F.col("n")), " ").alias("gram"))


def tag(docs: DataFrame, patterns: DataFrame, longest: int, key: str = "doc_id", column: str = "text") -> DataFrame:
    """patterns: (pattern, gram). (key, pattern, start, n) of all occurrences, nested ones included.

    Each place of a document makes one row with its next tokens; runs are cut from it only
    if the first token begins some pattern.
    """
    p = bounded(patterns.select("pattern", "gram"))
    heads = patterns.select(F.substring_index("gram", " ", 1).alias("head")).distinct()
    few = listed(heads, "head")
    t = docs.select(key, text.words(F.col(column)).alias("t"))
    if few is not None:
        starts = F.filter(F.when(F.size("t") > 0, F.sequence(F.lit(0), F.size("t") - 1)), lambda i: F.get("t", i).isin(few))
        at = t.select(key, "t", F.explode(starts).alias("start")).select(key, "start", F.slice("t", F.col("start") + 1, longest).alias("next"))
    else:
        at = t.select(key, F.posexplode(F.transform("t", lambda x, i: F.slice(F.col("t"), i + 1, longest))).alias("start", "next"))
        at = at.withColumn("head", F.get("next", F.lit(0))).join(bounded(heads), "head", "left_semi")
    runs = at.select(key, "start", F.explode(F.transform(F.sequence(F.lit(1), F.size("next")), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(F.col("next"), 1, n), " ").alias("gram")))).alias("x")).select(key, "start", "x.n", "x.gram")
    return runs.join(p, "gram").select(key, "pattern", "start", "n")


def longest_first(tags: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of a document's tags the longest, then the leftmost, that overlap none chosen before: (key, pattern, start, n)."""
    spans = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "start", "pattern")))
    got = tags.groupBy(key).agg(spans.alias("s"))
    clash = lambda acc, x: F.exists(acc, lambda y: (x["start"] < y["start"] - y["m"]) & (y["start"] < x["start"] - x["m"]))
    empty = F.filter("s", lambda x: F.lit(False))
    return got.select(key, F.explode(F.aggregate("s", empty, lambda acc, x: F.when(clash(acc, x), acc).otherwise(F.concat(acc, F.array(x))))).alias("x")).select(key, "x.pattern", "x.start", (-F.col("x.m")).alias("n"))


def _value(lexicon: Column, t: Column) -> Column:
    return F.coalesce(F.element_at(lexicon, t), F.lit(0.0))


def _in(words: list[str], t: Column) -> Column:
    return t.isin(words)


def _bag(tokens: Column, lexicon: Column) -> Column:
    return F.aggregate(tokens, F.lit(0.0), lambda s, t: s + _value(lexicon, t))


def _ruled(tokens: Column, lexicon: Column, strength: bool) -> Column:
    """A fold over the tokens: the last three are all that is remembered."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit("").alias("p1"), F.lit("").alias("p2"), F.lit("").alias("p3"))

    def step(s: Column, t: Column) -> Column:
        v = _value(lexicon, t)
        if strength:
            v = v * F.when(_in(BOOSTERS, s["p1"]), BOOST).when(_in(DAMPENERS, s["p1"]), DAMP).otherwise(1.0)
        v = F.when(_in(NEGATORS, s["p1"]) | _in(NEGATORS, s["p2"]) | _in(NEGATORS, s["p3"]), -v).otherwise(v)
        return F.struct((s["sum"] + v).alias("sum"), t.alias("p1"), s["p1"].alias("p2"), s["p2"].alias("p3"))

    return F.aggregate(tokens, start, step, lambda s: s["sum"])


def _contrastive(tokens: Column, lexicon: Column) -> Column:
    marks = F.transform(tokens, lambda t: _in(CONTRASTIVE, t))
    at = F.coalesce(F.array_position(marks, True), F.lit(0)).cast("int")
    n = F.size(tokens)
    before, after = F.slice(tokens, F.lit(1), F.greatest(at - 1, F.lit(0))), F.slice(tokens, at + 1, F.greatest(n - at, F.lit(0)))
    return F.when(at == 0, _ruled(tokens, lexicon, True)).otherwise(BEFORE * _ruled(before, lexicon, True) + AFTER * _ruled(after, lexicon, True))


RULES = {"bag": _bag, "negation": lambda t, x: _ruled(t, x, False), "intensifier": lambda t, x: _ruled(t, x, True), "contrastive": _contrastive}


def sentiment(rule: str, tokens: Column, lexicon: Column) -> Column:
    """Score of a token array (a column, not an expression) under a rule set; lexicon is a map column."""
    if rule not in RULES:
        raise ValueError(f"unknown rule set {rule!r}; one of {sorted(RULES)}")
    return RULES[rule](tokens, lexicon)


def _pieces(docs: DataFrame, key: str, column: str) -> DataFrame:
    """(key, at, left, right): the places behind marks that white space follows, with the pieces on either side.

    Offsets are a running sum over a text's pieces, worked out beside their explosion: an array of sums that
    each step copies would take the square of their number.
    """

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows, at, left, right = [], [], [], []
            for row, p in enumerate(b.column(1)):
                p, end = p.as_py(), 0
                for i in range(len(p) - 1):
                    end += len(p[i])
                    rows.append(row)
                    at.append(end)
                    left.append(p[i])
                    right.append(p[i + 1])
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(at, pa.int32()), pa.array(left, pa.string()), pa.array(right, pa.string())], names=[key, "at", "left", "right"])
                    rows, at, left, right = [], [], [], []
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(at, pa.int32()), pa.array(left, pa.string()), pa.array(right, pa.string())], names=[key, "at", "left", "right"])

    p = docs.where(F.col(column).isNotNull()).select(key, F.split(column, r"(?U)(?<=[.!?])(?=\s)").alias("p")).where(F.size("p") > 1)
    return p.mapInArrow(run, f"`{key}` {dict(p.dtypes)[key]}, at int, left string, right string")


def _abbreviation(known: list[str]) -> Column:
    return ~(F.col("left").endswith(".") & F.lower(F.regexp_extract("left", r"(?U)([\p{L}\p{N}']*)[.!?]$", 1)).isin(known))


def _conservative() -> Column:
    follow = F.regexp_extract("right", r"(?U)^\s+(\S)", 1)
    return (follow == "") | follow.rlike(r"^[\p{Lu}\p{N}\"'(\[]")


def boundaries(docs: DataFrame, rule: str, known: list[str] | None = None, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, at): character offsets after which a sentence ends, by ``naive``, ``abbreviation``, ``trained`` or ``conservative``.

    A text is split once behind each mark that white space follows; offsets are running sums of the pieces' lengths.
    """
    if rule not in ("naive", "abbreviation", "trained", "conservative"):
        raise ValueError(f"unknown splitter {rule!r}")
    known = ABBREVIATIONS if known is None or rule != "trained" else known
    rows = _pieces(docs, key, column)
    if rule == "naive":
        return rows.select(key, "at")
    rows = rows.where(_abbreviation(known))
    return (rows.where(_conservative()) if rule == "conservative" else rows).select(key, "at")


def disagreements(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, at, kind): boundaries that some splitters set and others do not, by the construction they stand in.

    The word before the mark and the word after it decide: the first kind that fits holds.
    """
    rows = _pieces(docs, key, column)
    mark = F.right("left", F.lit(1))
    before = F.regexp_extract("left", r"(?U)([\p{L}\p{N}']*)[.!?]$", 1)
    first = F.regexp_extract("right", r"(?U)^\s+(\S)", 1)
    kind = (
        F.when(mark.isin("!", "?"), "exclamation or question").when(F.lower(before).isin(ABBREVIATIONS), "known abbreviation").when(before.rlike(r"^\p{L}$"), "single initial")
        .when(before.rlike(r"^\p{N}+$") & first.rlike(r"^\p{N}"), "decimal or version number").when(before.rlike(r"^\p{N}+$"), "number before period").when(first == "", "end of text")
        .when(first.rlike(r"^\p{Ll}"), "lowercase follows").when(first.isin('"', "'", "(", "["), "quote or bracket follows").when(before.rlike(r"\p{Lu}$"), "acronym").otherwise("other")
    )
    # the naive splitter sets all of them, so another must leave one out
    return rows.where(~(_abbreviation(ABBREVIATIONS) & _conservative())).select(key, "at", kind.alias("kind"))


def learned_abbreviations(docs: DataFrame, least: int = 4, share: float = 0.85, column: str = "text") -> DataFrame:
    """(word, n, share) of words that a period follows nearly always."""
    rows = docs.select(F.explode(F.regexp_extract_all(F.coalesce(F.col(column), F.lit("")), F.lit("[A-Za-z][A-Za-z']*\\.?"), F.lit(0))).alias("w"))
    n = rows.groupBy(F.lower(F.rtrim(F.col("w"), F.lit("."))).alias("word")).agg(F.count("*").alias("n"), F.count_if(F.col("w").endswith(".")).alias("dots"))
    return n.where((F.col("n") >= least) & (F.col("dots") / F.col("n") >= share)).select("word", "n", (F.col("dots") / F.col("n")).alias("share"))


def matched(found: DataFrame, wanted: DataFrame, tolerance: int = 1, key: str = "doc_id") -> DataFrame:
    """One row (tp, fp, fn, precision, recall, f1): offsets matched greedily, one to one, in ascending order."""
    a = found.groupBy(key).agg(F.array_sort(F.collect_list("at")).alias("x"))
    b = wanted.groupBy(key).agg(F.array_sort(F.collect_list("at")).alias("y"))
    j = a.join(b, key, "full").select(F.coalesce("x", F.array().cast("array<int>")).alias("x"), F.coalesce("y", F.array().cast("array<int>")).alias("y"))
    skip = lambda s, v: F.coalesce(F.size("y") - F.size(F.filter(F.slice("y", s["i"] + 1, F.greatest(F.size("y") - s["i"], F.lit(0))), lambda r: r >= v - tolerance)), F.size("y"))
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("tp"))

    def step(s: Column, v: Column) -> Column:
        i = skip(s, v)
        hit = F.coalesce(F.get("y", i) <= v + tolerance, F.lit(False))
        return F.struct(F.when(hit, i + 1).otherwise(i).alias("i"), (s["tp"] + hit.cast("int")).alias("tp"))

    tp = F.aggregate("x", start, step, lambda s: s["tp"])
    t = j.agg(F.sum(tp).alias("tp"), F.sum(F.size("x")).alias("nx"), F.sum(F.size("y")).alias("ny"))
    return t.select("tp", (F.col("nx") - F.col("tp")).alias("fp"), (F.col("ny") - F.col("tp")).alias("fn"), F.coalesce(F.col("tp") / F.nullif("nx", F.lit(0)), F.lit(0.0)).alias("precision"), F.coalesce(F.col("tp") / F.nullif("ny", F.lit(0)), F.lit(0.0)).alias("recall"), F.coalesce(2 * F.col("tp") / F.nullif(F.col("nx") + F.col("ny"), F.lit(0)), F.lit(0.0)).alias("f1"))
