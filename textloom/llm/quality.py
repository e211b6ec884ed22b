"""Quality rules as a short-circuit cascade, in DataFrame operations only.

Each rule rejects a document by one measure of its text, and is an expression of the text
alone. On a bounded sample the operator measures every rule's cost (the fastest of some
timed runs on one core, less that of a job without a rule) and counts its rejections,
orders the rules by rejections per second, and nests them in that order in one CASE
expression: what an early rule rejects is not measured by the later ones. The order is a
matter of speed: a document is kept if no rule rejects it, whatever the order.
``filter_documents`` runs all rules that way, the two base rules (too short, repeating
itself) among them; ``judge`` has to return the base measures of every row, so there the
base rules stand first and the others follow in the measured order.

Defined results: a null text counts as empty; an empty text has no words and fails the base
rule (too short); ties do not arise; repeated rows are judged one by one; texts of any length
are measured whole; null ids are kept
as they are; an empty table gives an empty result. Columns of the input pass through; where
one has the name of a measure, the operator's own gets an underscore appended.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, SPLIT, bind, free_name

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Cheap measures that most rules share: worked out once, before the cascade.
SHARED = ("n_words", "word_chars")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """``fails`` is true for a text to be rejected."""

    name: str
    fails: Column


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPLIT), lambda w: w != "")


def without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def count_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(without(text, chars))


def repeat_words(words: Column) -> Column:
    """Number of words in 3-word windows that are found twice or more.

    The 64-bit hashes of the windows are sorted with their places; equal neighbours are
    windows found twice or more; the words that these cover are counted once each from the
    sorted list of places. That is one sort for a text, with no comparison of all pairs.
    """

    def triples(w: Column) -> Column:
        n = F.size(w)
        return F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: (F.get(s, i + 1)["h"] == x["h"]) | ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    more = lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"))
    covered = F.aggregate(bind(bind(words, lambda w: F.sort_array(triples(w))), places), F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), more, lambda a: a["n"])
    return F.coalesce(covered, F.lit(0))


def measures(text: str = "text") -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (all long), each of the text alone."""
    t = text_of(text)
    lines = F.filter(F.split(t, "\n"), lambda x: without(x, SPACES) != "")
    return {
        "n_words": F.size(words_of(t)).cast("long"),
        "word_chars": F.length(without(t, SPACES)).cast("long"),
        "n_symbols": count_of(t, SYMBOLS).cast("long"),
        "n_dup_lines": bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeat_words(words_of(t)).cast("long"),
    }


def base_rules(of: dict[str, Column], min_words: int = 50, max_repeat_percent: int = 50) -> list[Rule]:
    return [Rule("too_short", of["n_words"] < min_words), Rule("repeating", 100 * of["n_repeat_words"] > max_repeat_percent * of["n_words"])]


def default_rules(of: dict[str, Column] | None = None, text: str = "text") -> list[Rule]:
    """Rules that plain prose of any language and script passes by a wide margin. of: the measures, if they are columns already."""
    t = text_of(text)
    of = measures(text) if of is None else of
    return [
        Rule("symbols", of["n_symbols"] * 20 > of["word_chars"]),
        Rule("shouting", count_of(t, "!") * 20 > of["word_chars"]),
        Rule("dup_lines", of["n_dup_lines"] * 10 > 7 * F.size(F.split(t, "\n"))),
        Rule("long_words", of["word_chars"] > 40 * of["n_words"]),
        Rule("no_letters", ~t.rlike(r"\p{L}")),
        Rule("digits", count_of(t, "0123456789") * 2 > of["word_chars"]),
    ]


def measured_order(docs: DataFrame, rules: list[Rule], sample_rows: int = 2000, seed: int = 17, runs: int = 3, ready: dict[str, Column] | None = None) -> list[Rule]:
    """``rules`` by rejections per second on at most about ``sample_rows`` rows of ``docs``, best first.

    ``ready``: columns that rules refer to, added to the sample once it is drawn. The sample is brought into one partition, so that a run's time is the rule's and not the scheduler's.
    The first run of each rule warms it up and gives its rejections; of the others the
    fastest counts. A rule that rejects nothing goes last, the cheaper one first.
    """
    n = docs.count()
    if not n:
        return rules
    sample = (docs if n <= sample_rows else docs.sample(fraction=sample_rows / n, seed=seed)).repartition(1).withColumns(ready or {}).persist()

    def timed(what: Column) -> tuple[float, int]:
        hits, best = sample.agg(F.count_if(what)).first()[0], float("inf")
        for _ in range(runs):
            began = time.perf_counter()
            sample.agg(F.count_if(what)).first()
            best = min(best, time.perf_counter() - began)
        return best, hits

    try:
        sample.count()
        idle, _ = timed(F.lit(False))
        worth = []
        for k, r in enumerate(rules):
            cost, hits = timed(r.fails)
            cost = max(cost - idle, 1e-4)
            worth.append((-hits / cost, cost, k))
        return [rules[k] for _, _, k in sorted(worth)]
    finally:
        sample.unpersist()


def cascade(rules: list[Rule]) -> Column:
    """Name of the first rule, in the given order, that rejects the row; null if none does."""
    out = F.lit(None).cast("string")
    for r in reversed(rules):
        out = F.when(F.coalesce(r.fails, F.lit(False)), F.lit(r.name)).otherwise(out)
    return out


def judge(docs: DataFrame, text: str = "text", sample_rows: int = 2000) -> DataFrame:
    """``docs`` with the base measures, base_failed and kept."""
    names = {c: free_name(c, docs.columns) for c in (*MEASURES, "base_failed", "kept")}
    ready = {f"__q_{c}": m for c, m in measures(text).items()}
    got = docs.withColumns(ready)
    of = {c: F.col(f"__q_{c}") for c in MEASURES}
    short, repeating = base_rules(of)
    order = measured_order(docs.select(text), default_rules(of, text), sample_rows, ready=ready)
    got = got.withColumn("__q_base", short.fails | repeating.fails)
    got = got.withColumn("__q_kept", F.when(F.col("__q_base"), False).otherwise(cascade(order).isNull()))
    out = [*(of[c].alias(names[c]) for c in MEASURES), F.col("__q_base").alias(names["base_failed"]), F.col("__q_kept").alias(names["kept"])]
    return got.select(*[F.col(f"`{c}`") for c in docs.columns], *out)


def filter_documents(docs: DataFrame, text: str = "text", sample_rows: int = 2000) -> DataFrame:
    """The documents that no rule rejects, columns unchanged; what one rule rejects the later ones do not measure.

    Numbers of words and of their characters, which most rules share, are worked out first.
    """
    of = measures(text)
    ready = {f"__q_{c}": of[c] for c in SHARED}
    of |= {c: F.col(f"__q_{c}") for c in SHARED}
    order = measured_order(docs.select(text), [*base_rules(of), *default_rules(of, text)], sample_rows, ready=ready)
    # a random column keeps the optimiser from moving the filter below the shared measures and repeating them in each rule
    got = docs.withColumns(ready).withColumn("__q_r", F.rand(0)).where(cascade(order).isNull() & (F.col("__q_r") >= 0))
    return got.select(*[F.col(f"`{c}`") for c in docs.columns])
