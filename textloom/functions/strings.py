"""String similarity, phonetic codes and error models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.tables import bounded
from .rng import uniform

# Keyboard rows; steps to neighbours when measuring and when corrupting.
ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
MEASURED_STEPS = ((0, -1), (0, 1), (-1, 0), (1, 0), (-1, -1), (1, 1))
TYPED_STEPS = ((0, -1), (0, 1), (-1, 0), (1, 0))
# Pronunciation-preserving rewrites, either way.
PHONETIC = (("ph", "f"), ("c", "k"), ("s", "z"), ("ie", "y"), ("ei", "ai"), ("ck", "k"), ("qu", "kw"), ("x", "ks"), ("gh", ""), ("e", ""))
# Rewrites of the reduced Metaphone, in order.
METAPHONE = (("ph", "f"), ("gh", "f"), ("ck", "k"), ("sch", "sk"), ("tch", "ch"), ("wr", "r"), ("kn", "n"), ("gn", "n"), ("mb", "m"), ("ie", "y"), ("ei", "y"), ("c", "k"), ("q", "k"), ("x", "ks"), ("z", "s"))


def neighbours(steps) -> dict[str, str]:
    """Each key's neighbours on the keyboard, in the order of the steps."""
    at = {(r, c): k for r, row in enumerate(ROWS) for c, k in enumerate(row)}
    return {k: "".join(at[r + i, c + j] for i, j in steps if (r + i, c + j) in at) for (r, c), k in at.items()}


_NEAR = neighbours(MEASURED_STEPS)


def osa(a: str, b: str) -> int:
    """Edits with transpositions of neighbours, no part edited twice (optimal string alignment)."""
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, two[j - 2] + 1)
            row.append(best)
        two, one = one, row
    return one[-1]


def keyboard(a: str, b: str, near: float = 0.4) -> float:
    """Levenshtein in which replacing a key by its neighbour costs less; keys are taken from the longer word."""
    if len(a) < len(b):
        a, b = b, a
    last = [float(j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        row = [float(i)]
        close = _NEAR.get(x, "")
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (0.0 if x == y else near if y in close else 1.0)))
        last = row
    return last[-1]


def jaro(a: str, b: str) -> float:
    if not a or not b:
        return float(a == b)
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, left = set(), []
    for i, x in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if j not in taken and b[j] == x), None)
        if j is not None:
            taken.add(j)
            left.append(x)
    m = len(left)
    if not m:
        return 0.0
    moved = sum(x != b[j] for x, j in zip(left, sorted(taken), strict=True)) / 2
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    base, n = jaro(a, b), 0
    while n < min(4, len(a), len(b)) and a[n] == b[n]:
        n += 1
    return base + n * 0.1 * (1 - base)


def _of_pairs(f):
    @F.pandas_udf(T.DoubleType())
    def run(a, b):  # pandas Series
        import pandas as pd

        return pd.Series([None if x is None or y is None else float(f(x, y)) for x, y in zip(a, b, strict=True)], dtype="float64")

    return run


def _relative(f):
    return lambda a, b: 1 - f(a, b) / max(len(a), len(b)) if a or b else 1.0


def soundex(word: Column) -> Column:
    """The census code of a word's letters a-z; empty for none."""
    bare = F.regexp_replace(F.lower(word), "[^a-z]", "")
    return F.when(bare == "", "").otherwise(F.soundex(bare))


def metaphone(word: Column) -> Column:
    got = F.regexp_replace(F.lower(word), "[^a-z]", "")
    for a, b in METAPHONE:
        got = F.replace(got, F.lit(a), F.lit(b))
    got = F.concat(F.substring(got, 1, 1), F.regexp_replace(F.substr(got, F.lit(2)), "[aeiou]", ""))
    return F.regexp_replace(got, r"(.)\1+", "$1")


def bigrams(word: Column) -> Column:
    n = F.length(word)
    return F.when(n < 2, F.array(word)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(word, i, 2))))


def _bigram(a: Column, b: Column) -> Column:
    x, y = bigrams(a), bigrams(b)
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


MEASURES = {
    "levenshtein": lambda a, b: F.when(F.greatest(F.length(a), F.length(b)) == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))),
    "osa": _of_pairs(_relative(osa)),
    "keyboard": _of_pairs(_relative(keyboard)),
    "jaro": _of_pairs(jaro),
    "jaro_winkler": _of_pairs(jaro_winkler),
    "bigram": _bigram,
    "soundex": lambda a, b: (soundex(a) == soundex(b)).cast("double"),
    "metaphone": lambda a, b: (metaphone(a) == metaphone(b)).cast("double"),
}


def similarity(measure: str, a: Column, b: Column) -> Column:
    if measure not in MEASURES:
        raise ValueError(f"unknown measure {measure!r}; one of {sorted(MEASURES)}")
    return MEASURES[measure](a, b)


def transposed(words: DataFrame, word: str, seed: int) -> DataFrame:
    """(word, typed): two neighbouring letters swapped at a hashed place."""
    p = F.floor(uniform(seed, word) * (F.length(word) - 1)).cast("int")
    w = F.col(word)
    return words.select(w, p.alias("p")).select(word, F.concat(F.substr(w, F.lit(1), F.col("p")), F.substr(w, F.col("p") + 2, F.lit(1)), F.substr(w, F.col("p") + 1, F.lit(1)), F.substr(w, F.col("p") + 3)).alias("typed"))


def corrupt(model: str, word: Column, seed: int) -> Column:
    """One hashed edit of a kind: ``typing`` or ``phonetic``."""
    u = lambda k: uniform(seed, F.lit(k), word)
    n = F.length(word)
    if model == "typing":
        p = F.floor(u("place") * (n - 1)).cast("int")
        c = F.substr(word, p + 1, F.lit(1))
        near = F.element_at(F.create_map(*[F.lit(x) for kv in neighbours(TYPED_STEPS).items() for x in kv]), c)
        head, tail = F.substr(word, F.lit(1), p), F.substr(word, p + 2)
        swap = F.when(near.isNull(), c).otherwise(F.substr(near, F.floor(u("key") * F.length(near)).cast("int") + 1, F.lit(1)))
        kind = F.floor(u("kind") * 4)
        got = F.when(kind == 0, F.concat(head, swap, tail)).when(kind == 1, F.concat(head, F.substr(word, p + 2, F.lit(1)), c, F.substr(word, p + 3))).when(kind == 2, F.concat(head, tail)).otherwise(F.concat(head, c, c, tail))
        return F.when(n < 2, word).otherwise(got)
    if model == "phonetic":
        options = []
        for a, b in PHONETIC:
            for x, y in ((a, b), (b, a)):
                if x:
                    at = F.instr(word, x)
                    made = F.concat(F.substr(word, F.lit(1), at - 1), F.lit(y), F.substr(word, at + len(x)))
                    options.append(F.when((at > 0) & (made != ""), made))
        list_ = F.array_compact(F.array(*options))
        return F.when(F.size(list_) == 0, word).otherwise(F.get(list_, F.floor(u("rule") * F.size(list_)).cast("int")))
    raise ValueError(f"unknown error model {model!r}; one of ['phonetic', 'typing']")


def retrieve(typed: DataFrame, candidates: DataFrame, distance) -> DataFrame:
    """Each changed word's nearest candidates: (word, typed, distance, n of them, correct: it is unique and right)."""
    c = bounded(candidates.select(F.col("word").alias("candidate")).distinct())
    d = typed.where("typed != word").join(c).withColumn("distance", distance(F.col("typed"), F.col("candidate")))
    best = d.groupBy("word", "typed", "distance").agg(F.count("*").alias("n"), F.min("candidate").alias("first"))
    w = W.partitionBy("word", "typed").orderBy("distance")
    return best.withColumn("r", F.row_number().over(w)).where("r = 1").select("word", "typed", "distance", "n", ((F.col("n") == 1) & (F.col("first") == F.col("word"))).alias("correct"))
