"""Association of word pairs, Zipf and Heaps statistics, and the Hurwitz zeta function."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.tables import cut
from .scan import neighbours

# The even Bernoulli numbers B2 to B14.
BERNOULLI = (1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66, -691 / 2730, 7 / 6)


def bigrams(docs: DataFrame, least: int = 1) -> DataFrame:
    """(w1, w2, a, b, c, d): contingency counts of neighbours inside a document.

    The left margin counts a word in first places, the right margin in second places.
    """
    n = cut(neighbours(docs))
    left = n.groupBy("w1").agg(F.sum("a").alias("l"))
    right = n.groupBy("w2").agg(F.sum("a").alias("r"))
    total = n.agg(F.sum("a").alias("t"))
    got = n.where(F.col("a") >= least).join(left, "w1").join(right, "w2").crossJoin(F.broadcast(total))
    return got.select("w1", "w2", "a", (F.col("l") - F.col("a")).alias("b"), (F.col("r") - F.col("a")).alias("c"), (F.col("t") - F.col("l") - F.col("r") + F.col("a")).alias("d"))


def _cells() -> tuple[list[Column], list[Column], Column]:
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    n = a + b + c + d
    return [a, b, c, d], [(a + b) * (a + c) / n, (a + b) * (b + d) / n, (c + d) * (a + c) / n, (c + d) * (b + d) / n], n


def _llr() -> Column:
    seen, due, _ = _cells()
    out = F.lit(0.0)
    for o, e in zip(seen, due, strict=True):
        out = out + F.when((o > 0) & (e > 0), o * F.log(o / e)).otherwise(0.0)
    return 2 * out


def _chi2() -> Column:
    (a, b, c, d), _, n = _cells()
    under = (a + b) * (c + d) * (a + c) * (b + d)
    return F.when(under == 0, 0.0).otherwise(n * (a * d - b * c) * (a * d - b * c) / F.nullif(under, F.lit(0.0)))


def _pmi() -> Column:
    (a, *_), (e, *_), _ = _cells()
    return F.when(a > 0, F.log2(a / e)).otherwise(F.lit(float("-inf")))


MEASURES = {
    "pmi": _pmi,
    "ppmi": lambda: F.greatest(F.lit(0.0), _pmi()),
    "t": lambda: F.when(F.col("a") > 0, (F.col("a") - _cells()[1][0]) / F.sqrt(F.col("a"))).otherwise(0.0),
    "llr": _llr,
    "chi2": _chi2,
}


def association(measure: str) -> Column:
    """A measure over the columns a, b, c, d."""
    if measure not in MEASURES:
        raise ValueError(f"unknown measure {measure!r}; one of {sorted(MEASURES)}")
    return MEASURES[measure]()


def expected_below(limit: float = 5.0) -> Column:
    return F.least(*_cells()[1]) < limit


def rank_frequency(counts: DataFrame) -> DataFrame:
    """(f, rank): counts of types by descending frequency. Ranks come from a table of counts of counts, never from one sorted task of all types."""
    n = counts.groupBy(F.col("cnt").alias("f")).agg(F.count("*").alias("types"))
    w = W.orderBy(F.col("f").desc()).rowsBetween(W.unboundedPreceding, -1)
    before = n.withColumn("before", F.coalesce(F.sum("types").over(w), F.lit(0)))
    return before.select(F.col("f").cast("double").alias("f"), F.explode(F.sequence(F.col("before") + 1, F.col("before") + F.col("types"))).alias("rank"))


def _slope(points: DataFrame, name: str) -> DataFrame:
    got = points.agg((-F.regr_slope("y", "x")).alias("a"), F.count("*").alias("n_used"))
    return got.select(F.lit(name).alias("estimator"), F.when(F.col("n_used") >= 10, F.col("a")).alias("a"), "n_used")


def zipf_ols(counts: DataFrame, head: int | None = None, name: str = "ols") -> DataFrame:
    """Exponent by least squares of ln f on ln rank; null below ten points."""
    points = rank_frequency(counts).where(F.lit(True) if head is None else F.col("rank") <= head)
    return _slope(points.select(F.log("rank").alias("x"), F.log("f").alias("y")), name)


def zipf_binned(counts: DataFrame, per_decade: int = 10) -> DataFrame:
    """As ``zipf_ols`` over means of ln rank and ln f in logarithmic bins of ranks."""
    points = rank_frequency(counts).select(F.log("rank").alias("x"), F.log("f").alias("y"), F.floor(F.log10("rank") * per_decade + 1e-9).alias("bin"))
    return _slope(points.groupBy("bin").agg(F.avg("x").alias("x"), F.avg("y").alias("y")), "binned")


def zipf_split_half(tok_u: DataFrame) -> DataFrame:
    """tok_u: (token, u). Rank from one random half of the occurrences, frequency from the other."""
    n = tok_u.groupBy("token").agg(F.count_if(F.col("u") < 0.5).alias("fa"), F.count_if(F.col("u") >= 0.5).alias("fb"))
    a = n.where("fa > 0")
    per = a.groupBy("fa").agg(F.count("*").alias("types"))
    before = per.withColumn("before", F.coalesce(F.sum("types").over(W.orderBy(F.col("fa").desc()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(W.partitionBy("fa").orderBy("token"))
    points = a.withColumn("place", place).join(F.broadcast(before.select("fa", "before")), "fa").where("fb > 0")
    return _slope(points.select(F.log(F.col("before") + F.col("place")).alias("x"), F.log("fb").alias("y")), "split half")


def mle_gamma(counts: DataFrame, x_min: int = 1) -> DataFrame:
    """(gamma, a, n_used): the discrete approximation 1 + n / sum ln(x / (x_min - 1/2)); a is infinite for gamma <= 1."""
    t = counts.where(F.col("cnt") >= x_min)
    g = t.agg((1 + F.count("*") / F.sum(F.log(F.col("cnt") / (x_min - 0.5)))).alias("gamma"), F.count("*").alias("n_used"))
    return g.select("gamma", F.when(F.col("gamma") > 1, 1 / (F.col("gamma") - 1)).otherwise(float("inf")).alias("a"), "n_used")


def zeta(s: Column, q: Column, terms: int = 24, corrections: int = 6) -> Column:
    """The Hurwitz zeta function by the Euler-Maclaurin formula; null for s <= 1 or q <= 0."""
    direct = F.aggregate(F.sequence(F.lit(0), F.lit(terms - 1)), F.lit(0.0), lambda a, n: a + F.pow(q + n, -s))
    edge = q + terms
    out = direct + F.pow(edge, 1 - s) / (s - 1) + 0.5 * F.pow(edge, -s)
    rising = s
    for k in range(1, corrections + 1):
        if k > 1:
            rising = rising * (s + (2 * k - 3)) * (s + (2 * k - 2))
        out = out + BERNOULLI[k - 1] / math.factorial(2 * k) * rising * F.pow(edge, -s - 2 * k + 1)
    return F.when((s > 1) & (q > 0), out)


def x_min_scan(counts: DataFrame, least_tail: int = 50, most: int = 400) -> DataFrame:
    """Candidates (x_min, gamma, n_tail, ks) of a discrete power law, over distinct counts.

    The table of counts of counts is tiny; at most ``most`` candidates, log-spaced, are
    scanned. KS compares both sides of each step.
    """
    v = counts.groupBy(F.col("cnt").alias("x")).agg(F.count("*").alias("n"))
    down = W.orderBy(F.col("x").desc())
    tail = v.withColumn("n_tail", F.sum("n").over(down)).where(F.col("n_tail") >= least_tail)
    i = F.row_number().over(W.orderBy("x"))
    step = F.floor(F.log(i) * (most / 8.0))
    numbered = tail.withColumn("i", i).withColumn("slot", step)
    picks = numbered.withColumn("r", F.row_number().over(W.partitionBy("slot").orderBy("x"))).where("r = 1").select(F.col("x").alias("x_min"), "n_tail")
    pairs = F.broadcast(picks).join(v, F.col("x") >= F.col("x_min"))
    g = pairs.groupBy("x_min", "n_tail").agg((1 + F.first("n_tail") / F.sum(F.col("n") * F.log(F.col("x") / (F.col("x_min") - 0.5)))).alias("gamma")).where("gamma > 1")
    up = W.partitionBy("x_min").orderBy("x")
    run = F.broadcast(g).join(v, F.col("x") >= F.col("x_min")).withColumn("cum", F.sum("n").over(up) / F.col("n_tail"))
    run = run.withColumn("left", F.coalesce(F.lag("cum").over(up), F.lit(0.0)))
    whole = zeta(F.col("gamma"), F.col("x_min").cast("double"))
    cdf = lambda x: 1 - zeta(F.col("gamma"), x.cast("double")) / whole
    ks = F.greatest(F.abs(F.col("cum") - cdf(F.col("x") + 1)), F.abs(F.col("left") - cdf(F.col("x"))))
    return run.withColumn("ks", ks).groupBy("x_min", "gamma", "n_tail").agg(F.max("ks").alias("ks"))


def goodness_of_fit(counts: DataFrame, refits: int = 100, seed: int = 3) -> DataFrame:
    """One row (x_min, gamma, ks, p, plausible): share of semi-parametric resamples that fit as badly.

    Each resample is a task of its own; it draws the body from the observed counts below
    x_min and the tail from the fitted law, and searches x_min again. The counts of counts
    are the only thing sent to the tasks.
    """
    import numpy as np
    import pandas as pd

    table = counts.groupBy("cnt").agg(F.count("*").alias("n")).orderBy("cnt").collect()  # distinct counts only
    xs, ns = np.array([r["cnt"] for r in table], float), np.array([r["n"] for r in table], int)
    observed, x0, gamma = fit_ks(xs, ns)  # the same candidates for the data and for each resample
    if not math.isfinite(observed):
        raise ValueError("too few types to fit a power law")

    def run(frames):
        for f in frames:
            out = []
            for b in f["id"]:
                rng = np.random.default_rng([seed, int(b)])
                total = int(ns.sum())
                below = xs < x0
                k = rng.binomial(total, ns[~below].sum() / total)
                body = rng.choice(xs[below], total - k, p=ns[below] / ns[below].sum()) if below.any() and total > k else np.zeros(0)
                tail = np.floor((x0 - 0.5) * (1 - rng.random(k)) ** (-1 / (gamma - 1)) + 0.5)
                out.append(fit_ks(*np.unique(np.concatenate((body, tail)), return_counts=True))[0])
            yield pd.DataFrame({"ks": out})

    sims = counts.sparkSession.range(refits, numPartitions=min(refits, 32)).mapInPandas(run, "ks double")
    got = sims.agg(F.avg((F.col("ks") >= observed).cast("double")).alias("p"))
    return got.select(F.lit(int(x0)).alias("x_min"), F.lit(float(gamma)).alias("gamma"), F.lit(float(observed)).alias("ks"), "p", (F.col("p") >= 0.1).alias("plausible"))


def fit_ks(x, n, least_tail: int = 50, most: int = 400) -> tuple[float, float, float]:
    """(ks, x_min, gamma) with the least KS distance over candidates for x_min, of values x that occur n times (NumPy)."""
    import numpy as np

    tails = n[::-1].cumsum()[::-1]
    at = np.flatnonzero(tails >= least_tail)
    at = np.unique(at[np.unique(np.geomspace(1, len(at), min(most, len(at))).astype(int)) - 1]) if len(at) else at
    best = (math.inf, math.nan, math.nan)
    for i in at:
        v, m, t = x[i:], n[i:], tails[i]
        g = 1 + t / (m * np.log(v / (x[i] - 0.5))).sum()
        if g <= 1:
            continue
        z = _zeta(g, np.concatenate((v, v + 1)))
        z0 = _zeta(g, np.array([x[i]]))[0]
        cum = m.cumsum() / t
        lo, hi = 1 - z[: len(v)] / z0, 1 - z[len(v) :] / z0
        ks = max(np.abs(cum - hi).max(), np.abs(np.concatenate(([0.0], cum[:-1])) - lo).max())
        best = min(best, (float(ks), float(x[i]), float(g)))
    return best


def _zeta(s: float, q):
    import numpy as np

    edge = q + 24.0
    out = ((q[:, None] + np.arange(24.0)) ** -s).sum(1) + edge ** (1 - s) / (s - 1) + 0.5 * edge**-s
    rising = s
    for k in range(1, 7):
        if k > 1:
            rising *= (s + 2 * k - 3) * (s + 2 * k - 2)
        out += BERNOULLI[k - 1] / math.factorial(2 * k) * rising * edge ** (-s - 2 * k + 1)
    return out


def first_places(tok: DataFrame, offsets: DataFrame, key: str = "doc_id") -> DataFrame:
    """(token, first): where each type occurs first, counted from 1 over documents in id order.

    offsets: (key, before): tokens before the document.
    """
    return tok.join(offsets, key).groupBy("token").agg(F.min(F.col("before") + F.col("pos") + 1).alias("first"))


def running_offsets(sizes: DataFrame, key: str = "doc_id", bins: int = 1024) -> DataFrame:
    """(key, before) of documents in id order: sums of ranges of ids, cumulated, then sums inside a range."""
    ends = sizes.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    if ends["lo"] is None:
        return sizes.select(key, F.lit(0).cast("long").alias("before"))
    width = max(1, -(-(ends["hi"] - ends["lo"] + 1) // bins))
    got = sizes.withColumn("bin", F.floor((F.col(key) - ends["lo"]) / width))
    tops = got.groupBy("bin").agg(F.sum("len").alias("whole"))
    tops = tops.select("bin", (F.sum("whole").over(W.orderBy("bin")) - F.col("whole")).alias("start"))
    own = W.partitionBy("bin").orderBy(key).rowsBetween(W.unboundedPreceding, W.currentRow)
    return got.join(F.broadcast(tops), "bin").select(key, (F.col("start") + F.sum("len").over(own) - F.col("len")).alias("before"))


def heaps_curve(first: DataFrame, total: int, points: int = 60) -> DataFrame:
    """(n, types) at log-spaced prefixes: types are binned by the first prefix that holds them, then cumulated."""
    if total < 1:
        raise ValueError("an empty stream has no curve")
    marks = sorted({max(1, round(math.exp(math.log(total) * i / (points - 1)))) for i in range(points)})
    edges = F.array(*[F.lit(m).cast("long") for m in marks])
    per = first.select(F.get(F.filter(edges, lambda m: m >= F.col("first")), F.lit(0)).alias("n")).groupBy("n").agg(F.count("*").alias("new"))
    all_ = first.sparkSession.createDataFrame([(m,) for m in marks], "n long").join(F.broadcast(per), "n", "left")
    return all_.select("n", F.sum(F.coalesce("new", F.lit(0))).over(W.orderBy("n")).alias("types"))


def heaps_fit(curve: DataFrame) -> DataFrame:
    """(beta, k, r2) of types = k * n ** beta."""
    x, y = F.log("n"), F.log("types")
    return curve.agg(F.regr_slope(y, x).alias("beta"), F.exp(F.regr_intercept(y, x)).alias("k"), F.regr_r2(y, x).alias("r2"))


def heaps_drift(curve: DataFrame, window: int = 12, step: int = 4) -> DataFrame:
    """(start, beta) in sliding windows of points."""
    p = curve.withColumn("i", F.row_number().over(W.orderBy("n")) - 1)
    starts = F.sequence(F.greatest(F.lit(0), F.ceil((F.col("i") - window + 1) / step) * step).cast("int"), F.col("i").cast("int"))
    rows = p.withColumn("start", F.explode(F.filter(starts, lambda s: s % step == 0)))
    got = rows.groupBy("start").agg(F.regr_slope(F.log("types"), F.log("n")).alias("beta"), F.count("*").alias("m"))
    return got.where(F.col("m") == window).select("start", "beta")
