"""Every query of the library with SQL of its own is held against that SQL on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from pyspark.sql import functions as F

from textloom.operators import entities, models, statistics
from textloom.plans import catalogue
from textloom.sources import readers

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}/*.parquet'" if os.path.isdir(p) else f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return con


def tidy(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].astype(float).round(8) if df[c].dtype.kind in "iuf" else df[c].map(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), duck.sql(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    pd.testing.assert_frame_equal(tidy(got), tidy(want), check_dtype=False, rtol=0, atol=2e-8)


#: Queries without SQL: here they must only run and give rows without missing numbers; some have their values held by the tests below.
WITHOUT_SQL = sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES))


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_rows(spark, name):
    rows = catalogue.QUERIES[name](spark, SF).toPandas()
    assert len(rows) > 0 or name == "structural_dup_pairs"
    for c in rows.columns:
        if rows[c].dtype.kind == "f":
            assert rows[c].notna().all(), c


def test_compression_distances_by_hand(spark):
    import bz2
    import gzip
    import itertools
    import lzma

    texts = [r["text"].encode() for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(6).collect()]
    few = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "a int, ta string")
    pairs = few.join(few.selectExpr("a as b", "ta as tb"), F.col("a") < F.col("b"))
    sizes = {"gzip": lambda b: len(gzip.compress(b, 9, mtime=0)), "bz2": lambda b: len(bz2.compress(b, 9)), "lzma": lambda b: len(lzma.compress(b, preset=9))}
    for name, f in sizes.items():
        got = {(r["a"], r["b"]): r["ncd"] for r in models.ncd(pairs, name).collect()}
        for i, j in itertools.combinations(range(len(texts)), 2):
            x, y = f(texts[i]), f(texts[j])
            assert got[i, j] == pytest.approx((f(texts[i] + b" " + texts[j]) - min(x, y)) / max(x, y))


def test_random_projection_reaches_the_exact_spectrum(spark):
    rows = catalogue.QUERIES["svd_spectrum"](spark, SF).orderBy("i").collect()
    assert len(rows) == 20
    for r in rows:
        assert r["exact"] * 0.95 <= r["randomised"] <= r["exact"] * (1 + 1e-9)
    assert rows[0]["randomised"] == pytest.approx(rows[0]["exact"], rel=1e-6)


def test_exact_spectrum_is_bounded(spark):
    with pytest.raises(ValueError):
        models.exact_singular_values(spark.createDataFrame([(0, 0, 1.0)], "w long, c long, value double"), 6000)


def test_context_side_of_vectors(spark):
    """Of a symmetric positive matrix both sides agree, so adding the context doubles each vector."""
    import numpy as np

    rng = np.random.default_rng(2)
    half = rng.random((12, 12))
    m = half @ half.T
    w = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(12) for j in range(12)], "w long, c long, value double")
    one = {r["id"]: np.array(r["vec"]) for r in models.word_vectors(w, 12, dims=4).collect()}
    two = {r["id"]: np.array(r["vec"]) for r in models.word_vectors(w, 12, dims=4, context=True).collect()}
    for i in one:
        np.testing.assert_allclose(two[i], 2 * one[i], rtol=1e-6, atol=1e-8)


def test_x_min_scan_by_hand(spark):
    """Every candidate's exponent and distance against sums over the zeta function's own terms."""
    counts = [1] * 60 + [2] * 25 + [3] * 14 + [4] * 9 + [5] * 6 + [7] * 4 + [11] * 3 + [30]
    got = statistics.x_min_scan(spark.createDataFrame([(c,) for c in counts], "cnt long"), least_tail=10).collect()
    assert {r["x_min"] for r in got} >= {1, 2, 3}

    def zeta(s, q):
        n = 20000
        return sum((q + i) ** -s for i in range(n)) + (q + n) ** (1 - s) / (s - 1)

    for r in got:
        tail = [c for c in counts if c >= r["x_min"]]
        gamma = 1 + len(tail) / sum(math.log(c / (r["x_min"] - 0.5)) for c in tail)
        assert r["n_tail"] == len(tail) and r["gamma"] == pytest.approx(gamma)
        whole, worst = zeta(gamma, r["x_min"]), 0.0
        for v in sorted(set(tail)):
            below, upto = sum(c < v for c in tail) / len(tail), sum(c <= v for c in tail) / len(tail)
            worst = max(worst, abs(below - (1 - zeta(gamma, v) / whole)), abs(upto - (1 - zeta(gamma, v + 1) / whole)))
        assert r["ks"] == pytest.approx(worst, abs=1e-4)


def test_boundaries_matched_by_hand(spark):
    found = spark.createDataFrame([(1, 5), (1, 6), (1, 20), (2, 3)], "doc_id int, at int")
    wanted = spark.createDataFrame([(1, 6), (1, 7), (1, 30), (3, 1)], "doc_id int, at int")
    r = entities.matched(found, wanted).first()
    assert (r["tp"], r["fp"], r["fn"]) == (2, 2, 2) and r["f1"] == pytest.approx(0.5)


def test_lexicon_rules(spark):
    lines = lambda *x: spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, value string")
    got = {r["word"]: r["polarity"] for r in readers.lexicon_lists(lines("good", "both", "good"), lines("; no", "bad", "both")).collect()}
    assert got == {"good": 1.0, "bad": -1.0, "both": -1.0}
    assert {r["polarity"] for r in readers.lexicon_scored(lines("a\t0", "b\t0")).collect()} == {0.0}
    got = {r["word"]: r["polarity"] for r in readers.lexicon_scored(lines("a\t1", "a\t-2", "b\t4", "c", "d\tx"), order="i").collect()}
    assert got == {"a": -0.5, "b": 1.0}
