"""Duplicate detection among texts by hashes, MinHash signatures and banding.

The signature's 128 linear hashes modulo 2**31 - 1 have coefficients from hashes of a seed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rng import uniform
from .scan import TABLE, lowered

PRIME = 2147483647
BANDS, ROWS, MOST = 32, 4, 200
NEAR = 0.8


def coefficients(n: int = BANDS * ROWS, seed: int = 1) -> list[tuple[int, int]]:
    """Pairs (a >= 1, b >= 0) below the prime, by MD5: the same numbers as ``coefficient_sql``."""
    import hashlib

    h = lambda k, i: int(hashlib.md5(f"{seed}:{k}:{i}".encode()).hexdigest()[:8], 16)
    return [(1 + h("a", i) % (PRIME - 1), h("b", i) % PRIME) for i in range(n)]


def coefficient_sql(kind: str, i: str, seed: int = 1) -> str:
    h = f"(('0x' || substr(md5('{seed}:{kind}:' || {i}), 1, 8))::BIGINT)"
    return f"(1 + {h} % {PRIME - 1})" if kind == "a" else f"({h} % {PRIME})"


def shingle_sets(docs: DataFrame, key: str = "doc_id", column: str = "text", k: int = 5) -> DataFrame:
    """(key, s: array of distinct 31-bit hashes of k-token shingles), as ``text.shingles`` has them, in order of their first places."""
    kind = dict(docs.select(key).dtypes)[key]

    def run(batches):
        from hashlib import md5

        import pyarrow as pa

        for b in batches:
            keys, sets = [], []
            for row, t in enumerate(b.column(1)):
                w = t.as_py().translate(TABLE).split()
                runs = [b" ".join(w)] if 0 < len(w) < k else dict.fromkeys(b" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
                keys.append(row)
                sets.append(list(dict.fromkeys(int.from_bytes(md5(r).digest()[:4]) % PRIME for r in runs)))
                if len(keys) >= 500:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keys)), pa.array(sets, pa.list_(pa.int64()))], names=[key, "s"])
                    keys, sets = [], []
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keys, pa.int64())), pa.array(sets, pa.list_(pa.int64()))], names=[key, "s"])

    return lowered(docs, key, column=column).mapInArrow(run, f"`{key}` {kind}, s array<bigint>")


def signature(s: Column, n: int = BANDS * ROWS, seed: int = 1) -> Column:
    """The least of each linear hash over the set; all primes for an empty set."""
    one = lambda a, b: F.coalesce(F.array_min(F.transform(s, lambda x: (x * F.lit(a) + F.lit(b)) % PRIME)), F.lit(PRIME).cast("long"))
    return F.array(*[one(a, b) for a, b in coefficients(n, seed)])


def signatures(sets: DataFrame, key: str = "doc_id", n: int = BANDS * ROWS, seed: int = 1) -> DataFrame:
    """(key, n_shingles, sig), as ``signature`` has it: all hashes of a set at once."""
    kind, ab = dict(sets.select(key).dtypes)[key], coefficients(n, seed)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        a, c = (np.array([x[i] for x in ab], "i8") for i in (0, 1))
        for b in batches:
            sizes, sigs = [], []
            for x in b.column(1):
                s, least = x.values.to_numpy(zero_copy_only=False) if x.is_valid else (), np.full(n, PRIME, "i8")
                for i in range(0, len(s), 1000):
                    y = s[i : i + 1000, None] * a + c
                    for _ in range(2):  # 2 ** 31 leaves 1
                        y = (y & PRIME) + (y >> 31)
                    y[y >= PRIME] -= PRIME
                    np.minimum(least, y.min(0), out=least)
                sizes.append(len(s))
                sigs.append(least)
            flat = pa.array(np.concatenate(sigs) if sigs else np.zeros(0, "i8"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(0, n * len(sizes) + 1, n), pa.int32()), flat)], names=[key, "n_shingles", "sig"])

    return sets.select(key, "s").mapInArrow(run, f"`{key}` {kind}, n_shingles bigint, sig array<bigint>")


def agreement(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a == b).cast("int")), F.lit(0), lambda acc, v: acc + v) / F.size(x)


def jaccard(x: Column, y: Column) -> Column:
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def band_rows(sigs: DataFrame, key: str = "doc_id", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(key, band, bucket) of the non-empty sets."""
    s = F.col("sig")
    return sigs.where("n_shingles > 0").select(key, F.posexplode(F.array(*[F.md5(F.concat_ws(",", *[F.get(s, b * rows + r).cast("string") for r in range(rows)])) for b in range(bands)])).alias("band", "bucket"))


def candidates(sigs: DataFrame, key: str = "doc_id", bands: int = BANDS, rows: int = ROWS, most: int = MOST) -> DataFrame:
    """(a, b), a < b: pairs that share a band's bucket, buckets of more than ``most`` members excepted.

    The exception is the operator's own definition; for every link whatever a bucket's size
    see the training-data subpackage.
    """
    rows_ = band_rows(sigs, key, bands, rows)
    ok = rows_.groupBy("band", "bucket").agg(F.count("*").alias("c")).where((F.col("c") > 1) & (F.col("c") <= most)).drop("c")
    rows_ = rows_.join(ok, ["band", "bucket"])
    other = rows_.withColumnRenamed(key, "b")
    return rows_.withColumnRenamed(key, "a").join(other, ["band", "bucket"]).where("a < b").select("a", "b").distinct()


def verified(pairs: DataFrame, sets: DataFrame, key: str = "doc_id", least: float = NEAR) -> DataFrame:
    """(a, b, jaccard) of the pairs whose full sets are similar enough."""
    x, y = sets.select(F.col(key).alias("a"), F.col("s").alias("sa")), sets.select(F.col(key).alias("b"), F.col("s").alias("sb"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", jaccard(F.col("sa"), F.col("sb")).alias("jaccard")).where(F.col("jaccard") >= least)


def same_form(docs: DataFrame, form, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(a, b), a < b: all pairs with one normal form."""
    x = docs.select(F.col(key).alias("a"), F.md5(form(F.col(column))).alias("h")).where("h is not null")
    twice = x.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
    x = x.join(twice, "h")
    return x.join(x.withColumnRenamed("a", "b"), "h").where("a < b").select("a", "b")


def sampled_pairs(docs: DataFrame, n: int = 400, seed: int = 4, key: str = "doc_id") -> DataFrame:
    """(a, b), a < b: n random pairs of distinct rows; fewer where there are not 2 * n rows. The 2 * n first rows by hash are paired in that order."""
    first = docs.select(key).orderBy(uniform(seed, key), key).limit(2 * n)  # 2 * n ids, a parameter
    at = first.withColumn("r", F.row_number().over(W.orderBy(uniform(seed, key), key)) - 1)
    return at.groupBy(F.floor(F.col("r") / 2)).agg(F.min(key).alias("a"), F.max(key).alias("b")).where("a < b").select("a", "b")
