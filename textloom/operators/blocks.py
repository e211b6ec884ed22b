"""Exact top k of dot products: blocks of vectors are multiplied as matrices, and only the best k of a query leave a task.

Matrix products in single precision find the candidates, with a margin for their error; candidates are
scored again in double precision, dimension after dimension, and ranked by the score rounded to nine
places, then by key. No task holds more than one group of queries and one of items.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a packed block, of a group of queries, and of a group of items; tiles of a product.
PACKED, QUERIES, ITEMS = 2048, 16_384, 65_536
TILE_Q, TILE_D, KEPT = 1024, 8192, 1_000_000
PLACES = 9


def rounded_keys(x):
    """Whole numbers that order doubles as their value rounded half up to nine places does; not for NaN or infinity."""
    import numpy as np

    y = x * 10.0**PLACES
    out = np.floor(y + 0.5)
    for i in np.flatnonzero(np.abs(y - np.floor(y) - 0.5) < 1e-3):
        out.flat[i] = float(Decimal(repr(float(x.flat[i]))).scaleb(PLACES).to_integral_value(ROUND_HALF_UP))
    return out


def first_k(group, score, key, k: int):
    """Indices of the k best of each group, by rounded score, then key; groups are whole numbers."""
    import numpy as np

    order = np.lexsort((key, -rounded_keys(score), group))
    g = group[order]
    starts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.zeros(0, int)
    rank = np.arange(len(g)) - np.repeat(starts, np.diff(np.append(starts, len(g))))
    return order[rank < k]


def scored(a, b):
    """Dot products of rows, summed in the order of the dimensions."""
    import numpy as np

    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def units(x):
    """Rows over their lengths; a zero row stays."""
    import numpy as np

    n = np.maximum(np.sqrt(scored(x, x)), 1e-10)
    return x / n[:, None]


def best_of(qi, qv, di, dv, k: int, apart: bool):
    """(query's index, item's index, score): the k best items of each query; with ``apart`` those of other ids only."""
    import numpy as np

    d32, found = dv.astype("f4"), []
    largest = float(np.sqrt((dv * dv).sum(1).max())) if len(dv) else 0.0
    for a in range(0, len(qi), TILE_Q):
        ids, vecs = qi[a : a + TILE_Q], qv[a : a + TILE_Q]
        q32 = vecs.astype("f4")
        margin = (4 * vecs.shape[1] + 8) * 6e-8 * np.sqrt((vecs * vecs).sum(1)) * largest + 4e-9
        least = np.full(len(ids), -np.inf, "f4")
        kept = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
        loose, n = [], 0

        def settle():
            """Scores what was found since, keeps each query's best, and raises what is asked of later ones."""
            r, c = (np.concatenate([x[i] for x in loose]) for i in (0, 1))
            s = np.concatenate([scored(vecs[r[i : i + 100_000]], dv[c[i : i + 100_000]]) for i in range(0, len(r), 100_000)] or [np.zeros(0)])
            r, c, s = (np.concatenate(x) for x in zip(kept[0], (r, c, s), strict=True))
            at = first_k(r, s, di[c], k)
            kept[0] = (r[at], c[at], s[at])
            full = np.bincount(r[at], minlength=len(ids)) >= k
            low = np.full(len(ids), np.inf)
            np.minimum.at(low, r[at], s[at])
            return np.where(full, np.maximum(least, low - margin), least).astype("f4")

        for b in range(0, len(di), TILE_D):
            s = q32 @ d32[b : b + TILE_D].T
            if apart:
                same = np.flatnonzero(np.isin(di[b : b + TILE_D], ids))
                if len(same):
                    s[:, same] = np.where(ids[:, None] == di[b + same][None, :], -np.inf, s[:, same])
            if b == 0 and s.shape[1] >= k:
                least = np.partition(s, -k, axis=1)[:, -k] - margin.astype("f4")
            r, c = np.nonzero(s >= least[:, None])
            if apart:
                ok = s[r, c] > -np.inf
                r, c = r[ok], c[ok]
            loose.append((r, c + b))
            n += len(r)
            if n > KEPT:
                least, loose, n = settle(), [], 0
        if loose:
            settle()
        r, c, s = kept[0]
        found.append((r + a, c, s))
    return tuple(np.concatenate([x[i] for x in found]) for i in range(3)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _packed(df: DataFrame, key: str, vector: str, dims: int, unit: bool) -> DataFrame:
    """(n, ids, vecs): up to ``PACKED`` rows of a partition as one, in double precision."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def block(ids, vecs):
            v = np.concatenate(vecs)
            return pa.RecordBatch.from_arrays([pa.array([len(v)], pa.int64()), pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([(units(v) if unit else v).tobytes()], pa.binary())], names=["n", "ids", "vecs"])

        ids, vecs, n = [], [], 0
        for b in batches:
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(-1, dims)
            k = b.column(0).to_numpy(zero_copy_only=False)
            for a in range(0, len(v), PACKED):
                ids.append(k[a : a + PACKED])
                vecs.append(v[a : a + PACKED])
                n += len(vecs[-1])
                if n >= PACKED:
                    yield block(ids, vecs)
                    ids, vecs, n = [], [], 0
        if n:
            yield block(ids, vecs)

    return df.select(F.col(key).cast("long").alias("k"), F.col(vector).alias("v")).mapInArrow(run, "n long, ids binary, vecs binary")


def _groups(rows: int, most: int) -> int:
    return max(1, -(-rows // most))


def top_dots(queries: DataFrame, items: DataFrame, k: int, qid: str, key: str, qv: str, dv: str, apart: bool = False, unit: bool = False) -> DataFrame:
    """(qid, key, score): of each query the k items of the largest dot product, or more of them; ids are whole numbers.

    Rows whose vector is null, of another length or not finite are compared one by one, by an expression.
    """
    from .vectors import dot
    from .vectors import unit as units_of

    spark = items.sparkSession
    dims = items.agg(F.max(F.size(dv)).alias("n")).first()["n"]
    finite = lambda v: F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e150))
    plain = lambda v: F.coalesce((F.size(v) == F.lit(dims or 0)) & finite(F.col(v)) & F.lit((dims or 0) > 0), F.lit(False))
    q, d = queries.select(F.col(qid).alias("q"), F.col(qv).alias("v")), items.select(F.col(key).alias("i"), F.col(dv).alias("w"))
    q, d = q.withColumn("fine", plain("v") & F.col("q").isNotNull()), d.withColumn("fine", plain("w") & F.col("i").isNotNull())
    nq, nd = (x.agg(F.count_if("fine").alias("fine"), F.count_if(~F.col("fine")).alias("odd")).first() for x in (q, d))
    per_q, per_d, tasks = QUERIES, ITEMS, 4 * spark.sparkContext.defaultParallelism
    while _groups(nq["fine"], per_q) * _groups(nd["fine"], per_d) < tasks and max(per_q, per_d) > 1024:
        per_q, per_d = (per_q, per_d // 2) if per_d >= per_q else (per_q // 2, per_d)
    many_q, many_d = _groups(nq["fine"], per_q), _groups(nd["fine"], per_d)
    own = lambda df, n: F.pmod(F.xxhash64("ids"), F.lit(n)).cast("int")
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = _packed(q.where("fine"), "q", "v", dims or 1, unit).withColumn("g", own(q, many_q)).select("g", all_(many_d).alias("h"), F.lit(True).alias("asks"), "ids", "vecs")
    right = _packed(d.where("fine"), "i", "w", dims or 1, unit).withColumn("h", own(d, many_d)).select(all_(many_q).alias("g"), "h", F.lit(False).alias("asks"), "ids", "vecs")

    def run(table):
        import numpy as np
        import pyarrow as pa

        asks = table.column("asks").to_pylist()
        side = lambda want, column, kind: np.concatenate([np.zeros(0, kind), *[np.frombuffer(x.as_buffer(), kind) for x, y in zip(table.column(column), asks, strict=True) if y is want]])
        qi, di = side(True, "ids", "i8"), side(False, "ids", "i8")
        a, b, s = best_of(qi, side(True, "vecs", "f8").reshape(len(qi), -1), di, side(False, "vecs", "f8").reshape(len(di), -1), k, apart) if len(qi) and len(di) else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return pa.table([pa.array(qi[a]), pa.array(di[b]), pa.array(s)], names=["q", "i", "score"])

    got = left.unionByName(right).groupBy("g", "h").applyInArrow(run, "q long, i long, score double")
    if nq["odd"] or nd["odd"]:
        one = lambda df, v: (units_of(df, v, "u") if unit else df.withColumn("u", F.col(v))).drop(v)
        x, y = one(q, "v").withColumnsRenamed({"fine": "qf", "u": "uq"}), one(d, "w").withColumnsRenamed({"fine": "df", "u": "ud"})
        cond: Column = ~(F.col("qf") & F.col("df"))
        pairs = x.join(y.where("not df"), cond & (F.col("q") != F.col("i")) if apart else cond).unionByName(x.where("not qf").join(y.where("df"), (F.col("q") != F.col("i")) if apart else F.lit(True)))
        got = got.unionByName(pairs.select(F.col("q").cast("long").alias("q"), F.col("i").cast("long").alias("i"), dot(F.col("uq"), F.col("ud")).alias("score")))
    kinds = {**dict(queries.select(F.col(qid).alias("q")).dtypes), **dict(items.select(F.col(key).alias("i")).dtypes)}
    return got.select(F.col("q").cast(kinds["q"]).alias(qid), F.col("i").cast(kinds["i"]).alias(key), "score")
