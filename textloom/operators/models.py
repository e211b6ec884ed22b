"""Classifiers over term counts, co-occurrence weights, topics, senses and compression distances."""

from __future__ import annotations

import bz2
import gzip
import lzma

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rng import uniform
from ..plans.tables import bounded, cut, spread


def naive_bayes(train: DataFrame, test: DataFrame, alpha: float = 1.0, key: str = "doc_id", vocabulary: int | None = None) -> DataFrame:
    """train: (key, token, tf, label); test: (key, token, tf). (key, predicted): multinomial, ties to the smallest label.

    Tokens that no training text has are left out. Only classes that have a token are joined
    with it: a class without it gets alpha through the sum over all known tokens. Every test
    document with at least one known token is predicted.
    """
    counts = train.groupBy("label", "token").agg(F.sum("tf").alias("c"))
    types = counts.select("token").distinct()
    size = F.lit(float(vocabulary if vocabulary is not None else types.count()))
    docs = train.select(key, "label").distinct().groupBy("label").agg(F.count("*").alias("nd"))
    per = counts.groupBy("label").agg(F.sum("c").alias("nc")).join(docs, "label")
    all_ = docs.agg(F.sum("nd").alias("all"))
    per = per.crossJoin(F.broadcast(all_)).select("label", F.log(F.col("nd") / F.col("all")).alias("prior"), F.log(F.col("nc") + alpha * size).alias("under"))
    known = test.join(types, "token").withColumn("tf", F.col("tf").cast("double"))
    total = known.groupBy(key).agg(F.sum("tf").alias("n"))
    extra = known.join(counts, "token").groupBy(key, "label").agg(F.sum(F.col("tf") * (F.log(F.col("c") + alpha) - F.log(F.lit(alpha)))).alias("extra"))
    s = total.crossJoin(bounded(per, 100_000)).join(extra, [key, "label"], "left")  # classes are crossed with documents
    s = s.withColumn("score", F.col("prior") + F.coalesce("extra", F.lit(0.0)) + F.col("n") * (F.log(F.lit(alpha)) - F.col("under")))
    w = W.partitionBy(key).orderBy(F.round("score", 9).desc(), "label")
    return s.withColumn("r", F.row_number().over(w)).where("r = 1").select(key, F.col("label").alias("predicted"))


def nearest_centroid(train: DataFrame, test: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, predicted) by cosine with class means of ln(1 + tf) * ln(N / df), idf from the training texts."""
    n = train.select(key).distinct().count()
    idf = train.groupBy("token").agg(F.log(F.lit(float(n)) / F.count("*")).alias("idf"))
    size = train.select(key, "label").distinct().groupBy("label").agg(F.count("*").alias("size"))
    w = F.log(1 + F.col("tf")) * F.col("idf")
    mean = train.join(idf, "token").groupBy("label", "token").agg(F.sum(w).alias("s")).join(F.broadcast(size), "label").select("label", "token", (F.col("s") / F.col("size")).alias("m"))
    norm = mean.groupBy("label").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"))
    dots = test.join(idf, "token").select(key, "token", w.alias("x")).join(mean, "token").groupBy(key, "label").agg(F.sum(F.col("x") * F.col("m")).alias("dot")).join(F.broadcast(norm), "label").where("norm > 0")
    by = W.partitionBy(key).orderBy(F.round(F.col("dot") / F.col("norm"), 9).desc(), "label")
    return dots.withColumn("r", F.row_number().over(by)).where("r = 1").select(key, F.col("label").alias("predicted"))


def burrows_delta(train: DataFrame, test: DataFrame, features: list[str], key: str = "doc_id") -> DataFrame:
    """(key, predicted): least mean absolute difference of z-scored relative frequencies to class means."""
    fs = F.explode(F.array(*[F.lit(f) for f in features]))

    def dense(df: DataFrame, extra: list[str]) -> DataFrame:
        known = df.where(F.col("token").isin(features))
        total = df.select(key, *extra).distinct().join(known.groupBy(key).agg(F.sum("tf").alias("n")), key, "left")
        grid = total.withColumn("token", fs)
        return grid.join(known.select(key, "token", "tf"), [key, "token"], "left").select(key, *extra, "token", F.coalesce(F.col("tf") / F.col("n"), F.lit(0.0)).alias("f"))

    a, b = dense(train, ["label"]), dense(test, [])
    stats = F.broadcast(a.groupBy("token").agg(F.avg("f").alias("mu"), F.stddev_pop("f").alias("sd")))
    z = (F.col("f") - F.col("mu")) / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)
    mean = a.join(stats, "token").groupBy("label", "token").agg(F.avg(z).alias("m"))
    d = b.join(stats, "token").select(key, "token", z.alias("z")).join(bounded(mean), "token").groupBy(key, "label").agg(F.avg(F.abs(F.col("z") - F.col("m"))).alias("delta"))
    w = W.partitionBy(key).orderBy(F.round("delta", 9), "label")
    return d.withColumn("r", F.row_number().over(w)).where("r = 1").select(key, F.col("label").alias("predicted"))


#: Places of a text that gram order tells apart, and characters of texts whose grams a task counts at once.
PLACES = 10**9
CHARS = 4_000_000


def _grams_of(s: str, seen: dict[str, list[int]], longest: int) -> None:
    """Adds the n-grams of a padded text: how often, and by n, then place, where first."""
    for n in range(1, longest + 1):
        for i in range(len(s) - n + 1):
            g = seen.get(s[i : i + n])
            if g is None:
                seen[s[i : i + n]] = [1, n * PLACES + i + 1]
            else:
                g[0] += 1
                if n * PLACES + i + 1 < g[1]:
                    g[1] = n * PLACES + i + 1


def _gram_table(texts: list[str], longest: int):
    """(grams, counts, first places) of padded texts: each n-gram gets a number from that of its first n - 1 characters and its last one."""
    import numpy as np

    joined = "".join(texts)
    sizes = np.array([len(t) for t in texts])
    own = np.repeat(np.arange(len(texts), dtype="i4"), sizes)
    place = (np.arange(len(joined)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype("i4")
    letters, char = np.unique(np.frombuffer(joined.encode("utf-32-le"), "u4"), return_inverse=True)
    number, at, grams, counts, firsts = np.zeros(len(joined), "i8"), np.arange(len(joined)), [], [], []
    for n in range(1, longest + 1):
        at = at[(at + n <= len(joined))]
        at = at[own[at] == own[at + n - 1]]
        code = number[at] * len(letters) + char[at + n - 1]
        if not len(code):
            break
        most = int(code.max()) + 1
        if most <= max(1 << 24, 2 * len(code)):  # a table of all numbers, else a sort
            seen = np.flatnonzero(np.bincount(code, minlength=most))
            table = np.empty(most, "i4")
            table[seen] = np.arange(len(seen), dtype="i4")
            ids = table[code]
        else:
            seen, ids = np.unique(code, return_inverse=True)
        number[at] = ids
        count, first, where = np.bincount(ids, minlength=len(seen)), np.full(len(seen), np.iinfo("i4").max, "i4"), np.empty(len(seen), "i8")
        np.minimum.at(first, ids, place[at])
        where[ids] = at
        grams += [joined[i : i + n] for i in where.tolist()]
        counts.append(count)
        firsts.append(first.astype("i8") + n * PLACES + 1)
    return grams, np.concatenate(counts), np.concatenate(firsts)


def counted_grams(docs: DataFrame, by: list[str], column: str = "text", longest: int = 5) -> DataFrame:
    """(by..., gram, cnt, first): character n-grams of the texts padded with an underscore on either side.

    ``first`` orders by n, then place; the least of all texts counts. Grams are counted before they
    become rows: an exploded row for each would be ``longest`` times the text's length. A task holds
    ``CHARS`` characters of texts at a time, and hands their grams on in slices.
    """
    kinds = dict(docs.select(*by).dtypes)

    def run(batches):
        import pyarrow as pa

        schema: list = []

        def rows(held):
            for key, texts in held.items():
                grams, counts, firsts = _gram_table(texts, longest)
                for a in range(0, len(grams), 50_000):
                    part = grams[a : a + 50_000]
                    cols = [*([k] * len(part) for k in key), part, counts[a : a + 50_000], firsts[a : a + 50_000]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, schema, strict=True)], names=[*by, "gram", "cnt", "first"])

        held: dict[tuple, list[str]] = {}
        n = 0
        for b in batches:
            schema = [*(b.schema.field(k).type for k in range(len(by))), pa.string(), pa.int64(), pa.int64()]
            for row in range(b.num_rows):
                *key, t = (b.column(k)[row].as_py() for k in range(len(by) + 1))
                held.setdefault(tuple(key), []).append(f"_{t or ''}_")
                n += len(t or "") + 2
                if n > CHARS:
                    yield from rows(held)
                    held, n = {}, 0
        yield from rows(held)

    got = docs.select(*by, column).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "gram string, cnt long, first long"]))
    return got.groupBy(*by, "gram").agg(F.sum("cnt").alias("cnt"), F.min("first").alias("first"))


def opened_grams(docs: DataFrame, key: str, lengths: list[int], column: str = "text", longest: int = 5) -> DataFrame:
    """(key, gram, cnt: array): how often the padded first characters of a text hold a gram, at each length; a row for a text and gram."""
    kind = dict(docs.select(key).dtypes)[key]

    def run(batches):
        import pyarrow as pa

        keys, grams, counts = [], [], []
        for b in batches:
            field = b.schema.field(0).type
            block = lambda: pa.RecordBatch.from_arrays([pa.array(keys, field), pa.array(grams, pa.string()), pa.array(counts, pa.list_(pa.int64()))], names=[key, "gram", "cnt"])  # noqa: B023, E731
            for row in range(b.num_rows):
                t, own = b.column(1)[row].as_py() or "", {}
                for k, size in enumerate(lengths):
                    s = f"_{t[:size]}_"
                    for n in range(1, longest + 1):
                        for i in range(len(s) - n + 1):
                            x = own.get(s[i : i + n])
                            if x is None:
                                x = own[s[i : i + n]] = [0] * len(lengths)
                            x[k] += 1
                keys += [b.column(0)[row].as_py()] * len(own)
                grams += own
                counts += own.values()
                if len(keys) > 20_000:
                    yield block()
                    keys, grams, counts = [], [], []
            if keys:
                yield block()
                keys, grams, counts = [], [], []

    return docs.select(key, column).mapInArrow(run, f"`{key}` {kind}, gram string, cnt array<bigint>")


#: Rows of profiles that every task has.
PROFILES = 100_000


def placed(profiles: DataFrame, docs: DataFrame, key: str, lengths: list[int], column: str = "text", most: int = 400, longest: int = 5) -> DataFrame | None:
    """(key, length, predicted) of the padded first characters of texts, as ``out_of_place`` has it; None where the profiles are too many for every task.

    A text's grams are counted, ranked and compared where it is read: no gram becomes a row.
    """
    if profiles.limit(PROFILES + 1).count() > PROFILES:
        return None
    ranks: dict = {}
    for r in profiles.select("label", "gram", "rank").collect():
        ranks.setdefault(r["label"], {})[r["gram"]] = r["rank"]
    kinds = dict(docs.select(key).dtypes) | dict(profiles.dtypes)
    labels = sorted(ranks, key=lambda x: (x is not None, x.encode() if isinstance(x, str) else x))
    sent = docs.sparkSession.sparkContext.broadcast([(n, ranks[x]) for n, x in enumerate(labels)])

    def run(batches):
        import pyarrow as pa

        by: dict[str, list] = {}
        for n, own in sent.value:
            for g, r in own.items():
                by.setdefault(g, []).append((n, r))
        for b in batches:
            at, size, best = [], [], []
            for row in range(b.num_rows):
                t = b.column(1)[row].as_py() or ""
                for length in lengths:
                    seen: dict[str, list[int]] = {}
                    _grams_of(f"_{t[:length]}_", seen, longest)
                    first = sorted(seen, key=lambda g: (-seen[g][0], seen[g][1]))[:most]  # noqa: B023
                    d = [most * len(first)] * len(sent.value)
                    for r, g in enumerate(first):
                        for n, p in by.get(g, ()):
                            d[n] += abs(r - p) - most
                    at.append(row)
                    size.append(length)
                    best.append(min(range(len(d)), key=d.__getitem__) if d else None)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(size, pa.int32()), pa.array(best, pa.int32())], names=[key, "length", "n"])

    got = docs.select(key, column).mapInArrow(run, f"`{key}` {kinds[key]}, length int, n int")
    names = docs.sparkSession.createDataFrame(list(enumerate(labels)), f"n int, predicted {kinds['label']}")
    return got.join(F.broadcast(names), "n").select(key, "length", "predicted")


def top_grams(grams: DataFrame, by: list[str], most: int = 400) -> DataFrame:
    """grams: (by..., gram, cnt, first). The most frequent grams with rank from 0; ties by first place."""
    w = W.partitionBy(*by).orderBy(F.col("cnt").desc(), "first", "gram")
    return grams.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < most)


def out_of_place(profiles: DataFrame, texts: DataFrame, key: list[str], most: int = 400) -> DataFrame:
    """Distance of texts' gram ranks to class profiles: (key..., predicted). An unseen gram costs ``most``."""
    classes = bounded(profiles.select("label").distinct())
    hits = texts.join(bounded(profiles.select("label", "gram", F.col("rank").alias("p")), 100_000), "gram").groupBy(*key, "label").agg(F.sum(F.abs(F.col("rank") - F.col("p")) - most).alias("d"))
    total = texts.groupBy(*key).agg(F.count("*").alias("n")).crossJoin(classes)
    s = total.join(hits, [*key, "label"], "left").withColumn("d", F.col("n") * most + F.coalesce("d", F.lit(0)))
    w = W.partitionBy(*key).orderBy("d", "label")
    return s.withColumn("r", F.row_number().over(w)).where("r = 1").select(*key, F.col("label").alias("predicted"))


WINDOW = 5


def encoded(docs: DataFrame, vocab: list[str], kept: Column | None = None) -> DataFrame:
    """(doc_id, ids: binary of 32-bit numbers): the words of a text that the vocabulary has, by their places in it.

    Rows stand in the order of ids over all partitions, texts without such words left out; kept as a table.
    """
    from .scan import TABLE, lowered

    sent = docs.sparkSession.sparkContext.broadcast({w.encode(): i for i, w in enumerate(vocab)})

    def run(batches):
        import numpy as np
        import pyarrow as pa

        known = sent.value
        for b in batches:
            ids = [np.array([known[w] for w in x.as_py().translate(TABLE).split() if w in known], "i4").tobytes() for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    rows = lowered(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, "doc_id long, ids binary").where(F.length("ids") > 0)
    return cut(rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id"))


def pair_counts(rows: DataFrame, size: int, subsample: float | None = None, seed: int = 43) -> DataFrame:
    """rows: those of ``encoded``. (w, c, n1, ..., n5): how often c stands that far behind w in all texts' words, one after the other.

    With ``subsample``, after some occurrences of frequent words are left out by hash of their place in the
    whole stream. Partitions are counted side by side; what spans two of them is counted from their ends.
    """
    spark = rows.sparkSession

    def sizes(batches):
        import numpy as np
        import pyarrow as pa

        first, n, seen = None, 0, np.zeros(size, "i8")
        for b in batches:
            for doc, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.frombuffer(x.as_buffer(), "i4")
                first = (doc,) if first is None else first
                n += len(ids)
                seen += np.bincount(ids, minlength=size)
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array([n], pa.int64()), pa.array([seen.tobytes()], pa.binary())], names=["doc_id", "n", "seen"])

    import numpy as np

    parts = sorted(rows.mapInArrow(sizes, "doc_id long, n long, seen binary").collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"]))  # a row for each partition
    starts, at = {}, 0
    for r in parts:
        starts[r["doc_id"]] = at
        at += r["n"]
    keep = None
    if subsample is not None:
        f = sum((np.frombuffer(r["seen"], "i8") for r in parts), np.zeros(size, "i8")).astype("f8")
        ratio = subsample * float(at) / np.maximum(f, 1.0)
        keep = np.minimum(1.0, np.sqrt(ratio) + ratio)
    sent = spark.sparkContext.broadcast((starts, keep))

    def run(batches):
        from hashlib import md5

        import pyarrow as pa

        starts, keep = sent.value
        counts, key, pos, head, tail = np.zeros((WINDOW, size * size), "i8"), None, 0, np.zeros(0, "i4"), np.zeros(0, "i4")
        held, n = [], 0

        def flush():
            nonlocal head, tail, held, n
            s = np.concatenate([tail, *held])
            for d in range(1, WINDOW + 1):
                a = max(0, len(tail) - d)  # pairs whose later word is new
                if len(s) - d > a:
                    counts[d - 1] += np.bincount(s[a : len(s) - d].astype("i8") * size + s[a + d :], minlength=size * size)
            if len(head) < WINDOW:
                head = np.concatenate([head, *held])[:WINDOW]
            tail, held, n = s[-WINDOW:], [], 0

        for b in batches:
            for doc, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.frombuffer(x.as_buffer(), "i4")
                if key is None:
                    key, pos = (doc,), starts[doc]
                if keep is not None:
                    p = keep[ids]
                    stay = p >= 1.0
                    for i in np.flatnonzero(~stay).tolist():
                        stay[i] = int(md5(b"%d:%d" % (seed, pos + i + 1)).hexdigest()[:8], 16) / 4294967296.0 < p[i]
                    pos += len(ids)
                    ids = ids[stay]
                held.append(ids)
                n += len(ids)
                if n > 2_000_000:
                    flush()
        if key is None:
            return
        flush()
        seen = np.flatnonzero(counts.any(0))
        names, kinds = ["w", "c", *(f"n{d}" for d in range(1, WINDOW + 1))], pa.int64()
        for i in range(0, len(seen), 50_000):
            j = seen[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(x, kinds) for x in (j // size, j % size, *(counts[d, j] for d in range(WINDOW)))] + [pa.nulls(len(j), pa.list_(pa.int64()))] * 2 + [pa.nulls(len(j), kinds)], names=[*names, "head", "tail", "first"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, kinds)] * (2 + WINDOW) + [pa.array([x.tolist()], pa.list_(kinds)) for x in (head, tail)] + [pa.array(key, kinds)], names=[*names, "head", "tail", "first"])

    ns = [f"n{d}" for d in range(1, WINDOW + 1)]
    got = cut(rows.mapInArrow(run, ", ".join(["w long, c long", *(f"{x} long" for x in ns), "head array<bigint>, tail array<bigint>, first long"])))
    ends = sorted(got.where("head is not null").select("head", "tail", "first").collect(), key=lambda r: (r["first"] is not None, r["first"]))
    over, tail = [], []
    for r in ends:
        for a, w in enumerate(reversed(tail), 1):
            over += [(int(w), int(c), *(int(a + b == d) for d in range(1, WINDOW + 1))) for b, c in enumerate(r["head"]) if a + b <= WINDOW]
        tail = (tail + list(r["tail"]))[-WINDOW:]
    got = got.where("head is null").select("w", "c", *ns)
    if over:
        got = got.unionByName(spark.createDataFrame(over, ", ".join(["w long, c long", *(f"{x} long" for x in ns)])))
    return got.groupBy("w", "c").agg(*[F.sum(x).alias(x) for x in ns])


def cooccurrence(counts: DataFrame, dynamic: bool = True) -> DataFrame:
    """counts: those of ``pair_counts``. Symmetric weights (w, c, x) of words at most five apart, nearer ones weighing more if dynamic."""
    x = sum((F.col(f"n{d}") * (WINDOW - d + 1) for d in range(2, WINDOW + 1)), F.col("n1") * WINDOW) / WINDOW if dynamic else sum((F.col(f"n{d}") for d in range(2, WINDOW + 1)), F.col("n1")).cast("double")
    one = counts.select("w", "c", x.alias("x"))
    return one.union(one.select("c", "w", "x")).groupBy("w", "c").agg(F.sum("x").alias("x"))


def pmi(pairs: DataFrame, alpha: float = 1.0, k: float = 1.0, positive: bool = True) -> DataFrame:
    """(w, c, value): ln of p(w, c) over p(w) and alpha-smoothed p(c), less ln k; zeros are dropped."""
    rows = pairs.groupBy("w").agg(F.sum("x").alias("rw"))
    cols = pairs.groupBy("c").agg(F.pow(F.sum("x"), F.lit(alpha)).alias("pc"))
    t = rows.agg(F.sum("rw").alias("t")).crossJoin(cols.agg(F.sum("pc").alias("tc")))
    v = F.log(F.col("x") / F.col("t") / (F.col("rw") / F.col("t") * F.col("pc") / F.col("tc"))) - F.log(F.lit(float(k)))
    got = pairs.join(rows, "w").join(cols, "c").crossJoin(F.broadcast(t)).select("w", "c", (F.greatest(F.lit(0.0), v) if positive else v).alias("value"))
    return got.where("value != 0 and not isnan(value)")


def exact_singular_values(weights: DataFrame, size: int, dims: int = 50, most: int = 5000) -> list[float]:
    """The largest singular values of a weighted size x size matrix, without random projection: what ``word_vectors`` is measured against.

    The matrix is put together on the driver, so a vocabulary of more than ``most`` words is an error.
    """
    import numpy as np

    if size > most:
        raise ValueError(f"{size} words: an exact decomposition takes {most} at most")
    m = np.zeros((size, size))
    for r in weights.select("w", "c", "value").toLocalIterator():
        m[r["w"], r["c"]] = r["value"]
    return [float(x) for x in np.linalg.svd(m, compute_uv=False)[: min(dims, size - 1)]]


def word_vectors(weights: DataFrame, size: int, dims: int = 50, p: float = 0.5, rounds: int = 4, seed: int = 1, context: bool = False) -> DataFrame:
    """(id, vec) from a weighted size x size matrix by randomised SVD: U * S ** p, with ``context`` plus V * S ** p.

    The matrix stays distributed; a pass multiplies it with a thin block, whose rows (size x
    (dims + 10) numbers, size being a bounded vocabulary) are orthonormalised on the driver.
    """
    import numpy as np

    spark = weights.sparkSession
    dims = min(dims, size - 1)
    width = min(size, dims + 10)
    w = cut(weights)

    def times(block, transpose: bool):
        a, b = ("c", "w") if transpose else ("w", "c")
        sent = spark.sparkContext.broadcast(block)

        def run(frames):
            import pandas as pd

            acc: dict[int, np.ndarray] = {}
            for f in frames:
                for i, g in f.groupby(a):
                    part = g["value"].to_numpy() @ sent.value[g[b].to_numpy()]
                    acc[i] = acc[i] + part if i in acc else part
            yield pd.DataFrame({"i": list(acc), "row": [v.tolist() for v in acc.values()]})

        out = np.zeros((size, block.shape[1]))
        for r in w.mapInPandas(run, "i long, row array<double>").toLocalIterator():
            out[r["i"]] += r["row"]
        return out

    q = np.random.default_rng(seed).standard_normal((size, width))
    q, _ = np.linalg.qr(times(q, False))
    for _ in range(rounds):
        z, _ = np.linalg.qr(times(q, True))
        q, _ = np.linalg.qr(times(z, False))
    u, s, v = np.linalg.svd(times(q, True).T, full_matrices=False)
    vecs = (q @ u)[:, :dims] * s[:dims] ** p + (v.T[:, :dims] * s[:dims] ** p if context else 0.0)
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "id long, vec array<double>")


def npmi(presence: DataFrame, words: DataFrame, n_docs: int, eps: float = 1e-12) -> DataFrame:
    """presence: (doc_id, token) distinct; words: (topic, token). (topic, npmi): mean over word pairs; -1 for pairs never together."""
    w = bounded(words)
    own = presence.join(bounded(words.select("token").distinct()), "token", "left_semi")
    df = own.groupBy("token").agg(F.count("*").alias("df"))
    known = cut(words.join(df, "token"))
    pairs = known.select("topic", F.col("token").alias("a"), F.col("df").alias("da")).join(known.select("topic", F.col("token").alias("b"), F.col("df").alias("db")), "topic").where("a < b")
    at = own.join(w, "token").select("topic", "doc_id", "token")
    both = at.select("topic", "doc_id", F.col("token").alias("a")).join(at.select("topic", "doc_id", F.col("token").alias("b")), ["topic", "doc_id"]).where("a < b").groupBy("topic", "a", "b").agg(F.count("*").alias("n"))
    x = pairs.join(both, ["topic", "a", "b"], "left")
    p = F.col("n") / float(n_docs)
    v = F.when(F.col("n").isNull(), -1.0).otherwise(F.log(p / (F.col("da") / n_docs * F.col("db") / n_docs + eps) + eps) / -F.log(p + eps))
    return x.groupBy("topic").agg(F.avg(v).alias("npmi"))


def lda(post: DataFrame, k: int = 8, top: int = 10, rounds: int = 20, seed: int = 1, terms: int = 5000, key: str = "doc_id") -> DataFrame:
    """(topic, rank, token, weight): the heaviest words of each topic of an online LDA over the most frequent terms."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer

    docs = post.groupBy(key).agg(F.flatten(F.collect_list(F.array_repeat("token", F.col("tf").cast("int")))).alias("words"))
    cv = CountVectorizer(inputCol="words", outputCol="features", vocabSize=terms, minDF=2.0).fit(docs)
    model = LDA(k=k, maxIter=rounds, seed=seed, featuresCol="features").fit(cv.transform(docs).select(key, "features"))
    vocab = F.array(*[F.lit(w) for w in cv.vocabulary]) if len(cv.vocabulary) <= 200 else None
    rows = model.describeTopics(top).select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "t")).select("topic", "rank", F.col("t.termIndices").alias("i"), F.col("t.termWeights").alias("weight"))
    if vocab is not None:
        return rows.select("topic", "rank", F.get(vocab, F.col("i")).alias("token"), "weight")
    names = post.sparkSession.createDataFrame(list(enumerate(cv.vocabulary)), "i int, token string")
    return rows.join(F.broadcast(names), "i").select("topic", "rank", "token", "weight")


COMPRESSORS = {"gzip": lambda b: len(gzip.compress(b, 9, mtime=0)), "bz2": lambda b: len(bz2.compress(b, 9)), "lzma": lambda b: len(lzma.compress(b, preset=9))}


def compressed_length(name: str):
    """An Arrow-batched function of a text: its compressed length in bytes."""
    if name not in COMPRESSORS:
        raise ValueError(f"unknown compressor {name!r}; one of {sorted(COMPRESSORS)}")
    f = COMPRESSORS[name]

    @F.pandas_udf(T.LongType())
    def run(s):  # a pandas Series
        return s.map(lambda x: None if x is None else f(x.encode()))

    return run


def ncd(pairs: DataFrame, name: str = "gzip") -> DataFrame:
    """pairs: (a, b, ta, tb) texts. (a, b, ncd); a text's own length is worked out once a text, not once a pair.

    Pairs are dealt out evenly first: a small table of texts, in one file, makes many pairs, and each is costly.
    """
    c = compressed_length(name)
    pairs = spread(pairs)
    xs = pairs.select("a", F.col("ta").alias("t")).dropDuplicates(["a"]).select("a", c(F.col("t")).alias("ca"))
    ys = pairs.select("b", F.col("tb").alias("t")).dropDuplicates(["b"]).select("b", c(F.col("t")).alias("cb"))
    both = pairs.select("a", "b", c(F.concat_ws(" ", "ta", "tb")).alias("cab"))
    return both.join(xs, "a").join(ys, "b").select("a", "b", ((F.col("cab") - F.least("ca", "cb")) / F.greatest("ca", "cb")).alias("ncd"))


def window_pressure(texts: DataFrame, column: str = "text", window: int = 32 * 1024) -> DataFrame:
    """One row: sizes of texts in bytes, and whether two joined texts outgrow a compressor's window.

    The middle size comes from a table of sizes, not from all texts in one task.
    """
    n = texts.select(F.octet_length(F.coalesce(F.col(column), F.lit(""))).cast("long").alias("size")).groupBy("size").agg(F.count("*").alias("n"))
    n = n.withColumn("to", F.sum("n").over(W.orderBy("size"))).withColumn("r", F.row_number().over(W.orderBy(F.col("size").desc()))).crossJoin(F.broadcast(n.agg(F.sum("n").alias("all"))))
    at = n.agg(F.min(F.when(F.col("to") > F.floor(F.col("all") / 2), F.col("size"))).alias("median"), F.max("size").alias("top"), F.max(F.when(F.col("r") == 1, F.col("n"))).alias("tops"), F.max(F.when(F.col("r") == 2, F.col("size"))).alias("next"))
    at = at.select("median", (F.col("top") + F.when(F.col("tops") > 1, F.col("top")).otherwise(F.coalesce("next", F.lit(0)))).alias("pair"))
    return at.select(F.col("median").alias("median_bytes"), F.col("pair").alias("largest_pair_bytes"), (2 * F.col("median")).alias("median_pair_bytes"), F.lit(window).cast("long").alias("window_bytes"), (F.col("pair") > window).alias("worst_case_exceeds_window"), (2 * F.col("median") > window).alias("median_case_exceeds_window"))


def random_sense(train: DataFrame, test: DataFrame, seed: int = 41) -> DataFrame:
    """(document, sent, place, predicted): one of the senses seen in training, by hash of the token's place; 1 for unseen words."""
    seen = train.groupBy("lemma", "pos").agg(F.array_sort(F.collect_set("sense")).alias("senses"))
    x = test.select("document", "sent", "place", "lemma", "pos").join(seen, ["lemma", "pos"], "left").withColumn("u", uniform(seed, "document", "sent", "place"))
    return x.select("document", "sent", "place", F.coalesce(F.get("senses", F.floor(F.col("u") * F.size("senses")).cast("int")), F.lit(1)).alias("predicted"))


def discourse_oracle(train: DataFrame, test: DataFrame) -> DataFrame:
    """(document, sent, place, predicted): the modal true sense of a lemma's other tokens in the document, ties to the smallest; else the modal training sense, else 1.

    It reads the truth of the other tokens: what one sense a discourse could reach, not a method.
    """
    n = test.groupBy("document", "lemma", "pos", "sense").agg(F.count("*").alias("n")).withColumnRenamed("sense", "s")
    x = test.select("document", "sent", "place", "lemma", "pos", "sense").join(n, ["document", "lemma", "pos"]).withColumn("n", F.col("n") - (F.col("s") == F.col("sense")).cast("long"))
    best = x.where("n > 0").groupBy("document", "sent", "place").agg(F.max_by("s", F.struct("n", -F.col("s"))).alias("best"))
    got = test.select("document", "sent", "place", "lemma", "pos").join(best, ["document", "sent", "place"], "left").join(most_frequent_sense(train), ["lemma", "pos"], "left")
    return got.select("document", "sent", "place", F.coalesce("best", "mfs", F.lit(1)).alias("predicted"))


def most_frequent_sense(tagged: DataFrame) -> DataFrame:
    """(lemma, pos, mfs): the modal sense of training tokens, ties to the smallest."""
    n = tagged.groupBy("lemma", "pos", "sense").agg(F.count("*").alias("n"))
    return n.groupBy("lemma", "pos").agg(F.max_by("sense", F.struct("n", -F.col("sense"))).alias("mfs"))


def context_words(tagged: DataFrame, window: int = 5) -> DataFrame:
    """tagged with context: lower-cased surfaces up to ``window`` places away in the sentence, itself left out."""
    by = W.partitionBy("document", "sent").orderBy("place")
    before = F.collect_list(F.lower("surface")).over(by.rowsBetween(-window, -1))
    after = F.collect_list(F.lower("surface")).over(by.rowsBetween(1, window))
    return tagged.withColumn("context", F.concat(before, after))


def context_overlap(train: DataFrame, test: DataFrame) -> DataFrame:
    """(document, sent, place, predicted): the sense whose training contexts share most with the token's, idf-weighed; else the modal sense, else 1."""
    tr, te = context_words(train), context_words(test)
    bags = tr.select("lemma", "pos", "sense", F.explode("context").alias("word")).groupBy("lemma", "pos", "sense", "word").agg(F.count("*").alias("n"))
    total = bags.select("lemma", "pos", "sense").distinct().count()
    df = bags.groupBy("word").agg(F.log(F.lit(float(total)) / (1 + F.count("*"))).alias("idf"))
    s = te.select("document", "sent", "place", "lemma", "pos", F.explode("context").alias("word")).join(bags, ["lemma", "pos", "word"]).join(df, "word").groupBy("document", "sent", "place", "sense").agg(F.sum(F.col("n") * F.col("idf")).alias("score"))
    w = W.partitionBy("document", "sent", "place").orderBy(F.round("score", 9).desc(), "sense")
    best = s.withColumn("r", F.row_number().over(w)).where("r = 1 and score > 0").select("document", "sent", "place", "sense")
    return te.join(best, ["document", "sent", "place"], "left").join(most_frequent_sense(train), ["lemma", "pos"], "left").select("document", "sent", "place", F.coalesce(F.col("sense") if "sense" not in test.columns else best["sense"], F.col("mfs"), F.lit(1)).alias("predicted"))


def lesk(glosses: DataFrame, test: DataFrame, train: DataFrame) -> DataFrame:
    """glosses: (lemma, pos, sense, gloss). The sense whose gloss shares most words with the sentence; else the modal sense, else 1."""
    sent = test.groupBy("document", "sent").agg(F.collect_set(F.lower("surface")).alias("words"))
    g = glosses.select("lemma", "pos", F.col("sense").alias("s"), F.array_distinct(F.regexp_extract_all(F.lower("gloss"), F.lit("[a-z]+"), F.lit(0))).alias("bag"))
    x = test.select("document", "sent", "place", "lemma", "pos").join(sent, ["document", "sent"]).join(g, ["lemma", "pos"], "left").withColumn("n", F.size(F.array_intersect("words", "bag")))
    w = W.partitionBy("document", "sent", "place").orderBy(F.col("n").desc_nulls_last(), "s")
    best = x.withColumn("r", F.row_number().over(w)).where("r = 1")
    return best.join(most_frequent_sense(train), ["lemma", "pos"], "left").select("document", "sent", "place", F.coalesce(F.when(F.col("n") > 0, F.col("s")), F.col("mfs"), F.lit(1)).alias("predicted"))


def one_sense_per_discourse(predicted: DataFrame, test: DataFrame) -> DataFrame:
    """Every token of a lemma gets the majority prediction of its document, ties to the smallest."""
    x = test.select("document", "sent", "place", "lemma", "pos").join(predicted, ["document", "sent", "place"])
    n = x.groupBy("document", "lemma", "pos", "predicted").agg(F.count("*").alias("n"))
    top = n.groupBy("document", "lemma", "pos").agg(F.max_by("predicted", F.struct("n", -F.col("predicted"))).alias("predicted"))
    return x.drop("predicted").join(top, ["document", "lemma", "pos"]).select("document", "sent", "place", "predicted")


def keep_probability(freq: Column, total: Column, t: float = 1e-5) -> Column:
    """The share of occurrences of a word that subsampling keeps."""
    r = F.lit(t) * total / freq
    return F.least(F.lit(1.0), F.sqrt(r) + r)
