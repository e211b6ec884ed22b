"""Near-duplicate texts: fast similarity sketching, banding, exact verification.

Sketch (rounds of hashed bin placement): in round i < t every shingle falls into one of t
bins by a hash of its own for that round; in round t + i every shingle falls into bin i. A
bin keeps the least (round, hash) that fell into it, and the rounds end once each bin is
filled, after 2t rounds at the latest. The share of equal bins of two sketches estimates
the Jaccard similarity with Chernoff-type bounds, at the cost of about one pass over a
set larger than t log t. Bands of bins give candidate pairs.

Candidates are tested on the full sets of 64-bit shingle hashes. A bucket of one band first
tests each member against the bucket's smallest member only; what that links are components.
Only then do members of one bucket that still lie in different components get compared
with each other, unless their differences from the smallest member, or shingles that no
other candidate has, prove them too far apart. A large group of near copies thus costs a few
tests for each member, and no link between different texts is left out for the size of its
bucket.

Defined results: A-Z are lower-cased; a null or wordless text has an empty set and links
with nothing; a text with fewer words than a shingle is one shingle; texts of any length count
whole; rows with the same set link with each other; rows that repeat an id are rows of their
own, each with the component of its text; rows with a null id are returned with component null
and kept true; an empty table gives an empty result; other columns are not looked at.

A row is told by its id and a 64-bit hash of its text. Distinct sets are numbered, and
components are made of these numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HUB_PART, Words, chunks, components, cut, grams, join_groups, mix, ship, small, text_bytes, text_hash, written

#: Ids of documents that share a bucket are broadcast up to this many (16 MB); beyond it the join shuffles.
BROADCAST_IDS = 1_000_000
#: Pairs of one text that a task compares; a text in more pairs is copied.
PAIRS_OF_TEXT = 500
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of ``size`` words, lower-cased."""
    out: list[np.ndarray] = []
    for i, j in chunks(texts):
        w = Words(texts[i:j], lower=True)
        h = w.hashes()
        g, at = grams(h, w.doc, size)
        first = np.searchsorted(w.doc[at], np.arange(j - i + 1))
        for k in range(j - i):
            own = g[first[k] : first[k + 1]]
            if not len(own):
                words = h[w.first[k] : w.first[k + 1]]
                if not len(words):
                    out.append(np.zeros(0, np.uint64))
                    continue
                with np.errstate(over="ignore"):
                    one = np.full(1, len(words), np.uint64)
                    for x in words:
                        one = mix(one * np.uint64(0x9FB21C651E98DF25) + x)
                out.append(one)
                continue
            own = np.sort(own)
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
    return out


def sketch(u: np.ndarray, t: int) -> np.ndarray:
    """The t bins of a non-empty set of hashes; each holds round * 2**32 + 32 bits of a hash."""
    s = np.full(t, _FULL)
    i = 0
    while i < 2 * t:
        # as many rounds at once as are likely to be needed; more do no harm, since a bin keeps its first round
        k = 1 if len(u) > 4 * t else min(2 * t - i, 1 + 700 // len(u))
        rounds = np.arange(i, i + k, dtype=np.uint64)
        x = mix(u[None, :] ^ mix(rounds * np.uint64(0x9E3779B97F4A7C15), 5)[:, None], 1)
        bins = ((x >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)
        late = rounds >= t
        if late.any():
            bins[late] = (rounds[late] - np.uint64(t))[:, None]
        np.minimum.at(s, bins.ravel().astype(np.int64), ((x & np.uint64(0xFFFFFFFF)) | (rounds[:, None] << np.uint64(32))).ravel())
        i += k
        if (s != _FULL).all():
            break
    return s


def band_keys(s: np.ndarray, rows: int) -> np.ndarray:
    b = s.reshape(-1, rows)
    with np.errstate(over="ignore"):
        h = mix(np.arange(len(b), dtype=np.uint64), 77)
        for j in range(rows):
            h = mix(h * np.uint64(0x9FB21C651E98DF25) + b[:, j])
    return h


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


SKETCHED = "doc_id long, t long, n_shingles long, h1 long, h2 long, bands array<long>"


def sketches(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """docs: doc_id, t, text. (doc_id, t, n_shingles, h1, h2: 128 bits that tell sets apart, bands: keys, empty for an empty set)."""

    def run(batches):
        for b in batches:
            ids, texts = b.column(0), text_bytes(b.column(2))
            n, h1, h2, keys = [], [], [], []
            for u in shingle_sets(texts, size):
                n.append(len(u))
                with np.errstate(over="ignore"):
                    h1.append(int(_signed(mix(u, 21).sum(keepdims=True, dtype=np.uint64))[0]) if len(u) else 0)
                    h2.append(int(_signed(mix(u, 22).sum(keepdims=True, dtype=np.uint64))[0]) if len(u) else 0)
                keys.append(_signed(band_keys(sketch(u, bands * rows), rows)) if len(u) else np.zeros(0, np.int64))
            off = np.concatenate(([0], np.cumsum([len(k) for k in keys])))
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), b.column(1), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.ListArray.from_arrays(pa.array(off, pa.int32()), flat)], names=["doc_id", "t", "n_shingles", "h1", "h2", "bands"])

    ship(docs.sparkSession)
    return docs.mapInArrow(run, SKETCHED)


def _with_text(pairs: DataFrame, texts: DataFrame, key: str, other: str, name: str) -> DataFrame:
    """``pairs`` with the text of ``key``. Where one text is in very many pairs, it is copied to as many tasks as its pairs need."""
    counts = cut(pairs.groupBy(key).agg(F.count("*").alias("c")))
    n = counts.agg(F.sum("c")).first()[0] or 0
    # at most HUB_PART texts, whatever the input
    hot = F.broadcast(counts.where(F.col("c") > max(PAIRS_OF_TEXT, n / HUB_PART)).select(key, F.ceil(F.col("c") / PAIRS_OF_TEXT).cast("int").alias("copies")))
    copies = F.coalesce("copies", F.lit(1))
    left = pairs.join(hot, key, "left").withColumn("salt", F.pmod(F.xxhash64(other), copies).cast("int")).drop("copies")
    right = texts.select(F.col("doc_id").alias(key), F.col("text").alias(name)).join(hot, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), copies - 1))).drop("copies")
    return left.join(right, [key, "salt"]).drop("salt")


def _overlaps(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """For pairs (a, b) the sizes of their full sets and of the intersection: (a, b, na, nb, same).

    Texts travel, not sets: they compress well, and a set is twice as large.
    """

    def run(batches):
        for b in batches:
            a_ids, b_ids = b.column("a").to_pylist(), b.column("b").to_pylist()
            first = {}
            for ids, column in ((a_ids, "ta"), (b_ids, "tb")):
                for k, i in enumerate(ids):
                    first.setdefault(i, (column, k))
            sets = dict(zip(first, shingle_sets([b.column(c)[k].as_py().encode() for c, k in first.values()], size), strict=True))
            got = np.zeros((3, b.num_rows), np.int64)
            for k, (i, j) in enumerate(zip(a_ids, b_ids, strict=True)):
                u, v = sets[i], sets[j]
                both = np.concatenate((u, v))
                both.sort()
                got[:, k] = len(u), len(v), int((both[1:] == both[:-1]).sum())
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), *(pa.array(g) for g in got)], names=["a", "b", "na", "nb", "same"])

    got = _with_text(_with_text(cut(pairs), texts, "a", "b", "ta"), texts, "b", "a", "tb")
    return got.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, na long, nb long, same long")


def _lone(docs: DataFrame, size: int) -> DataFrame:
    """docs: doc_id, text. (rep, u): the number of shingles that no other of these documents has."""

    def run(batches):
        for b in batches:
            sets = shingle_sets(text_bytes(b.column(1)), size)
            ids = np.repeat(b.column(0).to_numpy(), [len(u) for u in sets])
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(_signed(flat), pa.int64())], names=["rep", "g"])

    rows = docs.mapInArrow(run, "rep long, g long")
    return rows.groupBy("g").agg(F.count("*").alias("c"), F.min("rep").alias("rep")).where("c = 1").groupBy("rep").agg(F.count("*").alias("u"))


def classes(docs: DataFrame, doc_id: str, text: str, size: int, percent: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, t: hash of the text, n_shingles, component_id) for every row of ``docs``."""
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_hash(text).alias("t"), F.col(text).alias("text"))
    sk = cut(sketches(d, size, bands, rows))
    some = sk.where("doc_id is not null and n_shingles > 0")
    first = some.groupBy("n_shingles", "h1", "h2").agg(F.min(F.struct("doc_id", "t")).alias("first"), F.count("*").alias("c"), F.min("bands").alias("bands"))
    # a number for each distinct set; written once and read from there
    reps = cut(first.select("n_shingles", "h1", "h2", "c", "bands", F.col("first.doc_id").alias("lowest"), F.col("first.t").alias("t"), F.monotonically_increasing_id().alias("rep")))
    rows_ = reps.select("rep", "lowest", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    # a bucket's pivot has its smallest id
    full = rows_.groupBy("key").agg(F.count("*").alias("c"), F.min(F.struct("lowest", "rep")).alias("pivot")).where("c > 1").select("key", F.col("pivot.rep").alias("pivot"))
    member = written(rows_.drop("lowest").join(full, "key"))
    size_ok = f"100 * least(n, m) >= {percent} * greatest(n, m)"
    n_of = reps.select(F.col("rep").alias("pivot"), F.col("n_shingles").alias("m"))
    stars = member.where("rep != pivot").select("rep", "n", "pivot").distinct().join(n_of, "pivot").where(size_ok)
    tested = stars.select(F.col("pivot").alias("a"), F.col("rep").alias("b"))
    ids = cut(member.select("rep").distinct().join(reps.select("rep", F.col("lowest").alias("i"), F.col("t").alias("h")), "rep"))
    named = d.join(small(ids, BROADCAST_IDS), (F.col("doc_id") == F.col("i")) & (F.col("t") == F.col("h")))
    texts = written(named.select(F.col("rep").alias("doc_id"), "text").dropDuplicates(["doc_id"]))
    similar = f"100 * same >= {percent} * (na + nb - same)"
    tested = cut(_overlaps(tested, texts, size))
    links = tested.where(similar).select("a", "b")
    comp = components(links).withColumnRenamed("node", "rep")
    # members of one bucket in different components; x: shingles that the pivot lacks, y: shingles of the pivot that are lacking
    placed = member.join(comp, "rep", "left").withColumn("comp", F.coalesce("component_id", "rep")).select("key", "rep", "n", "comp", "pivot")
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    rest = cut(placed.join(mixed, "key"))
    seen = tested.select(F.col("a").alias("pivot"), F.col("b").alias("rep"), (F.col("nb") - F.col("same")).alias("x"), (F.col("na") - F.col("same")).alias("y"))
    lone = _lone(texts.join(rest.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", "text"), size)
    rest = rest.join(seen, ["pivot", "rep"], "left").join(lone, "rep", "left").select(
        "key", "rep", "n", "comp", F.when(F.col("rep") == F.col("pivot"), 0).otherwise(F.col("x")).alias("x"), F.when(F.col("rep") == F.col("pivot"), 0).otherwise(F.col("y")).alias("y"), F.coalesce("u", F.lit(0)).alias("u"))
    rest = written(rest.join(reps.select("rep", "bands"), "rep"))
    other = rest.select("key", F.col("rep").alias("b"), F.col("bands").alias("bands2"), F.col("n").alias("m"), F.col("comp").alias("comp_b"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("u").alias("u2"))
    # each pair is looked at in one of the buckets that it shares;
    # two sets differ in at least this many shingles: those that only one has at all, and what they differ by from the pivot
    apart = "(u + u2 + coalesce(abs((x - u) - (x2 - u2)) + abs(y - y2), 0))"
    close = f"100 * (n + m - {apart}) >= {percent} * (n + m + {apart})"
    pairs = rest.withColumnRenamed("rep", "a").join(other, "key").where(f"a < b and comp != comp_b and {size_ok} and {close} and key = array_min(array_intersect(bands, bands2))").select("a", "b").distinct()
    more = cut(_overlaps(pairs.join(tested, ["a", "b"], "left_anti"), texts, size).where(similar).select("a", "b"))
    comp = components(links.union(more)) if more.limit(1).count() else comp.withColumnRenamed("rep", "node")
    root = reps.join(comp.select(F.col("node").alias("rep"), F.col("component_id").alias("root")), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    lowest = root.groupBy("root").agg(F.min("lowest").alias("component_id"))
    sets = cut(root.select("n_shingles", "h1", "h2", "c", "root").join(lowest, "root").drop("root"))
    return join_groups(sk.select("doc_id", "t", "n_shingles", "h1", "h2"), sets, ["n_shingles", "h1", "h2"], "c").select("doc_id", "t", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, bands: int = 24, rows: int = 4) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Texts link if 100 * intersection >= percent * union. A pair exactly at the threshold j
    shares no band with probability (1 - j ** rows) ** bands: 3e-6 for the defaults.
    """
    got = classes(docs, doc_id, text, size, percent, bands, rows)
    return got.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, bands: int = 24, rows: int = 4) -> DataFrame:
    """``docs`` without the rows whose id is not the smallest of their component; columns unchanged."""
    gone = classes(docs, doc_id, text, size, percent, bands, rows).where("doc_id != component_id").select(F.col("doc_id").alias("__gone"), F.col("t").alias("__t")).distinct()
    return docs.join(gone, (F.col(doc_id) == F.col("__gone")) & (text_hash(text) == F.col("__t")), "left_anti")
