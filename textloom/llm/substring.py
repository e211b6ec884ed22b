"""Substring dedup by super-k-mers.

A window is ``width`` consecutive words of a document. The minimiser of a window is the
least hash among its runs of ``mer`` words; consecutive windows with one minimiser are a
super-k-mer. Equal windows have equal minimisers, so a minimiser that only one text has
cannot belong to a repeated window: such super-k-mers need not travel. All others are
packed as one string of words and sent to the bucket of their minimiser, where the windows
are sorted by their words and each sequence gets its smallest document. A minimiser shared
by more than ``hot`` texts, or by more than ``hot_windows`` windows in all, would make a bucket too large for a task; of its super-k-mers each
distinct string (told by a 128-bit hash) is kept once with its smallest document and cut into runs of
``piece`` windows; of these again each distinct one is kept once and cut into windows, dealt
by a 128-bit hash and reduced on the map side.

Equal texts are told by a 128-bit hash beforehand: all but the first lose every covered
word, and only the first one's windows are looked at.

A word is removed if a window that covers it also starts in a document with a smaller id.
Defined results: a null text has no words; a text shorter than a window loses nothing; texts of
any length are read whole; rows with one id do not dedup each other, whether their texts are
equal or not, and each loses its own words; rows with a null id lose nothing and take nothing;
an empty table gives an empty result; other columns are not looked at.

A row is told by its id and a 64-bit hash of its text; rows that share both have the same words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, Words, chunks, cut, grams, join_groups, parts, rolling, ship, text_bytes, text_hash, written


def _window_min(g: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of ``w`` values."""
    k = 1
    a = g
    while 2 * k <= w:
        a = np.minimum(a[:-k], a[k:])
        k *= 2
    return np.minimum(a[: len(g) - w + 1], a[w - k : w - k + len(g) - w + 1]) if w > k else a


def super_kmers(texts: list[bytes], width: int, mer: int):
    """For runs of texts: (Words, from, text number, minimiser, first word, number of windows) arrays.

    Text numbers and word numbers count within the run, which begins at text ``from``.
    """
    for i, j in chunks(texts):
        w = Words(texts[i:j], lower=False)
        n = len(w.start)
        if n < width:
            continue
        h = w.hashes()
        g = np.full(n - mer + 1, np.uint64(0xFFFFFFFFFFFFFFFF))
        v, at = grams(h, w.doc, mer)
        g[at] = v
        low = _window_min(g, width - mer + 1)
        ok = np.flatnonzero(w.doc[: n - width + 1] == w.doc[width - 1 :])
        if not len(ok):
            continue
        m, d = low[ok], w.doc[ok]
        new = np.concatenate(([True], (m[1:] != m[:-1]) | (ok[1:] != ok[:-1] + 1) | (d[1:] != d[:-1])))
        s = np.flatnonzero(new)
        yield w, i, h, d[s], m[s].view(np.int64), ok[s], np.diff(np.concatenate((s, [len(ok)])))


def _marks(docs: DataFrame, width: int, mer: int) -> DataFrame:
    """docs: doc_id, t, text. (doc_id, t, digest, mins: array of (m, windows)) of each row."""

    def run(batches):
        for b in batches:
            texts = text_bytes(b.column(2))
            mins: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(texts)
            for _, i, _, d, m, _, n in super_kmers(texts, width, mer):
                ends = np.searchsorted(d, np.arange(d[-1] + 2))
                for k in range(d[0], d[-1] + 1):
                    if ends[k] < ends[k + 1]:
                        own, at = np.unique(m[ends[k] : ends[k + 1]], return_inverse=True)
                        mins[i + k] = own, np.bincount(at, n[ends[k] : ends[k + 1]]).astype(np.int64)
            off = pa.array(np.concatenate(([0], np.cumsum([len(x) for x, _ in mins]))), pa.int32())
            flat = [pa.array(np.concatenate([np.zeros(0, np.int64), *(x[j] for x in mins)]), pa.int64()) for j in (0, 1)]
            digest = pa.array([hashlib.blake2b(b" ".join(t.split()), digest_size=16).digest() for t in texts], pa.binary())
            lists = pa.ListArray.from_arrays(off, pa.StructArray.from_arrays(flat, names=["m", "n"]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), digest, lists], names=["doc_id", "t", "digest", "mins"])

    return docs.select("doc_id", "t", "text").mapInArrow(run, "doc_id long, t long, digest binary, mins array<struct<m:long,n:long>>")


def _sent(docs: DataFrame, width: int, mer: int) -> DataFrame:
    """docs: doc_id, t, text, shared (array of minimisers), hot (those whose buckets are split).

    Super-k-mers (doc_id, t, m, at, n windows, words, k): k is a 128-bit hash of the words where m is hot, else null.
    """

    def run(batches):
        for b in batches:
            ids, keys, texts = b.column("doc_id").to_numpy(), b.column("t").to_numpy(), text_bytes(b.column("text"))
            shared, hot = b.column("shared"), b.column("hot")
            for w, i, _, d, m, at, n in super_kmers(texts, width, mer):
                out: tuple[list, ...] = ([], [], [], [], [], [], [])
                raw = w.buf.tobytes()
                done = -1
                for k in range(len(d)):
                    if d[k] != done:
                        done = d[k]
                        own = set(shared[i + int(done)].as_py() or ())
                        burning = set(hot[i + int(done)].as_py() or ())
                    x = int(m[k])
                    if x not in own:
                        continue
                    a, c = int(at[k]), int(n[k])
                    words = b" ".join(raw[int(w.start[a]) : int(w.end[a + c + width - 2])].split())
                    for to, v in zip(out, (ids[i + int(done)], keys[i + int(done)], x, a - int(w.first[d[k]]), c, words, hashlib.blake2b(words, digest_size=16).digest() if x in burning else None), strict=True):
                        to.append(v)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["doc_id", "t", "m", "at", "n", "words", "k"])

    return docs.mapInArrow(run, "doc_id long, t long, m long, at int, n int, words binary, k binary")


def _windows(contents: DataFrame, width: int) -> DataFrame:
    """contents: k, lo, words. A row for each window: (k, lo, i, w1, w2), 128 bits of hash."""

    def run(batches):
        for b in batches:
            texts = text_bytes(b.column("words"))
            for i, j in chunks(texts):
                w = Words(texts[i:j], lower=False)
                r1, at = rolling(w.hashes("a"), w.doc, width, "a")
                r2, _ = rolling(w.hashes("b"), w.doc, width, "b")
                own = w.doc[at]
                take = pa.array(i + own)
                yield pa.RecordBatch.from_arrays([b.column("k").take(take), b.column("lo").take(take), pa.array((at - w.first[own]).astype(np.int32)), pa.array(r1.view(np.int64)), pa.array(r2.view(np.int64))], names=["k", "lo", "i", "w1", "w2"])

    return contents.select("k", "lo", "words").mapInArrow(run, "k binary, lo long, i int, w1 long, w2 long")


def _pieces(contents: DataFrame, width: int, piece: int) -> DataFrame:
    """contents: k, lo, words. Cut into runs of ``piece`` windows: (k, lo, i, n, kp, words), kp a hash of the run's words.

    Runs overlap by a window less a word, so they are far larger than what they are cut from: they leave in batches of bounded size.
    """
    kinds = (pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    packed = lambda out: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["k", "lo", "i", "n", "kp", "words"])

    def run(batches):
        out: tuple[list, ...] = ([], [], [], [], [], [])
        held = 0
        for b in batches:
            for k, lo, words in zip(b.column("k"), b.column("lo"), b.column("words"), strict=True):
                k, lo, ws = k.as_py(), lo.as_py(), words.as_py().split(b" ")
                n = len(ws) - width + 1
                for i in range(0, n, piece):
                    c = min(piece, n - i)
                    part = b" ".join(ws[i : i + c + width - 1])
                    for to, v in zip(out, (k, lo, i, c, hashlib.blake2b(part, digest_size=16).digest(), part), strict=True):
                        to.append(v)
                    held += len(part)
                    if held > 4 * CHUNK_BYTES:
                        yield packed(out)
                        out, held = ([], [], [], [], [], []), 0
        yield packed(out)

    return contents.select("k", "lo", "words").mapInArrow(run, "k binary, lo long, i int, n int, kp binary, words binary")


def _bucket(rows: list[tuple[int, int, int, bytes]], width: int):
    """Rows (doc, t, at, words) of one minimiser: (doc, t, from, to) of words to be removed."""
    windows = []
    for k, (doc, _, _, words) in enumerate(rows):
        ws = words.split(b" ")
        windows.extend((b" ".join(ws[i : i + width]), doc, k, i) for i in range(len(ws) - width + 1))
    windows.sort()
    spans: dict[int, list[int]] = {}
    last, lowest = None, 0
    for seq, doc, k, i in windows:
        if seq != last:
            last, lowest = seq, doc
        elif doc > lowest:
            spans.setdefault(k, []).append(i)
    for k, starts in spans.items():
        doc, t, at, _ = rows[k]
        starts.sort()
        lo = hi = starts[0]
        for s in starts[1:]:
            if s > hi + 1:
                yield doc, t, at + lo, at + hi + width
                lo = s
            hi = s
        yield doc, t, at + lo, at + hi + width


def _counted(sent: DataFrame, width: int) -> DataFrame:
    def run(batches):
        own: list[tuple[int, int, int, bytes]] = []
        now = None
        for b in batches:
            out: list[tuple[int, int, int, int]] = []
            for doc, t, m, at, words in zip(*(b.column(c).to_pylist() for c in ("doc_id", "t", "m", "at", "words")), strict=True):
                if m != now:
                    out.extend(_bucket(own, width) if len(own) > 1 else ())
                    own, now = [], m
                own.append((doc, t, at, words))
            yield _spans(out)
        if len(own) > 1:
            yield _spans(list(_bucket(own, width)))

    return sent.mapInArrow(run, "doc_id long, t long, a int, b int")


def _spans(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "t", "a", "b"])


def repeated_spans(docs: DataFrame, width: int = 50, mer: int = 8, hot: int = 64, hot_windows: int = 100_000, piece: int = 5) -> DataFrame:
    """docs: doc_id, t, text. One row for each (doc_id, t) that loses words: (doc_id, t, spans: array of (a, b)), null spans for all words."""
    spark = docs.sparkSession
    ship(spark)
    marks = written(_marks(docs.where("doc_id is not null"), width, mer))
    some = marks.where(F.size("mins") > 0)
    firsts = cut(some.groupBy("digest").agg(F.min("doc_id").alias("lowest"), F.count("*").alias("c")).where("c > 1"))
    named = join_groups(some, firsts, ["digest"], "c").withColumn("lowest", F.coalesce("lowest", "doc_id"))
    copies = named.where("doc_id > lowest").select("doc_id", "t").distinct().withColumn("spans", F.lit(None).cast("array<struct<a:int,b:int>>"))
    own = named.where("doc_id = lowest").select("doc_id", "t", F.explode("mins").alias("x")).select("doc_id", "t", "x.m", "x.n").distinct()
    shared = own.groupBy("m").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("c"), F.sum("n").alias("n")).where("lo < hi").select("m", ((F.col("c") > hot) | (F.col("n") > hot_windows)).alias("burns"))
    lists = own.join(shared, "m").groupBy("doc_id", "t").agg(F.collect_list("m").alias("shared"), F.collect_list(F.when(F.col("burns"), F.col("m"))).alias("hot"))
    texts = docs.select("doc_id", "t", "text").join(lists, ["doc_id", "t"])
    sent = written(_sent(texts, width, mer))
    cold = sent.where("k is null").select("doc_id", "t", "m", "at", "words").repartition(parts(docs), "m").sortWithinPartitions("m")
    spans = _counted(cold, width)
    # hot ones: each distinct string once, each distinct run of its windows once, then back to where the string occurs
    burning = sent.where("k is not null").select("doc_id", "t", "at", "n", "k", "words")
    contents = written(burning.groupBy("k").agg(F.min("doc_id").alias("lo"), F.min("words").alias("words")))
    cuts = written(_pieces(contents, width, piece))
    parts_ = written(cuts.groupBy("kp").agg(F.min("lo").alias("least"), F.min("words").alias("words")))
    known = cuts.select("k", "lo", "i", "n", "kp").join(parts_.select("kp", "least"), "kp")
    earlier = known.where("least < lo").select("k", "i", "n")
    windows = written(_windows(parts_.select(F.col("kp").alias("k"), F.col("least").alias("lo"), "words"), width))
    lowest = windows.groupBy("w1", "w2").agg(F.min("lo").alias("least"), F.max("lo").alias("most")).where("least < most").select("w1", "w2", "least")
    late = windows.join(lowest, ["w1", "w2"]).where("least < lo").select(F.col("k").alias("kp"), F.col("i").alias("j"))
    some = earlier.unionByName(known.where("least = lo").select("k", "i", "kp").join(late, "kp").select("k", (F.col("i") + F.col("j")).alias("i"), F.lit(1).alias("n")))
    again = burning.select("doc_id", "t", "at", "n", "k").join(contents.select("k", "lo"), "k")
    whole = again.where("doc_id > lo").select("doc_id", "t", F.col("at").alias("a"), (F.col("at") + F.col("n") + (width - 1)).alias("b"))
    part = again.where("doc_id = lo").drop("n").join(some, "k").select("doc_id", "t", (F.col("at") + F.col("i")).alias("a"), (F.col("at") + F.col("i") + F.col("n") + (width - 1)).alias("b"))
    each = spans.unionByName(whole).unionByName(part).groupBy("doc_id", "t").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    return each.unionByName(copies)


def drop_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 50, mer: int = 8, hot: int = 64, hot_windows: int = 100_000) -> DataFrame:
    """(doc_id, text: kept words joined by one space, n_words, n_removed) for every row of ``docs``."""
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_hash(text).alias("t"), F.col(text).alias("text"))
    spans = repeated_spans(d, width, mer, hot, hot_windows).withColumn("hit", F.lit(True))

    def run(batches):
        for b in batches:
            kept, n, gone = [], [], []
            spans = b.column("spans")
            edges = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False))))
            flat, some = spans.flatten(), spans.is_valid().to_numpy(zero_copy_only=False)
            lo, hi = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("a", "b"))
            for k, (t, hit) in enumerate(zip(text_bytes(b.column("text")), b.column("hit").to_pylist(), strict=True)):
                words = t.split()
                n.append(len(words))
                if hit and not some[k]:
                    words = []
                elif hit:
                    steps = np.zeros(n[-1] + 1, np.int64)
                    np.add.at(steps, lo[edges[k] : edges[k + 1]], 1)
                    np.add.at(steps, hi[edges[k] : edges[k + 1]], -1)
                    words = [words[j] for j in np.flatnonzero(np.cumsum(steps[:-1]) == 0)]
                gone.append(n[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], names=["doc_id", "text", "n_words", "n_removed"])

    return d.join(spans, ["doc_id", "t"], "left").select("doc_id", "text", "spans", "hit").mapInArrow(run, "doc_id long, text string, n_words long, n_removed long")
