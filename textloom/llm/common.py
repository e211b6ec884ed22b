"""Shared pieces of the training-data operators: sessions, hashing of words in bulk, components.

Words everywhere in this subpackage are maximal runs of characters other than the six
ASCII white-space characters (space, tab, newline, vertical tab, form feed, carriage return).
"""

from __future__ import annotations

import os
import tempfile
import uuid
import warnings
import zipfile

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SPLIT = r"[\x20\x09-\x0D]+"
#: Bytes of text that one vectorised step takes at a time; bounds a worker's memory.
CHUNK_BYTES = 500_000
#: Rows of an Arrow batch: texts can be long, and a batch is held whole by a Python worker.
BATCH_ROWS = 1000
_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each Spark application; keep the session's Arrow batches small."""
    sc = spark.sparkContext
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.basename(root)
    path = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"{name}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.join(name, os.path.relpath(full, root)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def durable(spark: SparkSession) -> None:
    """See that checkpoint() has a folder: the cluster's if it names one, else a local one (tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        warnings.warn("spark.checkpoint.dir is not set: checkpoints go to a folder of the driver's machine", stacklevel=3)
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from there, so that lost executors cost little."""
    durable(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """As ``cut``, as a table in the checkpoint folder: columns of small numbers take a fraction of the space there."""
    spark = df.sparkSession
    durable(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.parquet(path)


#: Groups with more than this part of all grouped rows (one over the number) are few enough to be broadcast.
HUB_PART = 100_000


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], size: str) -> DataFrame:
    """``rows`` left-joined with ``groups`` (materialised; one row for each value of ``on``, ``size`` rows of its own).

    The largest groups, at most HUB_PART of them whatever the input, are broadcast, so that the
    rows of none are gathered in a task; the others are joined by shuffle.
    """
    n = groups.agg(F.sum(size)).first()[0] or 0
    large = F.col(size) > n / HUB_PART
    got = rows.join(F.broadcast(groups.where(large)), on, "left")
    rest = got.where(F.col(size).isNull()).select(*rows.columns).join(groups.where(~large), on, "left")
    return got.where(F.col(size).isNotNull()).unionByName(rest)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of a file system that Spark knows."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def parts(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def free_name(name: str, taken) -> str:
    """``name``, with underscores appended while a column of ``taken`` has it (case does not tell names apart)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def text_hash(text: str) -> Column:
    """A 64-bit hash of a text, null counting as empty; with a row's id it tells rows apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def bind(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` or a lambda in it refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint if ``df`` (already materialised) has no more than ``rows`` rows; else ``df``."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


# ---------------------------------------------------------------- words of many texts at once

_WS = np.zeros(256, bool)
_WS[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE2 = np.uint64(0xC2B2AE3D27D4EB4F | 1)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (xor, shift, multiply), element by element."""
    x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    k = 1
    step = base
    while k < n:  # doubling: out[k:2k] = out[:k] * base**k
        m = min(k, n - k)
        out[k : k + m] = out[:m] * step
        step = step * step
        k += m
    return out


def _inverse(base: int) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


with np.errstate(over="ignore"):
    _POW = {"a": _powers(_BASE, 1 << 12), "b": _powers(_BASE2, 1 << 16)}
_INV = {"a": _inverse(_BASE), "b": _inverse(_BASE2)}
_INVPOW: dict[str, np.ndarray] = {"a": np.ones(1, np.uint64), "b": np.ones(1, np.uint64)}


def _grown(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        if len(_POW[kind]) < n:
            _POW[kind] = _powers(_BASE if kind == "a" else _BASE2, 2 * n)
        if len(_INVPOW[kind]) < n:
            _INVPOW[kind] = _powers(_INV[kind], 2 * n)
    return _POW[kind], _INVPOW[kind]


class Words:
    """The words of several texts: where they are, whose they are, and 64-bit hashes of them.

    ``buf`` holds the texts' bytes, each followed by a space. ``start`` and ``end`` are byte
    offsets of words, ``doc`` the number of the text, ``first`` where each text's words begin.
    """

    def __init__(self, texts: list[bytes], lower: bool):
        raw = b" ".join(texts) + b" "
        self.buf = np.frombuffer(raw, np.uint8)
        if lower:
            self.buf = _LOWER[self.buf]
        lens = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        ends = np.cumsum(lens)
        ws = _WS[self.buf]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], ws, [True])).view(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        self.doc = np.searchsorted(ends, self.start, side="right")
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))
        self._lens = lens

    def hashes(self, kind: str = "a") -> np.ndarray:
        """A hash of each word's bytes: polynomial over the bytes (odd base, modulo 2**64), then mixed."""
        n = len(self.buf)
        pw, inv = _grown(kind, n + 1)
        with np.errstate(over="ignore"):
            c = (self.buf.astype(np.uint64) + np.uint64(1)) * pw[:n]
            pre = np.concatenate((np.zeros(1, np.uint64), np.cumsum(c, dtype=np.uint64)))
            h = (pre[self.end] - pre[self.start]) * inv[self.start]
            return mix(h + (self.end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def grams(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words inside one text, and where each run starts."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        g = np.zeros(len(h) - n + 1, np.uint64)
        for j in range(n):
            g = mix(g * np.uint64(0x9FB21C651E98DF25) + h[j : j + len(g)])
    at = np.flatnonzero(doc[: len(g)] == doc[n - 1 :])
    return g[at], at


def rolling(h: np.ndarray, doc: np.ndarray, n: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """As ``grams`` for long runs: one pass, whatever ``n`` is."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    pw, inv = _grown(kind, len(h) + 1)
    with np.errstate(over="ignore"):
        pre = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * pw[: len(h)], dtype=np.uint64)))
        at = np.flatnonzero(doc[: len(h) - n + 1] == doc[n - 1 :])
        return mix((pre[at + n] - pre[at]) * inv[at], n), at


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is the empty text."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES):
    """Runs (from, to) of texts of about ``limit`` bytes; a longer text is a run of its own."""
    i = 0
    while i < len(texts):
        j, total = i, 0
        while j < len(texts) and (j == i or total + len(texts[j]) <= limit):
            total += len(texts[j])
            j += 1
        yield i, j
        i = j


# ---------------------------------------------------------------- components

def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components by joins: each node with the smallest node it can reach.

    edges: columns a, b (long). Returns (node, component_id), for nodes that have an edge only.
    Alternates large-star and small-star steps (links go to the smallest neighbour, first
    for larger neighbours, then for smaller ones) until nothing changes; each round is
    written to the checkpoint folder. A hub's neighbours are never gathered in one row.
    """
    spark = edges.sparkSession
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    e = cut(e)
    before = None
    for _ in range(rounds):
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every neighbour above u hangs from the smallest node around u
        star = both.where("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()
        # small star: u and its smaller neighbours hang from the smallest of them
        least = star.groupBy("b").agg(F.min("a").alias("m"))
        j = star.join(least, "b")
        e = cut(j.select(F.col("m").alias("a"), F.col("b")).union(j.select(F.col("m").alias("a"), F.col("a").alias("b"))).where("a < b").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    tops = e.groupBy("b").agg(F.min("a").alias("component_id")).withColumnRenamed("b", "node")
    roots = e.select(F.col("a").alias("node")).distinct().join(tops.select("node"), "node", "left_anti").withColumn("component_id", F.col("node"))
    return tops.unionByName(roots)


def keep(df: DataFrame) -> DataFrame:
    return df.persist(StorageLevel.DISK_ONLY)
