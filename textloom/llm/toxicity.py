"""Toxicity by class-conditional Kneser-Ney models.

One model of toxic and one of ordinary texts, each a chain of four orders with absolute
discounts: the class's pairs of words, the pairs of both classes together, the class's
single words, the single words of both. What an order discounts goes to the next one, so
that rare expressions are smoothed through counts that both models share and favour neither.
All counts are continuation counts: a word counts the distinct words before it, a pair the
distinct words before it, and a document adds one context (its first) to each, so that a
passage copied a thousand times, or a word that one text repeats, counts once. Discounts of
single words are those of counts of counts for one, two and more; a pair is discounted by
one whole count, so that a pair with a single context says nothing of a class; a word that
either class has fewer than ``least_context`` pairs after backs off at once.

The score is calibrated from length-normalised differences of the two log-likelihoods: of
the whole text, and of the best two of its windows of 1, 4 and 16 words, since a long text
is toxic if a small part of it is. No weight of the logistic calibration is negative.

What is learnt: from all labelled rows, counts and calibration alike. A row is labelled toxic if
any of its labels says so. Rows whose crc32 of the id mod 3 is 1 are never learnt from;
remainders 0 and 2 are the two folds. Counts come from both; the calibration sees each
fold's rows as models of the other fold judge them. The model is on the driver and in every task: all
words of these rows, told by 64-bit hashes (about 30 bytes each), and the pairs that have a
probability of their own (two contexts or more, after a word with enough pairs); it grows as
their vocabulary does.
Scoring covers every row and whole texts, however long.

Defined results: null and empty texts score as texts without words; null ids are held out
of learning; null labels are ignored; without labelled rows of both classes in both folds every
score is 0; rows that repeat an id are scored one by one; an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks, cut, ship, small, text_bytes, written

#: Bytes that end a word here: ASCII white space and these punctuation marks.
_PUNCTUATION = b".,!?;:\"()[]{}"
_TABLE = bytes(32 if i in b" \t\n\x0b\x0c\r" + _PUNCTUATION else i + 32 if 65 <= i <= 90 else i for i in range(256))
WIDTHS = (1, 4, 16)
FEATURES = 1 + len(WIDTHS)
#: Marks of what a model is learnt from, a fold or both, and of toxic, ordinary, shared.
FOLDS = {"0": 0b0101, "2": 0b1010, "all": 0b1111}
CLASSES = {"t": 0b0011, "o": 0b1100, "s": 0b1111}
#: Labelled rows up to which the join with the texts is by broadcast.
FEW_LABELS = 2_000_000


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the texts' words one after another, and how many each text has."""
    w = Words([t.translate(_TABLE) for t in texts], lower=False)
    return w.hashes(), np.diff(w.first)


def remainder(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def best_windows(x: np.ndarray, lens: np.ndarray, width: int) -> np.ndarray:
    """For each text the mean of its two disjoint windows of ``width`` with the largest means.

    x: the texts' words one after another, ``lens`` of each text, none 0. What a text is short of counts as 0.
    """
    starts = np.cumsum(lens) - lens
    out = np.add.reduceat(x, starts) / width / 2
    long = np.flatnonzero(lens > width)
    if not len(long):
        return out
    many = lens[long] - width + 1
    first = np.cumsum(many) - many
    place = np.arange(many.sum()) - np.repeat(first, many)
    at = place + np.repeat(starts[long], many)
    sums = np.concatenate(([0.0], np.cumsum(x)))
    m = (sums[at + width] - sums[at]) / width
    top = np.maximum.reduceat(m, first)
    hit = np.flatnonzero(m == np.repeat(top, many))
    _, one = np.unique(np.searchsorted(first, hit, side="right"), return_index=True)
    apart = np.abs(place - np.repeat(place[hit[one]], many)) >= width
    other = np.maximum.reduceat(np.where(apart, m, -np.inf), first)
    out[long] = (top + np.where(np.isinf(other), np.minimum(0.0, top), other)) / 2
    return out


class Index:
    """Numbers of words, from 1; 0 is what stands before a text, ``len`` any other word."""

    def __init__(self, hashes: np.ndarray, number: np.ndarray):
        self.hashes, self.number = hashes, number  # sorted; int32

    def __len__(self) -> int:
        return len(self.hashes) + 1

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(hashes), 1, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.number[at], len(self)).astype(np.int64)

    def __getitem__(self, word: bytes) -> int:
        got = int(self.numbers(word_hashes([word])[0])[0]) if word else 0
        if got == len(self):
            raise KeyError(word)
        return got


@dataclass
class Model:
    """The chain as arrays over word numbers (the last place is that of unseen words), and the calibration."""

    index: Index
    single: np.ndarray  # 2 x (words + 1): class probabilities of single words, toxic and ordinary
    slot: np.ndarray  # words + 1: a word's place in ``leave``, the last for all that have none of their own
    leave: np.ndarray  # 3 x places: what the pairs after a word leave to the next order: toxic, ordinary, shared
    pairs: np.ndarray  # sorted: number of the word before * (words + 1) + number of the word
    upper: np.ndarray  # 3 x pairs: discounted conditional probabilities, in the same order
    weights: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    def probabilities(self, before: np.ndarray, w: np.ndarray) -> np.ndarray:
        """2 x n: of words after the words before them."""
        top = np.zeros((3, len(w)))
        if len(self.pairs):
            keys = before * (len(self.index) + 1) + w
            at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
            top = np.where(self.pairs[at] == keys, self.upper[:, at], 0.0)
        leave = self.leave[:, self.slot[before]]
        shared = top[2] + leave[2] * self.single[:, w]
        return top[:2] + leave[:2] * shared

    def features(self, texts: list[bytes]) -> np.ndarray:
        """A row for each text."""
        out = np.zeros((len(texts), FEATURES))
        for i, j in chunks(texts):
            hashes, lens = word_hashes(texts[i:j])
            some = np.flatnonzero(lens)
            if not len(some):
                continue
            lens = lens[some]
            starts = np.cumsum(lens) - lens
            w = self.index.numbers(hashes)
            before = np.r_[0, w[:-1]]
            before[starts] = 0
            p = self.probabilities(before, w)
            x = np.log(p[0] / p[1])
            out[i + some] = np.stack([np.add.reduceat(x, starts) / lens, *(best_windows(x, lens, k) for k in WIDTHS)], 1)
        return out

    def scores(self, features: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.zeros(len(features))
        z = (features - self.centre) / self.scale
        return 1 / (1 + np.exp(-np.clip(np.c_[z, np.ones(len(z))] @ self.weights, -30, 30)))


def discounts(counts: np.ndarray) -> np.ndarray:
    """How much a count loses: by the counts of counts for one, two, and three or more."""
    n1, n2, n3, n4 = (int((counts == k).sum()) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    low, high = np.array([0.1, 0.1, 0.1]), np.array([1.0, 2.0, 3.0])
    return np.minimum(counts, np.clip(d, low, high)[np.clip(counts.astype(int), 1, 3) - 1])


def kneser_ney(index: Index, singles: np.ndarray, places: np.ndarray, contexts: np.ndarray, before: np.ndarray, after: np.ndarray, counts: np.ndarray, least_context: int = 20) -> Model:
    """A model without calibration, from continuation counts in the order toxic, ordinary, shared.

    singles: 3 x words. places: the words that may have enough pairs after them; contexts: 6 x
    these, for the pairs after a word the sum of their counts and how many there are, for each
    of the three. before, after: word numbers of the pairs with
    a shared count of two or more after words of ``places``, the others being discounted whole; counts: 3 x pairs.
    """
    n = len(index)
    pool = singles[2].astype(float)
    once, twice = int((pool == 1).sum()), int((pool == 2).sum())
    d = once / (once + 2 * twice) if once else 0.5
    known = int((pool > 0).sum())
    unseen = d * known / pool.sum() / (known + 1)
    shared = np.append(np.maximum(pool - d, 0) / pool.sum() + unseen, unseen)  # a word that only the other fold has is unseen here
    single = []
    for own in singles[:2].astype(float):
        lost = discounts(own)
        single.append(np.append((own - lost) / own.sum(), 0.0) + lost.sum() / own.sum() * shared)
    total, kinds = contexts[:3].astype(float), contexts[3:].astype(float)
    used = (total[:2] >= least_context).all(0)
    leave = np.where(used, kinds / np.maximum(total, 1), 1.0)
    keys = before.astype(np.int64) * (n + 1) + after
    order = np.argsort(keys)
    slot = np.full(n + 1, len(places), np.int32)
    slot[places] = np.arange(len(places))
    at = slot[before]
    upper = np.where(used[at], np.maximum(counts - 1.0, 0) / np.maximum(total[:, at], 1), 0.0)
    order = order[(upper[:, order] > 0).any(0)]
    return Model(index, np.stack(single), slot, np.c_[leave, np.ones(3)], keys[order], upper[:, order].astype(np.float32), np.zeros(0), np.zeros(0), np.ones(0))


def _vocabulary(rows: DataFrame) -> Index:
    """The words of ``rows`` (column text), those of many batches first."""

    def run(batches):
        for b in batches:
            texts = text_bytes(b.column(0))
            found = [np.unique(word_hashes(texts[i:j])[0]) for i, j in chunks(texts)]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([np.zeros(0, np.uint64), *found])).view(np.int64))], names=["h"])

    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in _rows(rows.select("text").mapInArrow(run, "h long").groupBy("h").agg(F.count("*").cast("int").alias("n")))]
    h = np.concatenate([np.zeros(0, np.int64), *(x[0] for x in got)]).view(np.uint64)
    n = np.concatenate([np.zeros(0, np.int32), *(x[1] for x in got)])
    order = np.argsort(h)
    h, n = h[order], n[order]
    number = np.empty(len(h), np.int32)
    number[np.argsort(-n, kind="stable")] = np.arange(1, len(h) + 1)
    return Index(h, number)


def triples(ids: np.ndarray, lens: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts as word numbers one after another: (v << 32 | w, u, marks) of words u v w in a row, each pair v w once a text.

    marks: the texts' bits or-ed, and 16 times those of the texts where w was new there.
    """
    lens, bits = lens[lens > 0], bits[lens > 0]
    if not len(lens):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.cumsum(lens) - lens
    doc = np.repeat(np.arange(len(lens)), lens)
    v = np.r_[0, ids[:-1]]
    v[starts] = 0
    u = np.r_[0, v[:-1]]
    u[starts] = 0
    kinds, kind = np.unique(v << 32 | ids, return_inverse=True)
    _, at = np.unique(doc * len(kinds) + kind, return_index=True)
    fresh = np.zeros(len(ids), bool)
    many = int(ids.max()) + 1
    fresh[np.unique(doc * many + ids, return_index=True)[1]] = True
    keys, place = np.unique(kind[at] * many + u[at], return_inverse=True)
    marks = np.zeros(len(keys), np.int64)
    np.bitwise_or.at(marks, place, bits[doc[at]] * np.where(fresh[at], 17, 1))
    return kinds[keys // many], keys % many, marks


def _contexts(rows: DataFrame, index) -> DataFrame:
    """rows: y, r, text; index: broadcast numbers of words. (p, x) of each batch: the ``triples``, x being u << 8 | marks."""

    def run(batches):
        for batch in batches:
            texts = text_bytes(batch.column(2))
            bits = 1 << (2 * (1 - batch.column(0).to_numpy().astype(np.int64)) + (batch.column(1).to_numpy() == 2))
            for i, j in chunks(texts):
                hashes, lens = word_hashes(texts[i:j])
                p, u, marks = triples(index.value.numbers(hashes), lens, bits[i:j])
                yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(u << 8 | marks)], names=["p", "x"])

    return rows.select("y", "r", "text").mapInArrow(run, "p long, x long")


def _cells(bits: Column) -> list[tuple[str, Column]]:
    """For each side and each of toxic, ordinary, shared whether one of its bits is set."""
    return [(f"{c}_{s}", (bits.bitwiseAND(F.lit(m & k)) != 0).cast("int")) for s, m in FOLDS.items() for c, k in CLASSES.items()]


def _rows(df: DataFrame):
    """Record batches of ``df``, brought to the driver a partition at a time."""

    def run(batches):
        for b in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema) as out:
                out.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["part"])

    for x in df.mapInArrow(run, "part binary").toLocalIterator():
        yield from pa.ipc.open_stream(bytes(x["part"]))


class _Counts:
    """Continuation counts of the learnt rows as arrays on the driver, of pairs only those that any model uses."""

    def __init__(self, rows: DataFrame, least_context: int):
        sc = rows.sparkSession.sparkContext
        self.least_context = least_context
        self.index = _vocabulary(rows)
        sent = sc.broadcast(self.index)  # the vocabulary
        # dealt by pair once, for both aggregates
        each = _contexts(rows, sent).repartition("p").groupBy("p", F.shiftright("x", 8).alias("u")).agg(F.bit_or(F.col("x").bitwiseAND(F.lit(255))).alias("m"))
        each = each.select("p", F.col("m").bitwiseAND(F.lit(15)).alias("b"), F.shiftright("m", 4).alias("f"))
        pairs = each.groupBy("p").agg(F.bit_or("f").cast("int").alias("f"), *[F.sum(x).cast("int").alias(c) for c, x in _cells(F.col("b"))])
        names = [c for c, _ in _cells(F.lit(0))]
        pairs = written(pairs.select(F.shiftright("p", 32).cast("int").alias("v"), F.col("p").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("w"), "f", *names), "zstd")
        sent.unpersist()
        # singles as a histogram of marks
        self.singles = self._table(pairs.groupBy("w", "f").agg(F.count("*").cast("int").alias("n")), ["w", "f", "n"])
        enough = pairs.groupBy("v").agg(F.sum("t_all").alias("t"), F.sum("o_all").alias("o")).where(F.least("t", "o") >= least_context)
        self.places = np.sort(self._table(enough, ["v"])["v"])
        chosen = np.zeros(len(self.index), bool)
        chosen[self.places] = True
        used = sc.broadcast(chosen)

        def own(batches):
            for b in batches:
                yield b.filter(pa.array(used.value[b.column(0).to_numpy()]))

        some = pairs.select("v", "w", *names)
        some = some.mapInArrow(own, some.schema)
        sums = some.groupBy("v").agg(*[F.sum(c).cast("int").alias(c) for c in names], *[F.count_if(F.col(c) > 0).cast("int").alias(f"k_{c}") for c in names])
        got = self._table(sums, ["v", *names, *(f"k_{c}" for c in names)])
        order = np.argsort(got["v"])
        self.contexts = {c: x[order] for c, x in got.items()}
        self.pairs = self._table(some.where("s_all > 1"), ["v", "w", *names])
        used.unpersist()

    def _table(self, df: DataFrame, names: list[str]) -> dict[str, np.ndarray]:
        parts = [[b.column(c).to_numpy() for c in names] for b in _rows(df.select(*names))]
        return {c: np.concatenate([np.zeros(0, np.int32), *(p[k] for p in parts)]) for k, c in enumerate(names)}

    def _single(self, marks: int) -> np.ndarray:
        """For each word the contexts with any of these marks."""
        some = (self.singles["f"] & marks) != 0
        return np.bincount(self.singles["w"][some], self.singles["n"][some], len(self.index)).astype(np.int32)

    def model(self, side: str) -> Model | None:
        """The model of a side's counts; None if it lacks a class."""
        singles = np.stack([self._single(FOLDS[side] & CLASSES[c]) for c in "tos"])
        if not singles[0].any() or not singles[1].any():
            return None
        contexts = np.stack([self.contexts[f"{k}{c}_{side}"] for k in ("", "k_") for c in "tos"])
        return kneser_ney(self.index, singles, self.places, contexts, self.pairs["v"], self.pairs["w"], np.stack([self.pairs[f"{c}_{side}"] for c in "tos"]), self.least_context)


def _sums(rows: DataFrame, of) -> np.ndarray:
    """The sum over all batches of ``rows`` (y, then features) of the array that ``of`` makes of features and y."""

    def run(batches):
        total = None
        for b in batches:
            x = np.stack([c.to_numpy() for c in b.columns[1:]], 1)
            got = of(x, b.column(0).to_numpy().astype(np.float64))
            total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["s"])

    return np.sum([x["s"] for x in rows.mapInArrow(run, "s array<double>").collect()], axis=0)


def logistic(rows: DataFrame, ridge: float = 0.05, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (intercept last), centre and scale, from ``rows`` (y, then features) by Newton steps, each a sum over all rows; features whose weight would be negative get none."""
    first = _sums(rows, lambda x, y: np.r_[len(x), x.sum(0)])
    n, centre = first[0], first[1:] / first[0]
    scale = np.sqrt(_sums(rows, lambda x, y: ((x - centre) ** 2).sum(0)) / n) + 1e-9
    on = list(range(len(centre)))
    while True:
        w = np.zeros(len(on) + 1)
        penalty = np.r_[np.full(len(on), ridge), 1e-6]
        for _ in range(rounds):

            def slopes(x, y, w=w, on=tuple(on)):
                z = np.c_[((x - centre) / scale)[:, on], np.ones(len(x))]
                p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
                return np.r_[z.T @ (p - y), ((z * (p * (1 - p))[:, None]).T @ z).ravel()]

            got = _sums(rows, slopes)
            g = got[: len(w)] + penalty * w
            step = np.linalg.solve(got[len(w) :].reshape(len(w), -1) + np.diag(penalty), g)
            w = w - step
            if np.abs(step).max() < 1e-8:
                break
        if (w[:-1] >= 0).all():
            full = np.zeros(len(centre) + 1)
            full[[*on, -1]] = w
            return full, centre, scale
        on = [k for k, v in zip(on, w[:-1], strict=True) if v >= 0]


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", least_context: int = 20) -> Model:
    """A model from ``docs`` joined with ``labels``; see the module's text for what it may see."""
    ship(docs.sparkSession)
    marked = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max(label).cast("int").alias("y"))
    marked = cut(marked.withColumn("r", remainder("id").cast("int")).where("r != 1 and y in (0, 1)"))
    n = {(x["y"], x["r"]): x["n"] for x in marked.groupBy("y", "r").agg(F.count("*").alias("n")).collect()}
    nothing = Model(Index(np.zeros(0, np.uint64), np.zeros(0, np.int32)), np.ones((2, 2)), np.zeros(2, np.int32), np.ones((3, 1)), np.zeros(0, np.int64), np.zeros((3, 0)), np.zeros(0), np.zeros(0), np.ones(0))
    if not all(n.get((y, r)) for y in (0, 1) for r in (0, 2)):
        return nothing
    own = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where(remainder("id") != 1)
    rows = written(own.join(small(marked, FEW_LABELS), "id").select("y", "r", "text"), "zstd")
    counts = _Counts(rows, least_context)
    folds = {0: counts.model("2"), 2: counts.model("0")}  # each fold is judged by the other
    if not all(folds.values()):
        return nothing
    sent = docs.sparkSession.sparkContext.broadcast(folds)  # the models
    del folds
    names = [f"f{k}" for k in range(FEATURES)]

    def run(batches):
        m = sent.value
        for b in batches:
            fold, texts = b.column(1).to_numpy(), text_bytes(b.column(2))
            f = np.zeros((len(texts), FEATURES))
            for r in m:
                own = np.flatnonzero(fold == r)
                f[own] = m[r].features([texts[k] for k in own])
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(f[:, k]) for k in range(FEATURES))], names=["y", *names])

    judged = written(rows.mapInArrow(run, ", ".join(["y int", *(f"{k} double" for k in names)])))
    sent.unpersist()
    model = counts.model("all")
    if judged.agg(F.count_distinct("y")).first()[0] == 2:
        model.weights, model.centre, model.scale = logistic(judged)
    return model


def score_documents(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for b in batches:
            scores = m.scores(m.features(text_bytes(b.column(1))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    got = d.mapInArrow(run, f"doc_id {dict(d.dtypes)['doc_id']}, score double")
    return got.select("doc_id", F.coalesce(remainder("doc_id") == 1, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
