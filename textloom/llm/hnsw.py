"""Near-duplicate vectors: one navigable small-world graph, cells around its upper nodes, exact cosine.

Equal vectors are one node. A hash draws the nodes of the upper levels (one in ``cell_rows``,
at most ``most_pivots`` of them and ``pivot_bytes``; of two that link only one stays, so that a
large group of near copies doesn't draw many). They make a hierarchical navigable small-world
graph (levels drawn from a hash, neighbours chosen for closeness and diversity, links both
ways), which is sent to every task. A greedy descent through its levels, then a beam on its
lowest one finds for every node the upper nodes nearest to it, closest first. The first is
the node's home: the nodes of one home are a cell, the graph's lowest neighbourhood. A node asks the
cells of its first ``probes`` upper nodes, by matrix products, so work grows as the input and
not as its square. A pair is found if either of the two asks the other's cell; a link that only
one of them sees counts for both. Pairs within rounding of the threshold are verified by
cosine in double precision.

How many cells a node asks is measured before: the links of ``audits`` nodes, drawn by hash, are
counted against all nodes, and the fewest probes are taken that lose at most half of what
``target`` allows, of all links and of each node's on average. If too few of them link, probes at
exactly the threshold must be found instead. If no beam is wide enough, every node
asks every cell. What the audits saw is returned on request.

A cell is answered in units of at most ``unit_rows`` nodes and as many that ask, each unit with
a count for every node and a spanning forest of its links: never the pairs of a large group. The
forests' union is what components are made of.

Cosines are of vectors scaled by a power of two, so that large and small components neither
over- nor underflow.

Defined results: vectors that are null, empty, zero or hold null or non-finite components
link with nothing; vectors of different length never link; equal vectors link with each
other; rows with a null id are returned with no links, component null and kept true; rows
that repeat an id count as vectors of their own, each with the links of its vector; an empty
table gives an empty result; other columns are not looked at. The input is read three times.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, join_groups, mix, ship, written

#: Links of a node on the lowest level and above.
LINKS_0, LINKS = 32, 16
BLOCK = 256
#: Numbers of a block of similarities.
BLOCK_CELLS = 4_000_000
#: Linked nodes that the audits must see, else probes at the threshold stand in; the part of these that must be found.
SEEN, PROBED = 20, 0.9
#: The least recall at which a beam is not replaced by the whole table, and the cells up to which it is replaced in any case.
LEAST_RECALL, FEW_CELLS = 0.9, 64


def scaled(raw: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that the largest component is between 0.5 and 1."""
    _, e = np.frexp(np.abs(raw).max(1, initial=0.0))
    return np.ldexp(raw, -e[:, None])


class Forest:
    """Disjoint sets of numbers, the smallest of a set being its root."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, others: list[int]) -> None:
        r = self.root(a)
        for b in others:
            s = self.root(b)
            if s != r:
                r, s = min(r, s), max(r, s)
                self.up[s] = r


class Graph:
    """A navigable small-world graph over the rows of ``x`` (float32, of unit length). tags: hashes that levels and order are drawn from."""

    def __init__(self, x: np.ndarray, tags: np.ndarray):
        self.x = x
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # (nodes, links as places in nodes), lowest first
        if len(x):
            u = (mix(tags.astype(np.int64).view(np.uint64), 41) >> np.uint64(11)).astype(np.float64) / 2**53
            level = np.floor(-np.log(np.maximum(u, 1e-300)) / math.log(LINKS)).astype(int)
            order = np.argsort(mix(tags.astype(np.int64).view(np.uint64), 42), kind="stable")
            built = []
            for l in range(int(level.max(initial=0)), -1, -1):
                nodes = order[level[order] >= l]
                built.append((nodes, self._build(nodes, LINKS_0 if l == 0 else LINKS)))
            self.levels = built[::-1]

    def _select(self, x: np.ndarray, base: np.ndarray, cand: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
        """For rows of candidates (places, -1 for none) the m to link to: close ones that no closer chosen one is nearer to, then the closest."""
        order = np.argsort(-np.where(cand < 0, -9.0, sims), axis=1, kind="stable")[:, : 3 * m]
        cand = np.take_along_axis(cand, order, 1)
        sims = np.where(cand < 0, -9.0, np.take_along_axis(sims, order, 1))
        v = x[base[np.maximum(cand, 0)]]
        near = v @ v.transpose(0, 2, 1)
        b, c = cand.shape
        chosen = np.zeros((b, c), bool)
        for j in range(c):
            worse = (near[:, j, :] > sims[:, j, None]) & chosen
            chosen[:, j] = (cand[:, j] >= 0) & ~worse.any(1) & (chosen.sum(1) < m)
        rank = np.argsort(-(chosen * 4.0 + (cand >= 0) * 2.0 + np.linspace(1, 0, c)[None, :]), axis=1, kind="stable")[:, :m]
        return np.take_along_axis(cand, rank, 1)

    def _build(self, nodes: np.ndarray, m: int) -> np.ndarray:
        n = len(nodes)
        links = np.full((n, m), -1, np.int32)
        x = self.x
        done = 0
        while done < n:
            size = min(n - done, 512 if not done else min(done, BLOCK))
            new = np.arange(done, done + size)
            q = x[nodes[new]]
            own = q @ q.T
            np.fill_diagonal(own, -9)
            k = min(size - 1, 2 * m)
            top = np.argpartition(-own, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((size, 0), int)
            cand, sims = (top + done).astype(np.int32), np.take_along_axis(own, top, 1)
            if done:
                c2, s2 = self._beam(q, nodes[:done], links[:done], 2 * m, self._entry(nodes, done, size))
                cand, sims = np.concatenate((cand, c2), 1), np.concatenate((sims, s2), 1)
            if cand.shape[1]:
                picked = self._select(x, nodes, cand, sims, m)
                links[new, : picked.shape[1]] = picked
                self._link_back(x, nodes, links, new, m)
            done += size
        return links

    @staticmethod
    def _entry(nodes: np.ndarray, done: int, size: int) -> np.ndarray:
        return np.tile(np.linspace(0, done - 1, min(done, 16)).astype(np.int32), (size, 1))

    def _link_back(self, x: np.ndarray, nodes: np.ndarray, links: np.ndarray, new: np.ndarray, m: int) -> None:
        src = np.repeat(new, links.shape[1])
        dst = links[new].ravel()
        ok = dst >= 0
        src, dst = src[ok], dst[ok]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        starts = np.flatnonzero(np.concatenate(([True], dst[1:] != dst[:-1])))
        count = np.diff(np.concatenate((starts, [len(dst)])))
        for a in range(0, len(starts), 1024):
            s, c = starts[a : a + 1024], count[a : a + 1024]
            to = dst[s]
            w = int(min(c.max(), 4 * m))
            extra = np.full((len(s), w), -1, np.int32)
            for j in range(w):
                has = c > j
                extra[has, j] = src[s[has] + j]
            cand = np.concatenate((links[to], extra), 1)
            dup = (extra[:, :, None] == links[to][:, None, :]).any(2)
            cand[:, m:][dup] = -1
            sims = np.einsum("bd,bkd->bk", x[nodes[to]], x[nodes[np.maximum(cand, 0)]])
            links[to] = self._select(x, nodes, cand, sims, m)

    def _beam(self, q: np.ndarray, nodes: np.ndarray, links: np.ndarray, ef: int, entry: np.ndarray, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of a block of queries: (places, similarities), -1 where there are fewer than ef."""
        b, n = len(q), len(nodes)
        ef = min(ef, n)
        seen = np.zeros((b, n + 1), bool)  # the last column stands for no node
        seen[:, n] = True
        place = np.full((b, ef), -1, np.int32)
        sim = np.full((b, ef), -9.0, np.float32)
        open_ = np.zeros((b, ef), bool)

        def merge(rows: np.ndarray, new: np.ndarray) -> None:
            idx = np.where(new < 0, n, new)
            r = np.arange(len(rows))[:, None]
            fresh = ~seen[rows[:, None], idx]
            # of one place twice in a row only the first counts
            o = np.argsort(idx, axis=1, kind="stable")
            so = np.take_along_axis(idx, o, 1)
            twice = np.zeros_like(fresh)
            twice[r, o[:, 1:]] = so[:, 1:] == so[:, :-1]
            fresh &= ~twice
            seen[rows[:, None], idx] = True
            s = (self.x[nodes[np.minimum(idx, n - 1)]] @ q[rows][:, :, None])[:, :, 0]
            s = np.where(fresh, s, -9.0)
            p = np.concatenate((place[rows], np.where(fresh, new, -1)), 1)
            s = np.concatenate((sim[rows], s), 1)
            u = np.concatenate((open_[rows], fresh), 1)
            top = np.argpartition(-s, ef - 1, axis=1)[:, :ef]
            place[rows] = np.take_along_axis(p, top, 1)
            sim[rows] = np.take_along_axis(s, top, 1)
            open_[rows] = np.take_along_axis(u, top, 1)

        merge(np.arange(b), entry)
        live = np.arange(b)
        while len(live):
            s = np.where(open_[live], sim[live], -9.0)
            k = min(step, ef)
            top = np.argpartition(-s, k - 1, axis=1)[:, :k]
            go = np.take_along_axis(s, top, 1) > -5
            some = go.any(1)
            live, top, go = live[some], top[some], go[some]
            if not len(live):
                break
            at = np.where(go, np.take_along_axis(place[live], top, 1), 0)
            keep = open_[live]
            np.put_along_axis(keep, top, False, 1)
            open_[live] = keep
            new = links[at]
            new[~go] = -1
            merge(live, new.reshape(len(live), -1))
        return place, sim

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, similarities) for queries of unit length."""
        entry = None
        for nodes, links in reversed(self.levels[1:]):
            start = self._entry(nodes, len(nodes), len(q)) if entry is None else entry
            p, s = self._beam(q, nodes, links, 4, start, step=1)
            # the same nodes as places of the level below
            below = self.levels[[k for k, l in enumerate(self.levels) if l[0] is nodes][0] - 1][0]
            where = np.full(len(self.x) + 1, -1, np.int32)
            where[below] = np.arange(len(below))
            entry = np.where(p >= 0, where[nodes[np.maximum(p, 0)]], -1).astype(np.int32)
        nodes, links = self.levels[0]
        if entry is None:
            entry = self._entry(nodes, len(nodes), len(q))
        p, s = self._beam(q, nodes, links, ef, entry)
        return np.where(p >= 0, nodes[np.maximum(p, 0)], -1), s

    def nearest(self, q: np.ndarray, ef: int) -> np.ndarray:
        """Places of the nodes nearest to queries of unit length, as a beam of ``ef`` finds them, closest first; -1 where there are fewer."""
        out = []
        for a in range(0, len(q), BLOCK):
            p, s = self.search(q[a : a + BLOCK], ef)
            out.append(np.take_along_axis(p, np.argsort(-np.where(p < 0, -9.0, s), axis=1, kind="stable"), 1))
        return np.concatenate(out) if out else np.zeros((0, min(ef, len(self.x))), int)


def unit(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows scaled, their lengths, and the rows at unit length in single precision."""
    raw = scaled(raw.astype(np.float64))
    norm = np.sqrt((raw * raw).sum(1))
    return raw, norm, (raw / norm[:, None]).astype(np.float32)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def apart(x: np.ndarray, least: float) -> np.ndarray:
    """Places of rows of which none has a similarity of ``least`` with an earlier one that was taken."""
    taken: list[np.ndarray] = []
    for a in range(0, len(x), BLOCK):
        b = x[a : a + BLOCK]
        free = np.ones(len(b), bool)
        for t in taken:
            free &= ~(b @ x[t].T >= least).any(1)
        own = b @ b.T >= least
        for k in range(len(b)):
            if free[k]:
                free[k + 1 :] &= ~own[k, k + 1 :]
        taken.append(a + np.flatnonzero(free))
    return np.concatenate(taken) if taken else np.zeros(0, int)


def merged(up: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``up`` (each place's root, the smallest place of its set) after the sets of a and b became one, pair by pair."""
    while True:
        a, b = up[a], up[b]
        some = a != b
        if not some.any():
            return up
        a, b = a[some], b[some]
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (up[up] != up).any():
            up = up[up]


class Side:
    """Nodes of a unit: ids, vectors, how many rows each stands for, the cells it asks."""

    def __init__(self, ids: np.ndarray, raw: np.ndarray, mult: np.ndarray, asks: np.ndarray):
        self.ids, self.mult, self.asks = ids, mult, asks
        self.raw, self.norm, self.x = unit(raw)


def links_between(q: np.ndarray, own: tuple, x: np.ndarray, others: tuple, least: float):
    """Pairs of places with cosine >= least, block by block. own, others: (raw, norm) of the rows of q and x."""
    margin = max(1e-3, 1.2e-7 * x.shape[1])
    step = max(1, BLOCK_CELLS // max(1, len(x)))
    for lo in range(0, len(q), step):
        sims = q[lo : lo + step] @ x.T
        a, b = np.divmod(np.flatnonzero(sims.ravel() >= least - margin), len(x))
        s = sims[a, b]
        a = a + lo
        near = np.flatnonzero(s < least + margin)
        good = np.ones(len(a), bool)
        for k in range(0, len(near), 50_000):
            n = near[k : k + 50_000]
            i, j = a[n], b[n]
            good[n] = (own[0][i] * others[0][j]).sum(1) / (own[1][i] * others[1][j]) >= least
        yield a[good], b[good]


def answer(cell: int, stored: Side, asking: Side, least: float, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, id of a smaller place of its set, links) of the nodes of a unit that have any."""
    ids, place = np.unique(np.concatenate((stored.ids, asking.ids)), return_inverse=True)
    s, q = place[: len(stored.ids)], place[len(stored.ids) :]
    up, count = np.arange(len(ids)), np.zeros(len(ids), np.int64)
    home = asking.asks[:, 0]
    for a, b in links_between(asking.x, (asking.raw, asking.norm), stored.x, (stored.raw, stored.norm), least):
        other = q[a] != s[b]
        a, b = a[other], b[other]
        np.add.at(count, q[a], stored.mult[b])
        if not whole:  # the other one does not ask this one's cell
            for k in range(0, len(a), 1_000_000):
                i, j = a[k : k + 1_000_000], b[k : k + 1_000_000]
                far = ~(stored.asks[j] == home[i][:, None]).any(1)
                np.add.at(count, s[j[far]], asking.mult[i[far]])
        up = merged(up, q[a], s[b])
    some = np.flatnonzero(count)
    return ids[some], ids[up[some]], count[some]


def planted(x: np.ndarray, least: float) -> np.ndarray:
    """For each row another at cosine ``least`` from it, in a direction drawn from a fixed seed."""
    u = np.random.default_rng(5).standard_normal(x.shape)
    u -= (u * x).sum(1, keepdims=True) * x
    u /= np.maximum(np.sqrt((u * u).sum(1, keepdims=True)), 1e-30)
    y = least * x + math.sqrt(1 - least * least) * u
    return (y / np.sqrt((y * y).sum(1, keepdims=True))).astype(np.float32)


def rank(lists: np.ndarray, homes: np.ndarray) -> np.ndarray:
    """The place from 1 of each home in its list; one more than the width where it is not there."""
    hit = lists == homes[:, None]
    return np.where(hit.any(1), hit.argmax(1) + 1, lists.shape[1] + 1)


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", least: float = 0.9, cell_rows: int = 512, least_shards: int = 6, most_pivots: int = 65_536, pivot_bytes: int = 32_000_000, unit_rows: int = 32_768, ef: int = 32, target: float = 0.999, audits: int = 1024, report: dict | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    cell_rows, least_shards, most_pivots and pivot_bytes say how many upper nodes are drawn; ef is the
    beam, the most cells that a node asks unless it asks all; target and audits are the recall asked
    for and the number of nodes that it is measured on. ``report`` takes what the audits saw:
    queries, links, found, recall, and how many probes were taken (0: all cells) of how many cells.
    """
    spark = vectors.sparkSession
    sc = spark.sparkContext
    ship(spark)
    e = F.col("e")
    number = "float" if dict(vectors.dtypes)[embedding] == "array<float>" else "double"
    d = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(f"array<{number}>").alias("e"))
    good = F.coalesce((F.size(e) > 0) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0), F.lit(False))
    d = d.select("vec_id", F.when(good & F.col("vec_id").isNotNull(), e).alias("e"), F.xxhash64(F.lit(1), e).alias("h1"), F.xxhash64(F.lit(2), e).alias("h2"))
    keys = written(d.select("vec_id", "h1", "h2", F.when(e.isNotNull(), F.size(e)).alias("dim")))
    some = d.where("e is not null")
    size = keys.where("dim is not null").agg(F.count("*").alias("n"), F.max("dim").alias("dim")).first()
    n = size["n"]
    cells = max(least_shards, n / max(32, min(cell_rows, 2 * math.sqrt(n))))
    cells = min(cells, most_pivots, max(1, pivot_bytes // (4 * (size["dim"] or 1))))

    def drawn(seed: int, rows: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By length (tags, vectors) of about ``rows`` distinct vectors."""
        got = some.where(F.pmod(F.xxhash64(F.lit(seed), "h1", "h2"), F.lit(1 << 40)) < int(min(1.0, rows / max(1, n)) * (1 << 40)))
        got = got.groupBy("h1", "h2").agg(F.first("e").alias("e")).select("h1", "h2", "e", F.size("e").alias("dim")).toArrow().sort_by([("h1", "ascending"), ("h2", "ascending")])
        dims = got.column("dim").to_numpy()
        return {int(k): ((t := got.filter(pa.array(dims == k))).column("h1").to_numpy(), matrix(t.column("e").combine_chunks(), int(k))) for k in np.unique(dims)}

    graphs = {}
    for dim, (tags, raw) in drawn(5, cells).items():
        x = unit(raw)[2]
        order = np.argsort(mix(tags.astype(np.int64).view(np.uint64), 43), kind="stable")
        order = order[apart(x[order], least)]
        graphs[dim] = Graph(x[order], tags[order])
    sent = sc.broadcast(graphs)  # bounded by most_pivots and pivot_bytes

    def route(batches):
        for b in batches:
            dims = b.column("dim").to_numpy()
            asks = np.empty(len(dims), object)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                g = sent.value.get(int(dim))
                if g is None:  # few vectors of this length: one cell
                    lists = np.zeros((len(at), 1), int)
                else:
                    lists = g.nearest(unit(matrix(b.column("e").take(pa.array(at)), int(dim)))[2], ef)
                for k, row in zip(at, lists, strict=True):
                    asks[k] = row[row >= 0]
            lens = np.fromiter(map(len, asks), np.int32, len(asks))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lens)].astype(np.int32)), pa.array(np.concatenate(asks).astype(np.int32) if len(asks) else [], pa.int32()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("h1", "h2", "lowest", "mult", "e", "dim")), lists], names=["h1", "h2", "lowest", "mult", "e", "dim", "asks"])

    nodes = some.groupBy("h1", "h2").agg(F.min("vec_id").alias("lowest"), F.count("*").alias("mult"), F.min_by("e", "vec_id").alias("e")).withColumn("dim", F.size("e"))
    nodes = nodes.mapInArrow(route, f"h1 long, h2 long, lowest long, mult long, e array<{number}>, dim int, asks array<int>")
    # a number for each distinct vector; written once and read from there
    nodes = written(nodes.withColumn("id", F.monotonically_increasing_id()))
    probes, whole, seen = _probes(nodes, graphs, drawn(6, audits), least, ef, target)
    most = max([len(g.x) for g in graphs.values()], default=1)
    if report is not None:
        report.update(queries=seen[0], links=seen[1], found=seen[2], recall=seen[2] / seen[1] if seen[1] else None, probes=0 if whole else probes, cells=most)

    wide = {dim: len(g.x) for dim, g in graphs.items()}
    home = F.get("asks", F.lit(0))
    every = F.coalesce(F.create_map(*[F.lit(x) for kv in wide.items() for x in kv])[F.col("dim")], F.lit(1)) if wide else F.lit(1)
    asked = F.sequence(F.lit(0), every - 1) if whole else F.slice("asks", 1, probes)
    kept = F.slice("asks", 1, 1 if whole else probes)
    # units: the nodes of a cell in parts, each copied for the parts of those that ask
    loads = nodes.select("dim", home.alias("home"), F.explode(asked).alias("cell")).groupBy("dim", "cell").agg(F.count_if(F.col("home") == F.col("cell")).alias("m"), F.count("*").alias("q"))
    loads = cut(loads.where(F.greatest("m", "q") > unit_rows).select("dim", "cell", F.ceil(F.col("m") / unit_rows).cast("int").alias("ms"), F.ceil(F.col("q") / unit_rows).cast("int").alias("qs")))
    flat = nodes.select("dim", "id", "mult", "e", kept.alias("asks"), home.alias("home"), F.explode(asked).alias("cell")).join(F.broadcast(loads), ["dim", "cell"], "left")  # at most a row for each 32,768 asks
    one = F.lit(1)
    flat = flat.withColumns({"ms": F.greatest(F.coalesce("ms", one), one), "qs": F.coalesce("qs", one), "part": F.pmod(F.xxhash64(F.lit(6), "id"), F.lit(1 << 30)).cast("int")})
    lone = (F.col("ms") == 1) & (F.col("qs") == 1)
    pair = "struct<i:int,j:int,stored:boolean,asking:boolean>"
    row = lambda i, j, stored, asking: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), stored.alias("stored"), asking.alias("asking"))
    zero, yes, no = F.lit(0), F.lit(True), F.lit(False)
    at_home = F.col("home") == F.col("cell")
    as_asking = F.transform(F.sequence(zero, F.col("ms") - 1), lambda i: row(i, F.col("jq"), no, yes))
    as_stored = F.when(F.col("at_home"), F.transform(F.sequence(zero, F.col("qs") - 1), lambda j: row(F.col("is"), j, yes, no))).otherwise(F.array().cast(f"array<{pair}>"))
    flat = flat.withColumns({"at_home": at_home, "jq": F.col("part") % F.col("qs"), "is": F.col("part") % F.col("ms")})
    flat = flat.withColumn("u", F.explode(F.when(lone, F.array(row(zero, zero, F.col("at_home"), yes))).otherwise(F.concat(as_asking, as_stored))))
    total = n * (1 + (most if whole else probes)) * (80 + (4 if number == "float" else 8) * (size["dim"] or 1))
    tasks = max(2 * sc.defaultParallelism, math.ceil(total / 64_000_000))
    unit_key = ["dim", "cell", "i", "j"]
    rows = flat.select("dim", "cell", "u.*", "id", "mult", "asks", "e").repartition(tasks, *unit_key).sortWithinPartitions(*unit_key)

    def ask(batches):
        held: list[pa.RecordBatch] = []
        now = None

        def done():
            t = pa.Table.from_batches(held)
            held.clear()
            dim, cell = now[:2]

            def side(flag: str) -> Side:
                own = t.filter(t.column(flag)).combine_chunks()
                lists = own.column("asks").combine_chunks()
                width = max(lists.value_lengths().to_numpy(zero_copy_only=False), default=1)
                lens = lists.value_lengths().to_numpy(zero_copy_only=False)
                asks = np.full((len(lists), width), -1, np.int32)
                asks[np.arange(width)[None, :] < lens[:, None]] = lists.flatten().to_numpy()
                return Side(own.column("id").to_numpy(), matrix(own.column("e").combine_chunks(), dim), own.column("mult").to_numpy(), asks)

            stored = side("stored")
            if not len(stored.ids):
                return None
            a, b, c = answer(cell, stored, side("asking"), least, whole)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64())], names=["a", "b", "n"])

        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in unit_key], 1)
            edge = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(1), [True]))) if len(keys) else []
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                key = tuple(keys[lo].tolist())
                if key != now:
                    if held and (got := done()) is not None:
                        yield got
                    now = key
                held.append(batch.slice(int(lo), int(hi - lo)))
        if held and (got := done()) is not None:
            yield got

    found = written(rows.mapInArrow(ask, "a long, b long, n long"))
    sent.unpersist()
    comp = components(found.select("a", "b").where("a != b")).select(F.col("node").alias("id"), F.col("component_id").alias("root"))
    links = found.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    named = nodes.select("h1", "h2", "id", "mult", "lowest").join(links, "id", "left").join(comp, "id", "left").withColumn("root", F.coalesce("root", "id"))
    lowest = named.where("n is not null").groupBy("root").agg(F.min("lowest").alias("component_id"))
    named = written(named.join(lowest, "root", "left").select("h1", "h2", "mult", (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component_id", "lowest").alias("component_id")))
    lone = keys.where("dim is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    got = join_groups(keys.where("dim is not null").select("vec_id", "h1", "h2"), named, ["h1", "h2"], "mult").select("vec_id", "n_links", "component_id").unionByName(lone)
    return got.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _probes(nodes: DataFrame, graphs: dict[int, Graph], sample: dict[int, tuple[np.ndarray, np.ndarray]], least: float, ef: int, target: float) -> tuple[int, bool, list[int]]:
    """How many cells a node asks, whether it has to ask all, and what the audits saw: nodes, their links, those found."""
    queries = {}
    for dim, (_, raw) in sample.items():
        own = unit(raw)
        g = graphs.get(dim)
        queries[dim] = (*own, np.zeros((len(raw), 1), int) if g is None else g.nearest(own[2], ef))
    sent = nodes.sparkSession.sparkContext.broadcast(queries)  # bounded by audits

    def run(batches):
        counts: dict[tuple[int, int, int], int] = {}
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims):
                if int(dim) not in sent.value:
                    continue
                raw, norm, x, lists = sent.value[int(dim)]
                at = pa.array(np.flatnonzero(dims == dim))
                there = unit(matrix(b.column("e").take(at), int(dim)))
                theirs = b.column("asks").take(at).to_pylist()
                for i, j in links_between(x, (raw, norm), there[2], there[:2], least):
                    for k, l in zip(i.tolist(), j.tolist(), strict=True):
                        if (raw[k] == there[0][l]).all():
                            continue
                        mine = lists[k].tolist()
                        need = min(mine.index(h) + 1 if (h := theirs[l][0]) in mine else ef + 1, theirs[l].index(mine[0]) + 1 if mine[0] in theirs[l] else ef + 1)
                        counts[(int(dim), k, need)] = counts.get((int(dim), k, need), 0) + 1
        cols = list(zip(*counts, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in cols), pa.array(list(counts.values()), pa.int64())], names=["dim", "q", "need", "n"])

    got = nodes.select("dim", "e", "asks").mapInArrow(run, "dim int, q int, need int, n long").groupBy("dim", "q", "need").agg(F.sum("n").alias("n")).collect()
    sent.unpersist()
    table: dict[tuple[int, int], np.ndarray] = {}
    for r in got:
        table.setdefault((r["dim"], r["q"]), np.zeros(ef + 2, np.int64))[r["need"]] += r["n"]
    audited = sum(len(x[0]) for x in queries.values())
    seen = np.array(list(table.values())) if table else np.zeros((0, ef + 2), np.int64)
    links, found = int(seen.sum()), np.cumsum(seen.sum(0))
    if len(seen) >= SEEN or links and audited >= nodes.count():
        recall = np.minimum(found / links, (np.cumsum(seen, 1) / seen.sum(1)[:, None]).mean(0))
        enough = recall >= 1 - (1 - target) / 2
    else:
        needs = np.concatenate([np.zeros(0, int), *(np.minimum(rank(l, (y := g.nearest(planted(x, least), ef))[:, 0]), rank(y, l[:, 0])) for dim, (_, _, x, l) in queries.items() if (g := graphs.get(dim)) is not None and x.shape[1] > 1)])
        recall = np.cumsum(np.bincount(np.minimum(needs, ef + 1), minlength=ef + 2)) / max(1, len(needs)) if len(needs) else np.ones(ef + 2)
        enough = recall >= (PROBED if len(needs) else 0)
        if links:
            enough &= found == links
    at = [int(t) for t in np.flatnonzero(enough) if 1 <= t <= ef]
    if at:
        probes, whole = at[0], False
    else:
        probes, whole = ef, recall[ef] < LEAST_RECALL or max([len(g.x) for g in graphs.values()], default=1) <= FEW_CELLS
    return probes, whole, [audited, links, links if whole else int(found[probes])]
