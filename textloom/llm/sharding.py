"""Sharding by balanced label propagation, in DataFrame operations only.

Documents with equal texts are linked (each to its group, a hub, never to each other).
Linked documents start on shards dealt by hash. The linked rows of one group, one starting
shard and one of a few hash bins are a cell; cells move, round by round, to the shard with room where most
bytes of their group lie, as far as that shard's quota goes: the cells are joined with their
group's tallies of the shards, and askers are admitted in hash
order up to the room, by a histogram of their hashes, never by sorting a shard in one task.
Groups that full shards leave cut then move whole to shards with room.
A group larger than a shard thus fills one shard and spills into others. At last the free
documents, which cut no edge wherever they lie, fill the shards up to equal bytes: laid on a
line in hash order, the line is cut where each shard's remaining room ends.

All hashes are of a row's id, text and number among rows that repeat both, so that the
shards do not depend on how the input is split or ordered.

Law kept: ``bytes`` (shard sizes near equal, apart by about a document).

Defined results: a null text has 0 bytes and is a free document; equal texts are one group
whatever their ids, and so are equal empty texts; rows that repeat an id, or id and text, are
placed one by one; null ids are hashed as
null; very long texts are placed before shorter ones; an empty table gives an empty result;
tables smaller than the shard count leave some shards empty; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, join_groups

#: Hash bins of a shard's askers, of the free documents' line, and of a shard's slots. The
#: driver and broadcasts see at most shards * ASK_BINS, LINE_BINS and shards * SLOT_BINS sums.
ASK_BINS = 64
CELL_BINS = 16
LINE_BINS = 4096
SLOT_BINS = 64
#: A shard counts as open while it has this part of its capacity left.
OPEN = 0.01
#: Free documents above these parts of a shard's capacity (one over the number) are placed before smaller ones.
LARGE = (4, 16, 64)


def _bin(n: int, seed: int, *key: Column | str) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(n)).cast("int")


def _choose(of: Column, values: dict[int, float], default) -> Column:
    """A small lookup (one entry a shard) as an expression."""
    if not values:
        return F.lit(default)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in sorted(values.items()) for x in kv]), of), F.lit(default))


def _admitted(sums: list, room: dict[int, float]) -> tuple[dict[int, int], set[int]]:
    """sums: (to, q, n). The last bin of askers that each shard has room for, and the shards that turn some away."""
    last: dict[int, int] = {}
    filled: dict[int, float] = {}
    closed: set[int] = set()
    for x in sorted(sums, key=lambda x: (x["to"], x["q"])):
        if x["to"] not in closed and filled.get(x["to"], 0.0) + x["n"] <= room[x["to"]]:
            filled[x["to"]] = filled.get(x["to"], 0.0) + x["n"]
            last[x["to"]] = x["q"]
        else:
            closed.add(x["to"])
    return last, closed


def gather(cells: DataFrame, shards: int, capacity: float, rounds: int) -> DataFrame:
    """cells: g, s0, c, n, s. Groups that full shards left cut move whole, as bins of groups, to shards with room dealt by hash."""
    now = cells
    for r in range(rounds):
        now = cut(now)
        load = {x["s"]: float(x["n"]) for x in now.groupBy("s").agg(F.sum("n").alias("n")).collect()}
        room = {s: capacity - load.get(s, 0.0) for s in range(shards)}
        has_room = [s for s, x in room.items() if x > OPEN * capacity]
        if not has_room:
            break
        groups = now.groupBy("g").agg(F.sum("n").alias("all"), F.min("s").alias("lo"), F.max("s").alias("hi")).where(F.col("lo") < F.col("hi")).where(F.col("all") <= max(room.values()) / 2)
        to = F.get(F.array(*[F.lit(s) for s in has_room]), _bin(len(has_room), 200 + r, "g"))
        asked = cut(now.join(groups.select("g", to.alias("to"), _bin(ASK_BINS, 300 + r, "g").alias("q")), "g", "left"))
        sums = asked.where("to is not null and to != s").groupBy("to", "q").agg(F.sum("n").alias("n")).collect()
        if not sums:
            break
        last, _ = _admitted(sums, room)
        now = asked.select("g", "s0", "c", "n", F.when(F.col("q") <= _choose(F.col("to"), last, -1), F.col("to")).otherwise(F.col("s")).alias("s"))
    return now


def propagate(cells: DataFrame, shards: int, capacity: float, rounds: int) -> DataFrame:
    """cells: g, s0 (starting shard), c (bin), n (bytes). Returns (g, s0, c, s) with the shard after the last round.

    No shard is filled beyond its capacity by a move; one that had to turn askers away is full from then on.
    """
    now = cut(cells.select("g", "s0", "c", "n", F.col("s0").alias("s")))
    full: set[int] = set()
    load = {x["s"]: float(x["n"]) for x in now.groupBy("s").agg(F.sum("n").alias("n")).collect()}
    for r in range(rounds):
        room = {s: capacity - load.get(s, 0.0) for s in range(shards)}
        has_room = [s for s, x in room.items() if x > OPEN * capacity and s not in full]
        # a group has at most shards * shards * CELL_BINS cells, and a tally for each shard
        vote = F.struct("m", F.xxhash64("g", "s").alias("tie"), F.col("s").alias("to"))
        tally = now.groupBy("g", "s").agg(F.sum("n").alias("m")).select("g", "s", vote.alias("vote"))
        group = tally.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("s", "vote"))).alias("votes"), F.max(F.when(F.col("s").isin(has_room), F.col("vote"))).alias("top"))
        asked = now.join(group, "g").withColumn("own", F.element_at("votes", F.col("s")))
        asks = F.coalesce((F.col("top.to") != F.col("s")) & (F.col("top") > F.col("own")), F.lit(False))
        asked = cut(asked.select("g", "s0", "c", "n", "s", F.when(asks, F.col("top.to")).alias("to"), F.when(asks, _bin(ASK_BINS, 100 + r, "g", "s0", "c")).alias("q")))
        sums = asked.where("to is not null").groupBy("to", "q").agg(F.sum("n").alias("n")).collect()
        if not sums:
            return now.select("g", "s0", "c", "s")
        last, closed = _admitted(sums, room)
        moves = F.col("q") <= _choose(F.col("to"), last, -1)
        full |= closed
        now = asked.select("g", "s0", "c", "n", F.when(moves, F.col("to")).otherwise(F.col("s")).alias("s"))
        load = {x["s"]: float(x["n"]) for x in now.groupBy("s").agg(F.sum("n").alias("n")).collect()}
    return now.select("g", "s0", "c", "s")


def _line(df: DataFrame, size: str, *key: str) -> DataFrame:
    """``df`` with ``at``: the bytes before the row in the order of (hash bin, key), over all rows.

    Two levels: sums of the bins, cumulated in one small table, and sums inside a bin.
    """
    got = df.withColumn("bin", _bin(LINE_BINS, 3, *key))
    tops = got.groupBy("bin").agg(F.sum(size).alias("whole"))
    before = tops.select("bin", (F.sum("whole").over(W.orderBy("bin")) - F.col("whole")).alias("before"))
    own = W.partitionBy("bin").orderBy(*key).rowsBetween(W.unboundedPreceding, W.currentRow)
    return got.join(F.broadcast(before), "bin").withColumn("at", F.col("before") + F.sum(size).over(own) - F.col(size)).drop("bin", "before")


def _fill(free: DataFrame, shards: int, capacity: float, load: dict[int, float], total: float | None) -> DataFrame:
    """Free rows with their shard: the line of their bytes is cut in proportion to the shards' rooms.

    total: bytes of ``free``; None if they fill all room there is.
    """
    room = [max(0.0, capacity - load.get(s, 0.0)) for s in range(shards)]
    scale = 1.0 if total is None or not sum(room) else total / sum(room)
    ends, end = [], 0.0
    for s in range(shards):
        end += room[s] * scale
        ends.append((end, s))
    cuts = F.array(*[F.struct(F.lit(e).alias("e"), F.lit(s).alias("s")) for e, s in ends])
    middle = F.col("at") + F.col("size") / 2
    spot = F.coalesce(F.get(F.filter(cuts, lambda c: c["e"] > middle), F.lit(0))["s"], F.lit(max(range(shards), key=room.__getitem__)))
    return _line(free, "size", "doc_id", "text_crc32", "g", "u").select("doc_id", "u", "size", "text_crc32", "g", "group_rows", spot.alias("shard"))


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with u: from 0, the number among rows with one id and text. Which of them has which number is no matter.

    Only rows that are repeated are numbered, by sums over the partitions they lie in and
    ranks inside a partition: a row repeated in every partition is not gathered in a task.
    """
    rows = cut(rows.withColumn("k", F.xxhash64("doc_id", "g")).withColumn("part", F.spark_partition_id()))
    counts = rows.groupBy("k", "part").agg(F.count("*").alias("c"))
    many = cut(counts.join(counts.groupBy("k").agg(F.sum("c").alias("all")).where("all > 1").drop("all"), "k"))
    if not many.limit(1).count():
        return rows.select("doc_id", "size", "text_crc32", "g", F.lit(0).cast("long").alias("u"))
    before = many.withColumn("before", F.sum("c").over(W.partitionBy("k").orderBy("part")) - F.col("c")).select("k", "part", "before")
    got = rows.join(before, ["k", "part"], "left")
    rank = F.row_number().over(W.partitionBy("k", "part").orderBy("doc_id"))
    again = got.where("before is not null").withColumn("u", F.col("before") + rank - 1)
    return got.where("before is null").withColumn("u", F.lit(0).cast("long")).unionByName(again).select("doc_id", "size", "text_crc32", "g", "u")


def _grouped(rows: DataFrame) -> DataFrame:
    """``rows`` with group_rows: how many rows share the text, null for one alone."""
    hubs = cut(rows.where("g is not null").groupBy("g").agg(F.count("*").alias("group_rows")).where("group_rows > 1"))
    return join_groups(rows, hubs, ["g"], "group_rows")


def shard_documents(docs: DataFrame, shards: int = 40, doc_id: str = "doc_id", text: str = "text", rounds: int = 6) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, group_rows) for every row of ``docs``."""
    raw = F.col(text)
    rows = cut(_numbered(docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(raw), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(raw, F.lit("")).cast("binary")).alias("text_crc32"),
        F.when(raw.isNotNull(), F.md5(raw.cast("binary"))).alias("g"),
    )))
    rows = cut(_grouped(rows).withColumn("s0", F.when(F.col("group_rows").isNotNull(), _bin(shards, 1, "doc_id", "g", "u"))).withColumn("c", _bin(CELL_BINS, 2, "doc_id", "g", "u")))
    free = F.col("s0").isNull()
    sums = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("all"), F.max(F.when(free, F.col("size"))).alias("most")).first()
    total = sums["all"]
    capacity = total / shards
    linked = rows.where("s0 is not null")
    cells = cut(linked.groupBy("g", "s0", "c").agg(F.sum("size").alias("n")))
    moved = gather(cells.join(propagate(cells, shards, capacity, rounds), ["g", "s0", "c"]), shards, capacity, rounds)
    placed = linked.join(moved.select("g", "s0", "c", "s"), ["g", "s0", "c"])
    placed = cut(placed.select("doc_id", "u", "size", "text_crc32", "g", "group_rows", F.col("s").alias("shard")))
    load = {x["shard"]: float(x["n"]) for x in placed.groupBy("shard").agg(F.sum("size").alias("n")).collect()}
    # large free documents first, so that the small ones can level what these leave uneven
    limits = [capacity / k for k in LARGE if (sums["most"] or 0) > capacity / k]
    rest = rows.where(free)
    for hi, lo in zip([None, *limits], [*limits, None], strict=True):
        own = rest.where(F.lit(True) if lo is None else F.col("size") > lo).where(F.lit(True) if hi is None else F.col("size") <= hi)
        spread = _fill(own, shards, capacity, load, None if lo is None else own.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
        if lo is not None:
            spread = cut(spread)
            for x in spread.groupBy("shard").agg(F.sum("size").alias("n")).collect():
                load[x["shard"]] = load.get(x["shard"], 0.0) + x["n"]
        placed = placed.unionByName(spread)
    got = slots(cut(placed))
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.coalesce("group_rows", F.lit(1)).cast("long").alias("group_rows"))


def slots(df: DataFrame) -> DataFrame:
    """Numbers the rows of each shard from 0 without gaps: offsets of hash bins, then ranks inside a bin."""
    got = df.withColumn("bin", _bin(SLOT_BINS, 9, "doc_id", "g", "u"))
    n = got.groupBy("shard", "bin").agg(F.count("*").alias("c"))
    off = n.select("shard", "bin", (F.sum("c").over(W.partitionBy("shard").orderBy("bin")) - F.col("c")).alias("off"))
    rank = F.row_number().over(W.partitionBy("shard", "bin").orderBy("doc_id", "text_crc32", "g", "u"))
    return got.withColumn("r", rank).join(F.broadcast(off), ["shard", "bin"]).withColumn("slot", (F.col("off") + F.col("r") - 1).cast("long"))
