"""Balanced label propagation over equal texts.

Documents of equal text are linked. All documents are dealt evenly over the shards, then the
linked ones move in rounds towards the shard that most of their neighbours are on. A round grants as
many moves from shard to shard as leave no shard above its capacity: swaps and longer cycles between
full shards, and moves into the free seats. Ties go by hash, another one each round, and a shard that
could not take all moves towards it is passed over by as large a share of the texts in the next round.
Rounds go on until two in a row gather nothing. Documents without links fill the seats that remain, so
the numbers of documents per shard differ by one at most at all times.

The unit that moves is the cell (text, shard, number of documents): documents of one text on one
shard are interchangeable, so no pair of documents is ever formed and a text that holds a third
of all rows is 16 cells. The moves wished from each shard to each other are summed by hash bucket and
granted bucket by bucket until the quota is spent; the bucket on the edge is granted cell by cell. What
is broadcast or sent to the driver in a round is bounded by shards x shards rows.

Defined cases: a null text counts as empty (size 1). Rows may repeat; each gets a seat of its
own. A null doc_id is a value like any other. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import saved

SHARDS = 16
SPREAD = 64
BUCKETS, BUCKET_ROWS = 1024, 1_000_000


def _pick(values: list[int], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), (index + 1).cast("int"))


def _cells(base: DataFrame, shards: int) -> DataFrame:
    """(k1, k2, shard, n) of the texts with more than one document, as first dealt."""
    counts = base.groupBy("b").agg(F.count(F.lit(1)).alias("c"))
    offsets = counts.select("b", (F.sum("c").over(Window.orderBy("b")) - F.col("c")).alias("off"))
    dealt = base.join(F.broadcast(offsets), "b").withColumn("shard", F.pmod(F.col("off") + F.col("rn") - 1, F.lit(shards)).cast("int"))
    cells = dealt.groupBy("k1", "k2", "shard").agg(F.count(F.lit(1)).alias("n"))
    return cells.withColumn("total", F.sum("n").over(Window.partitionBy("k1", "k2"))).where("total > 1").drop("total")


def _quotas(demand: list[list[int]], room: list[int]) -> list[list[int]]:
    """How much of the demand from shard to shard is granted: swaps, then longer cycles and ways into
    free room, until none is left. No shard gains more than it gives and has room for."""
    shards = len(room)
    left, room, grant = [list(row) for row in demand], list(room), [[0] * shards for _ in demand]

    def push(path: list[int], m: int) -> None:
        for a, b in zip(path, path[1:], strict=False):
            left[a][b] -= m
            grant[a][b] += m

    def way(start: int) -> list[int] | None:
        """A shortest way back to start or into a shard with room."""
        back: dict[int, int | None] = {start: None}
        queue = [start]
        for s in queue:
            for t in range(shards):
                if left[s][t] and (t == start or (t not in back and room[t] > 0)):
                    path, up = [t], s
                    while up is not None:
                        path.append(up)
                        up = back[up]
                    return path[::-1]
                if left[s][t] and t not in back:
                    back[t] = s
                    queue.append(t)
        return None

    for a in range(shards):
        for b in range(a):
            push([a, b, a], min(left[a][b], left[b][a]))
    for start in range(shards):
        while path := way(start):
            m, end = min(left[a][b] for a, b in zip(path, path[1:], strict=False)), path[-1]
            if end != start:
                m = min(m, room[end])
                room[end] -= m
                room[start] += m
            push(path, m)
    return grant


def _wishes(cells: DataFrame, passed: list[float], turn: int, buckets: int, capacity: int) -> DataFrame:
    """The cells (k1, k2, shard, n) that are not yet on the target of their text, with it and a hash bucket."""
    permille = F.pmod(F.xxhash64("k1", "shard", F.lit(turn)), F.lit(1000))
    is_open = (permille >= _pick([round(1000 * x) for x in passed], F.col("shard"))).cast("int")
    near = Window.partitionBy("k1", "k2").orderBy(is_open.desc(), F.col("n").desc(), F.xxhash64("shard", "k1", F.lit(turn)))
    aim = cells.select("*", F.first("shard").over(near).alias("target"), F.first("n").over(near).alias("there"))
    # A pile of half a shard or more does not move to a smaller one; small ones do, to be swapped.
    aim = aim.where((F.col("shard") != F.col("target")) & ((F.col("n") <= F.col("there")) | (2 * F.col("n") < F.lit(capacity)))).drop("there")
    return aim.withColumn("pb", F.pmod(F.xxhash64("k1", "k2", F.lit(turn)), F.lit(buckets)).cast("int"))


def _granted(wish: DataFrame, quotas: list[list[int]]) -> DataFrame:
    """The moves (k1, k2, shard, target, m) of the wishes within the quotas."""
    quota = _pick([q for row in quotas for q in row], F.col("shard") * len(quotas) + F.col("target"))
    demand = wish.groupBy("shard", "target", "pb").agg(F.sum("n").alias("d"))
    demand = demand.withColumn("upto", F.sum("d").over(Window.partitionBy("shard", "target").orderBy("pb")))
    edge = demand.where(F.col("upto") > quota).groupBy("shard", "target").agg(F.min(F.struct("pb", (quota - F.col("upto") + F.col("d")).alias("left"))).alias("edge"))
    line = F.sum("n").over(Window.partitionBy("shard", "target", "pb").orderBy("k1", "k2")) - F.col("n")
    wish = wish.withColumn("before", line).join(F.broadcast(edge), ["shard", "target"], "left")
    m = F.when(F.col("edge").isNull() | (F.col("pb") < F.col("edge.pb")), F.col("n")).when(F.col("pb") == F.col("edge.pb"), F.least(F.col("n"), F.col("edge.left") - F.col("before")))
    return wish.select("k1", "k2", "shard", "target", m.alias("m")).where("m > 0")


def propagate(base: DataFrame, capacity: list[int], rounds: int | None, buckets: int) -> DataFrame:
    """Cells after label propagation; no shard holds more linked documents than its capacity."""
    shards = len(capacity)
    cells = saved(_cells(base, shards), "cells")
    passed, best, idle, turn = [0.0] * shards, 0, 0, 0
    while idle < 2 and (rounds is None or turn < rounds):
        found = {r["shard"]: r for r in cells.groupBy("shard").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("gathered")).collect()}
        gathered = sum(r["gathered"] for r in found.values())
        idle = 0 if gathered > best else idle + 1
        best = max(best, gathered)
        room = [c - (found[s]["n"] if s in found else 0) for s, c in enumerate(capacity)]
        wish = saved(_wishes(cells, passed, turn, buckets, min(capacity)), "wishes")
        demand = [[0] * shards for _ in range(shards)]
        for r in wish.groupBy("shard", "target").agg(F.sum("n").alias("n")).collect():
            demand[r["shard"]][r["target"]] = r["n"]
        if not any(map(any, demand)) and not any(passed):
            break
        quotas = _quotas(demand, room)
        asked, given = ([sum(row[t] for row in m) for t in range(shards)] for m in (demand, quotas))
        passed = [1 - g / a if a else 0.0 for a, g in zip(asked, given, strict=True)]
        turn += 1
        if not any(given):
            continue
        moves = saved(_granted(wish, quotas), "moves")
        out = moves.select("k1", "k2", "shard", (-F.col("m")).alias("n"))
        into = moves.select("k1", "k2", F.col("target").alias("shard"), F.col("m").alias("n"))
        merged = cells.unionByName(out).unionByName(into).groupBy("k1", "k2", "shard").agg(F.sum("n").alias("n"))
        cells = saved(merged.where("n > 0"), "cells")
    return cells


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int | None = None, buckets: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; law `rows`: counts at most one apart."""
    total = docs.count()
    buckets = buckets or max(BUCKETS, total // BUCKET_ROWS)
    text = F.coalesce(F.col("text"), F.lit(""))
    turn = F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD))  # rows that repeat doc_id and text lie in many buckets
    base = docs.select(
        F.col("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("k1"),
        F.xxhash64(F.lit(1), text).alias("k2"),
    ).withColumn("b", F.pmod(F.xxhash64("doc_id", "k1", turn), F.lit(buckets)).cast("int"))
    base = saved(base.withColumn("rn", F.row_number().over(Window.partitionBy("b").orderBy("doc_id", "k1", "k2"))), "base")
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    cells = propagate(base, capacity, rounds, buckets)

    # Places of each text: its cells laid end to end; a document of rank q has the cell that holds q.
    upto = F.sum("n").over(Window.partitionBy("k1", "k2").orderBy("shard"))
    places = cells.withColumn("upto", upto).groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("upto", "shard"))).alias("places"))
    parts = base.groupBy("k1", "k2", "b").agg(F.count(F.lit(1)).alias("c"))
    parts = parts.withColumn("before", F.sum("c").over(Window.partitionBy("k1", "k2").orderBy("b")) - F.col("c"))
    parts = parts.join(places, ["k1", "k2"]).select("k1", "k2", "b", "before", "places")
    ranked = base.drop("rn").join(parts, ["k1", "k2", "b"], "left")
    ranked = ranked.withColumn("q", F.col("before") + F.row_number().over(Window.partitionBy("k1", "k2", "b").orderBy("doc_id")) - 1)
    placed = ranked.withColumn("place", F.when(F.col("places").isNull(), F.lit(-1)).otherwise(F.expr("get(filter(places, x -> x.upto > q), 0).shard")))
    placed = placed.withColumn("rn", F.row_number().over(Window.partitionBy("b", "place").orderBy("doc_id", "k1", "k2")))
    placed = saved(placed.select("doc_id", "size", "text_crc32", "b", "place", "rn"), "placed")

    counts = placed.groupBy("b", "place").agg(F.count(F.lit(1)).alias("c"))
    offsets = counts.select("b", "place", (F.sum("c").over(Window.partitionBy("place").orderBy("b")) - F.col("c")).alias("off"))
    linked = {r["place"]: r["n"] for r in placed.groupBy("place").agg(F.count(F.lit(1)).alias("n")).collect()}
    linked = [linked.get(s, 0) for s in range(shards)]
    ends, end = [], 0
    for s in range(shards):
        end += capacity[s] - linked[s]
        ends.append(end)
    rank = F.col("off") + F.col("rn") - 1
    seat = reduce(lambda rest, s: F.when(rank < ends[s], F.lit(s)).otherwise(rest), reversed(range(shards)), F.lit(None).cast("int"))
    out = placed.join(F.broadcast(offsets), ["b", "place"]).withColumn("rank", rank)
    out = out.withColumn("shard", F.when(F.col("place") >= 0, F.col("place")).otherwise(seat).cast("int"))
    first = [ends[s] - (capacity[s] - linked[s]) for s in range(shards)]
    slot = F.when(F.col("place") >= 0, F.col("rank")).otherwise(F.col("rank") - _pick(first, F.col("shard")) + _pick(linked, F.col("shard")))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
